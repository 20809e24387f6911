"""64-bit hashes of all words of many texts at once, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once.
PART = 1 << 18
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_P = 0xD6E8FEB86659FD93
_P_INVERSE = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(2)
def _table(inverse: bool, size: int) -> np.ndarray:
    return _powers(_P_INVERSE if inverse else _P, size)


def powers(n: int) -> np.ndarray:
    """At least n powers of an odd number modulo 2**64."""
    return _table(False, 1 << max(18, (n - 1).bit_length()))


def inverse_powers(n: int) -> np.ndarray:
    return _table(True, 1 << max(18, (n - 1).bit_length()))


def words_of(col: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a string column: hashes of the words of all texts in order, their text's number, and each text's first word.

    Words are runs of bytes other than the six ASCII blanks; lower: A-Z count as a-z. Nulls have no words. Bytes are read
    PART at a time, cut between words, so that the memory beyond the results doesn't grow with the texts.
    """
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    size = np.diff(offsets)
    if col.null_count:
        size = np.where(np.asarray(col.is_valid()), size, 0)
    n = int(offsets[-1] - offsets[0])
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
    at = offsets[:-1] - offsets[0]
    begins, hashes, here = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while here < n:
        stop = min(n, here + PART)
        while stop < n and not _BLANK[data[stop]]:  # to the next blank or the next text
            far = data[stop : stop + PART]
            gap, nxt = np.flatnonzero(_BLANK[far]), int(np.searchsorted(at, stop))
            ends = [stop + int(gap[0])] if len(gap) else [stop + len(far)]
            if nxt < len(at):
                ends.append(int(at[nxt]))
            if min(ends) == stop:
                break
            stop = min(ends)
        part = data[here:stop]
        if lower:
            part = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part)
        m = len(part)
        edge = np.zeros(m + 1, bool)  # where a text begins
        edge[at[np.searchsorted(at, here) : np.searchsorted(at, stop, side="right")] - here] = True
        blank = _BLANK[part]
        word = ~blank
        b = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], blank[:-1]))))
        e = np.flatnonzero(word & (edge[1:] | np.concatenate((blank[1:], [True])))) + 1
        # A word's hash is a polynomial in its bytes: a difference of prefix sums, moved to the same power.
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(m + 1)[:m], dtype=np.uint64)))
        hashes.append(mix((total[e] - total[b]) * inverse_powers(m + 1)[b]))
        begins.append(b + here)
        here = stop
    begins, hashes = np.concatenate(begins), np.concatenate(hashes)
    doc = np.searchsorted(at, begins, side="right") - 1
    # Empty texts share their start with the next one: searchsorted gives the last, which has the word.
    return hashes, doc, np.searchsorted(doc, np.arange(len(col)))
