"""Byte-level BPE encoding by overlapping chunks, and decoding to raw bytes.

A text is cut into chunks that overlap. Each chunk is pre-tokenised alone, as if its start were a boundary. A match
of the pattern depends only on where it starts and on what follows, so once two neighbouring chunks have a boundary
at the same place, all later boundaries agree: there the pieces are stitched. Where no boundary of the overlap agrees,
the left chunk is read on until one does. The stitched pieces are those of the whole text; each is then encoded.

The chunks of one text are handled in its row, one slice of rows at a time. Texts over LONG characters are exploded to
rows of overlapping parts that any task pre-tokenises; two neighbours meet to find where they agree, each part then
encodes its own stretch, and the ids are put together by document. Without a place where they agree, the text is encoded
in its row.

Pieces are merged by rank, the pair of least rank first and the leftmost of equal ones, for many different pieces at
once. Decoding looks up the bytes of all ids and cuts them by document.

Defined results: a null text counts as empty and gives no ids; decoding null ids gives empty bytes. Bytes that aren't
UTF-8 count as U+FFFD. An empty table gives no rows. Rows are handled one by one, so ties and repeated rows change
nothing; other columns are kept, whatever their names; a column of the output's name is replaced.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import Scratch, fresh
from quire.llm.frames import released, replace_column, slices, texts

#: Characters of a chunk, and of the overlap that the next chunk repeats.
CHUNK, OVERLAP = 2048, 128
#: Texts over LONG characters are exploded to parts of PART characters, which repeat LAP characters of the next.
LONG, PART, LAP = 1 << 16, 1 << 15, 1 << 10
#: Bytes of text in a slice.
SLICE = 1 << 20
#: Pieces whose ids are remembered by a worker, their ids, and the longest piece remembered.
REMEMBERED, REMEMBERED_IDS, REMEMBERED_LEN = 1 << 17, 1 << 22, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """The id that two neighbouring ids merge to: a hash table in arrays. NONE: they don't."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    found[a << 32 | b] = rank
        self.bits = max(8, (4 * len(found)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, self.NONE, np.int32)
        keys, values = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int32, len(found))
        at = self._slot(keys)
        while len(keys):  # the first of a slot takes it; the others go on to the next
            free = self.keys[at] < 0
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            take = free & first
            self.keys[at[take]], self.values[at[take]] = keys[take], values[take]
            keys, values, at = keys[~take], values[~take], (at[~take] + 1) & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 32 | b).ravel()
        at = self._slot(keys)
        out, open_ = self.values[at], np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        out[self.keys[at] != keys] = self.NONE
        while len(open_):
            at[open_] = (at[open_] + 1) & (1 << self.bits) - 1
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out.reshape(a.shape)


class Coder:
    def __init__(self, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern)
        self.merge = Merges(self.ranks)
        self.chunk, self.overlap = chunk, overlap
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        size = 1 + max(self.ranks.values(), default=0)
        by_id = [b""] * size
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.bytes_of = pa.array(by_id, pa.large_binary())
        self._forget()

    def part(self, text: str, at: int, end: int) -> tuple[list[str], list[int]]:
        """The matches from a start and their ends, of those that end before `end` (all, where that is the text's end)."""
        found = self.split.findall(text, at, end)
        ends = list(accumulate(map(len, found), initial=at))[1:]
        # A match that touches a cut, and white space just before one, may differ in the whole text.
        while end < len(text) and ends and (ends[-1] == end or text[ends[-1] : end].isspace()):
            found.pop(), ends.pop()
        return found, ends

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern over the whole text, found chunk by chunk."""
        n = len(text)
        if n <= self.chunk:
            return self.split.findall(text)
        starts = range(0, n, self.chunk)
        parts = [self.part(text, s, min(n, s + self.chunk + self.overlap)) for s in starts]
        out, ends = parts[0]
        for s, (more, to) in zip(starts[1:], parts[1:], strict=True):
            begins = [s, *to]
            last = ends[-1] if ends else 0
            places = set(begins[: bisect_right(begins, last)])
            k = next((k for k in range(bisect_left(ends, s), len(ends)) if ends[k] in places), None)
            if k is None:  # read on from the last sure boundary, match by match
                places = set(begins)
                for m in self.split.finditer(text, last):
                    out.append(m[0]), ends.append(m.end())
                    if m.end() in places:
                        break
                k = len(ends) - 1
                if ends[k] not in places:  # to the end of the text
                    continue
            j = bisect_left(begins, ends[k])
            out[k + 1 :], ends[k + 1 :] = more[j:], to[j:]
        for m in self.split.finditer(text, ends[-1] if ends else 0):
            out.append(m[0])
        return out

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, pieces: list[str]) -> None:
        """The ids of new pieces, put to those known."""
        data = [p.encode() for p in pieces]
        ids: list[np.ndarray | None] = [None] * len(data)
        by_size: dict[int, list[int]] = {}
        for i, b in enumerate(data):
            rank = self.ranks.get(b)
            if rank is not None or not b:
                ids[i] = np.array([rank] if b else [], np.int32)
            elif len(b) > REMEMBERED_LEN:
                ids[i] = self._one(b)
            else:
                by_size.setdefault(len(b), []).append(i)
        for size, some in by_size.items():
            rows = np.frombuffer(b"".join(data[i] for i in some), np.uint8).reshape(-1, size)
            for i, found in self._many(rows):
                ids[some[i]] = found
        count = np.array([len(x) for x in ids], np.int64)
        for i, p in enumerate(pieces, len(self.start)):
            self.known[p] = i
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.ids = np.concatenate((self.ids, *ids))

    def _many(self, rows: np.ndarray):
        """(number, ids) of pieces of the same number of bytes; in each step, each piece merges one pair."""
        of, now = np.arange(len(rows)), self.byte[rows]
        to = self.merge(now[:, :-1], now[:, 1:])
        while len(of):
            at = to.argmin(axis=1) if to.shape[1] else np.zeros(len(of), np.int64)  # the leftmost of the least
            least = to[np.arange(len(of)), at] if to.shape[1] else np.full(len(of), Merges.NONE)
            more = least < Merges.NONE
            for i in np.flatnonzero(~more).tolist():
                yield int(of[i]), now[i].copy()
            of, now, to, at, least = of[more], now[more], to[more], at[more], least[more]
            if not len(of):
                return
            here, width = np.arange(len(of)), now.shape[1]
            now[here, at] = least
            now = now[np.arange(width) != at[:, None] + 1].reshape(len(of), width - 1)
            # The pair that was merged goes; the pairs on both sides of it are new.
            to = to[np.arange(width - 1) != at[:, None]].reshape(len(of), width - 2)
            for side in (at - 1, at):
                use = (side >= 0) & (side < width - 2)
                r, c = here[use], side[use]
                to[r, c] = self.merge(now[r, c], now[r, c + 1])

    def _one(self, data: bytes) -> np.ndarray:
        """The ids of one long piece, with its pairs in a heap."""
        ids = self.byte[np.frombuffer(data, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.merge(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r != Merges.NONE]
        heapq.heapify(heap)
        tokens, by_id = self.ranks, self.bytes_of

        def pair(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n:
                r = tokens.get(by_id[ids[i]].as_py() + by_id[ids[j]].as_py())
                if r is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:  # one of the two has been merged since
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            pair(i)
            if before[i] >= 0:
                pair(before[i])
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_all(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and how many each has."""
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        different, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        new = [p for p in different if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            self._forget()
            new = different
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, different), np.int64, len(different))
        for p in new:
            if len(p) > REMEMBERED_LEN:
                del self.known[p]
        start, count = self.start[at][of], self.count[at][of]
        ends = np.cumsum(count)
        return self.ids[np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)], count

    def encode_texts(self, texts_: list[str | None]) -> pa.ListArray:
        pieces, sizes = [], [0]
        for t in texts_:
            pieces += self.pieces(t or "")
            sizes.append(len(pieces))
        ids, count = self.encode_all(pieces)
        ends = np.concatenate(([0], np.cumsum(count)))[sizes]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))

    def encode(self, text: str | None) -> list[int]:
        return self.encode_texts([text])[0].as_py()

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The raw bytes of each list of ids one after the other; they need not be valid UTF-8."""
        sizes = ids.value_lengths().fill_null(0).to_numpy()
        found = self.bytes_of.take(ids.flatten())
        offsets = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1] if len(found) else np.zeros(1, np.int64)
        ends = offsets[np.concatenate(([0], np.cumsum(sizes)))]
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), found.buffers()[2]]).cast(pa.binary())

    def decode(self, ids) -> bytes:
        return self.decode_all(pa.array([list(ids)], pa.list_(pa.int32())))[0].as_py()


@lru_cache(2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def _encode(df: DataFrame, vocabulary: str, pattern: str, text: str, out: str) -> DataFrame:
    """Rows whose texts are encoded in the row."""

    def run(batches):
        c = coder(vocabulary, pattern)
        for b in batches:
            for s in slices(b, text, SLICE):
                yield replace_column(s, out, c.encode_texts(texts(s.column(text))))

    kept = [f for f in df.schema.fields if f.name != out]
    return df.mapInArrow(lambda b: released(run(b)), T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType(), True))]))


def _parts(long: DataFrame, vocabulary: str, pattern: str, size: int, lap: int, s: Scratch) -> DataFrame:
    """rid and ids of the texts (rid, text) whose parts agree in all overlaps."""
    n = F.length("text")
    at = F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))
    parts = long.select("rid", "text", n.alias("n"), F.explode(at).alias("no"))
    parts = parts.select("rid", "no", (F.col("no") * size).alias("begin"), "n", F.substring("text", F.col("no") * size + 1, F.lit(size + lap)).alias("text"))

    def bounds(batches):
        c = coder(vocabulary, pattern)
        for b in batches:
            head, tail = [], []
            for t, begin, n in zip(texts(b.column("text")), b.column("begin").to_pylist(), b.column("n").to_pylist(), strict=True):
                # As the text goes on after the part, what touches its end isn't sure.
                ends = c.part(t + " x", 0, len(t))[1] if begin + len(t) < n else c.part(t, 0, len(t))[1]
                head.append([begin, *(begin + e for e in ends if e <= lap)])
                tail.append([begin + e for e in ends if e >= size])
            yield replace_column(replace_column(b, "head", pa.array(head, pa.list_(pa.int32()))), "tail", pa.array(tail, pa.list_(pa.int32())))

    found = s.write(parts.repartition("rid", "no").mapInArrow(lambda b: released(bounds(b)), "rid long, no int, begin int, n int, text string, head array<int>, tail array<int>"), "parts")
    ends = found.select("rid", "no", "tail", "begin", "n").join(found.select("rid", (F.col("no") - 1).alias("no"), F.col("head").alias("next")), ["rid", "no"], "left")
    # The first place where a part and the next one agree; the last part ends with the text.
    stop = F.when(F.col("begin") + size >= F.col("n"), F.col("n")).otherwise(F.array_min(F.array_intersect("tail", F.coalesce("next", F.array().cast("array<int>")))))
    ends = s.write(ends.select("rid", "no", stop.alias("stop")), "ends")
    lost = ends.where("stop is null").select("rid").distinct()
    own = found.select("rid", "no", "begin", "text").join(ends, ["rid", "no"]).join(ends.select("rid", (F.col("no") + 1).alias("no"), F.col("stop").alias("start")), ["rid", "no"], "left")
    own = own.join(lost, "rid", "left_anti")

    def encode(batches):
        c = coder(vocabulary, pattern)
        for b in batches:
            for part in slices(b, "text", SLICE):
                rows = zip(texts(part.column("text")), *(part.column(x).to_pylist() for x in ("begin", "start", "stop")), strict=True)
                ids = []
                for t, begin, start, stop in rows:
                    at, pieces = (start or 0) - begin, []
                    for m in c.split.finditer(t, at) if at < stop - begin else ():
                        pieces.append(m[0])
                        if m.end() >= stop - begin:
                            break
                    ids.append(c.encode_all(pieces)[0])
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("no"), pa.array(ids, pa.list_(pa.int32()))], names=["rid", "no", "ids"])

    coded = own.mapInArrow(lambda b: released(encode(b)), "rid long, no int, ids array<int>")
    return coded.groupBy("rid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x.ids)).alias("ids"))


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids", scratch: Scratch | None = None, long: int = LONG, part: int = PART, lap: int = LAP) -> DataFrame:
    """All columns, and the token ids of the text as an array of int. vocabulary: a rank file that every host has."""
    is_long = F.coalesce(F.length(text) > long, F.lit(False))
    if df.where(is_long).isEmpty():
        return _encode(df, vocabulary, pattern, text, out)
    s = scratch or Scratch(df.sparkSession)
    rid, own, found = fresh(df.withColumn(out, F.lit(0)), "rid", "own", "found")
    held = s.write(df.where(is_long).withColumn(rid, F.monotonically_increasing_id()), "long")
    ids = _parts(held.select(F.col(rid).alias("rid"), F.col(text).alias("text")), vocabulary, pattern, part, lap, s)
    ids = s.write(ids.select(F.col("rid").alias(own), F.col("ids").alias(found)), "long-ids")
    kept = [c for c in df.columns if c != out]
    split = held.join(ids, F.col(rid) == F.col(own)).select(*kept, F.col(found).alias(out))
    rest = df.where(~is_long).select(*kept).unionByName(held.join(ids.select(own), F.col(rid) == F.col(own), "left_anti").select(*kept))
    return _encode(rest, vocabulary, pattern, text, out).unionByName(split)


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns, and the bytes that the ids stand for."""

    def run(batches):
        c = coder(vocabulary, pattern)
        for b in batches:
            for s in slices(b, ids, 4 * SLICE):
                yield replace_column(s, out, c.decode_all(s.column(ids)))

    kept = [f for f in df.schema.fields if f.name != out]
    return df.mapInArrow(lambda b: released(run(b)), T.StructType([*kept, T.StructField(out, T.BinaryType())]))
