"""Near-duplicate components by an n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word shingles. All shingles have one global order: by their class of frequency, rare ones
first, then by hash; the classes come from a sketch of fixed size over all documents. If two sets of sizes n and m
reach the similarity, then for any l the first n - need(n) + l shingles of one and the first m - need(m) + l of the
other share at least l. Each document takes the l that costs least by the sketch's estimates: a longer prefix is read
in more lists but asks for more shared shingles before a pair is verified. A pair must share the smaller l of the two.

Equal sets are one node. The lists' lengths are counted first: shingles that one node has go, and so do nodes with fewer
shared shingles in all than any partner asks for. What is left is gathered in buckets; a list longer than PIECE is dealt
in pieces by node, so that no task gathers it whole. A piece counts as a list; it is also met by the whole list's first
node and, at last, by the other pieces. Lists of up to LONG nodes give all their pairs. For long lists, components come
first, as pairs inside one need no test: each list's members meet PIVOTS of them, then others while this finds links (which collapses
groups of copies in linear work), then all pairs whose components differ, block by block. Links found in a round join
components as they are, so no round goes through earlier links again. At first, what a pair may
share in long lists is taken to be as much as its nodes have there; a pivot's pairs count the lists that they met in;
at the end, short and long lists are counted together. Pairs that share enough are tested on the whole sets. Two nodes
meet only where their sizes and signatures allow the similarity: the bits in which the parities of two sets differ are
at most the members in which the sets do. No link between different components is left out.

Defined results: a null text, and one without words, has no shingles, links with nothing and is its own component. A
text under `size` words is one shingle. Rows of equal sets are one component, also rows with equal ids; the component
id is the least id of its rows, nulls ignored (null if all are). An empty table gives no rows. Ids may be of any type
that has an order. Other columns are ignored, whatever their names, and kept by one_of_each. A text is read in slices of
whole texts, so the memory of a worker grows with the longest text (about 45 bytes for each of its bytes). Bytes that
aren't UTF-8 are parts of words. Sets are told apart by 128 bits, shingles by 64; rows are found again by their id and a
64-bit hash of their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, bounded, fresh, small
from quire.llm.components import components
from quire.llm.frames import give_back, released, slices
from quire.llm.wordhash import mix, words_of

#: Cells of the frequency sketch, and the parts it is summed in.
CELLS, PARTS = 1 << 21, 32
#: Bytes of text in a slice, entries for each bucket of lists, longest extra prefix, cost of a test in list entries.
SLICE, ENTRIES_A_BUCKET, MOST, TEST = 1 << 19, 4096, 8, 8
#: Members of a list that meet at once, pivots of a list in a round, and most rounds with pivots before all pairs are met.
BLOCK, PIVOTS, STARS = 1024, 8, 8
#: Lists of more nodes than this are long; those of more than PIECE are dealt in pieces of about this size.
LONG, PIECE = 32, 4096
#: Bits of a signature.
BITS = 512
_Q = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text one after the other, and where each text's begin (and the last ends)."""
    words, doc, first = words_of(col, lower=True)
    n, count = len(col), np.bincount(doc, minlength=len(col))
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    m = max(0, len(words) - size + 1)
    grams = np.zeros(m, np.uint64)
    for j in range(size):
        grams = grams * _Q + words[j : m + j]
    inside = doc[:m] == doc[len(words) - m :] if m else np.zeros(0, bool)
    grams, owner = mix(grams[inside] + np.uint64(size)), doc[:m][inside]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            more = count[short] > j
            whole[more] = whole[more] * _Q + words[first[short[more]] + j]
        grams = np.concatenate((grams, mix(whole + count[short].astype(np.uint64))))
        owner = np.concatenate((owner, short))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])))
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(n + 1))


def need(n, part: int, whole: int):
    """The least overlap of a set of n with any partner that reaches part / whole."""
    return -(-part * n // whole)


def _sketch(batches, size: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    total = np.zeros(CELLS, np.uint32)
    for b in batches:
        for s in slices(b, "text", SLICE):
            grams, _ = shingle_sets(s.column("text"), size)
            np.add.at(total, ((grams >> np.uint64(20)) % np.uint64(CELLS)).astype(np.int64), np.uint32(1))
    cut = CELLS // PARTS
    rows = [np.minimum(total[i * cut : (i + 1) * cut], 65535).astype(np.uint16).tobytes() for i in range(PARTS)]
    task = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays([pa.array([task] * PARTS, pa.int64()), pa.array(range(PARTS), pa.int64()), pa.array(rows, pa.binary())], names=["task", "part", "counts"])


def frequency_classes(df: DataFrame, size: int) -> np.ndarray:
    """The class (a logarithm of the count) of each cell: CELLS bytes, whatever the size of the table."""
    table = df.select("text").mapInArrow(lambda b: released(_sketch(b, size)), "task long, part long, counts binary")

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // PARTS, np.float32)
        for c in rows.column("counts").to_pylist():
            total += np.frombuffer(c, np.uint16 if len(c) == 2 * len(total) else np.float32)
        return pa.table({"task": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()), "counts": [total.tobytes()]})

    for _ in range(3):  # sums of at most 256 at a time: up to 16 million tasks
        table = table.withColumn("task", F.floor(F.col("task") / 256)).groupBy("task", "part").applyInArrow(add, "task long, part long, counts binary")
    with bounded(df.sparkSession):
        got = sorted(table.collect(), key=lambda r: r.part)  # PARTS rows
    if not got:
        return np.zeros(CELLS, np.uint8)
    s_ = np.concatenate([np.frombuffer(r.counts, np.float32) for r in got])
    return np.log2(s_ + 1).astype(np.uint8)


def prefix(grams: np.ndarray, classes: np.ndarray, part: int, whole: int) -> tuple[int, np.ndarray]:
    """The l of least estimated cost, and the prefix for it."""
    n = len(grams)
    cls = classes[(grams >> np.uint64(20)) % np.uint64(CELLS)]
    base = n - need(n, part, whole)
    most = min(MOST, n - base)
    take = base + most
    if take < n:  # only what can be in the prefix is sorted
        edge = np.partition(cls, take - 1)[take - 1]
        keep = cls <= edge
        grams, cls = grams[keep], cls[keep]
    grams = grams[np.lexsort((grams, cls))[:take]]
    length = np.cumsum(np.exp2(np.sort(cls)[:take].astype(np.float64)))[base:]
    l = np.arange(1, most + 1)
    best = int(np.argmin(length + TEST * length / l))
    return best + 1, grams[: base + best + 1]


def signatures(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BITS bits of each set: whether an odd number of its members falls on a bit."""
    out, bit = [], ((mix(grams + _Q) >> np.uint64(17)) % np.uint64(BITS)).astype(np.int64)
    for i in range(0, len(at) - 1, 1024):
        j = min(i + 1024, len(at) - 1)
        own = np.repeat(np.arange(j - i), np.diff(at[i : j + 1])) * BITS + bit[at[i] : at[j]]
        odd = (np.bincount(own, minlength=(j - i) * BITS) & 1).astype(np.uint8)
        out.append(np.packbits(odd.reshape(j - i, BITS), axis=1).view("<u8"))
    return np.concatenate(out) if out else np.zeros((0, BITS // 64), "<u8")


def _profiles(batches, classes, size: int, part: int, whole: int) -> Iterator[pa.RecordBatch]:
    held = classes.value
    for b in batches:
        for s in slices(b, "text", SLICE):
            grams, at = shingle_sets(s.column("text"), size)
            mixed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams ^ _Q), dtype=np.uint64)))
            plain = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(mix(grams) + _Q), dtype=np.uint64)))
            f1, f2 = (mixed[at[1:]] - mixed[at[:-1]]).view(np.int64), (plain[at[1:]] - plain[at[:-1]]).view(np.int64)
            found = [prefix(grams[a:e], held, part, whole) if e > a else (0, grams[:0]) for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(s.column("id"), s.column("row"), pa.array(np.diff(at)), pa.array(f1), pa.array(f2), pa.array([f[0] for f in found], pa.int32())),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(f[1]) for f in found)]), pa.int32()), pa.array(np.concatenate([f[1] for f in found]).view(np.int64))),
                    pa.array([x.tobytes() for x in signatures(grams, at)], pa.binary()),
                ],
                names=["id", "row", "n", "f1", "f2", "l", "prefix", "sig"],
            )


#: An entry of a list: shingle, piece (0: the list is whole), pieces in all, node, size of its set and its l; whether the
#: list is long, how many shingles the node has in short and in long lists, and the signature of its set.
_ENTRY = np.dtype(
    [("gram", "<u8"), ("piece", "<u4"), ("lots", "<u4"), ("node", "<i8"), ("n", "<u4"), ("l", "u1"), ("long", "u1"), ("short_n", "<u2"), ("long_n", "<u2"), ("sig", "<u8", (BITS // 64,))]
)
#: A pair, the shingles it shares as counted, at most in the lists not counted, and at least by the smaller l.
_PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("shared", "<u2"), ("more", "<u2"), ("least", "u1")])


def _deal(to: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket as one value."""
    if len(rows):
        order = np.argsort(to, kind="stable")
        to = to[order]
        starts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        cuts = zip(starts.tolist(), np.append(starts[1:], len(to)).tolist(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(to[starts], pa.int64()), pa.array([rows[order[a:e]].tobytes() for a, e in cuts], pa.binary())], names=["bucket", "rows"])


_DEALT = "bucket long, rows binary"


def _same(rows: np.ndarray) -> np.ndarray:
    """Whether each entry but the first is of the same list (or piece) as the one before."""
    return (rows["gram"][1:] == rows["gram"][:-1]) & (rows["piece"][1:] == rows["piece"][:-1])


def _shared(rows: np.ndarray) -> np.ndarray:
    """The entries of shingles that at least two nodes have; of pieces all, as others may be in another piece."""
    if not len(rows):
        return rows
    same = _same(rows)
    return rows[np.concatenate((same, [False])) | np.concatenate(([False], same)) | (rows["piece"] > 0)]


def _gathered(part: pa.Table) -> pa.Table:
    """A bucket's lists, sorted by shingle, piece and size of the set."""
    rows = np.zeros(part.num_rows, _ENTRY)
    rows["gram"] = part.column("gram").to_numpy().view(np.uint64)
    for c in ("piece", "lots", "node", "n", "l", "long", "short_n", "long_n"):
        rows[c] = part.column(c).to_numpy()
    rows["sig"] = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u8").reshape(-1, BITS // 64)
    rows = _shared(rows[np.lexsort((rows["node"], rows["n"], rows["piece"], rows["gram"]))])
    give_back()
    return pa.table({"bucket": part.column("bucket")[:1], "rows": [rows.tobytes()]})


def _lists(nodes: DataFrame, piece: int, s: Scratch) -> tuple[DataFrame, DataFrame, int, bool]:
    """The lists in buckets (bucket, rows), the nodes that may have links, the number of buckets, and whether lists are split."""
    entries = nodes.select("node", "n", "l", F.explode("prefix").alias("gram"))
    # The lengths of all lists of two nodes or more, counted before the shuffle and then joined: one row for a shingle.
    lengths = s.write(entries.groupBy("gram").agg(F.count("*").alias("len"), F.min("l").alias("least")).where("len > 1"), "lengths")
    shared = s.write(entries.join(lengths, "gram").withColumn("long", (F.col("len") > LONG).cast("int")), "shared")
    counts = shared.groupBy("node").agg(F.sum(1 - F.col("long")).alias("short_n"), F.sum("long").alias("long_n"), F.min("least").alias("asked"))
    live = s.write(counts.where("short_n + long_n >= asked").join(nodes.select("node", "sig"), "node").drop("asked"), "live")
    lots = F.ceil(F.col("len") / piece)
    cut = F.when(lots > 1, F.pmod(F.xxhash64("node"), lots) + 1).otherwise(0)
    most = lambda c: F.least(F.col(c), F.lit(65535)).alias(c)
    kept = shared.join(live, "node").select("gram", cut.alias("piece"), lots.alias("lots"), "node", "n", "l", "long", most("short_n"), most("long_n"), "sig")
    split = not shared.where(F.col("len") > piece).isEmpty()
    buckets = max(64, live.agg(F.coalesce(F.sum(F.col("short_n") + F.col("long_n")), F.lit(0))).first()[0] // ENTRIES_A_BUCKET)
    dealt = kept.withColumn("bucket", F.pmod(F.xxhash64("gram", "piece"), F.lit(buckets)))
    found = s.write(dealt.groupBy("bucket").applyInArrow(_gathered, _DEALT), "lists")
    s.drop(shared, lengths)
    return found, live, buckets, split


def _bounds(rows: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.concatenate(([True], ~_same(rows)))), len(rows)) if len(rows) else np.zeros(1, np.int64)


def _uniq(pairs: np.ndarray) -> np.ndarray:
    """Pairs with the shared shingles of their repeats added up."""
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    new = np.flatnonzero(np.concatenate(([True], (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1]))))
    out = pairs[new].copy()
    out["shared"] = np.minimum(np.add.reduceat(pairs["shared"].astype(np.int64), new), 65535)
    out["more"] = np.maximum.reduceat(pairs["more"], new)
    return out


def _pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """more: what the pair can share in long lists; of members of a long list, as this is counted, 1."""
    out = np.empty(len(x), _PAIR)
    out["more"] = np.where(x["long"] == 1, 1, np.minimum(x["long_n"], y["long_n"]))
    swap = x["node"] > y["node"]
    out["a"], out["b"] = np.where(swap, y["node"], x["node"]), np.where(swap, x["node"], y["node"])
    out["shared"], out["least"] = 1, np.minimum(x["l"], y["l"])
    return out


def _near(n, m, part: int, whole: int):
    """Whether sets of these sizes can reach the similarity."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    return part * np.maximum(n, m) <= whole * np.minimum(n, m)


def _alike(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, part: int, whole: int) -> np.ndarray:
    """Of pairs x[i], y[j]: whether their signatures allow the similarity."""
    out = np.empty(len(i), bool)
    for k in range(0, len(i), 1 << 15):
        a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        both = x["n"][a].astype(np.int64) + y["n"][b]
        apart = both - 2 * -(-part * both // (part + whole))  # members that are in one of the sets only, at most
        out[k : k + (1 << 15)] = np.bitwise_count(x["sig"][a] ^ y["sig"][b]).sum(axis=1, dtype=np.int64) <= apart
    return out


def _labelled(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for rows, labels in zip(b.column("rows").to_pylist(), b.column("labels").to_pylist(), strict=True):
            yield np.frombuffer(rows, _ENTRY), np.frombuffer(labels, np.int64)


def _to_test(pairs: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    yield from _deal((mix(pairs["a"].astype(np.uint64) * _Q + pairs["b"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), pairs)


def _short_lists(batches, buckets: int, part: int, whole: int) -> Iterator[pa.RecordBatch]:
    """All pairs of short lists."""
    for b in batches:
        for data in b.column("rows").to_pylist():
            rows = np.frombuffer(data, _ENTRY)
            rows = rows[rows["long"] == 0]
            yield from _to_test(_within(rows, rows["node"], part, whole), buckets)


def _stars(batches, which: int, buckets: int, part: int, whole: int) -> Iterator[pa.RecordBatch]:
    """Each list's members against a few of them, which differ by round, where their components differ."""
    for rows, label in _labelled(batches):
        if not len(rows):
            continue
        # A pivot that was added to its own piece is there twice.
        new = np.concatenate(([True], ~_same(rows) | (rows["node"][1:] != rows["node"][:-1])))
        rows, label = rows[new], label[new]
        at = _bounds(rows)
        size = np.diff(at)
        of = np.repeat(np.arange(len(size)), size)
        # The pivots: the least scores of each list. A pair of two pivots meets once.
        order = np.lexsort((_score(rows, which), of))
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.arange(len(rows)) - at[:-1][of]
        found = []
        for k in range(PIVOTS):
            use = np.flatnonzero((rank > k) & (size[of] > k))
            pivot = order[at[:-1][of[use]] + k]
            open_ = (label[use] != label[pivot]) & _near(rows["n"][use], rows["n"][pivot], part, whole)
            use, pivot = use[open_], pivot[open_]
            near = _alike(rows, use, rows, pivot, part, whole)
            found.append(_pairs(rows[use[near]], rows[pivot[near]]))
        pairs = np.concatenate(found)
        pairs["more"] = 0  # pairs that share enough elsewhere are left to the last round
        yield from _to_test(_uniq(pairs), buckets)


def _score(rows: np.ndarray, which: int) -> np.ndarray:
    return rows["node"].astype(np.uint64) if not which else mix(rows["node"].astype(np.uint64) + np.uint64(which))


def _blocks(batches, part: int, whole: int) -> Iterator[pa.RecordBatch]:
    """Lists that still hold more than one component; long ones as pairs of blocks that can hold near sizes.

    A piece goes to each pair of pieces (place) that it is in; there it meets the other one.
    """
    for rows, label in _labelled(batches):
        at = _bounds(rows)
        if not len(rows):
            continue
        first = rows[at[:-1]]
        mixed = np.add.reduceat(label != np.repeat(label[at[:-1]], np.diff(at)), at[:-1]) > 0
        left, right, place = [], [], []
        keep = np.repeat(mixed & (np.diff(at) <= BLOCK), np.diff(at))
        if keep.any():
            left.append((rows[keep].tobytes(), label[keep].tobytes()))
            right.append((b"", b""))
            place.append(None)
        for j in np.flatnonzero(mixed & (np.diff(at) > BLOCK)).tolist():
            cuts = range(int(at[j]), int(at[j + 1]), BLOCK)
            for i in cuts:
                for k in cuts:
                    a, b = slice(i, min(i + BLOCK, at[j + 1])), slice(k, min(k + BLOCK, at[j + 1]))
                    # Sorted by size: the nearest are the last of the one and the first of the other.
                    if k == i or k > i and part * int(rows["n"][k]) <= whole * int(rows["n"][a.stop - 1]):
                        left.append((rows[a].tobytes(), label[a].tobytes()))
                        right.append((rows[b].tobytes(), label[b].tobytes()) if k > i else (b"", b""))
                        place.append(None)
        for j in np.flatnonzero(first["piece"] > 0).tolist():
            own, lots = int(first["piece"][j]), int(first["lots"][j])
            here = slice(int(at[j]), int(at[j + 1]))
            for other in range(1, lots + 1):
                if other != own:
                    left.append((rows[here].tobytes(), label[here].tobytes()))
                    right.append((b"", b""))
                    place.append(f"{int(first['gram'][j])}:{min(own, other)}:{max(own, other)}")
        for i in range(0, len(left), 16):
            c = [*zip(*left[i : i + 16], strict=True), *zip(*right[i : i + 16], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.binary()) for v in c), pa.array(place[i : i + 16], pa.string())], names=["rows", "labels", "rows2", "labels2", "place"])


def _within(x: np.ndarray, lx: np.ndarray, part: int, whole: int) -> np.ndarray:
    """Pairs of unlike components of the same list."""
    found, at = [], _bounds(x)
    for gap in range(1, int(np.diff(at).max(initial=1))):
        i = np.flatnonzero((x["gram"][:-gap] == x["gram"][gap:]) & (x["piece"][:-gap] == x["piece"][gap:]))
        i = i[(lx[i] != lx[i + gap]) & _near(x["n"][i], x["n"][i + gap], part, whole)]
        i = i[_alike(x, i, x, i + gap, part, whole)]
        found.append(_pairs(x[i], x[i + gap]))
        if len(found) > 64:
            found = [_uniq(np.concatenate(found))]
    return _uniq(np.concatenate(found)) if found else np.zeros(0, _PAIR)


def _between(x: np.ndarray, lx: np.ndarray, y: np.ndarray, ly: np.ndarray, part: int, whole: int) -> np.ndarray:
    """Pairs of unlike components of two blocks of one list."""
    found = []
    for k in range(0, len(x), BLOCK):
        i, j = np.nonzero((lx[k : k + BLOCK, None] != ly) & _near(x["n"][k : k + BLOCK, None], y["n"], part, whole))
        use = _alike(x, i + k, y, j, part, whole)
        found.append(_pairs(x[i[use] + k], y[j[use]]))
    return _uniq(np.concatenate(found)) if found else np.zeros(0, _PAIR)


def _met(batches, buckets: int, part: int, whole: int) -> Iterator[pa.RecordBatch]:
    """Pairs of unlike components in the same list."""
    for b in batches:
        for r1, l1, r2, l2 in zip(*(b.column(c).to_pylist() for c in ("rows", "labels", "rows2", "labels2")), strict=True):
            x, lx = np.frombuffer(r1, _ENTRY), np.frombuffer(l1, np.int64)
            pairs = _between(x, lx, np.frombuffer(r2, _ENTRY), np.frombuffer(l2, np.int64), part, whole) if r2 else _within(x, lx, part, whole)
            yield from _to_test(pairs, buckets)


def _candidates(part: pa.Table, last: bool) -> pa.Table:
    """Distinct pairs that share as many shingles as the smaller l asks for.

    At first with what they can share in lists not counted; at last, all is counted, and pairs without a long list are done.
    """
    pairs = _uniq(np.concatenate([np.frombuffer(x, _PAIR) for x in part.column("rows").to_pylist()]))
    if last:
        pairs = pairs[(pairs["shared"] >= pairs["least"]) & (pairs["more"] > 0)]
    else:
        pairs = pairs[pairs["shared"].astype(np.int64) + pairs["more"] >= pairs["least"]]
    return pa.table({"a": pa.array(pairs["a"], pa.int64()), "b": pa.array(pairs["b"], pa.int64())})


def _verified(batches, part: int, whole: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c, out = b.column("a").to_pylist(), b.column("b").to_pylist(), []
        for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            both = len(x) + len(y) - len(np.union1d(x, y))
            out.append(whole * both >= part * (len(x) + len(y) - both))
        out = np.array(out, bool)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[out]), pa.array(np.array(c, np.int64)[out])], names=["a", "b"])


def near_duplicates(df: DataFrame, part: int = 9, whole: int = 10, size: int = 3, text: str = "text", doc_id: str = "doc_id", scratch: Scratch | None = None, piece: int = PIECE) -> DataFrame:
    """doc_id, n_shingles, component_id, row (a hash of the text) and kept of every row.

    Similar means part / whole at least. kept: true for one row of each component, the first by id.
    """
    s = scratch or Scratch(df.sparkSession)
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("row"))
    classes = spark.sparkContext.broadcast(frequency_classes(docs, size))  # CELLS bytes
    kind = df.schema[doc_id].dataType.simpleString()
    profiles = docs.mapInArrow(lambda b: released(_profiles(b, classes, size, part, whole)), f"id {kind}, row long, n long, f1 long, f2 long, l int, prefix array<long>, sig binary")
    profiles = s.write(profiles.withColumn("rid", F.monotonically_increasing_id()), "profiles")
    # Equal sets are one node, named by its least row; rows without shingles are nodes of their own.
    # Groups are written before they are joined back: a join of two shuffled tables can split a large group's rows.
    groups = s.write(profiles.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("rid").alias("node"), F.min("id").alias("least")), "groups")
    first = F.col("rid") == F.col("node")
    own = [F.when(first, F.col(c)).alias(c) for c in ("l", "prefix", "sig")]
    rows = s.write(profiles.where("n > 0").join(groups, ["f1", "f2", "n"]).select("rid", "id", "row", "n", "node", "least", *own), "rows")
    empty = s.write(profiles.where("n = 0").select("id", "row", "n"), "empty")
    s.drop(profiles)
    nodes = rows.where(first).select("node", "id", "row", "least", "n", "l", "prefix", "sig")
    lists, live, buckets, split = _lists(nodes, piece, s)

    def candidates(dealt: DataFrame, name: str, last: bool = False) -> DataFrame:
        return s.write(dealt.groupBy("bucket").applyInArrow(lambda t: _candidates(t, last), "a long, b long"), f"pairs-{name}")

    pairs = candidates(lists.select("rows").mapInArrow(lambda b: released(_short_lists(b, buckets, part, whole)), _DEALT), "links")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(live.where("long_n > 0").select("node"))
    sets = _sets(docs, nodes, ends.distinct(), size, s)

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        met = s.write(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ends")
        used = sets.join(small(met), "node", "left_semi")  # sets that no pair needs aren't sent
        one, two = (used.select(F.col("node").alias(c), F.col("grams").alias(f"set_{c}")) for c in "ab")
        return s.write(pairs.join(two, "b").join(one, "a").mapInArrow(lambda b: released(_verified(b, part, whole)), "a long, b long"), name)

    nodes_labels = components(verify(pairs, "links"), s)
    # What rounds read: the long lists; at last, the entries of nodes that are in one, as pairs of others are done.
    long_lists = s.write(lists.mapInArrow(lambda b: released(_of_lists(b, "long")), _DEALT), "long-lists")
    open_lists = s.write(lists.mapInArrow(lambda b: released(_of_lists(b, "long_n")), _DEALT), "open-lists")
    s.drop(lists)
    for which in range(STARS):
        seen = _with_labels(long_lists, nodes_labels, split, s)
        seen = (_pivots(seen, which, s) if split else None) or seen
        links = verify(candidates(seen.mapInArrow(lambda b, w=which: released(_stars(b, w, buckets, part, whole)), _DEALT), f"links{which}"), f"links{which}")
        if links.isEmpty():
            break
        nodes_labels = _joined(nodes_labels, links, s)
    block = "rows binary, labels binary, rows2 binary, labels2 binary"
    seen = _with_labels(open_lists, nodes_labels, split, s)
    blocks = seen.mapInArrow(lambda b: released(_blocks(b, part, whole)), f"{block}, place string")
    if split:
        blocks = s.write(blocks, "blocks")
        ends = F.struct("rows", "labels")
        two = blocks.where("place is not null").groupBy("place").agg(F.min(ends).alias("one"), F.max(ends).alias("two"), F.count("*").alias("n")).where("n = 2")
        whole_lists = blocks.where("place is null").drop("place")
        blocks = whole_lists.unionByName(two.select("one.*", F.col("two.rows").alias("rows2"), F.col("two.labels").alias("labels2")))
    dealt = blocks.drop("place").repartition(_width(spark)).mapInArrow(lambda b: released(_met(b, buckets, part, whole)), _DEALT)
    links = verify(candidates(dealt, "last", True), "links-last")
    if not links.isEmpty():
        nodes_labels = _joined(nodes_labels, links, s)
    linked = nodes.select("node", "least").join(nodes_labels, "node")
    # Of each component: the row of the least id, and of equal ids the first. A node's first row of the least id:
    heads = s.write(rows.where(F.col("id").eqNullSafe(F.col("least"))).groupBy("node").agg(F.min("rid").alias("head")), "heads")
    firsts = s.write(linked.join(heads, "node").groupBy("label").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "head")).alias("first")), "firsts")
    of = linked.select("node", "label").join(firsts, "label").select("node", F.col("first.least").alias("component"), F.col("first.head").alias("first"))
    full = rows.select("rid", "id", "row", "n", "node", "least").join(of, "node", "left").join(heads, "node")
    own = F.col("rid") == F.coalesce("first", "head")
    full = full.select("id", "row", "n", F.when(F.col("first").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"), own.alias("kept"))
    empty = empty.select("id", "row", "n", F.col("id").alias("component"), F.lit(True).alias("kept"))
    return full.unionByName(empty).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "row", "kept")


def one_of_each(df: DataFrame, part: int = 4, whole: int = 5, size: int = 5, text: str = "text", doc_id: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """The rows that stay, with all their columns: one of each component, and all without shingles."""
    s, steps = scratch or Scratch(df.sparkSession), Scratch(df.sparkSession)
    found = steps.write(near_duplicates(df, part, whole, size, text, doc_id, steps).where("n_shingles > 0").select("doc_id", "row", "kept"), "components")
    # Rows of equal id and text are one here: together they stay once or go.
    own, of = fresh(df, "id", "row")
    known = s.write(found.groupBy(F.col("doc_id").alias(own), F.col("row").alias(of)).agg(F.bool_or("kept").alias("any"), F.count("*").alias("n")), "known")
    steps.clear()
    gone = known.where("not any").select(own, of)
    kept = df.join(small(gone), F.col(doc_id).eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(of)), "left_anti")
    if known.where("any and n > 1").isEmpty():
        return kept
    words = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return kept.where(words).dropDuplicates([doc_id, text]).unionByName(kept.where(~words))


def _width(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _sets(docs: DataFrame, nodes: DataFrame, some: DataFrame, size: int, s: Scratch) -> DataFrame:
    """node and its whole set, sorted, for some nodes."""

    def sets(batches):
        for b in batches:
            for part in slices(b, "text", SLICE):
                grams, at = shingle_sets(part.column("text"), size)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([grams[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=["node", "grams"])

    asked = s.write(nodes.join(some, "node", "left_semi").select("node", F.col("id").alias("own"), F.col("row").alias("of")), "asked")
    found = docs.join(small(asked), F.col("id").eqNullSafe(F.col("own")) & (F.col("row") == F.col("of"))).select("node", "text").mapInArrow(lambda b: released(sets(b)), "node long, grams binary")
    found = s.write(found, "sets")
    if found.select("node").groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return found
    return s.write(found.dropDuplicates(["node"]), "sets")  # rows that share id and text


def _of_lists(batches, column: str) -> Iterator[pa.RecordBatch]:
    """The entries of lists for which a column isn't 0, where a list has two of them."""
    for b in batches:
        for k, rows in zip(b.column("bucket").to_pylist(), b.column("rows").to_pylist(), strict=True):
            rows = np.frombuffer(rows, _ENTRY)
            rows = _shared(rows[rows[column] > 0])
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([rows.tobytes()], pa.binary())], names=["bucket", "rows"])


def _joined(labels: DataFrame, links: DataFrame, s: Scratch) -> DataFrame:
    """Components after more links: only the components that these meet are gone through again."""
    ends = s.write(links.select(F.col("a").alias("node")).union(links.select("b")).distinct(), "ends")
    known = s.write(labels.join(small(ends), "node"), "known")
    own = small(known)
    between = links.join(own.select(F.col("node").alias("a"), F.col("label").alias("one")), "a", "left").join(own.select(F.col("node").alias("b"), F.col("label").alias("two")), "b", "left")
    between = between.select(F.coalesce("one", "a").alias("a"), F.coalesce("two", "b").alias("b")).where("a <> b").distinct()
    found = components(s.write(between, "between"), s)
    far = small(found).select(F.col("node").alias("root"), F.col("label").alias("far"))
    moved = labels.join(far, F.col("label") == F.col("root"), "left").select("node", F.coalesce("far", "label").alias("label"))
    # Nodes that had no links; one that had some is the root of its component.
    had = known.select(F.col("label").alias("node")).distinct()
    return s.write(moved.union(found.join(had, "node", "left_anti")), "joined")


def _with_labels(lists: DataFrame, labels: DataFrame, split: bool, s: Scratch) -> DataFrame:
    """The lists that hold several components, with the component of each entry's node (itself without links)."""

    def asks(batches):
        for b in batches:
            for k, rows in zip(b.column("bucket").to_pylist(), b.column("rows").to_pylist(), strict=True):
                rows = np.frombuffer(rows, _ENTRY)
                node = np.unique(rows["node"])
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(node), pa.int64()), pa.array(node)], names=["bucket", "node"])

    def fill(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"rows": pa.array([], pa.binary()), "labels": pa.array([], pa.binary())})
        rows = np.frombuffer(left.column("rows")[0].as_py(), _ENTRY)
        node, label = (right.column(c).to_numpy() for c in ("node", "label"))
        order = np.argsort(node)
        own = rows["node"].copy()
        if len(node):
            at = np.minimum(np.searchsorted(node[order], own), len(node) - 1)
            hit = node[order][at] == own
            own[hit] = label[order][at[hit]]
        # Lists of one component are done; pieces may meet others.
        bounds = _bounds(rows)
        if len(rows):
            size = np.diff(bounds)
            mixed = np.add.reduceat(own != np.repeat(own[bounds[:-1]], size), bounds[:-1]) > 0
            keep = np.repeat(mixed, size) | (rows["piece"] > 0)
            rows, own = rows[keep], own[keep]
        return pa.table({"rows": pa.array([rows.tobytes()], pa.binary()), "labels": pa.array([own.tobytes()], pa.binary())})

    known = lists.mapInArrow(asks, "bucket long, node long").join(labels, "node").select("bucket", "node", "label")
    found = s.write(lists.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(fill, "rows binary, labels binary").where(F.length("rows") > 0), "labelled")
    return _open_pieces(found, s) if split else found


_EDGE = "gram long, low long, high long"


def _open_pieces(found: DataFrame, s: Scratch) -> DataFrame:
    """Without the pieces of lists of which all pieces together hold one component."""

    def ends(batches):
        for rows, label in _labelled(batches):
            rows, label = rows[rows["piece"] > 0], label[rows["piece"] > 0]
            at = _bounds(rows)[:-1]
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(rows["gram"][at].view(np.int64)), pa.array(np.minimum.reduceat(label, at)), pa.array(np.maximum.reduceat(label, at))], names=["gram", "low", "high"])

    split = s.write(found.mapInArrow(ends, _EDGE), "piece-ends")
    if split.isEmpty():
        return found
    done = split.groupBy("gram").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low = high").select("gram")
    # The lists that are done, for each row of the table that holds a piece of them.
    found = s.write(found.withColumn("at", F.monotonically_increasing_id()), "labelled-rows")

    def asks(batches):
        for b in batches:
            for k, rows in zip(b.column("at").to_pylist(), b.column("rows").to_pylist(), strict=True):
                rows = np.frombuffer(rows, _ENTRY)
                gram = np.unique(rows["gram"][rows["piece"] > 0])
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(gram), pa.int64()), pa.array(gram.view(np.int64))], names=["at", "gram"])

    def fill(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, label = np.frombuffer(left.column("rows")[0].as_py(), _ENTRY), np.frombuffer(left.column("labels")[0].as_py(), np.int64)
        keep = (rows["piece"] == 0) | ~np.isin(rows["gram"], right.column("gram").to_numpy().view(np.uint64))
        return pa.table({"rows": pa.array([rows[keep].tobytes()], pa.binary()), "labels": pa.array([label[keep].tobytes()], pa.binary())})

    known = found.mapInArrow(asks, "at long, gram long").join(done, "gram").select("at", "gram")
    kept = found.groupBy("at").cogroup(known.groupBy("at")).applyInArrow(fill, "rows binary, labels binary")
    return s.write(kept.where(F.length("rows") > 0), "labelled-open")


def _pivots(seen: DataFrame, which: int, s: Scratch) -> DataFrame | None:
    """The table with, in each piece, the first node of its whole list; None without pieces."""

    def firsts(batches):
        for rows, label in _labelled(batches):
            use = np.flatnonzero(rows["piece"] > 0)
            rows, label, at = rows[use], label[use], _bounds(rows[use])
            if len(rows):
                score = _score(rows, which)
                first = np.lexsort((score, np.repeat(np.arange(len(at) - 1), np.diff(at))))[at[:-1]]
                score = (score[first] ^ np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows["gram"][first].view(np.int64)), pa.array(score), pa.array([rows[i : i + 1].tobytes() for i in first], pa.binary()), pa.array(label[first])], names=["gram", "score", "entry", "label"])

    own = s.write(seen.mapInArrow(firsts, "gram long, score long, entry binary, label long"), "piece-firsts")
    if own.isEmpty():
        return None
    best = s.write(own.groupBy("gram").agg(F.min(F.struct("score", "entry", "label")).alias("best")), "list-firsts")
    seen = s.write(seen.withColumn("at", F.monotonically_increasing_id()), "labelled-at")

    def asks(batches):
        for b in batches:
            for k, rows in zip(b.column("at").to_pylist(), b.column("rows").to_pylist(), strict=True):
                rows = np.frombuffer(rows, _ENTRY)
                heads = rows[_bounds(rows)[:-1]] if len(rows) else rows
                heads = heads[heads["piece"] > 0]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(heads), pa.int64()), pa.array(heads["gram"].view(np.int64)), pa.array(heads["piece"].astype(np.int64))], names=["at", "gram", "piece"])

    def fill(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, label = np.frombuffer(left.column("rows")[0].as_py(), _ENTRY), np.frombuffer(left.column("labels")[0].as_py(), np.int64)
        if right.num_rows:
            more = np.frombuffer(b"".join(right.column("entry").to_pylist()), _ENTRY).copy()
            more["piece"] = right.column("piece").to_numpy()
            rows, label = np.concatenate((rows, more)), np.concatenate((label, right.column("label").to_numpy()))
            order = np.lexsort((rows["node"], rows["n"], rows["piece"], rows["gram"]))
            rows, label = rows[order], label[order]
        return pa.table({"rows": pa.array([rows.tobytes()], pa.binary()), "labels": pa.array([label.tobytes()], pa.binary())})

    known = seen.mapInArrow(asks, "at long, gram long, piece long").join(best, "gram").select("at", "piece", "best.entry", "best.label")
    return seen.groupBy("at").cogroup(known.groupBy("at")).applyInArrow(fill, "rows binary, labels binary")
