"""Exact top-k search by inner product with MaxScore.

Vectors are dealt to shards. The terms of a query are its components; a shard has two posting lists for each component,
of its positive and of its negative values, the largest first. The list of the query's sign can add to a score, at most
its bound: the query's component times the first value. While the bounds of the weakest lists add up to less than the
score to beat, these lists are non-essential: a vector in none of the others cannot compete. What is left of the score
to beat is dealt out to the essential lists, whose ends below that share are left out as well. The essential postings
are traversed, which gives partial scores; the other components are probed, strongest first, only for vectors whose
partial score plus the bounds of what is left still competes. Shards return their own best, merged by query.

Queries are packed in blocks and meet every shard block by block, so the work is queries times vectors at most, a task
holds one block and one shard, and what is shuffled beyond the vectors is one packed block for each pair.

Vectors without zeros, whose scores are sums of many small products, are the worst case: hardly any list is
non-essential and nearly all vectors are touched. `max_score` counts the postings that it read.

Defined results: vectors that are null or hold null or non-finite components take no part. Shorter vectors count as
filled up with 0. Candidates are all rows with another id than the query's; a row that occurs twice counts twice.
Equal queries are asked once. Ties go to the smaller id. With no other row, a query has no result. An empty table gives
no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Scratch
from quire.llm.frames import released

#: Vectors of a shard on average, of one at least where there are few, and queries of a block.
SHARD, LEAST, BLOCK = 32768, 4096, 4096


def quantise(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and q, the floors of scale * component, of the vectors that take part."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.where(x.isNotNull() & ~bad & F.col(id_col).isNotNull()).select(F.col(id_col).alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("q"))


def _narrow(x: np.ndarray) -> np.ndarray:
    """The values in the smallest type that holds them."""
    top = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def _pack(table: pa.Table) -> pa.Table:
    """One row for a group: its ids, its components one after the other (and their bytes), and the lengths of its vectors."""
    q = table.column("q").combine_chunks()
    lengths = np.diff(q.offsets.to_numpy()).astype(np.int32)
    values = _narrow(q.flatten().to_numpy().astype(np.int64))
    ids = table.column("vec_id").combine_chunks().to_numpy().astype(np.int64)
    return pa.table({"key": table.column("key")[:1], "ids": [ids.tobytes()], "values": [values.tobytes()], "bytes": pa.array([values.itemsize], pa.int32()), "lengths": [lengths.tobytes()]})


_PACKED = "key long, ids binary, values binary, bytes int, lengths binary"


def _unpack(ids: bytes, values: bytes, size: int, lengths: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(lengths, np.int32)
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width) < n[:, None]] = np.frombuffer(values, f"<i{size}")
    return np.frombuffer(ids, np.int64), out


def _kind(top_x: int, top_q: int, width: int):
    """A type in which all sums are exact."""
    top = top_x * top_q * max(1, width)
    return np.float64 if top < 1 << 53 else np.int64 if top < 1 << 63 else object


class Shard:
    """Vectors with two posting lists for each component: (places, values) of the positive and of the negative values, the largest first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.lists = ids, x, []
        for c in range(x.shape[1]):
            both = []
            for side in (x[:, c], -x[:, c]):
                at = np.flatnonzero(side > 0)
                at = at[np.argsort(-side[at], kind="stable")]
                both.append((at, side[at]))
            self.lists.append(both)


def max_score(shard: Shard, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the k best rows of a shard for a query of whole numbers, and how many postings were read."""
    ids, x = shard.ids, shard.x
    others = np.flatnonzero(ids != query_id)
    if len(others) <= k:
        return others, x[others] @ q, 0
    size = np.abs(q)
    lists = [shard.lists[c][0 if q[c] > 0 else 1] for c in range(len(q))]
    bound = np.array([size[c] * values[0] if q[c] and len(values) else 0 for c, (_, values) in enumerate(lists)], x.dtype)
    order = np.argsort(bound, kind="stable")
    # The score to beat at first: the k-th best of the first of the strongest list, filled up with any others.
    first = lists[order[-1]][0][: 8 * k] if len(q) else others[:0]
    first = first[ids[first] != query_id]
    if len(first) < k:
        first = np.union1d(first, others[: 2 * k])
    beat = np.sort(x[first] @ q)[-k] if len(first) >= k else None
    if beat is None or beat <= 0:  # a vector in no list has score 0 at most, and could compete
        return *_best(ids, others, x[others] @ q, k), x[others].size
    total = np.cumsum(bound[order])
    cut = int(np.searchsorted(total, beat, side="left"))
    rest, essential = order[:cut], order[cut:]
    # Values are whole: a vector with less than a share in each essential list stays below the score to beat.
    share = (beat - (total[cut - 1] if cut else 0)) // len(essential)
    least = {c: -(-share // size[c]) for c in essential.tolist()}
    most = bound.copy()  # what a component not yet read can add at most
    score, seen, read = np.zeros(len(ids), x.dtype), np.zeros(len(ids), bool), 0
    for c in essential[::-1].tolist():
        places, values = lists[c]
        n = int(np.searchsorted(-values, -least[c], side="right"))
        score[places[:n]] += size[c] * values[:n]
        seen[places[:n]] = True
        most[c] = size[c] * values[n] if n < len(values) else 0
        read += n
    rows = np.flatnonzero(seen & (ids != query_id))
    score, left = score[rows], most.sum()
    # Probe what isn't in the partial scores: ends of essential lists, the other lists, and all that takes away.
    probe = [*essential[::-1].tolist(), *rest[::-1].tolist()]
    for i in range(0, len(probe), 4):
        keep = score + left >= beat
        rows, score = rows[keep], score[keep]
        for c in probe[i : i + 4]:
            value = x[rows, c] * q[c]
            if c in least:
                value = np.where(value >= size[c] * least[c], 0, value) if share > 0 else np.minimum(value, 0)
            score = score + value
            left = left - most[c]
        read += len(rows) * len(probe[i : i + 4])
    return *_best(ids, rows, score, k), read


def _best(ids: np.ndarray, rows: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    take = np.lexsort((ids[rows], -score))[:k]
    return rows[take], score[take]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of `vectors` (vec_id, q) for each of `queries` (vec_id, q)."""
    s = scratch or Scratch(vectors.sparkSession)
    asked = queries.distinct()
    n, n_asked = vectors.count(), asked.count()
    # Few vectors are dealt to as many shards as there are tasks; a shard's size has the same bound for any number.
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards, blocks = max(1, -(-n // shard), min(width, -(-n // LEAST))), max(1, -(-n_asked // block))

    def packed(x, groups, *salt):
        # Rows are dealt one by one and not by id, so equal rows don't gather in one shard.
        return x.withColumn("key", F.pmod(F.xxhash64(*salt), F.lit(groups))).select("key", "vec_id", "q").groupBy("key").applyInArrow(_pack, _PACKED)

    held = s.write(packed(vectors, shards, "vec_id", F.monotonically_increasing_id()), "shards")
    to_ask = s.write(packed(asked, blocks, "vec_id", "q"), "blocks")
    met = to_ask.select(F.col("key").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("key"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "values", "bytes", "lengths")))

    def run(batches):
        last, own, top_x = None, None, 0
        for b in batches:
            for row in range(b.num_rows):
                get = lambda c: b.column(c)[row].as_py()  # noqa: B023, E731
                width = max(int(np.frombuffer(get(c), np.int32).max(initial=0)) for c in ("lengths", "q_lengths"))
                asked_ids, q = _unpack(get("q_ids"), get("q_values"), get("q_bytes"), get("q_lengths"), width)
                top_q = int(np.abs(q).max(initial=0))
                if last != (get("key"), width):  # blocks that meet one shard follow each other
                    ids, x = _unpack(get("ids"), get("values"), get("bytes"), get("lengths"), width)
                    top_x = int(np.abs(x).max(initial=0))
                    own, last = Shard(ids, x.astype(_kind(top_x, top_q, width))), (get("key"), width)
                elif own.x.dtype != _kind(top_x, top_q, width):
                    own = Shard(own.ids, own.x.astype(np.int64).astype(_kind(top_x, top_q, width)))
                q = q.astype(own.x.dtype)
                out = [[], [], [], []]
                for i, query_id in enumerate(asked_ids.tolist()):
                    rows, score, _ = max_score(own, query_id, q[i], k)
                    out[0] += [query_id] * len(rows)
                    out[1] += [get("block") * (1 << 32) + i] * len(rows)
                    out[2] += own.ids[rows].tolist()
                    out[3] += [int(min(max(v, -(1 << 63)), (1 << 63) - 1)) for v in score]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "which", "vec_id", "score"])

    found = met.join(held, "key").mapInArrow(lambda b: released(run(b)), "query_id long, which long, vec_id long, score long")
    order = Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
