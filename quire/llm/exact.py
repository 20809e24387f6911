"""Exact deduplication by deterministic block naming.

The normalised text is cut into blocks of BLOCK characters. Equal blocks get one integer name: the distinct blocks are
sorted within their partitions and numbered. Then adjacent names are paired, the distinct pairs are sorted and
numbered the same way, and so on, until every document has one name. Documents of the same number of blocks take the
same number of rounds, so (number of blocks, last name) is equal for two documents if and only if their texts are: a
name stands for one content only, which no hash decides.

The text itself is shuffled once, for the names of blocks. Rows find the name of a block by two 64-bit hashes of it;
where two different blocks share both (which the names table shows, as it holds the blocks), the names of these
carry the block and are matched by it.

Defined results: a null text counts as empty and equals the empty text; both are one class. Of equal texts, the row
with the smallest id stays; a null id comes last. Of rows that also share the id, one stays. An empty table gives no
rows. `dedup` ignores other columns; `distinct_documents` keeps them, whatever their names. A long text is more blocks,
which any task names; only its own row holds it whole, and about three times its size in memory. Ids may be of any type
that has an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WS, Scratch, fresh, small

#: Characters of a block.
BLOCK = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", " ")


def _prints(block: Column) -> list[Column]:
    return [F.xxhash64(block).alias("h1"), F.xxhash64(F.lit(7919), F.reverse(block)).alias("h2")]


def _named(distinct: DataFrame, *order: str) -> DataFrame:
    """Distinct rows, numbered in their order within each partition: names are unique integers."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """rid, doc_id, sha (binary of the normalised text), n_blocks and name: equal for equal texts only."""
    s = scratch or Scratch(df.sparkSession)
    norm = df.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("t"))
    at = F.sequence(F.lit(0), F.floor((F.greatest(F.length("t"), F.lit(1)) - 1) / block).cast("int"))
    blocks = F.transform(at, lambda i: F.substring(F.col("t"), i * block + 1, F.lit(block)))
    own = [F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha"), F.transform(blocks, lambda b: F.struct(*_prints(b))).alias("prints")]
    # Row numbers are of this written table: later steps see the same.
    base = s.write(norm.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *own), "documents")
    seen = norm.select(F.explode(blocks).alias("block")).select("block", *_prints(F.col("block"))).groupBy("h1", "h2", "block").agg(F.lit(1).alias("one"))
    named = _named(seen, "h1", "h2", "block")
    names = s.write(named.select("h1", "h2", "name"), "names")
    shared = names.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    rows = base.select("rid", F.size("prints").alias("n_blocks"), F.posexplode("prints").alias("pos", "p")).select("rid", "n_blocks", "pos", F.col("p.h1"), F.col("p.h2"))
    if not shared.isEmpty():  # the same with blocks matched by their content; numbers and texts are of one written table
        norm = s.write(norm.withColumn("rid", F.monotonically_increasing_id()), "texts")
        named = s.write(_named(seen.select("block"), "block"), "names-with-blocks")
        base = norm.select("rid", "doc_id", *own)
        rows = norm.select("rid", F.size(at).alias("n_blocks"), F.posexplode(blocks).alias("pos", "block"))
        return _pair_up(s, base, s.write(rows.join(named, "block").select("rid", "n_blocks", "pos", "name"), "level0"))
    now = s.write(rows.join(names, ["h1", "h2"]).select("rid", "n_blocks", "pos", "name"), "level0")
    return _pair_up(s, base, now)


def _pair_up(s: Scratch, base: DataFrame, now: DataFrame) -> DataFrame:
    """Rounds of naming adjacent pairs; documents that have one name are done."""
    done, width = [now.where("n_blocks = 1").select("rid", "name")], now.agg(F.max("n_blocks")).first()[0] or 1
    now = now.where("n_blocks > 1")
    level = 0
    while width > 1:
        level += 1
        width = -(-width // 2)
        half = F.floor(F.col("pos") / 2).cast("int")
        # A last name without a neighbour is paired with -1, which is no name.
        pairs = now.groupBy("rid", "n_blocks", half.alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = s.write(pairs, f"pairs{level}")
        names = s.write(_named(pairs.groupBy("a", "b").agg(F.lit(1).alias("one")), "a", "b").select("a", "b", "name"), f"pairnames{level}")
        now = s.write(pairs.join(names, ["a", "b"]).select("rid", "n_blocks", "pos", "name"), f"level{level}")
        last = F.col("n_blocks") <= 1 << level
        done.append(now.where(last).select("rid", "name"))
        now = now.where(~last)
    named = done[0]
    for more in done[1:]:
        named = named.unionByName(more)
    return base.select("rid", "doc_id", "sha", F.size("prints").alias("n_blocks")).join(named, "rid")


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and sha for every row; `kept` once for each class of equal texts."""
    s = scratch or Scratch(df.sparkSession)
    named = s.write(classes(df, text, doc_id, block, s), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    # Written before it is joined back: a join of two shuffled tables can split the rows of a large class.
    groups = s.write(named.groupBy("n_blocks", "name").agg(first.alias("first"), F.count("*").alias("group_size")), "groups")
    joined = named.join(groups, ["n_blocks", "name"])
    return joined.select("rid", "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), "sha")


def distinct_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """The rows that stay, with all their columns."""
    s, steps = scratch or Scratch(df.sparkSession), Scratch(df.sparkSession)
    found = s.write(dedup(df, text, doc_id, scratch=steps).where("not kept").select("doc_id", "keep_id", "sha"), "dropped")
    steps.clear()
    again = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    id_, sha_ = fresh(df, "id", "sha")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias(id_), F.col("sha").alias(sha_)).distinct()
    sha = F.unhex(F.sha2(normalised(F.col(text)).cast("binary"), 256))
    kept = df.join(small(gone), F.col(doc_id).eqNullSafe(F.col(id_)) & (sha == F.col(sha_)), "left_anti")
    if again.isEmpty():
        return kept
    return kept.withColumn(sha_, sha).dropDuplicates([doc_id, sha_]).drop(sha_)  # rows that share id and text
