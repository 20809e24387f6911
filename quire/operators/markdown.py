"""Section trees of Markdown texts, flat: one row for each node, keyed by document and node_seq in pre-order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

LEVELS = range(1, 7)


def _doc(order: str = "node_seq"):
    return Window.partitionBy("doc_id").orderBy(order)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1), line and whether it is a heading: not in a code fence, and one to six #."""
    spread = docs.select("doc_id", F.posexplode(F.split("content", "\n")).alias("at", "line")).withColumn("line_no", F.col("at") + 1)
    bare = X.trimmed(F.col("line"))
    fence = bare.startswith("```")
    fences = F.sum(fence.cast("int")).over(_doc("line_no"))
    return spread.select("doc_id", "line_no", "line", (~fence & (fences % 2 == 0) & bare.rlike(r"^#{1,6}\s+.+$")).alias("heading"))


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, level and title; the level is null where the line is indented (such headings are dropped)."""
    found = lines(docs).where("heading")
    marks = F.regexp_extract("line", "^(#{1,6})", 1)
    title = X.trimmed(F.regexp_extract(X.trimmed(F.col("line")), r"^#{1,6}\s+(.+)$", 1))
    return found.select("doc_id", "line_no", F.when(marks != "", F.length(marks)).alias("level"), title.alias("title"))


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, node_seq (from 0), line_no, level, title and text: the lines up to the next heading."""
    kept = lines(docs).withColumn("starts", F.col("heading") & F.col("line").rlike("^#"))
    kept = kept.withColumn("node_seq", F.sum(F.col("starts").cast("int")).over(_doc("line_no")) - 1).where("node_seq >= 0")
    marks = F.regexp_extract("line", "^(#{1,6})", 1)
    title = X.trimmed(F.regexp_extract(X.trimmed(F.col("line")), r"^#{1,6}\s+(.+)$", 1))
    own = lambda c: F.min(F.when(F.col("starts"), c))
    found = kept.groupBy("doc_id", "node_seq").agg(own(F.col("line_no")).alias("line_no"), own(F.length(marks)).alias("level"), own(title).alias("title"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return found.select("doc_id", F.col("node_seq").cast("int").alias("node_seq"), "line_no", "level", "title", X.trimmed(F.array_join(F.transform("ls", lambda x: x.line), "\n")).alias("text"))


def with_tree(nodes: DataFrame) -> DataFrame:
    """Adds parent_seq, subtree_end (the first later node that is no descendant) and is_leaf, all by windows of one order."""
    before = _doc().rowsBetween(Window.unboundedPreceding, -1)
    after = _doc().rowsBetween(1, Window.unboundedFollowing)
    parent, end = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k in LEVELS:
        of = F.greatest(F.lit(None).cast("int"), F.lit(-1), *(F.coalesce(F.last(F.when(F.col("level") == j, F.col("node_seq")), ignorenulls=True).over(before), F.lit(-1)) for j in range(1, k)))
        parent = F.when(F.col("level") == k, of).otherwise(parent)
        end = F.when(F.col("level") == k, F.first(F.when(F.col("level") <= k, F.col("node_seq")), ignorenulls=True).over(after)).otherwise(end)
    total = F.count("*").over(Window.partitionBy("doc_id")).cast("int")
    out = nodes.withColumn("parent_seq", parent).withColumn("subtree_end", F.coalesce(end, total))
    # A parent is a node above: one with a lower level and no lower or equal level of its own in between is the latest.
    return out.withColumn("parent_seq", F.when(F.col("parent_seq") >= 0, F.col("parent_seq"))).withColumn("is_leaf", F.col("subtree_end") == F.col("node_seq") + 1)


def with_subtree_tokens(tree: DataFrame) -> DataFrame:
    """Adds subtree_tokens: of the text with all descendants' texts, a line break between; by prefix sums."""
    cum = F.sum(F.length("text")).over(_doc())
    x = tree.withColumn("cum", cum)
    last = x.select("doc_id", F.col("node_seq").alias("last_seq"), F.col("cum").alias("last_cum"))
    joined = x.withColumn("last_seq", F.col("subtree_end") - 1).join(last, ["doc_id", "last_seq"])
    chars = F.col("last_cum") - F.col("cum") + F.length("text") + F.col("subtree_end") - F.col("node_seq") - 1
    return joined.withColumn("subtree_tokens", F.ceil(chars / 4).cast("int")).drop("cum", "last_cum", "last_seq")


def thin(tree: DataFrame, min_tokens: int = 5000) -> DataFrame:
    """Nodes whose subtree is under min_tokens take up their descendants' texts; these go.

    A node goes if and only if an earlier small node's subtree reaches over it, so no loop is needed.
    """
    x = with_subtree_tokens(tree)
    small = F.col("subtree_tokens") < min_tokens
    reach = F.max(F.when(small, F.col("subtree_end"))).over(_doc().rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("gone", F.coalesce(reach > F.col("node_seq"), F.lit(False)))
    keeper = F.last(F.when(~F.col("gone"), F.col("node_seq")), ignorenulls=True).over(_doc())
    groups = x.withColumn("into", keeper).groupBy("doc_id", "into").agg(F.array_sort(F.collect_list(F.struct("node_seq", "text"))).alias("ts"))
    merged = F.array_join(F.transform(F.filter("ts", lambda t: t.text != ""), lambda t: t.text), "\n\n")
    kept = x.where("not gone").join(groups.select("doc_id", F.col("into").alias("node_seq"), merged.alias("merged")), ["doc_id", "node_seq"])
    kept = kept.select("doc_id", "node_seq", "line_no", "level", "title", "subtree_tokens", F.when(small, F.col("merged")).otherwise(F.col("text")).alias("text"))
    return kept


def with_ids(nodes: DataFrame, first: int = 0) -> DataFrame:
    """Adds node_id: the pre-order number, four digits at least."""
    number = F.row_number().over(_doc()) - 1 + first
    return nodes.withColumn("node_id", X.pad_start(number.cast("string"), 4))


def with_paths(tree: DataFrame) -> DataFrame:
    """Adds depth and path, the node_seqs from the root: at most six levels, so five joins of the keys."""
    own = tree.select("doc_id", "node_seq", "parent_seq")
    path, x = F.array("node_seq"), own.withColumn("up", F.col("parent_seq"))
    x = x.withColumn("path", path)
    for _ in LEVELS[:-1]:
        above = own.select("doc_id", F.col("node_seq").alias("up"), F.col("parent_seq").alias("next"))
        x = x.join(above, ["doc_id", "up"], "left").select("doc_id", "node_seq", F.col("next").alias("up"), F.when(F.col("up").isNotNull(), F.concat(F.array("up"), "path")).otherwise(F.col("path")).alias("path"))
    return tree.join(x.select("doc_id", "node_seq", "path", F.size("path").alias("depth")), ["doc_id", "node_seq"])


def summary_columns(nodes: DataFrame, reply: Column, threshold: int = 200) -> DataFrame:
    """Adds summary (leaves) and prefix_summary (others): short texts as they are, else the model's reply."""
    short = X.token_count(F.col("text")) < threshold
    made = F.when(short, F.col("text")).otherwise(reply)
    return nodes.withColumn("summary", F.when(F.col("is_leaf"), made)).withColumn("prefix_summary", F.when(~F.col("is_leaf"), made))
