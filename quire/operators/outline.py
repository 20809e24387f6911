"""Tables of contents and page ranges: the relational part of finding a document's structure.

Items are rows (doc_id, list_index, structure, title, page, physical_index, appear_start); pages are rows (doc_id,
page_no, text, token_count). Everything is keyed by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X



def _items():
    return Window.partitionBy("doc_id").orderBy("list_index")


def located_pairs(items: DataFrame, located: DataFrame, start_page: int = 0) -> DataFrame:
    """Items with the physical index of located items of exactly their title, from a page on; repeats multiply."""
    found = located.where(F.col("physical_index") >= start_page).select("doc_id", "title", F.col("physical_index").alias("found_index"))
    return items.join(found, ["doc_id", "title"]).select("doc_id", "list_index", "title", "page", F.col("found_index").alias("physical_index"))


def page_offset(pairs: DataFrame) -> DataFrame:
    """doc_id and offset: the most frequent physical_index - page; of ties the least of 0 and more, else the first met."""
    diff = F.col("physical_index") - F.col("page")
    counted = pairs.where(diff.isNotNull()).groupBy("doc_id", diff.alias("diff")).agg(F.count("*").alias("n"), F.min("list_index").alias("first"))
    tie = F.when(F.col("diff") >= 0, F.col("diff")).otherwise(F.col("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), F.col("diff") < 0, tie))
    return counted.withColumn("r", rank).where("r = 1").select("doc_id", F.col("diff").alias("offset"))


def apply_offset(items: DataFrame, offsets: DataFrame) -> DataFrame:
    joined = items.join(offsets, "doc_id", "left")
    return joined.withColumn("physical_index", F.when(F.col("page").isNotNull(), F.col("page") + F.col("offset")).otherwise(F.col("physical_index"))).drop("offset")


def drop_beyond(items: DataFrame, page_counts: DataFrame, start_index: int = 1) -> DataFrame:
    """Page references after a document's end become null."""
    last = F.col("n_pages") + start_index - 1
    joined = items.join(page_counts, "doc_id", "left")
    return joined.withColumn("physical_index", F.when(F.col("physical_index") <= last, F.col("physical_index"))).drop("n_pages")


def neighbour_bounds(items: DataFrame, page_counts: DataFrame, start_index: int = 1, usable: Column | None = None, low: int = 0) -> DataFrame:
    """Adds prev_index and next_index: the nearest items with a page before and after (usable: that may serve)."""
    known = F.when(F.lit(True) if usable is None else usable, F.col("physical_index"))
    before = F.last(known, ignorenulls=True).over(_items().rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(known, ignorenulls=True).over(_items().rowsBetween(1, Window.unboundedFollowing))
    joined = items.join(page_counts, "doc_id", "left")
    return joined.withColumn("prev_index", F.coalesce(before, F.lit(low))).withColumn("next_index", F.coalesce(after, F.col("n_pages") + start_index - 1)).drop("n_pages")


def with_preface(items: DataFrame) -> DataFrame:
    """Puts a preface at page 1 before documents whose first item starts later."""
    first = F.row_number().over(_items())
    late = items.withColumn("r", first).where("r = 1 and physical_index > 1")
    row = late.select(*(F.lit({"structure": "0", "title": "Preface", "physical_index": 1, "list_index": -1}.get(c)).cast(items.schema[c].dataType).alias(c) if c != "doc_id" else F.col(c) for c in items.columns))
    return items.unionByName(row)


def ranges(items: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Adds start_index and end_index: up to the next item's page, or the one before if that item starts its page.

    An end may lie before its start, where two items start one page; readers of ranges guard against it.
    """
    nxt = F.lead("physical_index").over(_items())
    has_next = F.lead(F.lit(1)).over(_items()).isNotNull()
    starts = F.coalesce(F.lead("appear_start").over(_items()) == "yes", F.lit(False))
    end = F.when(has_next & starts, F.coalesce(nxt, F.lit(1)) - 1).when(has_next, nxt).otherwise(F.col("n_pages"))
    joined = items.join(page_counts, "doc_id", "left")
    return joined.withColumn("start_index", F.col("physical_index")).withColumn("end_index", end).drop("n_pages")


def with_parents(items: DataFrame) -> DataFrame:
    """Adds parent_index: the latest earlier item whose code is this one's without its last part; else null."""
    code = F.when(F.col("structure").contains("."), F.regexp_replace("structure", r"\.[^.]*$", ""))
    above = items.select("doc_id", F.col("structure").alias("parent_code"), F.col("list_index").alias("above"))
    pairs = items.select("doc_id", "list_index", code.alias("parent_code")).join(above, ["doc_id", "parent_code"]).where("above < list_index")
    latest = pairs.groupBy("doc_id", "list_index").agg(F.max("above").alias("parent_index"))
    return items.join(latest, ["doc_id", "list_index"], "left")


def with_paths(items: DataFrame) -> DataFrame:
    """Adds path, the list indexes from the root, and pre-order node_id.

    A parent's code is one part shorter, so the longest code of an item with a parent tells how many joins reach all
    roots; finding it runs the plan of the items once.
    """
    parts = F.when(F.col("parent_index").isNotNull(), F.size(F.split("structure", r"\.")))
    depth = items.agg(F.max(parts)).first()[0] or 1
    own = items.select("doc_id", "list_index", "parent_index")
    x = own.select("doc_id", "list_index", F.col("parent_index").alias("up"), F.array("list_index").alias("path"))
    for _ in range(depth - 1):
        above = own.select("doc_id", F.col("list_index").alias("up"), F.col("parent_index").alias("next"))
        x = x.join(above, ["doc_id", "up"], "left").select("doc_id", "list_index", F.col("next").alias("up"), F.when(F.col("up").isNotNull(), F.concat(F.array("up"), "path")).otherwise(F.col("path")).alias("path"))
    out = items.join(x.select("doc_id", "list_index", "path"), ["doc_id", "list_index"])
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1
    return out.withColumn("node_seq", number).withColumn("node_id", X.pad_start(number.cast("string"), 4))


def range_text(nodes: DataFrame, pages: DataFrame, tagged: bool = False, key: tuple[str, ...] = ("doc_id", "list_index")) -> DataFrame:
    """key and text: the pages of a range one after the other. Ranges are exploded, so the join is on equal pages."""
    span = F.when(F.col("start_index") <= F.col("end_index"), F.sequence(F.col("start_index").cast("int"), F.col("end_index").cast("int")))
    wanted = nodes.select(*key, F.explode(span).alias("page_no"))
    text = X.page_tag(F.col("page_no"), F.col("text")) if tagged else F.col("text")
    found = wanted.join(pages.select("doc_id", "page_no", text.alias("text")), ["doc_id", "page_no"])
    joined = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("ps"))
    texts = joined.select(*key, F.array_join(F.transform("ps", lambda p: p.text), "").alias("text"))
    return nodes.select(*key).join(texts, list(key), "left").select(*key, F.coalesce("text", F.lit("")).alias("text"))


def range_tokens(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds tokens of a range, as the difference of two prefix sums: two joins on equal pages, no range join."""
    total = F.sum("token_count").over(Window.partitionBy("doc_id").orderBy("page_no"))
    sums = pages.select("doc_id", F.col("page_no"), total.alias("total"))
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("n_pages"))
    x = nodes.join(last, "doc_id", "left").withColumn("hi", F.least("end_index", "n_pages")).withColumn("lo", F.col("start_index") - 1)
    for c in ("hi", "lo"):
        x = x.join(sums.select("doc_id", F.col("page_no").alias(c), F.col("total").alias(f"{c}_sum")), ["doc_id", c], "left")
    value = F.when(F.col("start_index") <= F.col("hi"), F.coalesce("hi_sum", F.lit(0)) - F.coalesce("lo_sum", F.lit(0))).otherwise(0)
    return x.withColumn("tokens", value).drop("n_pages", "hi", "lo", "hi_sum", "lo_sum")


def large(nodes: DataFrame, pages: DataFrame, max_pages: int = 10, max_tokens: int = 20000) -> DataFrame:
    """Nodes over both limits, which are refined."""
    return range_tokens(nodes, pages).where((F.col("end_index") - F.col("start_index") > max_pages) & (F.col("tokens") >= max_tokens))


def page_groups(pages: DataFrame, max_tokens: int = 20000, overlap: int = 1) -> DataFrame:
    """doc_id, group_no and page_nos: pages packed in order to about max_tokens, each group repeating the last page.

    A fold over each document's page sizes, in one row for a document.
    """
    packed = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", F.col("token_count").cast("int").alias("t")))).alias("ps"))
    total = F.aggregate("ps", F.lit(0), lambda a, p: a + p.t)
    packed = packed.withColumn("total", total).withColumn("avg", F.ceil((F.col("total") / F.ceil(F.col("total") / max_tokens) + max_tokens) / 2))
    empty = F.array().cast("array<int>")
    start = F.struct(F.array().cast("array<array<int>>").alias("done"), empty.alias("now"), F.array().cast("array<int>").alias("sizes"))

    def step(a, p):
        over = F.aggregate(a.sizes, F.lit(0), lambda x, y: x + y) + p.t > F.col("avg")
        tail = lambda xs: F.slice(xs, F.greatest(F.size(xs) - overlap + 1, F.lit(1)), F.lit(overlap))
        # The page before is the last of the group, or of the group emitted before it.
        done = F.when(over, F.concat(a.done, F.array(a.now))).otherwise(a.done)
        now = F.when(over, tail(a.now)).otherwise(a.now)
        sizes = F.when(over, tail(a.sizes)).otherwise(a.sizes)
        return F.struct(done.alias("done"), F.concat(now, F.array(p.page_no.cast("int"))).alias("now"), F.concat(sizes, F.array(p.t)).alias("sizes"))

    folded = F.aggregate("ps", start, step, lambda a: F.when(F.size(a.now) > 0, F.concat(a.done, F.array(a.now))).otherwise(a.done))
    whole = F.array(F.transform("ps", lambda p: p.page_no.cast("int")))
    groups = F.when(F.col("total") <= max_tokens, whole).otherwise(folded)
    return packed.select("doc_id", F.posexplode(groups).alias("group_no", "page_nos"))


def accuracy(checks: DataFrame) -> DataFrame:
    """doc_id and the share of answers that are yes; 0 where none was checked."""
    return checks.groupBy("doc_id").agg(F.coalesce(F.avg(F.when(F.col("answer") == "yes", 1.0).when(F.col("answer").isNotNull(), 0.0)), F.lit(0.0)).alias("accuracy"))


def last_page(items: DataFrame) -> DataFrame:
    """doc_id and the page of the last item that has one."""
    return items.where("physical_index is not null").groupBy("doc_id").agg(F.max_by("physical_index", "list_index").alias("last_page"))


def toc_pages(flags: DataFrame, check_pages: int = 20) -> DataFrame:
    """The run of pages that look like a table of contents, of (doc_id, page_no, answer).

    It starts at the first yes within check_pages, goes on as long as pages say yes (other answers are passed over)
    and ends at the first no.
    """
    order = Window.partitionBy("doc_id").orderBy("page_no")
    said = flags.where(F.col("answer").isin("yes", "no"))
    first = F.min(F.when((F.col("answer") == "yes") & (F.col("page_no") <= check_pages), F.col("page_no"))).over(Window.partitionBy("doc_id"))
    after = said.withColumn("first", first).where(F.col("page_no") >= F.col("first"))
    ended = F.sum((F.col("answer") == "no").cast("int")).over(order)
    return after.withColumn("ended", ended).where("ended = 0").select("doc_id", "page_no")


def put_back(items: DataFrame, fixes: DataFrame) -> DataFrame:
    """Items with the pages of fixes (doc_id, list_index, physical_index) where there are such."""
    new = fixes.select("doc_id", "list_index", F.col("physical_index").alias("fixed"))
    return items.join(new, ["doc_id", "list_index"], "left").withColumn("physical_index", F.coalesce("fixed", "physical_index")).drop("fixed")
