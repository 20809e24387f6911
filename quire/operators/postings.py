"""The reverse index: scored postings of section trees, by keywords or by a model's terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X

#: Columns of a node that a posting carries.
NODE = ("doc_id", "node_seq", "node_id", "title", "start_index", "end_index")


def node_text(title: Column, summary: Column, prefix_summary: Column, text: Column) -> Column:
    """The title counts twice; empty parts are skipped."""
    full = lambda c: F.when(c != "", c)
    return F.concat_ws(" ", full(title), full(title), full(summary), full(prefix_summary), full(text))


def with_defaults(nodes: DataFrame) -> DataFrame:
    """Nodes with all columns an index reads; missing ones are null."""
    kinds = {"node_id": "string", "start_index": "int", "end_index": "int", "summary": "string", "prefix_summary": "string", "text": "string"}
    return nodes.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in nodes.columns})


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def term_runs(nodes: DataFrame, min_length: int = 3) -> DataFrame:
    """NODE and `terms`: (term, first_pos, tf) of each node's terms, in order of the terms.

    A node is one row, so its terms are sorted and counted in the row: no text is shuffled. Only where the input has fewer
    partitions than the cluster has cores (a single file) are rows dealt out first.
    """
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    if nodes.rdd.getNumPartitions() < cores:
        nodes = nodes.repartition(cores)
    body = X.tokens(node_text(F.col("title"), F.col("summary"), F.col("prefix_summary"), F.col("text")))
    placed = F.transform(body, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))

    def runs(found: Column) -> Column:
        # Sorted by term and place, a term's tokens are one run; the next run's start tells how many they are.
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0))), lambda i: (i < F.size(found)) & ((i == 0) | (F.get(found, i).term != F.get(found, i - 1).term)))
        one = lambda starts: F.transform(starts, lambda i, k: F.struct(F.get(found, i).term.alias("term"), F.get(found, i).pos.alias("first_pos"), (F.coalesce(F.get(starts, k + 1), F.size(found)) - i).cast("long").alias("tf")))
        return _let(at, one)

    indexed = F.array_sort(F.filter(placed, lambda x: X.index_term(x.term, min_length)))
    return with_defaults(nodes).select(*NODE, _let(indexed, runs).alias("terms"))


def term_frequencies(nodes: DataFrame, min_length: int = 3) -> DataFrame:
    """NODE, term, tf and first_pos."""
    return term_runs(nodes, min_length).select(*NODE, F.inline("terms")).select(*NODE, "term", "tf", "first_pos")


def build_keywords(nodes: DataFrame, per_node: int = 10, min_length: int = 3) -> DataFrame:
    """NODE, term, tf, rank and score = ln(1 + tf) / ln(1 + the node's largest tf); the first per_node terms."""
    ranked = F.array_sort(F.transform("terms", lambda x: F.struct((-x.tf).alias("less"), x.first_pos.alias("first_pos"), x.term.alias("term"), x.tf.alias("tf"))))
    score = lambda x, most: F.log1p(x.tf.cast("double")) / F.log1p(most.cast("double"))
    scored = lambda top: F.transform(top, lambda x, i: F.struct(x.term.alias("term"), x.tf.alias("tf"), (i + 1).alias("rank"), score(x, F.get(top, F.lit(0)).tf).alias("score")))
    return term_runs(nodes, min_length).select(*NODE, F.inline(_let(F.slice(ranked, 1, per_node), scored)))


def llm_terms(reply: Column, most: int = 10) -> Column:
    """Terms of a model's reply: strings in lower case, trimmed, of two characters or more; the first `most`."""
    clean = F.transform(X.json_array(reply), lambda t: X.trimmed(F.lower(t)))
    return F.slice(F.filter(F.coalesce(clean, F.array().cast("array<string>")), lambda t: F.length(t) >= 2), 1, most)


def build_from_terms(nodes: DataFrame, terms: str = "terms") -> DataFrame:
    """NODE, term, rank and score = 1 - (rank - 1) / number of terms, from an array of terms in order."""
    spread = with_defaults(nodes).select(*NODE, F.size(terms).alias("n"), F.posexplode(terms).alias("at", "term"))
    return spread.select(*NODE, "term", (F.col("at") + 1).alias("rank"), (1 - F.col("at") / F.col("n")).alias("score"))


def stats(nodes: DataFrame, postings: DataFrame, mode: str = "keyword") -> DataFrame:
    """One row for each document: distinct terms, nodes, mode and the time."""
    terms = postings.groupBy("doc_id").agg(F.countDistinct("term").alias("total_terms"))
    counted = nodes.groupBy("doc_id").agg(F.count("*").alias("total_nodes"))
    return counted.join(terms, "doc_id", "left").select("doc_id", F.coalesce("total_terms", F.lit(0)).alias("total_terms"), "total_nodes", F.lit(mode).alias("mode"), F.current_timestamp().alias("indexed_at"))


def write_index(postings: DataFrame, table: str, buckets: int = 64) -> None:
    """A table bucketed and sorted by term, so that look-ups and joins on terms read one bucket without a shuffle."""
    postings.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(table)
