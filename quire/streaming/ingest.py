"""New documents into a keyword index as they arrive: an extension beyond batch builds.

A stream of nodes (doc_id, node_seq, title, text, ...) is turned into postings batch by batch. Each batch is written
under its own number, replacing what a failed try left, so a repeated batch changes nothing; of a node that arrives
again, readers take the postings of the latest batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import postings


def start(nodes: DataFrame, path: str, checkpoint: str, per_node: int = 10, once: bool = False) -> StreamingQuery:
    """Starts the stream; postings go to path/batch=N. once: what is there now, then stop."""

    def put(batch: DataFrame, number: int) -> None:
        found = postings.build_keywords(postings.with_defaults(batch), per_node)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = nodes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark, path: str) -> DataFrame:
    """The postings of each node's latest batch."""
    every = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    latest = F.max("batch").over(Window.partitionBy("doc_id", "node_seq"))
    return every.withColumn("latest", latest).where("batch = latest").drop("batch", "latest")


def term_counts(nodes: DataFrame, event_time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """A stream's terms by time window, with late rows up to the watermark."""
    from quire.functions import text as X

    timed = nodes.withWatermark(event_time, late).select(F.window(event_time, window).alias("w"), F.explode(X.tokens(F.col("text"))).alias("term"))
    return timed.where(X.index_term(F.col("term"), 3)).groupBy("w", "term").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "term", "n")
