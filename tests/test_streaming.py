from quire.streaming import ingest

SCHEMA = "doc_id string, node_seq int, title string, text string"


def test_ingest_twice(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.createDataFrame([("a", 0, "T", "wheat wheat rain"), ("a", 1, "U", "soil")], SCHEMA).write.parquet(src)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(src)
    ingest.start(stream(), out, ck, once=True).awaitTermination()
    assert {r.term for r in ingest.current(spark, out).collect()} == {"wheat", "rain", "soil"}
    spark.createDataFrame([("a", 1, "U", "clay")], SCHEMA).write.mode("append").parquet(src)
    ingest.start(stream(), out, ck, once=True).awaitTermination()
    assert {r.term for r in ingest.current(spark, out).collect()} == {"wheat", "rain", "clay"}


def test_term_counts(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'wheat rain' AS text UNION ALL SELECT timestamp'2024-01-01 00:02:00', 'wheat'").write.parquet(src)
    counts = ingest.term_counts(spark.readStream.schema("ts timestamp, text string").parquet(src), "ts")
    q = counts.writeStream.format("memory").queryName("term_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.term, r.n) for r in spark.sql("SELECT * FROM term_counts").collect()} == {("wheat", 2), ("rain", 1)}
