"""One query for each operator: whole tables, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import documents

ORACLES: dict[str, str] = {}


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm import bpe

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ids = bpe.encode(docs, vocabulary, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(ids, vocabulary, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import exact

    found = exact.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


ORACLES["op1_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import repeats

    found = repeats.remove(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op2_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
firsts AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (k) WHERE least < doc_id),
words AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import lm

    def held_out(doc_id):
        return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))

    scored = lm.score(documents(spark, sf_dir).select("doc_id", "text"), ~held_out(F.col("doc_id")))
    return scored.withColumn("held_out", held_out(F.col("doc_id")))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import topk

    vectors = topk.quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


ORACLES["op4_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p
)
SELECT * FROM r WHERE rank <= 10
"""


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import mixing

    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import langid

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    profiles = langid.fit(docs, ~held_out)
    found = langid.predict(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import jaccard

    found = jaccard.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), part=9, whole=10, size=3)
    return found.select("doc_id", "n_shingles", "component_id")


ORACLES["op7_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT r, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS g
  FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
both_ AS (SELECT a.r AS a, b.r AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY 1) c USING (r)
"""


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import licenses

    def labels(found):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x.label))), ",")

    base = F.filter("license_matches", lambda x: x.phrase)
    starts = F.transform(base, lambda x: x.start)
    return licenses.scan(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id",
        F.col("license_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("license_matches")).alias("labels"),
        F.col("license_score").alias("score"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm import secrets

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")

    def count(kind):
        return F.size(F.filter("found", lambda x: x.kind == kind))

    base = F.filter("found", lambda x: x.kind.isin("assign", "access", "hex"))
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"), out="found")
    return found.select(
        "doc_id",
        *(count(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [op1_exact_dedup, op2_substring_dedup, op3_lm_score, op4_top_k, op5_mix_sources, op6_language_id, op7_jaccard_join, op8_license_scan, op9_secret_scan, op10_byte_bpe]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
