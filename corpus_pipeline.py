"""From raw documents to token ids: five stages, each over all that the one before kept.

Every stage returns the columns of the documents it is given, whatever their names (the last adds n_tokens and ids, in
place of such columns). Null ids and sources are values like others. A null or empty text goes in the first stage, as it
has no language. Long texts are handled whole; repeated rows are told apart by none of the stages but by their number:
exact_dedup and near_dedup keep one of them, mix takes each by its share. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import bpe, exact, jaccard, langid, mixing
from quire.llm.common import Scratch, bounded, documents, fresh, small

#: Documents whose language is not told with at least this score go, or with half of what nearly all labelled rows of the
#: language and of like length score, where that is less: short texts with thousands of letters score low.
LEAST_SCORE = 0.25
#: Steps of a score that are told apart where bounds are counted.
STEPS = 10_000

#: Vocabulary file and pattern of the encoding; None: byte_bpe_50k of public_tokenizers.
VOCABULARY: str | None = None


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return VOCABULARY or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _band(text: str = "text"):
    """Texts of like length: up to a factor of two."""
    return F.floor(F.log2(F.length(text).cast("double")))


def least_scores(docs: DataFrame, train, ranks: dict[str, list[int]]) -> DataFrame:
    """_lang, _band and _least: the bound of each language for texts of that length, if it is below LEAST_SCORE.

    A length without labelled rows has the language's least bound, at most 64 rows for each language.
    """
    rows = docs.where(train & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", _band().alias("_band"))
    right = langid.predict(rows, ranks).where("lang_pred = lang")
    # How many rows score so much or less, of all labelled ones: the bound is the first step with a twentieth of them.
    steps = right.groupBy("lang", "_band", F.floor(F.col("lang_score") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    of = Window.partitionBy("lang", "_band")
    steps = steps.withColumn("below", F.sum("n").over(of.orderBy("step"))).withColumn("all", F.sum("n").over(of))
    found: dict[str, dict[int, float]] = {}
    with bounded(docs.sparkSession):
        low = steps.where("20 * below >= all").groupBy("lang", "_band").agg(F.min("step").alias("low")).collect()
    for r in low:
        found.setdefault(r.lang, {})[r["_band"]] = r.low / STEPS / 2
    bounds = [(k, band, v.get(band, min(v.values()))) for k, v in found.items() for band in range(64)]
    return docs.sparkSession.createDataFrame([b for b in bounds if b[2] < LEAST_SCORE], "_lang string, _band long, _least double")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters, or unlike all learned ones.

    Only ids and hashes of the texts that go are written: the rows that stay are read from their table.
    """
    train = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2, F.lit(True))
    ranks = langid.fit(docs, train, most=None)
    some = docs.where(F.length("text") > 0)
    rows = some.select("doc_id", F.xxhash64("text").alias("row"), _band().alias("band"), "text")
    found = langid.predict(rows, ranks, kept=["doc_id", "row", "band"])
    bounds = F.broadcast(least_scores(docs, train, ranks))
    found = found.join(bounds, (F.col("lang_pred") == F.col("_lang")) & (F.col("band") == F.col("_band")), "left")
    unlike = (F.col("lang_pred") == "und") | (F.col("lang_score") < F.coalesce("_least", F.lit(LEAST_SCORE)))
    own, of = fresh(docs, "id", "row")
    gone = Scratch(spark).write(found.where(unlike).select(F.col("doc_id").alias(own), F.col("row").alias(of)).distinct(), "unlike")
    return some.join(small(gone), F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(of)), "left_anti").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of equal texts."""
    return exact.distinct_documents(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return jaccard.one_of_each(docs, part=4, whole=5, size=5).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their number; the text is what the ids decode to."""
    vocabulary, pattern = _vocabulary()
    kept = [c for c in docs.columns if c not in ("n_tokens", "ids")]
    (decoded,) = fresh(docs, "decoded")
    # Each way is written, so that a task holds the vocabulary in one worker at a time.
    scratch, steps = Scratch(spark), Scratch(spark)
    ids = steps.write(bpe.encode(docs.select(*kept), vocabulary, pattern, scratch=steps).drop("text"), "ids")
    back = bpe.decode(ids, vocabulary, pattern, out=decoded).withColumn("text", F.col(decoded).cast("string"))
    found = scratch.write(back.select(*kept, F.size("ids").cast("long").alias("n_tokens"), "ids"), "encode")
    steps.clear()
    return found


STAGES = [("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: Stages with Python in their last step: they write it themselves, so that batches are bounded under any caller's settings.
WRITTEN = {"encode"}

#: Language profiles, random rounding and byte pairs have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written before the next; then what the one before wrote goes."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        scratch, docs = Scratch(spark), stage(spark, docs, sf_dir)
        if name not in WRITTEN:
            docs = scratch.write(docs, name)
        if before:
            before.clear()
        before = scratch
    return docs
