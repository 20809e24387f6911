"""What the operators share: word rules, row ids of hashed text, and written intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch of rows that a written step hands to Python.
BATCH = 2 << 20
#: Rows that a scan of written tables holds at once, as values can be large.
SCANNED = 256
#: Settings of a written table's files: after so many rows a page's and a row group's size is looked at, as single values
#: can take half a megabyte and a codec holds a whole page twice, and a row group of a task takes so much memory.
PAGES = {"parquet.page.size.row.check.min": "16", "parquet.block.size.row.check.min": "16", "parquet.block.size": str(32 << 20)}
#: Rows of ids and hashes that are broadcast at most.
SMALL = 200_000
#: White space of the word rules: space and 0x09-0x0D.
WS = r"[\x20\x09-\x0D]"
NON_WS = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words as a long: starts of runs that are not white space; null counts as empty."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"{NON_WS}++{WS}*+|{WS}++", "x")) - F.when(
        F.coalesce(text, F.lit("")).rlike(f"^{WS}"), 1
    ).otherwise(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, the folder that driver and executors share.

    Only where all run on one machine, as in tests, a folder of this machine is taken if none is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"


def small(df: DataFrame) -> DataFrame:
    """A written table of a few short columns, broadcast where it has at most SMALL rows; else joined by a shuffle."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bounded(spark: SparkSession):
    """While this is open, batches that Python is sent and that a scan holds have a bounded size, and shuffle files go at once."""
    return _conf(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH), "spark.sql.parquet.columnarReaderBatchSize": str(SCANNED)})


class Scratch:
    """Tables written between the steps of one operator, so that later steps read them and not the whole lineage.

    A lost executor then costs only the step under way. Shuffle files of the written step are given free at once.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, scratch_dir(spark), 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        with bounded(self.spark):
            df.write.options(**PAGES).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that no later step reads."""
        for t in tables:
            for f in {x.rsplit("/", 1)[0] for x in t.inputFiles()}:
                self._remove(f)
        gc.collect()

    def clear(self) -> None:
        """Removes all its tables, where no later step reads any."""
        self._remove(self.root)
        gc.collect()

    def _remove(self, folder: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
