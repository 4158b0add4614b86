"""Inputs, shared work folders and batch limits used by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; with the byte limit below it bounds what a Python worker holds.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, since documents may be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def workdir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; below the warehouse where that is unset, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: While it is set, a query's shuffle files go when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stored:
    """Tables written into the shared folder, so that lost executors don't cost what came before them.

    They go when they are dropped, or else when the driver's Python ends: results that are read later
    may still need them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{workdir(spark)}/textloom-{uuid.uuid4().hex}", 0
        atexit.register(self.close)

    def keep(self, df: DataFrame) -> DataFrame:
        """df, computed once: written as Parquet and read back with the schema it had. What was shuffled on the way goes."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_at = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in dfs:
            self._delete(df._stored_at)

    def close(self) -> None:
        """Delete all tables, if Spark still runs."""
        with contextlib.suppress(Exception):
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def as_text(df: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """Only the id and the text (null: empty) under fixed names, so that other columns can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


#: Rows of a few numbers that are broadcast at most; more are joined by an exchange.
SMALL_ROWS = 4_000_000


def small(df: DataFrame) -> DataFrame:
    """df with a hint to broadcast it, if a count says that it has no more than SMALL_ROWS rows."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df
