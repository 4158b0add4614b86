"""Lines and key-value requests as Structured Streaming queries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import shared_folder


def line_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The lines of text files as they appear in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path).withColumnRenamed("value", "line")


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream of its files."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def dedup_stream(df: DataFrame, keys: list[str], time_col: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each key to arrive; with a time column state is kept for `delay` only."""
    return df.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys) if time_col else df.dropDuplicates(keys)


def window_counts(df: DataFrame, time_col: str, key: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return df.withWatermark(time_col, delay).groupBy(F.window(time_col, window), key).agg(F.count("*").alias("n"))


def kv_stream(df: DataFrame) -> DataFrame:
    """(key, value, seq) after each batch for the keys in it, from puts (key, value, seq); the state holds
    the last value of each key."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, seq = state.get if state.exists else (None, -(2**63))
        for pdf in rows:
            i = pdf["seq"].idxmax()
            if pdf["seq"][i] > seq:
                value, seq = pdf["value"][i], int(pdf["seq"][i])
        state.update((value, seq))
        yield pd.DataFrame({"key": [key[0]], "value": [value], "seq": [seq]})

    kind = df.schema["key"].dataType.simpleString()
    return df.select("key", "value", "seq").groupBy("key").applyInPandasWithState(step, f"key {kind}, value string, seq long", "value string, seq long", "append", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, root: str | None = None) -> DataFrame:
    """Runs an append stream over all that is there and returns what it wrote below root (by default the shared folder)."""
    at = f"{root or shared_folder(df.sparkSession)}/textloom-stream-{uuid.uuid4().hex}"
    df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/log").option("path", f"{at}/rows").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/rows")
