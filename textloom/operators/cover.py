"""Greedy vocabulary cover and curricula."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import units as U
from ..sources.files import shared_folder
from .joins import small


def minimal(df: DataFrame, wordlist: DataFrame, id_cols: list[str], col: str = "line", restrict_search_to: int = 50, per_word: int = 3, sort_by_length: bool = False) -> DataFrame:
    """(word, rank, nth, ...row): for each word of the list (rank, word), up to per_word rows that it makes
    readable once the words before it are known, among the first restrict_search_to such rows.

    A row becomes readable at the highest rank of its words, if all are in the list; so no loop is needed.
    """
    ranks = wordlist.groupBy("word").agg(F.min("rank").alias("rank"))
    ws = df.select(*id_cols, F.explode(F.array_distinct(U.cleaned_words(col))).alias("word")).join(small(ranks), "word", "left")
    at = ws.groupBy(*id_cols).agg(F.max(F.struct("rank", "word")).alias("m"), F.bool_and(F.col("rank").isNotNull()).alias("all")).filter("all").select(*id_cols, F.col("m.rank").alias("rank"), F.col("m.word").alias("word"))
    x = df.join(at, id_cols)
    x = x.withColumn("__i", F.row_number().over(Window.partitionBy("rank").orderBy(*id_cols))).filter(F.col("__i") <= restrict_search_to)
    order = [F.octet_length(col), *id_cols] if sort_by_length else id_cols
    return x.withColumn("nth", F.row_number().over(Window.partitionBy("rank").orderBy(*order)).cast("long")).filter(F.col("nth") <= per_word).drop("__i")


def curriculum(df: DataFrame, id_cols: list[str], col: str = "line", existing: DataFrame | None = None, desired: DataFrame | None = None, start: int = 26, max_rounds: int | None = None) -> list[list[str]]:
    """Rounds of words to learn: in each, the words that are the only unknown one of some line, those first
    that then leave most lines with one unknown word (or that come early in desired), half of `start` plus
    the words learnt so far. Ends when no line has just one unknown word, or after max_rounds if given.

    Only the words of a round come to the driver; what remains of the lines is checkpointed each round.
    """
    words = df.select(*id_cols, F.explode(F.array_distinct(U.words(col))).alias("word"))
    if existing is not None:
        words = words.join(small(existing.select("word").distinct()), "word", "left_anti")
    spark = df.sparkSession
    shared_folder(spark)
    out: list[list[str]] = []
    total = start
    while max_rounds is None or len(out) < max_rounds:
        words = words.checkpoint()
        sizes = words.groupBy(*id_cols).agg(F.count("*").alias("n")).filter("n <= 2")
        near = words.join(sizes, id_cols).groupBy("word").agg(F.max(F.col("n") == 1).alias("only"), F.sum(F.when(F.col("n") == 2, 1).otherwise(0)).alias("two")).filter("only")
        if desired is not None:
            top = desired.agg(F.max("rank").alias("m"))
            near = near.join(desired.groupBy("word").agg(F.min("rank").alias("rank")), "word", "left").crossJoin(F.broadcast(top)).withColumn("two", F.col("two") + F.coalesce((F.col("m") + 1 - F.col("rank")) * 20_000, F.lit(0)))
        got = [r.word for r in near.orderBy(F.desc("two"), "word").limit(max(1, total // 2)).collect()]
        if not got:
            break
        out.append(got)
        total += len(got)
        words = words.join(small(spark.createDataFrame([(w,) for w in got], "word string")), "word", "left_anti")
    return out
