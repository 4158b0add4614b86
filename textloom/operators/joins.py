"""Lookups and set membership: recover, known words, containment, overlap."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import units as U

#: Bytes of a word list up to which it is sent to all workers instead of being joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if the optimiser's estimate of its size is within limit."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if 0 <= size <= limit else df


def recover(probe: DataFrame, build: DataFrame, key_column: int = 0, sep: str = "\t", probe_col: str = "key", build_col: str = "line", build_order: str = "line_no") -> DataFrame:
    """For each probe row the build line whose key column equals it; of several, the last. Misses go."""
    parts = F.split(F.col(build_col), re.escape(sep), -1)
    table = build.filter(F.contains(F.col(build_col), F.lit(sep))).select(F.get(parts, F.lit(key_column)).alias("__key"), F.col(build_col).alias("__line"), F.col(build_order).alias("__at")).filter("__key IS NOT NULL")
    table = table.groupBy("__key").agg(F.max_by("__line", "__at").alias("recovered"))
    return probe.join(table, probe[probe_col] == table["__key"]).drop("__key")


def _exploded(df: DataFrame, id_cols: list[str], ws) -> DataFrame:
    return df.select(*id_cols, F.explode(F.array_distinct(ws)).alias("word"))


def known_words(df: DataFrame, allowed: DataFrame, id_cols: list[str], col: str = "line", truncate: int | None = None, max_unknown: int = 0) -> DataFrame:
    """Rows with at most max_unknown distinct cleaned words outside the first `truncate` of allowed
    (rank, word); rows without words stay."""
    if truncate is not None:
        allowed = allowed.filter(F.col("rank") <= truncate)
    unknown = _exploded(df, id_cols, U.cleaned_words(col)).join(small(allowed.select("word").distinct()), "word", "left_anti")
    over = unknown.groupBy(*id_cols).agg(F.count("*").alias("__n")).filter(F.col("__n") > max_unknown)
    return df.join(over.drop("__n"), id_cols, "left_anti")


def contained(df: DataFrame, known: DataFrame, desired: DataFrame, id_cols: list[str], col: str = "line") -> DataFrame:
    """Rows whose words are all known or desired, and at least one of them desired."""
    vocabulary = known.select("word", F.lit(False).alias("want")).unionByName(desired.select("word", F.lit(True).alias("want"))).groupBy("word").agg(F.max("want").alias("want"))
    ws = _exploded(df, id_cols, U.words(col)).join(small(vocabulary), "word", "left")
    ok = ws.groupBy(*id_cols).agg(F.bool_and(F.col("want").isNotNull()).alias("__all"), F.bool_or(F.coalesce("want", F.lit(False))).alias("__any")).filter("__all AND __any")
    return df.join(ok.select(*id_cols), id_cols, "left_semi")


def focus_queries(df: DataFrame, requests: DataFrame, id_cols: list[str], col: str = "line") -> DataFrame:
    """For each request (request_id, focus, known array) the rows that hold the focus word and otherwise
    only known words: request_id with the row's columns."""
    rows = df.withColumn("__ws", F.array_distinct(U.words(col)))
    hits = rows.select("*", F.explode("__ws").alias("__focus")).join(small(requests.select("request_id", F.col("focus").alias("__focus"), "known")), "__focus")
    return hits.filter(F.size(F.array_except("__ws", F.concat("known", F.array("__focus")))) == 0).drop("__ws", "__focus", "known")


def parse_request(x) -> tuple:
    """focus and known of a request `focus|||known1||known2`."""
    parts = F.split(U.c(x), r"\|\|\|", -1)
    return F.get(parts, F.lit(0)).alias("focus"), U.full_tokens(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\|\|").alias("known")


def overlap_join(df: DataFrame, id_col: str, ws) -> DataFrame:
    """(a, b, overlap) for pairs a < b of rows that share a word; overlap is one more than the number of
    shared distinct words.

    An equi-join on exploded words, so pairs without a common word are never formed.
    """
    x = df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(ws)).alias("word"))
    pairs = x.select(F.col("id").alias("a"), "word").join(x.select(F.col("id").alias("b"), "word"), "word").filter("a < b")
    return pairs.groupBy("a", "b").agg((F.count("*") + 1).alias("overlap"))


#: Rows that all pairs of are compared at most.
MAX_PAIRED = 5000


def pairwise_diff(pairs: DataFrame) -> DataFrame:
    """(p1, p2, score): evidence that word p1 of one side matches p2 of the other, over all i < j of pairs
    (id, lw array, rw array): words that two rows share on both sides, or that both lack, speak for it,
    mixed ones against it."""
    if (n := pairs.count()) > MAX_PAIRED:
        raise ValueError(f"{n} rows; all pairs are compared for up to {MAX_PAIRED}")
    a, b = (pairs.select(F.col("id").alias(f"id{k}"), F.array_distinct("lw").alias(f"l{k}"), F.array_distinct("rw").alias(f"r{k}")) for k in "ab")
    x = a.join(b, F.col("ida") < F.col("idb"))
    x = x.select(F.array_except("la", "lb").alias("dl"), F.array_except("ra", "rb").alias("dr"), F.array_intersect("la", "lb").alias("sl"), F.array_intersect("ra", "rb").alias("sr"))
    n = {k: F.size(k).cast("double") for k in ("dl", "dr", "sl", "sr")}
    kinds = [("dl", "dr", lambda: 1.0 / (n["dl"] * n["dr"])), ("sl", "sr", lambda: 1.0 / (n["sl"] * n["sr"])), ("dl", "sr", lambda: -1.0 + 1.0 / (n["dl"] + n["sr"])), ("sl", "dr", lambda: -1.0 + 1.0 / (n["sl"] + n["dr"]))]
    out = None
    for p, q, weight in kinds:
        y = x.filter((F.size(p) > 0) & (F.size(q) > 0)).withColumn("w", weight()).select(F.explode(p).alias("p1"), q, "w").select("p1", F.explode(q).alias("p2"), "w")
        out = y if out is None else out.unionByName(y)
    return out.groupBy("p1", "p2").agg(F.sum("w").alias("score"))


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str, name: str = "value") -> DataFrame:
    """left with `name`: the value of the right row of the same key with the latest time not after the left
    row's; of equal times the largest value; null without one. One exchange on the key, no pairs."""
    kept = [F.col(c) for c in left.columns]
    a = left.select(F.col(key).alias("__k"), F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.struct(*kept).alias("__row"))
    b = right.select(F.col(key).alias("__k"), F.col(time).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"))
    w = Window.partitionBy("__k").orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = a.unionByName(b).withColumn(name, F.last("__v", ignorenulls=True).over(w)).filter("__side = 1")
    return x.select("__row.*", name)
