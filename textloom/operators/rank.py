"""Ranking: global positions, rank aggregation of pairs, weighted vocabularies, first occurrences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import units as U
from .aggregate import char_range, doc_freq_weight, vocabulary
from .joins import small


#: Rows that are numbered in one task, and rows that range borders are chosen from, about.
RANGE_ROWS, SAMPLED = 200_000, 20_000


def global_rank(df: DataFrame, key: str, tie: str, name: str = "rank", descending: bool = False, group: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds the 0-based position by a number, then by tie; nulls and NaN last; within each group, if given.

    Rows are cut into ranges of about range_rows rows by (group, number, tie), so equal numbers are spread
    over ranges like others, numbered in each range, and shifted by the counts of the ranges before. The
    borders are chosen from about SAMPLED rows; no task sees all rows.
    """
    v = F.when(F.isnan(F.col(key).cast("double")), None).otherwise(F.col(key).cast("double"))
    v = -v if descending else v
    x = df.withColumn("__o", F.struct((F.col(group) if group else F.lit(0)).alias("g"), v.isNull().alias("none"), F.coalesce(v, F.lit(0.0)).alias("v"), F.col(tie).alias("t")))
    splits = (n := x.count()) // range_rows + 1
    bucket = F.lit(0)
    if splits > 1:
        every = max(1, n // SAMPLED)
        sample = sorted({tuple(r[0]) for r in x.filter(F.pmod(F.xxhash64("__o"), F.lit(every)) == 0).select("__o").filter("__o.t IS NOT NULL").collect()})
        cuts = sorted({sample[i * len(sample) // splits] for i in range(1, splits)}) if sample else []
        kind = df.sparkSession.createDataFrame([(cuts,)], f"__cuts array<{x.schema['__o'].dataType.simpleString()}>")
        x = x.crossJoin(F.broadcast(kind))  # one row with a border for each range
        bucket = F.size(F.filter("__cuts", lambda c: c <= F.col("__o")))
    x = x.withColumn("__b", bucket)
    counts = x.groupBy("__o.g", "__b").agg(F.count("*").alias("__n"))
    # a row for each range, and for each group that a range holds
    before = counts.select(F.col("g").alias("__g"), F.col("__b").alias("__b2"), (F.sum("__n").over(Window.partitionBy("g").orderBy("__b")) - F.col("__n")).alias("__at"))
    nth = F.row_number().over(Window.partitionBy("__b", "__o.g").orderBy("__o"))
    x = x.withColumn("__i", nth).join(F.broadcast(before), F.col("__o.g").eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__b2")))
    return x.select(*df.columns, (F.col("__at") + F.col("__i") - 1).alias(name))


def keep_first(df: DataFrame, key: list, order: list[str]) -> DataFrame:
    """The first row of each key in an order, by one aggregation rather than a sort."""
    cols = df.columns
    named = [F.col(k).alias(f"__k{i}") if isinstance(k, str) else k.alias(f"__k{i}") for i, k in enumerate(key)]
    out = df.select(*named, F.struct(*order).alias("__o"), F.struct(*cols).alias("__row")).groupBy(*(f"__k{i}" for i in range(len(key)))).agg(F.min_by("__row", "__o").alias("__row"))
    return out.select("__row.*")


def dedup(df: DataFrame, col: str = "line", order: list[str] | None = None, no_punct: bool = False) -> DataFrame:
    """The first of equal lines; no_punct compares them without ASCII punctuation."""
    key = F.regexp_replace(col, U.ASCII_PUNCTUATION, "") if no_punct else F.col(col)
    return keep_first(df, [key], order or ["doc_id", "line_no"])


def cardinalise(counts: DataFrame) -> DataFrame:
    """(word, n, rank): positions of words by rising count."""
    return global_rank(counts, "n", "word")


def frqsort(df: DataFrame, id_cols: list[str], col: str = "line") -> DataFrame:
    """Adds `score`: the highest rank of a line's parts, of which rarer ones have lower ranks."""
    ws = F.transform(U.space_tokens(col), lambda w: F.regexp_replace(w, U.ASCII_PUNCTUATION, ""))
    x = df.select(*id_cols, F.explode(ws).alias("word"))
    ranks = cardinalise(x.groupBy("word").agg(F.count("*").alias("n")))
    best = x.join(ranks.select("word", "rank"), "word").groupBy(*id_cols).agg(F.max("rank").alias("score"))
    return df.join(best, id_cols)


def subset(df: DataFrame, wordlist: DataFrame, id_cols: list[str], col: str = "line") -> DataFrame:
    """Adds `score`: the weights of a line's distinct words, those outside the list counted negative."""
    weights = doc_freq_weight(df, col).join(small(wordlist.select("word", F.lit(1).alias("known")).distinct()), "word", "left")
    x = df.select(*id_cols, F.explode(F.array_distinct(U.words(col))).alias("word")).join(weights, "word")
    s = x.groupBy(*id_cols).agg(F.sum(F.when(F.col("known").isNotNull(), F.col("weight")).otherwise(-F.col("weight"))).alias("score"))
    return df.join(s, id_cols, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def _both(f: Callable[[str], Column]) -> Column:
    return f("l") + f("r")


def redundancy() -> Column:
    return _both(lambda s: U.bound(U.cased_words(s), lambda xs: U.ratio(F.size(U.runs_once(xs)), F.size(xs))))


def translated_partial() -> Column:
    ws = F.concat(U.cased_words("l"), U.cased_words("r"))
    return U.bound(ws, lambda xs: 1 - U.ratio(F.size(U.runs_once(xs)), F.size(xs)))


def nonalphabetic() -> Column:
    return _both(lambda s: U.ratio(U.count_re(s, r"[\p{L}\s]"), U.n_bytes(s)))


def penalise_capitals() -> Column:
    return _both(lambda s: U.ratio(1 + U.count_re(F.substring(s, 2, 1 << 30), r"\p{Ll}"), U.n_bytes(s)))


def well_formed() -> Column:
    return _both(lambda s: F.when(F.col(s).rlike(r"^\p{Lu}"), 0.5).otherwise(0.0) + F.when(F.col(s).rlike(U.ASCII_PUNCTUATION + r"\z"), 0.5).otherwise(0.0))


def length_difference() -> Column:
    return 1 - F.abs(U.ratio(F.size(U.cased_words("l")), F.size(U.cased_words("r"))))


def ideal_length(ideal: float) -> Column:
    return _both(lambda s: U.ratio(F.lit(1), F.abs(F.size(U.cased_words(s)) - ideal), float("inf")))


def with_unicode_range(pairs: DataFrame) -> DataFrame:
    """Adds `unicode_range`: minus the mean relative distance of the code points' ends from their averages."""
    for s in "lr":
        fit = char_range(pairs, s).select(F.col("lo").alias(f"__lo{s}"), F.col("hi").alias(f"__hi{s}"))
        pairs = pairs.crossJoin(F.broadcast(fit))  # one row
    def off(s):
        points = F.transform(F.regexp_extract_all(F.col(s), F.lit(r"[\p{L}\p{N}]"), F.lit(0)), lambda ch: F.ascii(ch))
        far = lambda x, y: F.abs(1 - U.ratio(F.coalesce(x, y), y))
        return (far(F.array_min(points), F.col(f"__lo{s}")) + far(F.array_max(points), F.col(f"__hi{s}"))) / 2
    return pairs.withColumn("unicode_range", -(off("l") + off("r"))).drop("__lol", "__hil", "__lor", "__hir")


def with_out_of_freq(pairs: DataFrame, cutoff: int = 5000) -> DataFrame:
    """Adds `out_of_freq`: the shares of words that are among the most frequent of their side."""
    for s in "lr":
        top = vocabulary(pairs, s, cutoff).select("word")
        x = pairs.select("id", F.explode(U.cased_words(s)).alias("word"))
        share = x.join(small(top.withColumn("__in", F.lit(1))), "word", "left").groupBy("id").agg((F.count("__in") / F.count("*")).alias(f"__{s}"))
        pairs = pairs.join(share, "id", "left")
    return pairs.withColumn("out_of_freq", F.col("__l") + F.col("__r")).drop("__l", "__r")


#: Scores of a pair; higher is better.
PAIR_SCORERS: dict[str, Callable] = {"redundancy": redundancy, "translated_partial": translated_partial, "nonalphabetic": nonalphabetic, "penalise_capitals": penalise_capitals, "well_formed": well_formed, "length_difference": length_difference}
FITTED = {"unicode_range": with_unicode_range, "out_of_freq": with_out_of_freq}


def quality_rank(pairs: DataFrame, scorers: list[str], k_top: float = 0.75) -> DataFrame:
    """The floor(n * k_top) pairs (id, l, r) with the smallest sum of their positions under the scorers,
    as (id, l, r, total). Missing scores rank last, ties go by id; without scorers, the first pairs."""
    df = pairs.select("id", "l", "r")
    for name in scorers:
        df = FITTED[name](df) if name in FITTED else df.withColumn(name, F.round(PAIR_SCORERS[name](), 9))
    total = pairs.select("id", F.lit(0).cast("long").alias("total"))
    if scorers:
        # all scores as rows of one table, which is ranked once; it is read three times
        long = df.select("id", F.explode(F.array(*(F.struct(F.lit(i).alias("scorer"), F.col(n).cast("double").alias("score")) for i, n in enumerate(scorers)))).alias("x")).select("id", "x.*").persist()
        total = global_rank(long, "score", "id", "at", descending=True, group="scorer").groupBy("id").agg(F.sum("at").alias("total"))
    n = int(pairs.count() * k_top)
    best = global_rank(total, "total", "id", "__at").filter(F.col("__at") < n).select("id", "total")
    return pairs.select("id", "l", "r").join(best, "id")


def unique_by(scored: DataFrame, first: str = "p1", second: str = "p2", score: str = "score") -> DataFrame:
    """The best row of each `first`, then of those the best of each `second`."""
    best = lambda d, k, o: keep_first(d.withColumn("__neg", -F.col(score)), [k], ["__neg", o]).drop("__neg")
    return best(best(scored, first, second), second, first)
