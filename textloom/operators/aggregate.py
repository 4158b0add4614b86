"""Counts: words, n-grams, sizes, weights, fitted ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import units as U


def frqlist(df: DataFrame, col: str = "line", min_count: int = 0) -> DataFrame:
    """(word, n) of runs of letters, for words with more than min_count occurrences."""
    return df.select(F.explode(U.alphabetic_runs(col)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") > min_count)


def ngrams(df: DataFrame, col: str = "line", min_size: int = 1, max_size: int = 5, filter_below: int = 1, top_n: int | None = 30_000, compat: bool = False) -> DataFrame:
    """(ngram, n) over parts between single spaces, sizes min_size to max_size (compat: below max_size,
    and without each line's last), of more than filter_below occurrences; the top_n most frequent."""
    sizes = range(min_size, max_size if compat else max_size + 1)
    grams = df.select(F.explode(U.bound(U.space_tokens(col), lambda ws: F.concat(*(U.ngrams(ws, n, not compat) for n in sizes)))).alias("ngram"))
    out = grams.groupBy("ngram").agg(F.count("*").alias("n")).filter(F.col("n") > filter_below)
    return out if top_n is None else out.orderBy(F.desc("n"), "ngram").limit(top_n)


def wc(docs: DataFrame, col: str = "text") -> DataFrame:
    """(lines, words, chars): newlines, spaces and bytes."""
    return docs.agg(F.coalesce(F.sum(U.count_re(col, "\n")), F.lit(0)).alias("lines"), F.coalesce(F.sum(U.count_re(col, " ")), F.lit(0)).alias("words"), F.coalesce(F.sum(U.n_bytes(col)), F.lit(0)).alias("chars"))


def distinct_words(df: DataFrame, col: str = "line") -> DataFrame:
    return df.select(F.explode(F.array_distinct(U.words(col))).alias("word")).distinct()


def doc_freq_weight(df: DataFrame, col: str = "line") -> DataFrame:
    """(word, df, weight): weight = sum of all df / cube root of df."""
    out = df.select(F.explode(F.array_distinct(U.words(col))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    total = out.agg(F.sum("df").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("word", "df", (F.col("total") / F.cbrt("df")).alias("weight"))  # one row


def char_range(pairs: DataFrame, col: str) -> DataFrame:
    """(lo, hi): the smallest and largest code point of letters and digits, averaged over all rows."""
    points = F.transform(F.regexp_extract_all(U.c(col), F.lit(r"[\p{L}\p{N}]"), F.lit(0)), lambda ch: F.ascii(ch))
    return pairs.agg(F.floor(F.coalesce(F.sum(F.array_min(points)), F.lit(0)) / F.count("*")).alias("lo"), F.floor(F.coalesce(F.sum(F.array_max(points)), F.lit(0)) / F.count("*")).alias("hi"))


def vocabulary(df: DataFrame, col: str = "line", cutoff: int = 5000) -> DataFrame:
    """(word, n): the most frequent lower-cased words, ties in the order of words."""
    return df.select(F.explode(U.words(col)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(cutoff)


def fill_map(df: DataFrame, ws) -> DataFrame:
    """(word, size): the sizes of the word sets that a word is in, summed."""
    s = df.select(F.array_distinct(ws).alias("s"))
    return s.select(F.explode("s").alias("word"), F.size("s").cast("long").alias("n")).groupBy("word").agg(F.sum("n").alias("size"))


def mean_rescale(df: DataFrame, col: str, name: str = "rescaled") -> DataFrame:
    mean = df.agg(F.avg(col).alias("__m"))
    return df.crossJoin(F.broadcast(mean)).withColumn(name, U.ratio(col, "__m")).drop("__m")  # one row


def batch_by_size(df: DataFrame, order: list[str], size_col: str, limit: int = 4999, group: str | None = None) -> DataFrame:
    """Adds `batch`: consecutive rows of a group, packed greedily. A row that would bring a batch to `limit`
    or over begins the next one, so only a single row can be as large.

    Which rows are together depends on all rows before, so a group is one stream through one task, with
    bounded memory; without a group all rows are one. Null sizes count as 0.
    """
    names = df.columns

    def run(batches):
        at, batch, held = None, 0, 0
        for pdf in batches:
            out = []
            for g, n in zip(pdf["__g"], pdf["__n"], strict=True):
                if g != at:
                    at, batch, held = g, 0, 0
                if held and held + n >= limit:
                    batch, held = batch + 1, 0
                held += n
                out.append(batch)
            yield pdf[names].assign(batch=out)

    # a null group is one, too
    x = df.withColumn("__g", F.coalesce(F.col(group).cast("string"), F.lit("\u0000")) if group else F.lit("")).withColumn("__n", F.coalesce(F.col(size_col), F.lit(0)).cast("long"))
    x = x.repartition("__g").sortWithinPartitions("__g", *order)
    return x.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", batch long")
