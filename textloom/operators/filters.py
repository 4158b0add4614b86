"""Predicates over lines, pairs and keywords."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units as U


def lengthfilter(df: DataFrame, col: str = "line", min_words: int = 0, min_chars: int = 0, max_words: int = 1_000_000, max_chars: int | None = None) -> DataFrame:
    """Bounds, both included, on bytes and on the parts between single spaces."""
    if max_words == 0:
        raise ValueError("max_words must not be 0")
    top = max_words * 15 if max_chars is None else max_chars
    return df.filter(F.octet_length(col).between(min_chars, top)).filter(F.size(U.space_tokens(col)).between(min_words, max_words))


def norepeat(df: DataFrame, col: str = "line", min_char_length: int = 3, column: int = 0, sep: str = "\t") -> DataFrame:
    """Rows in one of whose delimited columns no word of min_char_length bytes or more comes twice."""
    part = F.get(F.split(F.col(col), re.escape(sep), -1), F.lit(column))
    ws = F.filter(U.words(part), lambda w: F.octet_length(w) >= min_char_length)
    return df.filter(F.size(F.array_distinct(ws)) == F.size(ws))


def nosame(df: DataFrame, left: str = "l", right: str = "r") -> DataFrame:
    """Pairs whose sides share no cleaned word of over two bytes."""
    return df.filter(~F.arrays_overlap(U.cleaned_words(left, 3), U.cleaned_words(right, 3)))


def uppercased(x) -> Column:
    n = U.count_re(x, r"\p{Lu}")
    return F.when(n == 0, F.lit(float("inf"))).otherwise(U.ratio(F.lit(1), n))


def noisy(x) -> Column:
    """Share of letters and white space; NaN for an empty text."""
    return U.ratio(U.count_re(x, r"[\p{L}\s]"), U.n_chars(x), float("nan"))


def word_length_variety(x) -> Column:
    n = F.transform(U.space_tokens(x), lambda w: F.octet_length(w))
    return 1.0 - 1.0 / (1.0 + (F.array_max(n) - F.array_min(n)).cast("double"))


#: name: (score of a text, 1 if higher is better, -1 if lower is).
SCORERS: dict[str, tuple] = {"uppercased": (uppercased, 1), "noisy": (noisy, 1), "word_length_variety": (word_length_variety, 1)}


def softscore(x, scorers: list[str]) -> Column:
    """The mean of scores, lower-is-better ones negated."""
    parts = [SCORERS[n][0](x) * SCORERS[n][1] for n in scorers]
    return sum(parts[1:], parts[0]) / len(parts)


def soft_filter(df: DataFrame, col: str = "line", min_score: float = 0.94, variety_filter: bool = True) -> DataFrame:
    return df.filter(softscore(col, ["uppercased", "noisy"] + ["word_length_variety"] * variety_filter) > min_score)


def hard_filter(df: DataFrame, cutoffs: dict[str, float], col: str = "line") -> DataFrame:
    """Rows on the right side of every cutoff."""
    for name, cut in cutoffs.items():
        score, sign = SCORERS[name]
        df = df.filter(score(col) > cut if sign > 0 else score(col) < cut)
    return df


def keyword_filter(df: DataFrame, col: str = "keyword", score: str = "score", min_score: float = 0.0) -> DataFrame:
    """Keywords of over seven bytes whose first word doesn't end in s and no word in ed, es, ly or ing."""
    ws = F.split(col, " ", -1)
    return df.filter((F.octet_length(col) > 7) & ~F.get(ws, F.lit(0)).endswith("s") & ~F.exists(ws, lambda w: w.rlike("(ed|es|ly|ing)$")) & (F.col(score) > min_score))


def valid_pairs(df: DataFrame, col: str = "line") -> DataFrame:
    """Delimited lines with a tab and over five bytes."""
    return df.filter(F.contains(F.col(col), F.lit("\t")) & (F.octet_length(col) > 5))


def valid_utf8(df: DataFrame, col: str) -> DataFrame:
    """Rows whose bytes are valid UTF-8."""
    return df.filter(F.is_valid_utf8(F.col(col).cast("string")))
