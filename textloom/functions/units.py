"""What a line, a word, a length or a sentence is; every operator builds on these columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words as UAX-29 has them, as far as one pattern portable between regex engines can: joins over . and '
#: hold between any letters and digits, and CJK text is not cut into characters.
WORD_RE = r"[\p{L}\p{N}_]+(?:['.][\p{L}\p{N}_]+)*"
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: The sentence delimiters; \u037e is the Greek question mark, which looks like a semicolon.
DELIMITERS = "..۔܁܂።᙮᠃᠉。..꓿꘎｡?¿\u037e՞؟፧⁇⁈⁉≟⍰⸮꘏!¡՜߹႟᥄‼؟⁈܀፨"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line): the universal row; line_no from 0. Null texts have no lines."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def n_bytes(x) -> Column:
    return F.octet_length(c(x)).cast("long")


def n_chars(x) -> Column:
    return F.length(c(x)).cast("long")


def space_tokens(x) -> Column:
    """Split at single spaces; empty tokens count."""
    return F.split(c(x), " ", -1)


def full_tokens(x, pattern: str = " ") -> Column:
    return F.filter(F.split(c(x), pattern, -1), lambda w: w != "")


def alphabetic_runs(x) -> Column:
    return full_tokens(F.lower(c(x)), r"[^\p{L}]+")


def words(x) -> Column:
    """Lower-cased words by WORD_RE."""
    return F.regexp_extract_all(F.lower(c(x)), F.lit(WORD_RE), F.lit(0))


def cased_words(x) -> Column:
    return F.regexp_extract_all(c(x), F.lit(WORD_RE), F.lit(0))


def cleaned(x) -> Column:
    return F.regexp_replace(F.lower(c(x)), r"[^\p{L}\s]", "")


def cleaned_words(x, min_bytes: int = 1) -> Column:
    """Lower-cased letters between white space, of min_bytes bytes or more."""
    return F.filter(F.split(cleaned(x), r"\s+", -1), lambda w: F.octet_length(w) >= min_bytes)


def count_re(x, pattern: str) -> Column:
    return F.regexp_count(c(x), F.lit(pattern)).cast("long")


def ratio(a, b, otherwise: float | None = None) -> Column:
    """a / b as a double; `otherwise` (null by default) where b is 0."""
    out = F.try_divide(c(a).cast("double"), c(b).cast("double"))
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def bound(x: Column, f) -> Column:
    """f(x) with x computed once: inside a lambda, a column is computed again for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def runs_once(ws: Column) -> Column:
    """The words without those equal to the one before."""
    return bound(ws, lambda xs: F.filter(xs, lambda w, i: (i == 0) | (w != F.get(xs, i - 1))))


def ngrams(ws: Column, n: int, inclusive: bool = True) -> Column:
    """The n-grams of an array of words, joined by spaces; not inclusive: without the last one. ws is read
    for each of them, so it should be `bound`."""
    last = F.size(ws) - n + (1 if inclusive else 0)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.array_join(F.slice(ws, k, n), " "))).otherwise(F.array().cast("array<string>"))


def pairs(conversations: DataFrame) -> DataFrame:
    """(id, l, r): each user turn and the assistant turn after it, newlines as spaces."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    after = conversations.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next"), F.lead("text").over(w).alias("reply"))
    flat = lambda x: F.replace(F.col(x), F.lit("\n"), F.lit(" "))
    return after.filter("role = 'user' AND next = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), flat("text").alias("l"), flat("reply").alias("r"))
