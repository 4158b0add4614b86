"""Recurring lines by a log-template tree, in DataFrame operations only.

Lines are parsed at a fixed depth: by the number of their words, then by their first words, with words
that hold a digit taken as a variable field. That leads to a leaf. Within a leaf lines share a template
if all their words agree apart from variable fields: words with a digit anywhere, and, in leaves with
several templates, one residue class of positions modulo `STRIDE` (so that at least three quarters of
the words are constant). A template is recurring if it stands in at least `min_contexts` different
documents, wherever in them and next to whatever lines. Copies of a whole text, blank lines aside, count
as one document, and are left to the operators for documents. The first line of a recurring template stays, all others go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import Stored, as_text, table

#: Leading words on the way to a leaf; positions that may vary together; words a line needs for that.
DEPTH, STRIDE, LEAST = 4, 4, 8
FIELD = "<*>"


def _fields(line: Column) -> Column:
    """The line with variable fields replaced."""
    # each word is looked at once
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", FIELD)).otherwise(line)


def _even(line: Column) -> Column:
    """The line's words between single spaces."""
    # most lines have single spaces already
    uneven = reduce(lambda a, x: a | F.contains(line, F.lit(x)), ["\t", "\r", "\f", "\x0b"], F.contains(line, F.lit("  ")))
    return F.trim(F.when(uneven, F.regexp_replace(line, r"\s+", " ")).otherwise(line))


def _class(j: int) -> Column:
    """A hash of the words at positions j, j + STRIDE, ..."""
    return F.xxhash64(F.transform(F.sequence(F.lit(j), F.size("w") - 1, F.lit(STRIDE)), lambda i: F.get("w", i)), F.lit(j))


def parsed(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, copy, line_no, t1, t2, leaf, variants) for each line with a word; copies of a text share copy."""
    rows = docs.select("doc_id", "uid", F.split("text", "\n").alias("ls"))
    rows = rows.withColumn("copy", F.xxhash64(F.filter("ls", lambda x: F.trim(x) != "")))
    # one after the other, or the first would be worked out for each use that the second makes of it
    rows = rows.select("doc_id", "uid", "copy", F.posexplode("ls").alias("line_no", "line")).filter(F.col("line").rlike(r"\S"))
    rows = rows.withColumn("line", _fields(F.col("line"))).withColumn("line", _even(F.col("line")))
    rows = rows.select("doc_id", "uid", "copy", "line_no", F.xxhash64("line").alias("t1"), F.xxhash64("line", F.lit(1)).alias("t2"), F.split("line", " ").alias("w"))
    leaf = F.xxhash64(F.size("w"), F.slice("w", 1, DEPTH))
    rows = rows.select("doc_id", "uid", "copy", "line_no", "t1", "t2", leaf.alias("leaf"), F.when(F.size("w") >= LEAST, F.array(*(_class(j) for j in range(STRIDE)))).alias("cs"))
    but = F.array(*(F.xxhash64(*(F.get("cs", F.lit(k)) for k in range(STRIDE) if k != j), F.lit(j)) for j in range(STRIDE)))
    return rows.select("doc_id", "uid", "copy", "line_no", "t1", "t2", "leaf", F.when(F.col("cs").isNotNull(), but).otherwise(F.array().cast("array<long>")).alias("variants"))


def _recurring(uses: DataFrame, min_contexts: int) -> DataFrame:
    """(t1, t2, first): templates in enough different documents, and their first line."""
    held = uses.groupBy("t1", "t2", "copy").agg(F.min(F.struct("doc_id", "uid", "line_no")).alias("first"))
    return held.groupBy("t1", "t2").agg(F.min("first").alias("first"), F.count("*").alias("n")).filter(F.col("n") >= min_contexts).select("t1", "t2", "first")


def dropped_lines(docs: DataFrame, min_contexts: int = 4) -> DataFrame:
    """(doc_id, uid, gone): for each document with such lines the numbers of lines that go."""
    store = Stored(docs.sparkSession)
    rows = store.keep(parsed(docs))
    exact = store.keep(_recurring(rows, min_contexts))
    # leaves with several templates, be it two, get those with one residue class of positions left open;
    # in fewer lines than min_contexts nothing recurs
    several = rows.filter(F.size("variants") > 0).groupBy("leaf", "t1", "t2").agg(F.count("*").alias("m")).groupBy("leaf").agg(F.count("*").alias("n"), F.sum("m").alias("m"))
    several = several.filter((F.col("n") > 1) & (F.col("m") >= min_contexts)).select("leaf")
    # written, so that the join reads both sides from exchanges and a leaf with very many lines can be split
    several = store.keep(several)
    loose = rows.filter(F.size("variants") > 0).join(several, "leaf", "left_semi")
    loose = store.keep(loose.select("doc_id", "uid", "copy", "line_no", F.col("leaf").alias("t1"), F.explode("variants").alias("t2")))
    more = store.keep(_recurring(loose, min_contexts))
    gone = None
    for uses, templates in ((rows, exact), (loose, more)):
        one = uses.join(templates, ["t1", "t2"]).filter(F.struct("doc_id", "uid", "line_no") != F.col("first")).select("doc_id", "uid", "line_no")
        gone = one if gone is None else gone.unionByName(one)
    return gone.groupBy("doc_id", "uid").agg(F.collect_set("line_no").alias("gone"))


def _uid() -> Column:
    return F.xxhash64("doc_id", "text").alias("uid")


def without_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_contexts: int = 4) -> DataFrame:
    """docs with recurring lines taken out of the text, and the new columns n_lines and n_dropped (long).

    Lines are what lies between newlines; lines without a word never go. Null text: stays null, with no
    lines. Empty text stays empty; very long texts are read in whole. Repeated rows get the same answer, and count as one document. Null
    ids come first in the order that decides which line stays. Other columns pass through as they are
    (n_lines and n_dropped are overwritten). An empty table gives an empty table.
    """
    ids = as_text(docs, id_col, text_col)
    gone = dropped_lines(ids.select("doc_id", "text", _uid()), min_contexts)
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("uid").alias("__uid_of"), F.col("gone").alias("__gone"))
    uid = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.withColumn("__uid", uid)
    rows = rows.join(gone, rows[id_col].eqNullSafe(gone["__id"]) & (rows["__uid"] == gone["__uid_of"]), "left")
    # split once, not for each line that stays
    rows = rows.withColumn("__ls", F.split(text_col, "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__ls") - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__ls", i)), "\n"))
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    rows = rows.withColumns({"n_lines": n("__ls"), "n_dropped": n("__gone")})
    return rows.withColumn(text_col, text).drop("__uid", "__id", "__uid_of", "__gone", "__ls")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the remaining text as a digest."""
    out = without_recurring_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
