"""From raw documents to packed training sequences, in stages that each keep, change or drop documents.

A document is a row; rows are told apart by their id and text, so that null ids, or one id on several
texts, cost no document. All stages but the last return the columns of documents and take no notice of
others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.decontaminate import passages
from textloom.llm.io import Stored, table
from textloom.llm.lines import without_recurring_lines
from textloom.llm.minhash import near_duplicates
from textloom.llm.packing import pack
from textloom.llm.toxicity import fit, training_labels

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _matched(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose id and text are, or with left_anti aren't, in found (doc_id, uid)."""
    found = found.select(F.col("doc_id").alias("__id"), F.col("uid").alias("__uid_of"))
    docs = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("__uid"))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]) & (docs["__uid"] == found["__uid_of"]), how)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.7.

    Null and empty texts score as a text without evidence does. Repeated rows score alike, very long
    texts are read in whole, null ids stay. An empty table stays empty.
    """
    scorer = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    return scorer.add(docs.select(*COLUMNS), score_col="__score").filter("__score < 0.7").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; documents that consisted of such lines only go.

    Null and empty texts stay as they are. Repeated rows count as one document and get the same answer.
    Null ids stay; very long texts are read in whole. An empty table stays empty.
    """
    out = without_recurring_lines(docs.select(*COLUMNS)).filter(r"n_dropped = 0 OR text RLIKE '\\S'")
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates.

    Repeated rows, equal in id (null too) and text (null: empty), are one document. Different texts under
    one id are different documents, each in its own group. Null ids, and texts that are null, empty or
    without a word, are linked with nothing and stay. Very long texts are read in whole. An empty table
    stays empty.
    """
    found = Stored(spark).keep(near_duplicates(docs, with_groups=True).select("doc_id", "uid", "group_id"))
    least = found.filter("group_id IS NOT NULL").groupBy("group_id").agg(F.min(F.struct("doc_id", "uid")).alias("m")).select("m.*")
    alone = found.filter("group_id IS NULL").select("doc_id", "uid").distinct()
    return _matched(docs, least.unionByName(alone), "left_semi").dropDuplicates(["doc_id", "__uid"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages.

    Null and empty texts hold none and stay, as do null ids. Repeated rows get the same answer. Very long
    texts are read in whole. An empty table stays empty.
    """
    found = passages(docs, table(spark, sf_dir, "benchmark"), with_uid=True).select("doc_id", "uid").distinct()
    return _matched(docs, found, "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids, as `pack` returns them.

    Null and empty texts give the end id alone. Repeated rows and null ids are packed like others; very
    long texts are cut. An empty table gives an empty table.
    """
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Scores of language models, similarity joins and tokenisers have no SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each result written before the next reads it.

    Null, empty and very long texts, ties, repeated rows and empty tables: as the stages say.
    """
    store, docs, done = Stored(spark), table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store.keep(docs)
            done.append(docs)
    store.drop(*done[:-1])
    return docs
