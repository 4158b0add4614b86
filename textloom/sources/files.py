"""Reading lines, files, folders, markup and key-value tables; writing lines and tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that prefix scans read.
PREFIX = 200_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of text files; no order is kept."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line"))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_dir(spark: SparkSession, path: str, recursive: bool = False, contains: str = "") -> DataFrame:
    """(path, content) of a folder's files, or of all below it whose path contains a string."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return files.filter(F.contains(F.col("path"), F.lit(contains))).select("path", "content")


def prefix(files: DataFrame, n: int = PREFIX, col: str = "content") -> DataFrame:
    return files.withColumn(col, F.substring(F.col(col).cast("binary"), 1, n))


def write_lines(df: DataFrame, path: str, col: str = "line") -> None:
    df.select(col).write.text(path)


def write_sets(sets: DataFrame, dictionary: DataFrame, path: str) -> None:
    """Word sets and their dictionary as two Parquet tables below path."""
    sets.write.parquet(f"{path}/sets")
    dictionary.write.parquet(f"{path}/dictionary")


def read_sets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/sets"), spark.read.parquet(f"{path}/dictionary")


def wiki_text(df: DataFrame, col: str) -> DataFrame:
    """Wiki markup as plain text: links by their label, paragraphs by newlines, no bold, italics or templates."""
    x = F.col(col)
    for pattern, by in ((r"(?s)\{\{.*?\}\}", ""), (r"\[\[(?:[^\]|]*\|)*([^\]|]*)\]\]", "$1"), (r"'{2,5}", ""), (r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1"), (r"\n{2,}", "\n")):
        x = F.regexp_replace(x, pattern, by)
    return df.withColumn(col, x)


def markup_text(df: DataFrame, col: str) -> DataFrame:
    """HTML or XML as text: scripts, styles, comments and tags go, the five named entities and spaces are resolved."""
    x = F.col(col)
    for pattern, by in ((r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " "), (r"<[^>]*>", " ")):
        x = F.regexp_replace(x, pattern, by)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return df.withColumn(col, F.trim(F.regexp_replace(x, r"\s+", " ")))


def read_xml(spark: SparkSession, path: str, row_tag: str, text_tag: str = "text") -> DataFrame:
    """(text) of each element row_tag of XML files, wiki markup resolved."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(f"{text_tag} string").load(path)
    return wiki_text(rows.select(F.col(text_tag).alias("text")), "text")


def kv_put(table: DataFrame, rows: DataFrame, bucket: str | None = None) -> DataFrame:
    """A key-value table (key, value, seq) after puts (key, value, seq): the last value of a key stays.
    With a column for buckets, a key is one of its bucket."""
    names = [*([bucket] if bucket else []), "key"]
    both = table.select(*names, "value", "seq").unionByName(rows.select(*names, "value", "seq"))
    return both.groupBy(*names).agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def kv_get(table: DataFrame, keys: DataFrame, missing: str = "Not found", bucket: str | None = None) -> DataFrame:
    """(key, value) for each asked key, of its bucket if there are buckets."""
    names = [*([bucket] if bucket else []), "key"]
    return keys.select(*names).join(table.select(*names, "value"), names, "left").select(*names, F.coalesce("value", F.lit(missing)).alias("value"))


def kv_list(table: DataFrame, bucket: str | None = None, of=None) -> DataFrame:
    """The keys, or those of one bucket."""
    return (table.filter(F.col(bucket) == F.lit(of)) if bucket else table).select("key")


def kv_requests(requests: DataFrame, col: str = "request", seq: str = "seq") -> DataFrame:
    """(seq, was_success, err, val): the answers to JSON lines in order; {key, value} sets, {key} gets the
    last value set before it, all else fails."""
    from pyspark.sql import Window

    x = requests.select(F.col(seq).alias("seq"), F.from_json(col, "key string, value string").alias("q"))
    w = Window.partitionBy("q.key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("q.value", ignorenulls=True).over(w)
    key, value = F.col("q.key"), F.col("q.value")
    ok = key.isNotNull() & (value.isNotNull() | last.isNotNull())
    err = F.when(key.isNull(), "bad request").when(~ok, "not found")
    return x.select("seq", ok.alias("was_success"), err.alias("err"), F.when(key.isNotNull() & value.isNull(), last).alias("val"))


def map_files(files: DataFrame, change: Callable[[DataFrame], DataFrame], path: str, name_col: str = "path") -> None:
    """Applies a change to the lines of all files and writes one folder for each file below path."""
    change(files).write.partitionBy(name_col).parquet(path)


def prompt(template: str, *cols: str):
    """A few-shot prompt from columns, with {name} for each; sending it is not part of this library."""
    out = F.lit(template)
    for x in cols:
        out = F.replace(out, F.lit("{" + x + "}"), F.coalesce(F.col(x).cast("string"), F.lit("")))
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; below the warehouse where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return (at or spark.sparkContext.getCheckpointDir()).rstrip("/")
