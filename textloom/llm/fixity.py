"""Merkle fixity audit of record archives.

Every record is written out as a WARC record and hashed. Volumes hold records in the order of their
ids, hence of their offsets; a leaf of the tree covers a range of that order, and a node the ranges of
`fanout` nodes below it, up to one root for an archive. Two replicas are compared root first, and only
branches whose hashes differ are followed down, to the records at fault.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .io import Stored, table

#: Ids to a leaf, and nodes to a node above.
LEAF, FANOUT = 8, 16
#: Ids to a volume.
VOLUME = LEAF * FANOUT
#: Ids from here down stand for records without one.
NO_ID = -(1 << 62)


def record(url: str = "url", key: str = "page_id", body: str = "html"):
    """The WARC record of a row."""
    c = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), c(key), F.lit(">\r\nWARC-Target-URI: "), c(url), F.lit("\r\nContent-Length: "), F.octet_length(c(body)).cast("string"), F.lit("\r\n\r\n"), c(body), F.lit("\r\n\r\n"))


def manifest(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(id, nth, size, digest): a row for each record; nth tells rows of equal id apart, in digest order.
    Records without an id get one below NO_ID by their content, so that they spread over leaves."""
    rows = pages.select(F.col(key).cast("long").alias("id"), record(url, key, body).alias("r"))
    rows = rows.withColumn("id", F.coalesce("id", F.lit(NO_ID) - F.pmod(F.xxhash64("r"), F.lit(1 << 40))))
    rows = rows.select("id", F.octet_length("r").cast("long").alias("size"), F.sha2("r", 256).alias("digest"))
    return rows.groupBy("id", "digest", "size").agg(F.count("*").alias("copies")).select("id", "digest", "size", "copies", F.row_number().over(Window.partitionBy("id").orderBy("digest")).alias("nth"))


def offsets(entries: DataFrame) -> DataFrame:
    """Adds volume and offset: the bytes of the records before it in its volume of VOLUME ids."""
    volume = F.floor(F.col("id") / VOLUME)
    order = Window.partitionBy("volume").orderBy("id", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("volume", volume).withColumn("offset", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0)))


def _up(nodes: DataFrame) -> DataFrame:
    """The level above: each node hashes the ordered hashes of the nodes below it."""
    rows = F.array_sort(F.collect_list(F.struct("node", "hash")))
    joined = F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"])), ";")
    return nodes.groupBy(F.floor(F.col("node") / FANOUT).alias("up")).agg(F.sha2(joined, 256).alias("hash")).select(F.col("up").alias("node"), "hash")


def tree(store: Stored, entries: DataFrame) -> list[DataFrame]:
    """Levels (node, hash), leaves first; the last has the one root, or no row for an empty archive."""
    rows = F.array_sort(F.collect_list(F.struct("id", "nth", "size", "digest", "copies")))
    text = F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["id"].cast("string"), x["size"].cast("string"), x["digest"], x["copies"].cast("string"))), ";")
    level = store.keep(entries.groupBy(F.floor(F.col("id") / LEAF).alias("node")).agg(F.sha2(text, 256).alias("hash")))
    levels = [level]
    for _ in range(17):  # 16**16 leaves cover all ids; negative and other ids meet in node 0 or -1
        if level.agg(F.min("node") == F.max("node")).first()[0] in (True, None):
            break
        level = store.keep(_up(level))
        levels.append(level)
        if level.filter("node NOT IN (0, -1)").isEmpty():
            break
    return levels


def audit(ours: DataFrame, theirs: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(page_id, kind, volume, offset, size, digest): records in which the replicas differ.

    kind is changed, missing (of theirs) or extra (only theirs); volume, offset and size are those of our
    record where there is one. Equal replicas give no row. Records with a null id are told apart by their
    content, so a change shows as one missing and one extra (page_id is null in the result); ids are above
    NO_ID. Null urls and bodies are empty; very long ones are hashed in whole. Repeated rows: a record that one side has more often is changed.
    Other columns are not looked at. Empty tables: all records of the other side are missing or extra.
    """
    store = Stored(ours.sparkSession)
    left, right = (store.keep(manifest(x, key, url, body)) for x in (ours, theirs))
    a, b = tree(store, left), tree(store, right)
    while len(a) < len(b):
        a.append(store.keep(_up(a[-1])))
    while len(b) < len(a):
        b.append(store.keep(_up(b[-1])))
    bad = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if bad is not None:
            x, y = (z.join(bad, F.floor(F.col("node") / FANOUT) == F.col("parent"), "left_semi") for z in (x, y))
        bad = x.withColumnRenamed("hash", "h").join(y.withColumnRenamed("hash", "g"), "node", "full").filter("NOT h <=> g").select(F.col("node").alias("parent"))
        bad = store.keep(bad)
        if bad.isEmpty():
            break
    at = F.floor(F.col("id") / LEAF)
    ours_, theirs_ = (z.join(bad, at == F.col("parent"), "left_semi") for z in (left, right))
    # offsets need the other records of the volumes at fault
    volumes = store.keep(bad.select(F.floor(F.col("parent") * LEAF / VOLUME).alias("v")).distinct())
    placed = offsets(left.join(volumes, F.floor(F.col("id") / VOLUME) == F.col("v"), "left_semi"))
    placed = placed.join(bad, at == F.col("parent"), "left_semi")
    other = theirs_.select("id", "nth", F.col("digest").alias("d"), F.col("copies").alias("k"), F.col("size").alias("z"))
    both = placed.join(other, ["id", "nth"], "full").filter("NOT (digest <=> d AND copies <=> k)")
    kind = F.when(F.col("d").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    return both.select(F.when(F.col("id") > NO_ID, F.col("id")).alias("page_id"), kind.alias("kind"), F.coalesce("volume", F.floor(F.col("id") / VOLUME)).alias("volume"), "offset", F.coalesce("size", "z").alias("size"), F.coalesce("digest", "d").alias("digest"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with faults in fixed places: some bodies changed, some records lost."""
    return pages.filter("page_id % 211 <> 5").withColumn("html", F.when(F.col("page_id") % 101 == 7, F.concat("html", F.lit("?"))).otherwise(F.col("html")))


def op9_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a replica with faults in fixed places."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages))


ORACLE_SQL = f"""
WITH r AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM pages
), o AS (
  SELECT page_id, CAST(page_id // {VOLUME} AS BIGINT) AS volume, CAST(strlen(rec) AS BIGINT) AS size, sha256(rec) AS digest,
    CAST(coalesce(sum(strlen(rec)) OVER (PARTITION BY page_id // {VOLUME} ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM r
)
SELECT page_id, CASE WHEN page_id % 211 = 5 THEN 'missing' ELSE 'changed' END AS kind, volume, "offset", size, digest
FROM o WHERE page_id % 211 = 5 OR page_id % 101 = 7
"""
