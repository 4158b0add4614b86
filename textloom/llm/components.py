"""Connected components of a link table, by rounds of neighbour minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .io import Stored


def components(store: Stored, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, c) with c the smallest vertex that v reaches, for each vertex of links(a, b).

    Each round replaces an edge (v, parent) by edges to the smallest neighbour (a large star, then a
    small star), so chains of length d end after about log(d) rounds. Edges and labels stay in tables
    of the shared folder; the driver sees only counts.
    """
    edges = store.keep(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v > u").distinct())
    before = _checksum(edges)
    for _ in range(max_rounds):
        # large star: each vertex hangs its larger neighbours on its smallest neighbour
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v > u").distinct()
        # small star: each vertex hangs its smaller neighbours, and itself, on the smallest
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").filter("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        after = store.keep(small.unionByName(least.select("v", F.col("m").alias("u"))).distinct())
        now = _checksum(after)
        store.drop(edges)
        edges, same, before = after, now == before, now
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select("v", F.col("u").alias("c")).unionByName(edges.select(F.col("u").alias("v"), F.col("u").alias("c")).distinct()).distinct()


def _checksum(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
