"""Connected components of an edge table, by alternating large and small stars.

Every round replaces edges by edges to smaller nodes and keeps who reaches whom; a table in the shared folder cuts the
lineage after each. No neighbour list is gathered: only minima are aggregated, and joins split hot nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailsplit.scratch import materialize


def _to_smallest(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge in both directions with the smallest of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    return _to_smallest(edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges(u, v)``, two long columns; the component is its smallest node.

    Edges may repeat, come in either direction and lead to their own node; an edge with a null end is no edge. No edges
    give no rows.
    """
    loops = edges.where("u = v").select("u")
    now = materialize(_small_star(edges.where("u is not null and v is not null")), "edges")
    seen = None
    while True:
        sums = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u").cast("decimal(38,0)")),
                       F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if sums == seen or not sums[0]:
            break
        seen = sums
        now = materialize(_small_star(_large_star(now)), "edges")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    ends = stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    alone = loops.distinct().join(ends, F.col("u") == F.col("node"), "left_anti")
    return ends.union(alone.select(F.col("u").alias("node"), F.col("u").alias("component")))
