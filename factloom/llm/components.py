"""Connected components by alternating large-star and small-star (a step of operator 7).

Every step is a map-side combined minimum a node and a join back to its edges,
so a node with very many edges is split by AQE's skew join and never gathered.
Each iteration is written to the shared folder: lineage stays short, and a lost
executor costs a reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import discard, staged


def _with_least(edges: DataFrame, floor: bool) -> DataFrame:
    """Edges (u, v) with m, the least of u's neighbours (and of u itself where floor)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.withColumn("m", F.least("m", "u")) if floor else least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _with_least(down, False)
    moved = least.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge to another; component is its least node. edges: u, v."""
    spark = edges.sparkSession
    now, path = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        after, next_path = staged(small_star(large_star(now)), "edges")
        discard(spark, path)
        now, path, before, mark = after, next_path, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
