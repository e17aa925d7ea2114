"""Iterative graph operators: bounded breadth-first search and connected components.

Each step is a join of a frontier or labelling with the edges; between steps what
is left is written to the shared folder, so that a join knows its sides' sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import walk_key
from factloom.operators import graph
from factloom.operators.held import kept, measured


def subgraph(nodes: DataFrame, edges: DataFrame, roots: DataFrame, *, depth: int = 1, direction: str = "out", confidence: tuple[str, ...] = (), containment: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges met within ``depth`` steps of the roots (id); neighbours without a node row are passed through, not returned."""
    usable = graph.with_confidence(edges if containment else edges.where(graph.semantic()), confidence)
    hops = graph.adjacency(usable, direction)
    seen = frontier = measured(roots.select("id").distinct())
    met = None
    for _ in range(max(depth, 0)):
        step = measured(hops.join(frontier.withColumnRenamed("id", "cur"), "cur", "left_semi"))
        met = step.select("edge") if met is None else met.unionByName(step.select("edge"))
        frontier = measured(step.select(F.col("nbr").alias("id")).distinct().join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    found = edges.limit(0) if met is None else edges.join(met.select(F.col("edge").alias("id")).distinct(), "id", "left_semi")
    return nodes.join(seen, "id", "left_semi"), found


def walk_order(files: DataFrame, spread: int | None = None) -> DataFrame:
    """(path, nth) of all files as a walk meets them: ranges of walk keys, sorted each, and the number of files in the ranges before."""
    keyed = files.select("path", walk_key(F.col("path")).alias("_key"))
    ranged = keyed.repartitionByRange(spread, "_key") if spread else keyed.repartitionByRange("_key")
    placed = kept(ranged.sortWithinPartitions("_key").select("path", F.monotonically_increasing_id().alias("at")))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # as many rows as ranges
        starts.append((r["part"], before))
        before += r["count"]
    offsets = files.sparkSession.createDataFrame(starts, "part long, start long")
    return placed.withColumn("part", part).join(offsets, "part").select("path", (F.col("start") + within + 1).alias("nth"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node over edges that are no containment and have both ends; a component is named by its least id.

    Nodes are numbered in the order of their ids. A round gives each node its least neighbour or itself, follows these
    to their ends by pointer jumping, and contracts the edges: of the nodes that still have edges at most half are left
    after two rounds.
    """
    ids = nodes.select("id").distinct()
    numbered = measured(ids.repartitionByRange("id").sortWithinPartitions("id").select("id", F.monotonically_increasing_id().alias("n")))
    now = measured(
        edges.where(graph.semantic() & (F.col("src") != F.col("dst"))).select("src", "dst")
        .join(numbered.select(F.col("id").alias("src"), F.col("n").alias("u")), "src")
        .join(numbered.select(F.col("id").alias("dst"), F.col("n").alias("v")), "dst").select("u", "v")
    )
    placed = None
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        tops = _tops(measured(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("top"))))
        placed = tops if placed is None else measured(_moved(placed, "top", tops))
        now = measured(_moved(_moved(now, "u", tops), "v", tops).where("u <> v").distinct())
    if placed is None:
        return ids.select("id", F.col("id").alias("component"))
    names = measured(placed.select(F.col("top").alias("n")).distinct().join(numbered, "n").select(F.col("n").alias("top"), F.col("id").alias("component")))
    told = numbered.join(placed.withColumnRenamed("u", "n"), "n", "left").join(names, "top", "left")
    return told.select("id", F.coalesce("component", "id").alias("component"))


def _moved(rows: DataFrame, at: str, tops: DataFrame) -> DataFrame:
    """rows with the nodes of a column replaced by their tops; nodes without one stay."""
    to = tops.where("u <> top").select(F.col("u").alias(at), F.col("top").alias("_to"))
    return rows.join(to, at, "left").withColumn(at, F.coalesce("_to", at)).select(rows.columns)


def _tops(up: DataFrame) -> DataFrame:
    """(u, top) with each top followed to its end; every step doubles the way that is followed."""
    while True:
        next_up = up.where("u <> top").select(F.col("u").alias("top"), F.col("top").alias("_next"))
        jumped = measured(up.join(next_up, "top", "left").select("u", F.coalesce("_next", "top").alias("top"), F.col("_next").isNotNull().alias("moved")))
        up = jumped.select("u", "top")
        if jumped.where("moved").isEmpty():
            return up


def component_summary(placed: DataFrame) -> DataFrame:
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    n = F.count(F.lit(1))
    alone = F.coalesce(F.sum((F.col("size") == 1).cast("long")), F.lit(0))
    return sizes.agg(
        n.alias("component_count"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_component_size"), alone.alias("singleton_count"),
        F.when(n == 0, 0.0).otherwise(F.round(alone / n, 4)).alias("singleton_ratio"),
    )
