"""Relational operators over a property graph: nodes, edges (src, dst, evidence_id) and evidence.

Joins are by id and left to the optimizer: no hint forces a broadcast, so a side
is broadcast only where its measured size allows. What is mostly small, hubs and
ids that no node has, is written first, so that edges need not be shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.held import measured

CONFIDENCES = ("PROVEN", "DERIVED", "INFERRED", "UNRESOLVED")


def semantic() -> Column:
    """Whether an edge is more than containment."""
    return F.col("kind") != "contains"


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def totals(nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    sizes = [t.agg(F.count(F.lit(1)).alias(f"{n}_count")) for n, t in (("node", nodes), ("edge", edges), ("evidence", evidence))]
    return sizes[0].crossJoin(sizes[1]).crossJoin(sizes[2])  # three rows of one number each


def endpoints(edges: DataFrame) -> DataFrame:
    """(id, kind, way) twice for each edge that is no containment; a loop counts at both ends."""
    told = edges.where(semantic())
    return told.select(F.col("src").alias("id"), "kind", F.lit("out").alias("way")).unionByName(
        told.select(F.col("dst").alias("id"), "kind", F.lit("in").alias("way"))
    )


def semantic_degree(edges: DataFrame) -> DataFrame:
    return endpoints(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def edge_kind_histogram(edges: DataFrame) -> DataFrame:
    return endpoints(edges).groupBy("id", "way", "kind").agg(F.count(F.lit(1)).alias("n"))


def edge_kind_count(edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(id, n) of incident edges of some kinds."""
    return endpoints(edges).where(F.col("kind").isin(*kinds)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def linked_files(edges: DataFrame) -> DataFrame:
    """(id, n) of files that belong to a hub or are categorized as it."""
    return edges.where(F.col("kind").isin("belongs_to", "categorized_as")).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def top_per_kind(nodes: DataFrame, counts: DataFrame, kinds: tuple[str, ...], k: int | None) -> DataFrame:
    """The k nodes of each kind with the most, or all, ties by id; nodes without any count 0."""
    ranked = nodes.where(F.col("kind").isin(*kinds)).join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("n").desc(), "id"))
    placed = ranked.withColumn("rank", place)
    return (placed if k is None else placed.where(F.col("rank") <= k)).select("kind", "rank", "id", "label", "n")


def top_files(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    files = nodes.where(F.col("kind") == "file").join(semantic_degree(edges), "id", "left")
    return files.select("id", "source_path", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.col("degree").desc(), "id").limit(k)


def external_modules(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Modules by how many import edges reach them."""
    imports = edges.where(F.col("kind") == "imports").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    modules = nodes.where(F.col("kind") == "module").join(imports, "id", "left")
    return modules.select("id", "label", F.coalesce("n", F.lit(0)).alias("imports")).orderBy(F.col("imports").desc(), "id").limit(k)


def first_per_kind(nodes: DataFrame, kinds: tuple[str, ...], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("kind").orderBy("id"))
    return nodes.where(F.col("kind").isin(*kinds)).withColumn("rank", place).where(F.col("rank") <= k).select("kind", "rank", "id")


def hub_files(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...], k: int) -> DataFrame:
    """For each hub its k files with the most semantic edges, and the kinds of edge that tie them to it."""
    hubs = measured(nodes.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("hub")))
    files = nodes.where(F.col("kind") == "file").select(F.col("id").alias("file"), "source_path")
    tied = (
        edges.where(semantic()).select(F.col("dst").alias("hub"), F.col("src").alias("file"), "kind")
        .join(hubs, "hub").join(files, "file").groupBy("hub", "file", "source_path")
        .agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("reasons"))
    )
    ranked = tied.join(semantic_degree(edges).withColumnRenamed("id", "file"), "file")
    place = F.row_number().over(Window.partitionBy("hub").orderBy(F.col("degree").desc(), "source_path"))
    return ranked.withColumn("rank", place).where(F.col("rank") <= k).select("hub", "rank", "source_path", "degree", "reasons")


def hub_details(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...], k: int) -> DataFrame:
    """As hub_files, over the files that belong to a hub or are categorized as it; with their ids, how many a hub has, and how many edges of each kind tie them."""
    hubs = measured(nodes.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("hub")))
    files = nodes.where(F.col("kind") == "file").select(F.col("id").alias("file"), F.coalesce("source_path", "id").alias("source_path"))
    tied = (
        edges.where(F.col("kind").isin("belongs_to", "categorized_as")).select(F.col("dst").alias("hub"), F.col("src").alias("file"), "kind")
        .join(hubs, "hub").join(files, "file").groupBy("hub", "file", "source_path", "kind").agg(F.count(F.lit(1)).alias("m"))
        .groupBy("hub", "file", "source_path").agg(F.array_sort(F.collect_list(F.struct("kind", "m"))).alias("each"))
    )
    reasons = F.array_join(F.transform("each", lambda x: F.concat(x["kind"], F.lit(" x"), x["m"].cast("string"))), ", ")
    ranked = tied.join(semantic_degree(edges).withColumnRenamed("id", "file"), "file")
    place = F.row_number().over(Window.partitionBy("hub").orderBy(F.col("degree").desc(), "source_path"))
    placed = ranked.withColumn("rank", place).where(F.col("rank") <= k)
    return placed.join(tied.groupBy("hub").agg(F.count(F.lit(1)).alias("n_files")), "hub").select("hub", "n_files", "rank", "file", "source_path", "degree", reasons.alias("reasons"))


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges with an end that no node has. Ends are looked up once each, so a hub's edges don't meet in one task."""
    ends = edges.select(F.col("src").alias("end")).unionByName(edges.select(F.col("dst").alias("end"))).distinct()
    gone = measured(ends.join(nodes.select(F.col("id").alias("end")), "end", "left_anti"))
    lost = [edges.join(gone, edges[c].eqNullSafe(gone["end"]), "left_semi").select("id", "kind", "src", "dst") for c in ("src", "dst")]
    return lost[0].unionByName(lost[1]).distinct()


def without_evidence(edges: DataFrame) -> DataFrame:
    return edges.where(semantic() & (F.coalesce("evidence_id", F.lit("")) == "")).select("id", "kind", "src", "dst")


def broken_evidence(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    named = edges.where(F.coalesce("evidence_id", F.lit("")) != "")
    return named.join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_anti").select("id", "kind", "evidence_id")


def evidence_of(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    return evidence.join(edges.select(F.col("evidence_id").alias("id")), "id", "left_semi")


def with_confidence(edges: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    return edges.where(F.col("confidence").isin(*allowed)) if allowed else edges


def adjacency(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(cur, nbr, edge) in the direction asked for."""
    out = edges.select(F.col("src").alias("cur"), F.col("dst").alias("nbr"), F.col("id").alias("edge"))
    back = edges.select(F.col("dst").alias("cur"), F.col("src").alias("nbr"), F.col("id").alias("edge"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def edge_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each edge with the labels of its ends, null where an end has no node. An id made by hashing travels as twelve bytes."""
    ends = nodes.select("id", "label")
    hashed = F.col("id").rlike("^edge:[0-9a-f]{24}$") & (F.length("id") == 29)  # $ also stands before a last line break
    short = F.when(hashed, F.unhex(F.substring("id", 6, 24)))
    packed = edges.select(short.alias("_short"), F.when(~hashed, F.col("id")).alias("_long"), "kind", "src", "dst")
    whole = F.coalesce("_long", F.concat(F.lit("edge:"), F.lower(F.hex("_short"))))
    return (
        packed.join(ends.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src", "left")
        .join(ends.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst", "left")
        .select(whole.alias("id"), "kind", "src", "src_label", "dst", "dst_label")
    )


def find_nodes(nodes: DataFrame, text: str) -> DataFrame:
    """The node that the text names: by id, file path, path, label, in this order; where no tier has just one, all that contain it.

    A tier with several ends the exact search. One pass; the counts are four numbers.
    """
    same_path = F.col("source_path") == text
    tiers = [F.col("id") == text, same_path & (F.col("kind") == "file"), same_path, F.col("label") == text]
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
    flagged = nodes.select("id", "kind", "label", "source_path", *[F.coalesce(t, F.lit(False)).cast("int").alias(f"t{i}") for i, t in enumerate(tiers)],
                           (has("id") | has("source_path") | has("label")).alias("part")).where("part OR t0 + t1 + t2 + t3 > 0")
    counts = flagged.agg(*[F.coalesce(F.sum(f"t{i}"), F.lit(0)).alias(f"n{i}") for i in range(4)])
    chosen = F.lit(None).cast("int")
    for i in reversed(range(4)):
        chosen = F.when(F.col(f"n{i}") == 1, i).when(F.col(f"n{i}") > 1, F.lit(None).cast("int")).otherwise(chosen)
    picked = flagged.crossJoin(F.broadcast(counts.select(chosen.alias("tier"))))  # one row
    exact = F.lit(False)
    for i in range(4):
        exact = exact | ((F.col("tier") == i) & (F.col(f"t{i}") == 1))
    return picked.where(F.when(F.col("tier").isNull(), F.col("part")).otherwise(exact)).select("id", "kind", "label", "source_path")


def duplicates(values: DataFrame, key: Column) -> DataFrame:
    return values.groupBy(key.alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def merged(rows: DataFrame) -> DataFrame:
    """One row an id: the first within a file, the last file in walk order. rows: id, walk, seq and what is kept."""
    kept = [c for c in rows.columns if c not in ("id", "walk", "seq")]
    value = F.struct(*kept)
    per_file = rows.groupBy("id", "walk").agg(F.min_by(value, F.col("seq")).alias("v"))
    return per_file.groupBy("id").agg(F.max_by("v", F.col("walk")).alias("v")).select("id", "v.*")
