"""The inferred architecture layer: hubs, edges from files to hubs, and roles of imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import classify as C
from factloom.functions.text import edge_id, evidence_id

DIMENSIONS = ("area", "domain", "layer", "role", "feature")


def classified(files: DataFrame, markers: tuple[str, ...] = (), generic: tuple[str, ...] = ()) -> DataFrame:
    """path with its five dimensions; feature may be null."""
    path = F.col("path")
    return files.select("path", C.content_domain(path).alias("domain")).select(
        "path", C.area(path).alias("area"), "domain", C.layer(path, F.col("domain")).alias("layer"),
        C.role(path, F.col("domain")).alias("role"), C.feature(path, F.col("domain"), markers, generic).alias("feature"),
    )


def memberships(classes: DataFrame) -> DataFrame:
    """(path, dimension, value) of each dimension that a file has."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS])
    return classes.select("path", F.explode(pairs).alias("p")).where("p.value IS NOT NULL").select("path", "p.dimension", "p.value")


def hubs(classes: DataFrame) -> DataFrame:
    return memberships(classes).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("files")).select(
        F.concat_ws(":", "dimension", "value").alias("id"), "dimension", "value", "files"
    )


def inferred(rows: DataFrame) -> DataFrame:
    """Adds the ids of INFERRED edges and their evidence to (kind, src, dst, locator)."""
    sure, maker = F.lit("INFERRED"), F.lit("architecture.enrichment")
    snippet = F.concat_ws(" ", "src", "kind", "dst")
    told = rows.withColumn("evidence_id", evidence_id(maker, F.col("kind"), F.col("locator"), snippet, sure))
    return told.withColumn("id", edge_id(F.col("kind"), F.col("src"), F.col("dst"), sure, F.col("evidence_id"))).select(
        "id", "kind", "src", "dst", sure.alias("confidence"), "evidence_id", "locator", snippet.alias("snippet")
    )


def file_edges(classes: DataFrame) -> DataFrame:
    kind = F.when(F.col("dimension") == "role", "categorized_as").otherwise("belongs_to")
    return inferred(memberships(classes).select(
        kind.alias("kind"), F.concat(F.lit("file:"), F.col("path")).alias("src"), F.concat_ws(":", "dimension", "value").alias("dst"), F.col("path").alias("locator")
    ))


def hub_edges(hub_rows: DataFrame) -> DataFrame:
    return inferred(hub_rows.select(F.lit("part_of").alias("kind"), F.col("id").alias("src"), F.lit("arch:project").alias("dst"), F.col("dimension").alias("locator")))


def import_edges(imports: DataFrame, classes: DataFrame) -> DataFrame:
    """One edge for each import edge (id, src, dst) between two files whose target has a telling role."""
    as_node = classes.select(F.concat(F.lit("file:"), F.col("path")).alias("node"), "role", "layer")
    told = (
        imports.join(as_node.select(F.col("node").alias("src")), "src", "left_semi")
        .join(as_node.withColumnRenamed("node", "dst"), "dst")
        .select(C.import_role(F.col("role"), F.col("layer")).alias("kind"), "src", "dst", F.col("id").alias("locator"))
        .where("kind IS NOT NULL")
    )
    return inferred(told)
