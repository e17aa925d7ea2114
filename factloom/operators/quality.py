"""Quality of an evidence graph: extraction statistics, gates, verdicts and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import ratio
from factloom.operators import graph

# The gates' thresholds.
SUPPORTED, DENSITY, DULL, UNTRUSTED_SUPPORTED, UNTRUSTED_DENSITY = 0.70, 0.75, 0.10, 0.35, 0.10


def extraction_results(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each file (path, extractor, supported, domain) what was found in it: counts, and the kinds, sorted and comma-joined."""
    n = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("node_count"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("node_kinds"))
    e = edges.groupBy("path").agg(
        F.count(F.lit(1)).alias("edge_count"), F.countDistinct("evidence_id").alias("evidence_count"),
        F.sum(graph.semantic().cast("long")).alias("relationship_edge_count"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("edge_kinds"),
    )
    counts = ["node_count", "edge_count", "evidence_count", "relationship_edge_count"]
    return files.join(n, "path", "left").join(e, "path", "left").fillna(0, counts).fillna("", ["node_kinds", "edge_kinds"])


def observed_kinds(results: DataFrame) -> DataFrame:
    """By extractor and by domain: supported files and all kinds seen; two groupings in one pass."""
    def kinds(c):
        every = F.flatten(F.collect_list(F.split(c, ",")))
        return F.array_join(F.array_sort(F.array_distinct(F.filter(every, lambda k: k != ""))), ",")

    sets = F.array(F.struct(F.lit("extractor").alias("by"), F.col("extractor").alias("value")), F.struct(F.lit("domain").alias("by"), F.col("domain").alias("value")))
    distinct = results.select("supported", "node_kinds", "edge_kinds", F.explode(sets).alias("g")).groupBy("g", "node_kinds", "edge_kinds").agg(
        F.sum(F.col("supported").cast("long")).alias("n")
    )  # kinds meet as distinct combinations only, which are few
    return distinct.groupBy("g").agg(F.sum("n").alias("supported_files"), kinds(F.col("node_kinds")).alias("node_kinds"), kinds(F.col("edge_kinds")).alias("edge_kinds")).select("g.by", "g.value", "supported_files", "node_kinds", "edge_kinds")


def measures(files: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, *, invalid_paths: int = 0) -> DataFrame:
    """One row of all that the gates look at. files: domain, supported, error, node_count, relationship_edge_count."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    fine = F.col("supported") & F.col("error").isNull()
    per_file = files.agg(
        F.count(F.lit(1)).alias("file_count"), count(F.col("supported")).alias("supported"), count(F.col("error").isNotNull()).alias("extractor_failures"),
        count(fine & (F.col("node_count") == 0) & (F.col("relationship_edge_count") == 0)).alias("low_information"),
        F.coalesce(F.max(F.col("supported") & F.col("domain").isin("code", "test")), F.lit(False)).alias("code_like"),
    )
    per_edge = edges.agg(count(graph.semantic()).alias("semantic_edges"), count(graph.semantic() & (F.coalesce("evidence_id", F.lit("")) == "")).alias("edge_evidence"))
    lost = graph.missing_endpoints(edges, nodes).agg(F.count(F.lit(1)).alias("edge_endpoints"))
    broken = graph.broken_evidence(edges, evidence).agg(F.count(F.lit(1)).alias("evidence_references"))
    row = per_file.crossJoin(per_edge).crossJoin(lost).crossJoin(broken).withColumn("source_paths", F.lit(invalid_paths).cast("long"))  # one row each
    return row.select(
        "*", ratio(F.col("supported"), F.col("file_count")).alias("supported_ratio"), ratio(F.col("semantic_edges"), F.col("file_count")).alias("density"),
        ratio(F.col("low_information"), F.col("supported")).alias("low_information_ratio"), F.when(F.col("code_like"), DENSITY).otherwise(0.0).alias("density_threshold"),
    )


CRITICAL = ("edge_endpoints", "edge_evidence", "evidence_references", "source_paths", "extractor_failures")


def gates(measured: DataFrame) -> DataFrame:
    """(name, passed, value, threshold) of the eight gates."""
    rows = [(g, F.col(g) == 0, F.col(g).cast("double"), F.lit(0.0)) for g in CRITICAL]
    rows += [
        ("supported_ratio", F.col("supported_ratio") >= SUPPORTED, F.round("supported_ratio", 4), F.lit(SUPPORTED)),
        ("semantic_edge_density", F.col("density") >= F.col("density_threshold"), F.round("density", 4), F.col("density_threshold")),
        ("low_information_ratio", F.col("low_information_ratio") <= DULL, F.round("low_information_ratio", 4), F.lit(DULL)),
    ]
    gate = F.array(*[F.struct(F.lit(n).alias("name"), p.alias("passed"), v.alias("value"), t.alias("threshold")) for n, p, v, t in rows])
    return measured.select(F.inline(gate))


def status(measured: DataFrame) -> DataFrame:
    """untrusted, partial or passed."""
    critical = F.lit(False)
    for g in CRITICAL:
        critical = critical | (F.col(g) > 0)
    weak = F.col("code_like") & (F.col("supported") > 0) & ((F.col("supported_ratio") < UNTRUSTED_SUPPORTED) | (F.col("density") < UNTRUSTED_DENSITY))
    failed = (F.col("supported_ratio") < SUPPORTED) | (F.col("density") < F.col("density_threshold")) | (F.col("low_information_ratio") > DULL)
    return measured.select(F.when(critical | weak, "untrusted").when(failed, "partial").otherwise("passed").alias("status"), "file_count", "supported", "semantic_edges")


def doctor(measured: DataFrame, quality: str, fresh: str, **files: bool) -> DataFrame:
    """(name, passed, value) of integrity checks over a stored graph; ``files`` names what must be on disk."""
    rows = [(n, F.lit(ok), F.lit(str(ok).lower())) for n, ok in files.items()]
    rows += [(g, F.col(g) == 0, F.col(g).cast("string")) for g in CRITICAL[:3]]
    rows += [("quality_not_untrusted", F.lit(quality != "untrusted"), F.lit(quality)), ("freshness_current", F.lit(fresh == "current"), F.lit(fresh))]
    return measured.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), p.alias("passed"), v.alias("value")) for n, p, v in rows])))
