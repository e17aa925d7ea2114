"""The shape in which extractors hand over what they found, and its way into a graph.

Node facts: path, seq, id, kind, label, source_path, start_line, attributes (JSON).
Edge facts: path, seq, kind, src, dst, confidence, extractor, method, locator, snippet, attributes.
An edge fact without an extractor has no evidence. seq orders the facts of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import edge_id, evidence_id, walk_key
from factloom.operators.graph import merged

def none() -> Column:
    return F.lit(None).cast("string")


def node(path: Column, seq: Column, id_: Column, kind, label: Column, *, source: Column | None = None, line: Column | None = None, attributes: Column | None = None) -> list[Column]:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    start = F.lit(None) if line is None else line
    return [path.alias("path"), seq.cast("long").alias("seq"), id_.alias("id"), kind.alias("kind"), label.alias("label"),
            (none() if source is None else source).alias("source_path"), start.cast("int").alias("start_line"), (none() if attributes is None else attributes).alias("attributes")]


def edge(path: Column, seq: Column, kind, src: Column, dst: Column, confidence, extractor, method, locator: Column, snippet: Column, *, attributes: Column | None = None) -> list[Column]:
    kind, confidence, extractor, method = (c if isinstance(c, Column) else F.lit(c).cast("string") for c in (kind, confidence, extractor, method))
    return [path.alias("path"), seq.cast("long").alias("seq"), kind.alias("kind"), src.alias("src"), dst.alias("dst"), confidence.alias("confidence"),
            extractor.alias("extractor"), method.alias("method"), locator.alias("locator"), snippet.alias("snippet"), (none() if attributes is None else attributes).alias("attributes")]


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def identified(edges: DataFrame) -> DataFrame:
    """Edge facts with id and evidence_id."""
    c = F.col
    proof = F.when(c("extractor").isNotNull(), evidence_id(c("extractor"), c("method"), c("locator"), c("snippet"), c("confidence")))
    with_proof = edges.withColumn("evidence_id", proof)
    return with_proof.withColumn("id", edge_id(c("kind"), c("src"), c("dst"), c("confidence"), c("evidence_id")))


def graph_of(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, evidence), one row an id: a file's first fact, the last file's in walk order."""
    walk = walk_key(F.col("path"))
    out_nodes = merged(nodes.withColumn("walk", walk).drop("path"))
    known = identified(edges).withColumn("walk", walk)
    out_edges = merged(known.select("id", "walk", "seq", "kind", "src", "dst", "confidence", "evidence_id", "attributes"))
    proof = known.where(F.col("evidence_id").isNotNull()).select(
        F.col("evidence_id").alias("id"), "walk", "seq", "extractor", "method", F.col("locator").alias("source_locator"), F.btrim("snippet").alias("snippet"), "confidence"
    )
    return out_nodes, out_edges, merged(proof)
