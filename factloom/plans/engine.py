"""Building a graph from a directory and asking about it: scan, status, refresh, query, overview, doctor, export, clean.

A bundle is a folder of Parquet tables (nodes, edges, evidence, files, skipped,
results, and the facts by file that a refresh reuses), a manifest and a marker
that is removed first and written last.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from dataclasses import asdict, dataclass, replace
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import classify as C
from factloom.functions.text import name_of, parts
from factloom.operators import architecture, code, code_facts, export, facts, freshness, graph, lines, quality, traverse
from factloom.sources import disk

READY, MANIFEST, REPORT, VAULT, VERSION = ".ready", "manifest.json", "REPORT.md", "vault", 1
HUBS = ("area", "domain", "layer", "role", "feature")
#: What each extractor may find.
DECLARATIONS = (
    ("markdown", ("documentation",), ("claim", "concept", "reference", "section"), ("contains", "mentions", "references", "cites", "supports", "contradicts", "depends_on", "derived_from")),
    ("config.lexical", ("configuration",), ("config_file", "config_key"), ("configures", "defines")),
    ("log.lexical", ("observability",), ("log_file", "log_statement"), ("diagnoses", "emits_log")),
    ("asset.metadata", ("asset",), ("asset_file",), ("stores_asset",)),
    ("artifact.metadata", ("generated",), ("artifact", "lockfile"), ("generated_from",)),
    ("python.ast", ("code", "test"), ("class", "function", "module", "imported_symbol"), ("calls", "contains", "defines", "exports", "imports", "depends_on")),
    ("code.lexical", ("code", "test"), ("class", "function", "module", "imported_symbol", "symbol"), ("contains", "defines", "exports", "imports", "renders")),
)


@dataclass(frozen=True)
class Options:
    include: tuple[str, ...] = ()
    disable_default_ignore: tuple[str, ...] = ()
    no_default_ignores: bool = False
    inside_target: bool = False
    vault: bool = False
    replace_output: bool = False
    existing_output: bool = False
    incremental: bool = False
    config: str | None = None


def is_bundle(out: Path) -> bool:
    return (out / MANIFEST).is_file() and (out / "nodes").is_dir()


def prepare(target: Path, out: Path, options: Options) -> None:
    """Refuses outputs that would touch anything but a bundle; takes the marker away."""
    if not target.is_dir():
        raise ValueError(f"target {target} is not a directory")
    if out == target or out in target.parents:
        raise ValueError("the output may not hold the target")
    if target in out.parents and not options.inside_target:
        raise ValueError("the output lies inside the target")
    if out.exists() and any(out.iterdir()):
        if not is_bundle(out):
            raise ValueError(f"{out} is not empty and no bundle")
        if not (options.replace_output or options.existing_output):
            raise ValueError(f"{out} holds a bundle; replace it explicitly")
    out.mkdir(parents=True, exist_ok=True)
    (out / READY).unlink(missing_ok=True)


def write_text(path: Path, text: str) -> None:
    """All of it or nothing."""
    part = path.with_name(f"{path.name}.part")
    part.write_text(text, "utf-8")
    os.replace(part, path)


def write_table(df: DataFrame, out: Path, name: str, by: str | None = None) -> DataFrame:
    """Written beside, then swapped in: a plan may read the table it replaces. Sorted by a column over all its files, if one is named."""
    df = df.repartitionByRange(by).sortWithinPartitions(by) if by else df
    df.write.mode("overwrite").parquet(str(out / f"{name}.part"))
    shutil.rmtree(out / name, ignore_errors=True)
    os.replace(out / f"{name}.part", out / name)
    return table(df.sparkSession, out, name)


def table(spark: SparkSession, out: Path, name: str) -> DataFrame:
    return spark.read.parquet(str(out / name))


def counts_by(df: DataFrame, column: str) -> dict[str, int]:
    """Rows a value of a column that takes few values, in their order."""
    return {r[0]: r[1] for r in df.groupBy(column).count().orderBy(column).collect()}


def load(spark: SparkSession, out: Path) -> tuple[DataFrame, DataFrame, DataFrame]:
    if not (out / READY).is_file():
        raise ValueError(f"{out} is not ready")
    return tuple(table(spark, out, n) for n in ("nodes", "edges", "evidence"))


def manifest_of(out: Path) -> dict:
    if not (out / MANIFEST).is_file():
        raise ValueError(f"{out} holds no manifest")
    return json.loads((out / MANIFEST).read_text("utf-8"))


def extract(files: DataFrame, inventory: DataFrame, aliases: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Facts of files (path, size, text, domain, extractor)."""
    by = lambda *names: files.where(F.col("extractor").isin(*names))
    note = lines.note_facts(lines.lines_of(by("markdown")))
    conf = lines.config_facts(by("config.lexical").select("path"), lines.lines_of(by("config.lexical")))
    logs = lines.log_facts(by("log.lexical").select("path"), lines.lines_of(by("log.lexical")))
    meta = lines.metadata_facts(by("asset.metadata", "artifact.metadata").withColumn("is_lockfile", C.is_lockfile(F.col("path"))))
    sources = by("python.ast", "code.lexical")
    src = code_facts.source_facts(traverse.kept(code.records(sources)), lines.lines_of(sources), inventory, aliases)
    every = (note, conf, logs, meta, src)
    return facts.union([n for n, _ in every]), facts.union([e for _, e in every])


def structure(files: DataFrame, target: Path) -> tuple[DataFrame, DataFrame]:
    """The collection, its directories and files, each contained in the one above; containment needs no evidence."""
    c, none = F.col, F.lit(None).cast("string")
    parent = lambda p: F.when(F.size(parts(p)) > 1, F.concat(F.lit("dir:"), F.array_join(F.slice(parts(p), F.lit(1), F.size(parts(p)) - 1), "/"))).otherwise("collection:target")
    spark = files.sparkSession
    root = spark.range(1).select(*facts.node(F.lit(""), F.lit(0), F.lit("collection:target"), "collection", F.lit(target.name), attributes=F.to_json(F.struct(F.lit(str(target)).alias("absolute_path")))))
    dirs = disk.directories(files).withColumnRenamed("directory", "path")
    own = F.concat(F.lit("dir:"), "path")
    seen = F.to_json(F.struct(c("domain").alias("content_domain"), F.lower(F.regexp_extract(name_of(c("path")), r"[^.].*?(\.[^.]+)$", 1)).alias("extension"), "sha256", "size"))
    file = F.concat(F.lit("file:"), "path")
    up = lambda me: ("contains", parent(c("path")), me, "PROVEN", none, none, none, none)
    nodes = [root, dirs.select(*facts.node(c("path"), F.lit(0), own, "directory", name_of(c("path")), source=c("path"))),
             files.select(*facts.node(c("path"), F.lit(-1), file, "file", name_of(c("path")), source=c("path"), attributes=seen))]
    edges = [dirs.select(*facts.edge(c("path"), F.lit(0), *up(own))), files.select(*facts.edge(c("path"), F.lit(-1), *up(file)))]
    return facts.union(nodes), facts.union(edges)


def enriched(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, files: DataFrame, config: disk.Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph with the inferred architecture layer over it; what was there first stays."""
    classes = traverse.kept(architecture.classified(files, config.markers, config.generic))
    found = architecture.hubs(classes)
    spark, none = nodes.sparkSession, F.lit(None).cast("string")
    more = found.select("id", F.col("dimension").alias("kind"), F.col("value").alias("label"), none.alias("source_path"), F.lit(None).cast("int").alias("start_line"), none.alias("attributes"))
    root = spark.range(1).select(F.lit("arch:project").alias("id"), F.lit("architecture_root").alias("kind"), F.lit("project").alias("label"), none.alias("source_path"), F.lit(None).cast("int").alias("start_line"), none.alias("attributes"))
    imports = edges.where("kind = 'imports'").select("id", "src", "dst")
    inferred = facts.union([architecture.hub_edges(found), architecture.file_edges(classes), architecture.import_edges(imports, classes)])
    proof = inferred.select(F.col("evidence_id").alias("id"), F.lit("architecture.enrichment").alias("extractor"), F.col("kind").alias("method"), F.col("locator").alias("source_locator"), "snippet", "confidence").dropDuplicates(["id"])
    new = inferred.select("id", "kind", "src", "dst", "confidence", "evidence_id", none.alias("attributes")).dropDuplicates(["id"])
    fresh = lambda a, b: a.unionByName(b.join(a.select("id"), "id", "left_anti"))
    return fresh(nodes, more.unionByName(root)), fresh(edges, new), fresh(evidence, proof)


def scan(spark: SparkSession, target: str | Path, output: str | Path, options: Options = Options()) -> dict:
    target, out = Path(target).resolve(), Path(output).resolve()
    prepare(target, out, options)
    config = disk.load_config(target, options.config)
    merged = replace(config, include=(*config.include, *options.include), disable_default_ignore=(*config.disable_default_ignore, *options.disable_default_ignore), no_default_ignores=config.no_default_ignores or options.no_default_ignores)
    runtime = (out.relative_to(target).as_posix(),) if target in out.parents else ()
    rules = disk.ignore_rules(target, merged, runtime)
    found, skipped = disk.walk(target, rules, merged.include)
    aliases = [*config.aliases, *disk.package_aliases(target, found)]
    stat = disk.inventory(spark, found)
    path = F.col("path")
    previous = manifest_of(out) if options.incremental and is_bundle(out) else None
    if previous and previous["version"] != VERSION:  # facts of another version say nothing here
        previous = None

    # contents are read where size or time tell of a change, and everywhere in a full build
    if previous:
        old = table(spark, out, "files")
        reused = freshness.reused_fingerprints(old, stat, F.lit(None).cast("string"))
        unread = reused.where("reused").select("path", "size", "mtime_ns", "sha256", F.lit(None).cast("string").alias("error"))
        read = traverse.kept(disk.contents(reused.where("NOT reused").select("path", "size", "mtime_ns"), target))
        known = unread.unionByName(read.drop("text"))
        plan = freshness.refresh_plan(freshness.content_diff(old, known), config_changed=previous["config_stamp"] != (list(config.stamp) if config.stamp else None), aliases_changed=previous["aliases"] != [list(a) for a in aliases])
        plan = plan.first().asDict()
    else:
        plan = {"mode": "full", "reason": "no_previous_manifest", "added": len(found), "deleted": 0, "changed": 0}
    if plan["mode"] == "full":
        read = traverse.kept(disk.contents(stat, target))
        known = read.drop("text")
    classed = lambda df: df.select("*", C.content_domain(path).alias("domain"), C.is_supported(path).alias("supported"), C.extractor(path).alias("extractor"))
    files = traverse.kept(classed(known))
    # an import may name a file that the scan leaves out
    everything = disk.inventory(spark, disk.walk(target, [])[0]) if skipped else files
    new_nodes, new_edges = extract(classed(read).where("supported AND error IS NULL"), everything.select("path"), aliases)
    if plan["mode"] == "incremental":
        again = read.select("path")
        new_nodes = new_nodes.unionByName(table(spark, out, "fact_nodes").join(again, "path", "left_anti"))
        new_edges = new_edges.unionByName(table(spark, out, "fact_edges").join(again, "path", "left_anti"))
    fact_nodes, fact_edges = write_table(new_nodes, out, "fact_nodes"), write_table(new_edges, out, "fact_edges")

    made_nodes, made_edges = structure(files, target)
    base = [traverse.kept(t) for t in facts.graph_of(fact_nodes.unionByName(made_nodes), fact_edges.unionByName(made_edges))]
    nodes, edges, evidence = (write_table(t, out, n, "id") for t, n in zip(enriched(*base, files, config), ("nodes", "edges", "evidence"), strict=True))
    write_table(files, out, "files")
    write_table(spark.createDataFrame(skipped, "path string, reason string"), out, "skipped")
    own = facts.identified(fact_edges).dropDuplicates(["path", "id"])
    results = write_table(quality.extraction_results(files.select("path", "extractor", "supported", "domain", "error"), fact_nodes.dropDuplicates(["path", "id"]), own), out, "results")
    listed = nodes.where(F.col("kind").isin("file", "section", "function", "class") & F.col("source_path").isNotNull())
    invalid = listed.join(everything.select(path.alias("source_path")), "source_path", "left_anti").count()
    measured = traverse.kept(quality.measures(results, nodes, edges, evidence, invalid_paths=invalid))
    summary = traverse.component_summary(traverse.components(nodes, edges)).first().asDict()
    manifest = {
        "version": VERSION, "target": str(target), "output": str(out), "at": datetime.now(UTC).isoformat(timespec="seconds"), "freshness": "current",
        "options": asdict(options), "effective": {"include": merged.include, "disable_default_ignore": merged.disable_default_ignore, "no_default_ignores": merged.no_default_ignores},
        "config": config.path, "config_stamp": config.stamp, "aliases": aliases, "declarations": DECLARATIONS, "ignore_rules": rules, "refresh": plan | {"reused": len(found) - read.count() if plan["mode"] == "incremental" else 0},
        "cache": {"reused": files.count() - read.count(), "read": read.count(), "written": fact_nodes.select("path").unionByName(fact_edges.select("path")).distinct().count()},
        "quality": {"status": quality.status(measured).first()["status"], "gates": [r.asDict() for r in quality.gates(measured).collect()], "components": summary,
                    "skipped_count": len(skipped), **measured.first().asDict(), **graph.totals(nodes, edges, evidence).first().asDict(),
                    "content_domain_counts": counts_by(files, "domain"), "unsupported_by_domain": counts_by(files.where("NOT supported"), "domain"), "extractors": counts_by(files.where("supported"), "extractor"),
                    "nodes_by_kind": counts_by(nodes, "kind"), "relationship_edges_by_kind": counts_by(edges.where(graph.semantic()), "kind")},
        "observed_kinds": [r.asDict() for r in quality.observed_kinds(results).collect()],
    }
    write_text(out / REPORT, report(manifest))
    write_text(out / MANIFEST, json.dumps(manifest, indent=2, sort_keys=True))
    if options.vault:
        write_vault(nodes, edges, out)
    write_text(out / READY, "ready\n")
    return json.loads((out / MANIFEST).read_text("utf-8"))


def report(manifest: dict) -> str:
    q = manifest["quality"]
    facts_ = [("Target", manifest["target"]), ("Quality", q["status"]), ("Files", q["file_count"]), ("Skipped", q["skipped_count"]), ("Nodes", q["node_count"]), ("Edges", q["edge_count"]), ("Evidence", q["evidence_count"]),
              ("Supported", round(q["supported_ratio"], 4)), ("Semantic edges a file", round(q["density"], 4)), ("Components", q["components"]["component_count"]), ("Singletons", q["components"]["singleton_count"])]
    gates = [f"- {g['name']}: {'pass' if g['passed'] else 'fail'} ({g['value']:g}, bound {g['threshold']:g})" for g in q["gates"]]
    return "\n".join(["# Graph report", "", *[f"- {k}: {v}" for k, v in facts_], "", "## Gates", "", *gates, ""])


def refresh(spark: SparkSession, output: str | Path) -> dict:
    """Scans again with the options of the bundle, reusing what did not change."""
    kept = manifest_of(Path(output).resolve())
    said = {k: tuple(v) if isinstance(v, list) else v for k, v in kept["options"].items()}
    return scan(spark, kept["target"], output, replace(Options(**said), incremental=True, existing_output=True, replace_output=False, config=kept["config"]))


def status(spark: SparkSession, output: str | Path) -> dict:
    """Freshness of a bundle from names, sizes and times, and all paths that differ; no content is read."""
    out = Path(output).resolve()
    kept = manifest_of(out)
    target = Path(kept["target"])
    said = {"target": str(target), "output": str(out)}
    if not (out / READY).is_file():
        return said | {"freshness": "building", "reason": "ready_marker_missing"}
    if not target.is_dir():
        return said | {"freshness": "failed", "reason": "target_missing"}
    config = disk.Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in kept["effective"].items()})
    runtime = (out.relative_to(target).as_posix(),) if target in out.parents else ()
    now, _ = disk.walk(target, disk.ignore_rules(target, config, runtime), config.include)
    moved = False
    if kept["config"]:
        path = Path(kept["config"])
        moved = not path.is_file() or [path.stat().st_size, path.stat().st_mtime_ns] != kept["config_stamp"]
    diff = traverse.kept(freshness.stat_diff(table(spark, out, "files"), disk.inventory(spark, now)))
    row = freshness.freshness(diff, config_changed=moved).first()
    known = table(spark, out, "files").count()
    paths = {s: [r["path"] for r in diff.where(F.col("state") == s).select("path").orderBy("path").toLocalIterator()] for s in ("added", "deleted", "changed")}
    return said | {"freshness": row["freshness"], "config_changed": moved, "counts": {s: row[s] for s in paths}, "indexed_file_count": known, "current_file_count": len(now), **paths}


def query(spark: SparkSession, output: str | Path, node: str, *, depth: int = 1, direction: str = "out", confidence: tuple[str, ...] = (), containment: bool = False) -> dict:
    """What lies around a node: DataFrames nodes, edges and evidence, with the nodes that match and warnings."""
    nodes, edges, evidence = load(spark, Path(output).resolve())
    match = traverse.kept(graph.find_nodes(nodes, node))
    n = match.count()
    if n != 1:
        empty = {"nodes": nodes.limit(0), "edges": edges.limit(0), "evidence": evidence.limit(0)}
        return empty | {"matches": match, "warnings": ["no matching node" if not n else f"{n} nodes match"]}
    near, met = traverse.subgraph(nodes, edges, match, depth=depth, direction=direction, confidence=confidence, containment=containment)
    return {"nodes": near.orderBy("id"), "edges": met.orderBy("id"), "evidence": graph.evidence_of(met, evidence).orderBy("id"), "matches": match, "warnings": []}


def overview(spark: SparkSession, output: str | Path, limit: int = 12) -> dict:
    nodes, edges, evidence = load(spark, Path(output).resolve())
    kept = manifest_of(Path(output).resolve())
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  bounded by limit or by the number of kinds
    q = kept["quality"]
    warnings = ([f"quality is {q['status']}"] if q["status"] != "passed" else []) + ([f"{n} unsupported files"] if (n := q["file_count"] - q["supported"]) else [])
    return {
        "totals": graph.totals(nodes, edges, evidence).first().asDict(), "node_kinds": rows(graph.kind_counts(nodes).orderBy("kind")), "edge_kinds": rows(graph.kind_counts(edges).orderBy("kind")),
        "architecture": rows(graph.top_per_kind(nodes, graph.linked_files(edges), HUBS, limit).orderBy("kind", "rank")), "important_files": rows(graph.top_files(nodes, edges, limit)),
        "external_modules": rows(graph.external_modules(nodes, edges, limit)), "entrypoints": rows(graph.first_per_kind(nodes, HUBS, limit).orderBy("kind", "rank")),
        "freshness": status(spark, output)["freshness"], "quality": q["status"], "warnings": warnings,
    }


def doctor(spark: SparkSession, output: str | Path) -> dict:
    """Every integrity check of a bundle, and whether all pass."""
    out = Path(output).resolve()
    nodes, edges, evidence = load(spark, out)
    kept = manifest_of(out)
    measured = quality.measures(table(spark, out, "results"), nodes, edges, evidence)
    on_disk = {"ready_marker": (out / READY).is_file(), "graph_tables": is_bundle(out), "manifest_file": True}
    if (out / VAULT).is_dir():
        paths = traverse.kept(export.note_paths(nodes))
        same, clashes = (graph.duplicates(paths, c).isEmpty() for c in (F.col("note"), export.folded(F.col("note"))))
        reserved = paths.where(export.folded(F.col("note")).isin(*[r.lower() for r in export.RESERVED])).isEmpty()
        there = spark.createDataFrame([(p.relative_to(out / VAULT).with_suffix("").as_posix(),) for p in (out / VAULT).rglob("*.md")], "note string")
        on_disk |= {"note_paths_unique": same, "note_paths_unique_folded": clashes, "note_paths_free": reserved, "notes_present": paths.join(there, "note", "left_anti").isEmpty(), "vault_settings": (out / VAULT / "view.json").is_file()}
    now = status(spark, out)
    checks = [r.asDict() for r in quality.doctor(measured, kept["quality"]["status"], now["freshness"], **on_disk).collect()]
    verdict = "passed" if all(c["passed"] for c in checks) else "failed"
    return {"status": verdict, "checks": checks, "target": kept["target"], "output": str(out), "freshness": now, "quality": kept["quality"]}


def write_vault(nodes: DataFrame, edges: DataFrame, out: Path) -> None:
    """Notes, indexes and dashboards, written by the executors beside the old ones and swapped in."""
    paths = traverse.kept(export.note_paths(nodes))
    rank = lambda kinds, k: graph.top_per_kind(nodes, graph.linked_files(edges), kinds, k).join(paths, "id")
    degree = graph.semantic_degree(edges).withColumnRenamed("degree", "n")
    pages = [export.notes(nodes, edges), export.index_pages(nodes, paths)]
    pages.append(export.ranked_page("Architecture", rank(HUBS, 8), "files"))
    pages += [export.hub_page(t, rank(k, None), graph.hub_details(nodes, edges, k, 8), paths) for t, k in (("Domains", ("domain",)), ("Roles", ("role",)), ("Features", ("feature",)), ("Layers", ("layer",)))]
    pages.append(export.ranked_page("Entrypoints", graph.top_per_kind(nodes, degree, ("file",), 24).join(paths, "id"), "semantic edges"))
    pages.append(export.ranked_page("Research", graph.top_per_kind(nodes, degree, ("concept", "claim", "reference"), 24).join(paths, "id"), "semantic edges"))
    pages.append(export.ranked_page("Graph Views", graph.top_per_kind(nodes, degree, (*HUBS, "module"), 8).join(paths, "id"), "semantic edges"))
    part = Path(tempfile.mkdtemp(prefix="vault-", dir=out))
    root = str(part)

    def put(batches):
        for pdf in batches:
            for note, text in zip(pdf["note"], pdf["text"], strict=True):
                at = Path(root, f"{note}.md")
                at.parent.mkdir(parents=True, exist_ok=True)
                at.write_text(text, "utf-8")
            yield pdf[["note"]]

    facts.union(pages).mapInPandas(put, "note string").write.format("noop").mode("overwrite").save()
    write_text(part / "index.md", "# Graph\n\n" + "".join(f"- [[Dashboards/{d}]]\n" for d in export.DASHBOARDS) + "".join(f"- [[Indexes/{i}]]\n" for i in (*export.INDEXES, "Other")))
    write_text(part / "view.json", json.dumps({"colorGroups": [{"query": f"path:{f}/"} for f in ("Architecture", "Docs", "Files", "Modules", "Symbols")], "showOrphans": True}, indent=2))
    shutil.rmtree(out / VAULT, ignore_errors=True)
    os.replace(part, out / VAULT)


def export_vault(spark: SparkSession, output: str | Path) -> Path:
    out = Path(output).resolve()
    nodes, edges, _ = load(spark, out)
    write_vault(nodes, edges, out)
    return out / VAULT


def clean(output: str | Path, *, yes: bool = False) -> None:
    """Removes a bundle, and nothing else, when told to."""
    out = Path(output).resolve()
    if not yes:
        raise ValueError("say yes to remove the bundle")
    if not is_bundle(out):
        raise ValueError(f"{out} is no bundle")
    shutil.rmtree(out)
