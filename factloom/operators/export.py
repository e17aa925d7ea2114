"""Linked notes from a graph: unique note paths, note texts, indexes and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import safe_name

ARCHITECTURE = ("architecture_root", "area", "domain", "layer", "role", "feature")
# Dashboards and indexes, whose names no note may take.
DASHBOARDS = ("Architecture", "Entrypoints", "Domains", "Roles", "Features", "Layers", "Graph Views", "Research")
INDEXES = {
    "Architecture": ARCHITECTURE, "Features": ("feature",), "Layers": ("layer",), "Roles": ("role",), "Domains": ("domain",), "Files": ("file",),
    "Symbols": ("class", "function"), "Modules": ("module", "imported_symbol"), "Concepts": ("concept",), "Claims": ("claim",), "Assets": ("asset_file",),
    "Artifacts": ("artifact", "lockfile"), "Config": ("config_file", "config_key"), "Observability": ("log_file", "log_statement"), "Directories": ("directory",),
}
RESERVED = ("index", *(f"Dashboards/{d}" for d in DASHBOARDS), *(f"Indexes/{i}" for i in INDEXES), "Indexes/Other")


def folded(path: Column) -> Column:
    """What two paths share if a file system without case takes them for one."""
    return F.replace(F.lower(path), F.lit("ß"), F.lit("ss"))


def base_path(nodes: DataFrame) -> Column:
    c = F.col
    name = safe_name(F.coalesce("source_path", "label", "id"))
    label = safe_name(F.coalesce("label", "id"))
    line = F.when(c("start_line").isNull(), "").otherwise(F.concat(F.lit("_L"), c("start_line").cast("string")))
    deep = lambda folder: F.concat(F.lit(f"{folder}/"), name, F.lit("__"), label, line)
    flat = lambda folder: F.concat(F.lit(f"{folder}/"), name)
    module = safe_name(F.coalesce(F.get_json_object("attributes", "$.module"), F.lit("module")))
    cases = (
        (("file",), flat("Files")), (("directory",), flat("Directories")), (("function", "class"), deep("Symbols")), (("module",), flat("Modules")),
        (("imported_symbol",), F.concat(F.lit("Modules/"), module, F.lit("__"), label)), (("asset_file",), flat("Assets")), (("artifact", "lockfile"), flat("Artifacts")),
        (("config_file",), flat("Config")), (("config_key",), deep("Config")), (("log_file",), flat("Observability")), (("log_statement",), deep("Observability")),
        (ARCHITECTURE, F.concat(F.lit("Architecture/"), c("kind"), F.lit("/"), name)), (("section",), deep("Docs")), (("reference",), flat("Docs")),
        (("concept",), flat("Concepts")), (("claim",), deep("Claims")),
    )
    out = F.lit(None).cast("string")
    for kinds, value in cases:
        out = F.when(c("kind").isin(*kinds), value).otherwise(out)
    return F.coalesce(out, F.concat(F.lit("Other/"), safe_name(c("kind")), F.lit("/"), name))


def note_paths(nodes: DataFrame) -> DataFrame:
    """(id, note): in the order of ids the first to want a path has it; others add their id, and a number where that is taken too."""
    based = nodes.select("id", base_path(nodes).alias("base"))
    turn = F.row_number().over(Window.partitionBy(folded(F.col("base"))).orderBy("id"))
    taken = folded(F.col("base")).isin(*[r.lower() for r in RESERVED])
    first = based.withColumn("n", turn + taken.cast("int")).select("id", "base", "n", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("__"), safe_name(F.col("id")))).alias("note"))
    # one with its plain path goes before one that had to add its id
    again = F.row_number().over(Window.partitionBy(folded(F.col("note"))).orderBy((F.col("n") > 1).cast("int"), "id"))
    return first.withColumn("k", again).select("id", F.when(F.col("k") == 1, F.col("note")).otherwise(F.concat("note", F.lit("_"), F.col("k").cast("string"))).alias("note"))


def index(nodes: DataFrame, kinds: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    kept = nodes.where(F.col("kind").isin(*kinds)) if kinds else nodes
    return (kept.where(~F.col("kind").isin(*exclude)) if exclude else kept).select("kind", "id", "label")


def notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(note, text): a page for each node with links both ways; containment is named, not linked."""
    paths = note_paths(nodes)
    labelled = nodes.select("id", "kind", "label", "source_path").join(paths, "id")

    def links(own: str, other: str) -> DataFrame:
        far = labelled.select(F.col("id").alias(other), F.col("label").alias("far_label"), F.col("note").alias("far_note"))
        line = F.when(F.col("kind") == "contains", F.concat(F.lit("- `contains` `"), "far_label", F.lit("`"))).otherwise(
            F.concat(F.lit("- `"), "kind", F.lit("` [["), "far_note", F.lit("|"), "far_label", F.lit("]]"))
        )
        each = edges.join(far, other).select(F.col(own).alias("id"), F.struct("kind", other, line.alias("line")).alias("l"))
        return each.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("l")), lambda x: x["line"]), "\n").alias(f"{own}_lines"))

    joined = labelled.join(links("src", "dst"), "id", "left").join(links("dst", "src"), "id", "left")
    none = F.lit("- none")
    text = F.concat(
        F.lit("# "), F.coalesce("label", "id"), F.lit("\n\n- id: `"), "id", F.lit("`\n- kind: `"), "kind", F.lit("`\n- source: `"), F.coalesce("source_path", F.lit("")),
        F.lit("`\n\n## Outgoing\n\n"), F.coalesce("src_lines", none), F.lit("\n\n## Incoming\n\n"), F.coalesce("dst_lines", none), F.lit("\n"),
    )
    return joined.select("note", text.alias("text"))


def ranked_page(title: str, rows: DataFrame, by: str) -> DataFrame:
    """(note, text) of one dashboard from ranked rows (kind, rank, note, label, n); a dashboard's rows are a few."""
    line = F.concat(F.lit("- [["), "note", F.lit("|"), "label", F.lit("]] ("), F.col("n").cast("string"), F.lit(f" {by})"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "rank", line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.agg(F.lit(f"Dashboards/{title}").alias("note"), F.concat(F.lit(f"# {title}\n\n"), body, F.lit("\n")).alias("text"))


def hub_page(title: str, rows: DataFrame, details: DataFrame, paths: DataFrame) -> DataFrame:
    """(note, text) of a dashboard of all hubs of a kind: the ranked hubs, then each with its files (graph.hub_details)."""
    c = F.col
    of = details.join(paths.select(c("id").alias("file"), c("note").alias("file_note")), "file")
    file = F.concat(F.lit("- [["), "file_note", F.lit("|"), "source_path", F.lit("]] ("), "reasons", F.lit("; "), c("degree").cast("string"), F.lit(" semantic edges)"))
    files = of.groupBy(c("hub").alias("id")).agg(
        F.max("n_files").alias("n_files"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", file.alias("line")))), lambda x: x["line"]), "\n").alias("files")
    )
    link = F.concat(F.lit("[["), "note", F.lit("|"), F.coalesce("label", "id"), F.lit("]] ("))
    hub = F.concat(F.lit("- "), link, c("n").cast("string"), F.lit(" files)"))
    more = F.concat(F.lit("### "), link, F.coalesce("n_files", F.lit(0)).cast("string"), F.lit(" linked files)\n\n"), F.coalesce("files", F.lit("- No linked files")))
    each = rows.join(files, "id", "left").agg(F.array_sort(F.collect_list(F.struct("kind", "rank", hub.alias("hub"), more.alias("more")))).alias("l"))
    body = lambda name, sep: F.when(F.size("l") == 0, "- None").otherwise(F.array_join(F.transform("l", lambda x: x[name]), sep))
    text = F.concat(F.lit(f"# {title}\n\n"), body("hub", "\n"), F.lit("\n\n## Top Hubs With Files\n\n"), body("more", "\n\n"), F.lit("\n"))
    return each.select(F.lit(f"Dashboards/{title}").alias("note"), text.alias("text"))


def index_pages(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(note, text) of all indexes, the one of other kinds included."""
    of = F.array(*[F.when(F.col("kind").isin(*kinds), title) for title, kinds in INDEXES.items()])
    titles = F.filter(of, lambda t: t.isNotNull())
    each = nodes.join(paths, "id").withColumn("title", F.explode(F.when(F.size(titles) == 0, F.array(F.lit("Other"))).otherwise(titles)))
    line = F.concat(F.lit("- [["), "note", F.lit("|"), F.coalesce("label", "id"), F.lit("]]"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n")
    return each.groupBy("title").agg(body.alias("body")).select(
        F.concat(F.lit("Indexes/"), "title").alias("note"), F.concat(F.lit("# "), "title", F.lit("\n\n"), "body", F.lit("\n")).alias("text")
    )
