"""Node and edge facts of source files: imports, definitions, references, calls, exports, renders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.classify import SCRIPT
from factloom.functions.text import suffix_of
from factloom.operators import script
from factloom.operators.facts import edge, node, union
from factloom.operators.resolve import resolved


def _file() -> Column:
    return F.concat(F.lit("file:"), F.col("path"))


def _at() -> Column:
    return F.concat_ws(":", "path", F.col("line_number").cast("string"))


def _attributes(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())]))


def import_facts(imports: DataFrame, inventory: DataFrame, aliases: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, bindings) of imports (path, seq, line_number, snippet, module, names, edge_kind, bind, method, extractor, relative_level)."""
    c = F.col
    found = imports.join(resolved(imports, inventory, aliases).withColumnRenamed("target", "file"), ["path", "module"], "left")
    inside = c("file").isNotNull()
    found = found.withColumn("dst", F.when(inside, F.concat(F.lit("file:"), "file")).otherwise(F.concat(F.lit("module:"), "module"))).withColumn(
        "sure", F.when(inside, "DERIVED").otherwise("PROVEN")
    ).withColumn("how", F.coalesce("method", F.when(inside, "lexical-import+relative-resolution").otherwise("lexical-import")))
    proof = (c("sure"), c("extractor"), c("how"), _at(), c("snippet"))
    outside = found.where(~inside)
    each = outside.withColumn("nth", F.lit(0)).select("*", F.posexplode("names").alias("at", "name")).withColumn("symbol", F.concat(F.lit("imported-symbol:"), "module", F.lit("#"), "name"))
    said, told = {"module": c("module"), "relative_level": c("relative_level")}, {"module": c("module"), "symbol": c("name"), "relative_level": c("relative_level")}
    nodes = union([
        outside.select(*node(c("path"), c("seq"), c("dst"), "module", c("module"))),
        each.select(*node(c("path"), c("seq"), c("symbol"), "imported_symbol", c("name"), attributes=_attributes(module=c("module")))),
    ])
    edges = union([
        found.select(*edge(c("path"), c("seq"), c("edge_kind"), _file(), c("dst"), *proof, attributes=_attributes(**said))),
        each.select(*edge(c("path"), c("seq"), "exports", c("dst"), c("symbol"), *proof, attributes=_attributes(**told))),
        each.select(*edge(c("path"), c("seq"), c("edge_kind"), _file(), c("symbol"), *proof, attributes=_attributes(**told))),
    ])
    bound = found.where("bind").select("path", F.explode("names").alias("name"), "seq", "module", "dst", "sure", inside.alias("inside"))
    target = F.when(c("inside"), c("dst")).otherwise(F.concat(F.lit("imported-symbol:"), "module", F.lit("#"), "name"))
    return nodes, edges, script.last_bindings(bound.select("path", "name", "seq", target.alias("target"), c("sure").alias("confidence")))


def source_facts(records: DataFrame, lines: DataFrame, inventory: DataFrame, aliases: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Facts of script and Python files from parser records and lines."""
    c = F.col
    fields = ["path", "seq", "line_number", "snippet", "module", "names", "edge_kind", "bind", "method", "extractor", "relative_level"]
    inline = script.inline_modules(lines).select(
        "path", (c("line_number") * 16 + 1).alias("seq"), "line_number", c("line").alias("snippet"), "module", F.array().cast("array<string>").alias("names"),
        F.lit("imports").alias("edge_kind"), F.lit(False).alias("bind"), "method", F.lit("code.lexical").alias("extractor"), F.lit(None).cast("long").alias("relative_level"),
    )
    nodes, edges, bindings = import_facts(records.where("rec = 'import'").select(fields).unionByName(inline), inventory, aliases)
    node_frames, edge_frames = [nodes], [edges]

    # Python: definitions, what they rest on, and what they call
    python = lambda rec: records.where(c("rec") == rec)
    defined = python("definition")
    owner = F.when(c("module").isNotNull(), _attributes(owner=c("module")))
    node_frames.append(defined.select(*node(c("path"), c("seq"), c("id"), c("kind"), c("name"), source=c("path"), line=c("line_number"), attributes=owner)))
    for kind in ("contains", "defines"):
        edge_frames.append(defined.select(*edge(c("path"), c("seq"), kind, c("owner"), c("id"), "PROVEN", c("extractor"), c("method"), _at(), c("snippet"))))
    names = bindings.select("path", "name", c("target").alias("bound"), "confidence")
    leaning = python("reference").join(names, ["path", "name"], "left").withColumn("dst", F.coalesce("target", "bound")).where("dst IS NOT NULL AND dst <> id")
    sure = F.when(c("target").isNotNull(), "PROVEN").otherwise(c("confidence"))
    edge_frames.append(leaning.select(*edge(c("path"), c("seq"), "depends_on", c("id"), c("dst"), sure, c("extractor"), c("method"), _at(), c("snippet"), attributes=_attributes(relationship=c("method")))))
    edge_frames.append(python("call").select(*edge(c("path"), c("seq"), "calls", c("id"), c("target"), "PROVEN", c("extractor"), "call", _at(), c("snippet"), attributes=_attributes(function=c("name")))))

    # scripts, and Python that doesn't parse: line by line
    unparsed = python("unparsed").select("path")
    is_script = suffix_of(c("path")).isin(*SCRIPT)
    plain = lines.where(is_script).unionByName(lines.where(suffix_of(c("path")) == ".py").join(unparsed, "path", "left_semi"))
    symbol = F.concat(F.lit("symbol:"), "path", F.lit("#"), "name", F.lit(":"), c("line_number").cast("string"))
    local = script.definitions(plain).withColumn("id", symbol)
    exports = script.local_exports(plain)
    missing = exports.select("path", "name").distinct().join(local.select("path", "name"), ["path", "name"], "left_anti")
    extra = script.local_bindings(plain).join(missing, ["path", "name"]).select("path", "line_number", "line", F.lit("symbol").alias("kind"), "name", F.lit(False).alias("exported")).withColumn("id", symbol)
    every = local.select("path", "line_number", "line", "kind", "name", "exported", "id").unionByName(extra)
    seq = c("line_number") * 16 + 2
    node_frames.append(every.select(*node(c("path"), seq, c("id"), c("kind"), c("name"), source=c("path"), line=c("line_number"))))
    proof = ("PROVEN", "code.lexical", F.concat("kind", F.lit("-definition")), _at(), c("line"))
    for kind in ("contains", "defines"):
        edge_frames.append(every.select(*edge(c("path"), seq, kind, _file(), c("id"), *proof)))
    edge_frames.append(every.where("exported").select(*edge(c("path"), seq, "exports", _file(), c("id"), *proof, attributes=_attributes(symbol=c("name")))))
    last = every.groupBy("path", "name").agg(F.max_by("id", "line_number").alias("id"))
    shown = exports.join(last, ["path", "name"])
    edge_frames.append(shown.select(*edge(c("path"), seq + 1, "exports", _file(), c("id"), "PROVEN", "code.lexical", "lexical-commonjs-export", _at(), c("line"), attributes=_attributes(symbol=c("name")))))
    drawn = script.renders(plain, bindings.drop("confidence"))
    edge_frames.append(drawn.select(*edge(c("path"), seq + 2, "renders", _file(), c("target"), "DERIVED", "code.lexical", "jsx-render", _at(), c("line"), attributes=_attributes(component=c("component")))))
    return union(node_frames), union(edge_frames)
