"""Import specifiers to files of an inventory.

A distinct base path becomes at most four keys (the path itself, with an
extension, with its extension replaced, an index file in it); the inventory is
keyed by path and by path without extension; one equi-join and a minimum choose.
Specifiers join their base path's file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.classify import CODE, MARKDOWN

#: Extensions in the order in which they are tried.
ORDER = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", *sorted(set(CODE) - {".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py"}), *MARKDOWN)
_EXTENSION = r"\.[^./]+$"


def normal_path(path: Column) -> Column:
    """The path without . and .. segments; null where it leaves the root."""
    keep = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.lit(None).cast("array<string>")))
        .otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(keep, "/")


def alias_base(module: Column, pattern: str, target: str) -> Column:
    """The base path that an alias gives a module, or null."""
    if "*" in pattern:
        head, _, tail = pattern.partition("*")
        middle = F.substring(module, F.lit(len(head) + 1), F.length(module) - len(head) - len(tail))
        value = F.replace(F.lit(target), F.lit("*"), middle)
        return F.when(module.startswith(head) & module.endswith(tail) & (F.length(module) >= len(head) + len(tail)), value)
    head, to = pattern.rstrip("/"), target.rstrip("/")
    return F.when(module == head, F.lit(to)).when(module.startswith(f"{head}/"), F.concat(F.lit(to), F.substring(module, F.lit(len(head) + 1), F.length(module))))


def bases(path: Column, module: Column, aliases: list[tuple[str, str]]) -> Column:
    """The base paths a specifier may mean, in order of preference."""
    here = F.regexp_replace(path, "[^/]*$", "")
    dots = F.length(F.regexp_extract(module, r"^(\.+)", 1))
    dotted = F.concat(here, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), F.replace(F.substring(module, dots + 1, F.length(module)), F.lit("."), F.lit("/")))
    other = F.array(*[alias_base(module, p, t) for p, t in aliases]) if aliases else F.array().cast("array<string>")
    raw = F.when(module.rlike(r"^\.\.?/"), F.array(F.concat(here, module))).when(module.startswith("."), F.array(dotted)).otherwise(other)
    return F.transform(raw, normal_path)


def targets(keys: DataFrame, inventory: DataFrame) -> DataFrame:
    """(key, target) of the base paths (key: in lower case, distinct) that mean a file."""
    base = F.col("key")
    tried = F.array(
        F.struct(F.lit(0).alias("way"), base.alias("name"), F.lit("=").alias("how")), F.struct(F.lit(1).alias("way"), base.alias("name"), F.lit("s").alias("how")),
        F.struct(F.lit(2).alias("way"), F.when(base.rlike(_EXTENSION), F.regexp_replace(base, _EXTENSION, "")).alias("name"), F.lit("s").alias("how")),
        F.struct(F.lit(3).alias("way"), F.concat(base, F.lit("/index")).alias("name"), F.lit("s").alias("how")),
    )
    asked = keys.select("key", F.explode(tried).alias("k")).where("k.name IS NOT NULL").select("key", "k.way", "k.name", "k.how")
    ext = F.lower(F.regexp_extract("path", _EXTENSION, 0))
    rank = F.array_position(F.array(*map(F.lit, ORDER)), ext)
    there = inventory.select(F.col("path").alias("target"), rank.alias("rank"), F.explode(F.array(
        F.struct(F.lit("=").alias("how"), F.lower("path").alias("name")), F.struct(F.lit("s").alias("how"), F.when(rank > 0, F.regexp_replace(F.lower("path"), _EXTENSION, "")).alias("name")),
    )).alias("k")).where("k.name IS NOT NULL").select("target", "rank", "k.how", "k.name")
    code_only = (F.col("way") != 3) | (F.col("rank") <= len(ORDER) - len(MARKDOWN))
    return asked.join(there, ["how", "name"]).where(code_only).groupBy("key").agg(F.min_by("target", F.struct("way", "rank", "target")).alias("target"))


def with_target(imports: DataFrame, inventory: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """imports (path, module and more), each with the file that its specifier means, null if none.

    Only distinct base paths meet the inventory; a specifier without a base gets a key of its own that no base has
    (a base never starts with /), so that these do not gather in one task.
    """
    based = bases(F.col("path"), F.col("module"), aliases)
    # outer, as for a plain explode the optimizer adds a filter that makes the bases once more
    found = imports.select(F.explode_outer(based).alias("base")).where("base IS NOT NULL")
    known = targets(found.select(F.lower("base").alias("key")).distinct(), inventory)
    own = F.concat_ws("|", F.lit("/"), "path", "module")
    if len(aliases) <= 1:  # one base at most
        keyed = imports.withColumn("key", F.coalesce(F.lower(F.get(based, F.lit(0))), own))
        return keyed.join(known, "key", "left").select(*imports.columns, "target")
    keyed = imports.select("path", "module").distinct().select("path", "module", F.posexplode_outer(based).alias("nth", "base"))
    each = keyed.withColumn("key", F.coalesce(F.lower("base"), own)).join(known, "key", "left")
    first = each.groupBy("path", "module").agg(F.min_by("target", F.when(F.col("target").isNotNull(), F.col("nth"))).alias("target"))
    return imports.join(first, ["path", "module"], "left").select(*imports.columns, "target")


def resolved(imports: DataFrame, inventory: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """(path, module, target): each distinct specifier of a file with the file it means, null if none."""
    return with_target(imports.select("path", "module").distinct(), inventory, aliases)
