"""Real collections: a directory tree, its ignore rules, configuration and inventory.

The driver lists names only (ignored directories are never entered); contents and
hashes are read on the executors, which must see the tree under the same path.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import ancestors, parts

# Names that are ignored unless told otherwise, and files with more rules.
DEFAULT_IGNORES = (
    ".git", ".hg", ".svn", "node_modules", "vendor", "dist", "build", "coverage", ".coverage", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    ".tox", ".venv", "venv", "__pycache__", ".expo", ".next", ".turbo", ".gradle", "Pods", "DerivedData", ".DS_Store",
)
IGNORE_FILES = (".gitignore", ".npmignore", ".dockerignore")
CONFIG_NAME = "factloom.toml"

Rule = tuple[str, str, bool]  # pattern, source, negated


@dataclass(frozen=True)
class Config:
    """A collection's configuration file; lists of strings, and aliases in order of their patterns."""

    include: tuple[str, ...] = ()
    disable_default_ignore: tuple[str, ...] = ()
    no_default_ignores: bool = False
    aliases: tuple[tuple[str, str], ...] = ()
    markers: tuple[str, ...] = ()
    generic: tuple[str, ...] = ()
    path: str | None = None
    stamp: tuple[int, int] | None = field(default=None, compare=False)


def _strings(table: dict, key: str) -> tuple[str, ...]:
    value = table.get(key, [])
    if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
        raise ValueError(f"{key} must be a list of strings")
    return tuple(value)


def load_config(target: Path, explicit: str | None = None) -> Config:
    """The configuration named, which must exist, or the optional one at the target's root."""
    path = Path(explicit).resolve() if explicit else target / CONFIG_NAME
    if not path.is_file():
        if explicit:
            raise ValueError(f"configuration {path} does not exist")
        return Config()
    payload = tomllib.loads(path.read_text("utf-8"))
    tables = {n: payload.get(n, {}) for n in ("scan", "import_aliases", "architecture")}
    for n, t in tables.items():
        if not isinstance(t, dict):
            raise ValueError(f"{n} must be a table")
    aliases = tables["import_aliases"]
    if not all(isinstance(v, str) for v in aliases.values()):
        raise ValueError("import_aliases must map patterns to paths")
    scan, arch, stat = tables["scan"], tables["architecture"], path.stat()
    return Config(
        _strings(scan, "include"), _strings(scan, "disable_default_ignore"), bool(scan.get("no_default_ignores", False)), tuple(sorted(aliases.items())),
        _strings(arch, "feature_markers"), _strings(arch, "generic_feature_names"), str(path), (stat.st_size, stat.st_mtime_ns),
    )


def ignore_rules(target: Path, config: Config, runtime: tuple[str, ...] = ()) -> list[Rule]:
    """Default, file and runtime rules in the order in which they are tried; the last that matches counts."""
    rules: list[Rule] = []
    if not config.no_default_ignores:
        rules += [(p, "default", False) for p in DEFAULT_IGNORES if p not in config.disable_default_ignore]
    for name in IGNORE_FILES:
        if (target / name).is_file():
            for raw in (target / name).read_text("utf-8", errors="replace").splitlines():
                line = raw.strip()
                pattern = line.removeprefix("!").strip().strip("/")
                if line and not line.startswith("#") and pattern:
                    rules.append((pattern, name, line.startswith("!")))
    return rules + [(p, "runtime", False) for p in runtime]


def _regex(pattern: str) -> str:
    return fnmatch.translate(pattern).replace(r"\Z", r"\z")


def _matches(path: Column, pattern: str, is_dir: bool = False) -> Column:
    clean = pattern.rstrip("/")
    if not clean:
        return F.lit(False)
    if "/" not in clean:
        return F.exists(parts(path), lambda p: p.rlike("^" + _regex(clean)))
    either = path.rlike("^" + _regex(clean)) | path.rlike("^" + _regex(f"{clean}/**")) | path.startswith(f"{clean}/")
    return either | F.concat(path, F.lit("/")).rlike("^" + _regex(clean)) if is_dir else either


def _included(path: Column, pattern: str, is_dir: bool = False) -> Column:
    clean = pattern.rstrip("/")
    hit = (path == clean) | path.startswith(f"{clean}/")
    if is_dir:
        hit = hit | F.startswith(F.lit(clean), F.concat(path, F.lit("/")))
    if "/" not in clean:
        return hit | F.exists(parts(path), lambda p: p.rlike("^" + _regex(clean)))
    return hit | path.rlike("^" + _regex(clean))


def decision(path: Column, rules: list[Rule], includes: list[str] | tuple[str, ...] = (), *, is_dir: bool = False) -> tuple[Column, Column]:
    """(ignored, reason) of a path under the rules; an include beats them all."""
    wanted = F.lit(False)
    for i in includes:
        wanted = wanted | _included(path, i, is_dir)
    ignored, reason = F.when(wanted, False), F.when(wanted, "explicit include")
    for pattern, source, negated in reversed(rules):
        hit = _matches(path, pattern, is_dir)
        ignored, reason = ignored.when(hit, not negated), reason.when(hit, None if negated else f"{source}:{pattern}")
    return ignored.otherwise(False), reason.otherwise(None)


def decided(files: DataFrame, rules: list[Rule], includes=()) -> DataFrame:
    ignored, reason = decision(F.col("path"), rules, includes)
    return files.select("path", ignored.alias("ignored"), reason.cast("string").alias("reason"))


def decide(path: str, rules: list[Rule], includes=(), *, is_dir: bool = False) -> tuple[bool, str | None]:
    """The same for one name, on the driver, to keep out of ignored directories."""
    forms = [path, f"{path}/"] if is_dir else [path]
    segments = path.split("/")
    for i in includes:
        clean = i.rstrip("/")
        under = path == clean or path.startswith(f"{clean}/") or (is_dir and clean.startswith(f"{path}/"))
        names = segments if "/" not in clean else forms
        if under or any(fnmatch.fnmatchcase(n, clean) for n in names):
            return False, "explicit include"
    for pattern, source, negated in reversed(rules):
        clean = pattern.rstrip("/")
        if "/" in clean:
            hit = any(fnmatch.fnmatchcase(f, clean) or fnmatch.fnmatchcase(f, f"{clean}/**") or f.startswith(f"{clean}/") for f in forms)
        else:
            hit = bool(clean) and any(fnmatch.fnmatchcase(s, clean) for s in segments)
        if hit:
            return not negated, None if negated else f"{source}:{pattern}"
    return False, None


def walk(target: Path, rules: list[Rule], includes=()) -> tuple[list[tuple[str, int, int]], list[tuple[str, str]]]:
    """(path, size, mtime_ns) of each file in walk order, and (path, reason) of what was skipped; names and stats only."""
    found, skipped = [], []
    for root, dirs, files in os.walk(target):
        base = Path(root).relative_to(target).as_posix()
        name = lambda n: n if base == "." else f"{base}/{n}"  # noqa: E731, B023
        kept = []
        for d in sorted(dirs):
            ignored, why = decide(name(d), rules, includes, is_dir=True)
            skipped.append((name(d), why)) if ignored else kept.append(d)
        dirs[:] = kept
        for f in sorted(files):
            ignored, why = decide(name(f), rules, includes)
            if ignored:
                skipped.append((name(f), why))
            elif os.path.isfile(os.path.join(root, f)):
                s = os.stat(os.path.join(root, f))
                found.append((name(f), s.st_size, s.st_mtime_ns))
    return found, skipped


def inventory(spark: SparkSession, found: list[tuple[str, int, int]]) -> DataFrame:
    return spark.createDataFrame(found, "path string, size long, mtime_ns long")


def contents(files: DataFrame, target: Path) -> DataFrame:
    """files with text (bad bytes replaced), sha256 and error of what is on disk, read on the executors."""
    root = str(target)

    def of(batches):
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    raw = Path(root, path).read_bytes()
                    rows.append((raw.decode("utf-8", "replace"), hashlib.sha256(raw).hexdigest(), None))
                except OSError as x:
                    rows.append(("", None, str(x)))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=["text", "sha256", "error"])], axis=1)

    schema = ", ".join(f"{n} {t}" for n, t in files.dtypes) + ", text string, sha256 string, error string"
    spread = max(1, files.sparkSession.sparkContext.defaultParallelism)
    return files.repartition(spread, "path").mapInPandas(of, schema)


def directories(files: DataFrame) -> DataFrame:
    """(directory, depth) of every directory above a file."""
    return files.select(F.explode(ancestors(F.col("path"))).alias("directory")).distinct().select("directory", F.size(parts(F.col("directory"))).alias("depth"))


def package_aliases(target: Path, found: list[tuple[str, int, int]]) -> list[tuple[str, str]]:
    """Aliases of the packages inside a collection: each name to its entry, and what is below it."""
    out: dict[tuple[str, str], None] = {}
    for path, *_ in found:
        if path.rpartition("/")[2] != "package.json":
            continue
        try:
            said = json.loads((target / path).read_text("utf-8"))
        except (OSError, ValueError):
            continue
        name = said.get("name") if isinstance(said, dict) else None
        if not isinstance(name, str) or not name.strip():
            continue
        home = (target / path).parent
        base = home / "src" if (home / "src").is_dir() else home
        entry = base
        for key in ("source", "module", "main", "types"):
            value = said.get(key)
            if isinstance(value, str) and value.strip():
                at = home / value
                if at.exists() or (at.name not in ("", ".", "..") and (at.with_suffix(".ts").exists() or at.with_suffix(".tsx").exists())):
                    entry = at
                    break
        rel = lambda p: Path(os.path.normpath(p)).relative_to(target).as_posix()
        try:
            out[name.strip(), rel(entry)] = None
            out[f"{name.strip()}/*", f"{rel(base)}/*"] = None
        except ValueError:
            continue
    return list(out)
