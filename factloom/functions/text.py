r"""Column functions for names, slugs and content-addressed identities.

Identities are part of the data: an edge's or evidence record's id is a prefix of
the SHA-256 of its fields, joined by ``|``, so equal facts meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(prefix: str, *parts: Column) -> Column:
    # concat_ws leaves nulls out, and a null must stay an empty field
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(joined, 256), 1, 24))


def evidence_id(extractor: Column, method: Column, locator: Column, snippet: Column, confidence: Column) -> Column:
    """The raw snippet counts, with its white space."""
    return _digest("evidence", extractor, method, locator, snippet, confidence)


def edge_id(kind: Column, src: Column, dst: Column, confidence: Column, evidence: Column) -> Column:
    return _digest("edge", kind, src, dst, confidence, evidence)


def slug(value: Column) -> Column:
    """Lower case, other runs than letters and digits as one dash, never empty."""
    dashed = F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.btrim(dashed, F.lit("-")), F.lit("")), F.lit("section"))


def safe_name(value: Column) -> Column:
    r"""A file name: anything but letters, digits, -, _ and . becomes _."""
    return F.regexp_replace(value, r"[^\p{L}\p{N}_.-]", "_")


def parts(path: Column) -> Column:
    return F.split(path, "/")


def name_of(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def suffix_of(path: Column) -> Column:
    """The last extension with its dot, in lower case; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(name_of(path), r"[^.].*?(\.[^.]+)$", 1))


def walk_key(path: Column) -> Column:
    """Orders paths as a top-down walk meets them: a directory's files first, then its directories."""
    return F.transform(
        parts(path), lambda p, i: F.concat(F.when(i == F.size(parts(path)) - 1, "0").otherwise("1"), p)
    )


def ancestors(path: Column) -> Column:
    """The directories above a path, outermost first."""
    n = F.size(parts(path))
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts(path), F.lit(1), i), "/"))).otherwise(
        F.array().cast("array<string>")
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """A share; of nothing it is 1."""
    return F.when(denominator <= 0, F.lit(1.0)).otherwise(numerator / denominator)
