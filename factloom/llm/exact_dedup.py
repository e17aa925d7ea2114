"""Exact dedup with a heavy-hitter split (operator 4; DataFrame functions only).

Texts are equal when identical after lower-casing A-Z. Digests that are
frequent are found with a mergeable frequent-items sketch of the Misra-Gries
family (Spark's ``approx_top_k``: ``track`` counters, so every digest with more
than about n / (0.75 * track) rows is among the candidates). Candidates are
verified by an exact, map-side combined count; the verified winners, at most
``heavy`` rows, are broadcast, and the rows of those groups are settled where they
are read, without a shuffle. Every other row goes through one ordinary shuffle on
its digest: the groups are counted with map-side combining and joined back, so
that AQE's skew join splits a group that is large and no winner all the same.

Nulls and odd rows: a null text equals the empty text; a null doc_id orders
below every id. Rows that repeat both doc_id and text are members of the group
like any other; one of the rows with the largest doc_id stays. An empty table
gives an empty result. Other columns of the input are not read; they pass through
``drop_copies`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import ascii_lower, staged, table, unused, whole_text

TRACK, HEAVY = 10_000, 1_000


def groups(digests: DataFrame) -> DataFrame:
    """(digest, keep, n): of each digest the row that stays, struct<doc_id, nth>, and the number of rows."""
    return digests.groupBy("digest").agg(F.max(F.struct("doc_id", "nth")).alias("keep"), F.count(F.lit(1)).alias("n"))


def frequent_digests(digests: DataFrame, *, track: int = TRACK, heavy: int = HEAVY) -> DataFrame:
    """groups() of verified frequent digests, at most about ``heavy`` rows."""
    sketch = digests.agg(F.expr(f"approx_top_k(item, {heavy}, {track})").alias("top"))
    candidates = sketch.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("item"))
    return groups(digests.join(F.broadcast(candidates), "item", "left_semi")).where("n > 1")


def exact_groups(docs: DataFrame, *, track: int = TRACK, heavy: int = HEAVY) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    sha = F.sha2(ascii_lower(whole_text()), 256)
    digests, _ = staged(
        docs.select("doc_id", F.unhex(sha).alias("digest")).withColumn("item", F.xxhash64("digest")).withColumn("nth", F.monotonically_increasing_id()),
        "digests",
    )
    winners, _ = staged(frequent_digests(digests, track=track, heavy=heavy), "winners")
    tagged = digests.drop("item").join(F.broadcast(winners), "digest", "left")
    rest = tagged.where("n IS NULL").drop("keep", "n")
    every = tagged.where("n IS NOT NULL").unionByName(rest.join(groups(rest), "digest"))
    return every.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("nth") == F.col("keep.nth")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The input's rows that stay, with all their columns; repeated rows stay once."""
    own, keep, sha = unused(docs, "own", "keep", "sha")
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias(keep), F.col("text_sha256").alias(sha))
    named = docs.withColumn(own, F.sha2(ascii_lower(whole_text()), 256))
    return named.join(kept, F.col("doc_id").eqNullSafe(F.col(keep)) & (F.col(own) == F.col(sha)), "left_semi").dropDuplicates(["doc_id", own]).drop(own)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
