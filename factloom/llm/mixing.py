r"""Mixing sources to target weights (operator 3; DataFrame functions only).

Every document gets a hash-random key. Within its source, documents stand in
the order of their keys; a source's budget is cut from that order at the exact
word, whole epochs first. The running totals are distributed: the key's first
hex digits range-partition each source into slices of about ``ROWS_A_SLICE`` rows
or fewer, slices are summed with map-side combining, the sums are prefix-summed,
and each slice then only needs its own running total. No task ever holds a
whole source, so a source with a third of all rows costs no more than others.

Targets: sources in code-point order (null last) weigh ``weights`` in turn and
share ``share`` of all words; no target passes ``cap`` times its source's words
(water filling; the excess goes to the others by weight).

Nulls and odd rows: a null text has size 0 and takes 0; null sources form one
source; a row with a null doc_id hashes by its text, so that many of them spread;
rows that repeat are separate documents, ordered by (key, doc_id, size), which
makes reruns agree. An empty table gives an empty result. Further columns are not
read; they pass through ``mixed_documents`` whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import staged, table, unused, whole_text, word_array

WEIGHTS, SHARE, CAP, LEAST_DIGITS, ROWS_A_SLICE = (5, 2, 1), 1.5, 2, 3, 50_000


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(skey, source_size, target) from (skey, size); one small row for each source."""
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy("skey")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    caps = per.withColumn("w", w).withColumn("most", F.col("source_size") * cap)
    fill = Window.orderBy(F.col("most") / F.col("w"), "skey")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        caps.withColumn("nth", F.row_number().over(fill))
        .withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("gone", F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("level", (F.col("budget") - F.col("full")) / (F.col("all_w") - F.col("gone")))
    )
    # the first source, in filling order, that its share does not fill sets the level
    open_at = F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("nth"))
    chosen = levels.withColumn("at", F.min(open_at).over(everything)).withColumn(
        "lambda", F.max(F.when(F.col("nth") == F.col("at"), F.col("level"))).over(everything)
    )
    target = F.when(F.col("at").isNull() | (F.col("nth") < F.col("at")), F.col("most").cast("double")).otherwise(F.col("w") * F.col("lambda"))
    return chosen.select("skey", "source_size", target.alias("target"))


def mix(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, digits: int | None = None, carry=()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken; ``carry`` names expressions kept with each row."""
    key = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), whole_text())), 256)
    sized, _ = staged(
        docs.select(
            "doc_id", "source",
            F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("skey"),
            F.size(word_array(whole_text())).cast("long").alias("size"),
            F.substring(key, 1, 16).alias("key"), *carry,
        ),
        "sizes",
    )
    digits = digits or max(LEAST_DIGITS, math.ceil(math.log(max(sized.count(), 1) / ROWS_A_SLICE, 16)))
    sized = sized.withColumn("slice", F.substring("key", 1, digits))
    slices = sized.groupBy("skey", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("skey").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        slices.withColumn("offset", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
        .join(source_targets(sized.select("skey", "size"), weights=weights, share=share, cap=cap), "skey")
        .drop("slice_size")
    )
    inside = Window.partitionBy("skey", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size") - F.col("offset") - F.col("run")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    extra = [c for c in sized.columns if c not in ("doc_id", "source", "skey", "size", "key", "slice")]
    return (
        sized.withColumn("run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(placed, ["skey", "slice"])
        .select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *extra)
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    r"""The mix itself, with the input's columns: each document once an epoch that takes it whole, and once cut after the last word taken.

    n_chars, where there is one, follows a text that is cut; documents of which nothing is taken go.
    """
    carried = [c for c in docs.columns if c not in ("doc_id", "source")]
    held = dict(zip(carried, unused(docs, *carried), strict=True))
    nth, text = unused(docs, "nth", "cut")
    placed = mix(docs, carry=[F.col(c).alias(held[c]) for c in carried], **options)
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    each = placed.where("taken > 0").withColumn(nth, F.explode(F.sequence(F.lit(1), copies)))
    words = F.least(F.col("size"), F.col("taken") - (F.col(nth) - 1) * F.col("size")).cast("int")
    # pieces that end with a word each, so that white space stays as it is
    pieces = F.split(F.col(held["text"]), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    cut = each.withColumn(text, F.when(words < F.col("size"), F.array_join(F.slice(pieces, F.lit(1), words), "")).otherwise(F.col(held["text"])))
    if "n_chars" in carried:
        cut = cut.withColumn(held["n_chars"], F.when(words < F.col("size"), F.length(text).cast("long")).otherwise(F.col(held["n_chars"])))
    held["text"] = text
    return cut.select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    substring(sha256(coalesce(CAST(doc_id AS VARCHAR), 'null ' || coalesce(text, ''))), 1, 16) AS key FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM d GROUP BY source),
f AS (
  SELECT *, 2 * source_size AS most, row_number() OVER o AS nth,
    coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
    CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS budget, sum(w) OVER () AS all_w
  FROM s WINDOW o AS (ORDER BY CAST(2 * source_size AS DOUBLE) / w, source NULLS LAST)),
l AS (SELECT *, (budget - CAST(filled AS DOUBLE)) / CAST(all_w - gone AS DOUBLE) AS level FROM f),
c AS (SELECT min(nth) AS at_nth, min_by(level, nth) AS pitch FROM l WHERE level * w <= most),
t AS (
  SELECT source, source_size,
    CASE WHEN at_nth IS NULL OR nth < at_nth THEN CAST(most AS DOUBLE) ELSE w * pitch END AS target
  FROM l CROSS JOIN c),
r AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS b,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN b // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, b - epochs * source_size - run)) AS BIGINT) AS taken
FROM e
"""
