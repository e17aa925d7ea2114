r"""Line dedup over levelled sorted runs of line hashes (operator 5; DataFrame functions only).

A line's key is the line stripped of [\x20\x09-\x0D] at both ends with A-Z
lower-cased; keys of under ``min_chars`` code points never count. A run is a
bucketed table (h, n_docs, last_doc), sorted by h, the 128-bit hash of a key. Each
batch of documents merge-anti-joins the runs there are and adds the keys that none
of them has as a run of its own at level 0, so a key is in one run only; ``fanout``
runs of one level are compacted into one of the next, so a key is rewritten once a
level and the runs stay logarithmic in number. A batch's keys have the buckets of
the runs: the anti-joins shuffle nothing.

Two uses. ``fresh_lines`` takes batches as they come and returns the lines that no
batch had before. ``repeated_lines`` is the form of the query, where keys found in
at least ``min_docs`` documents lose their lines everywhere but in the largest
doc_id that holds them. It deals the documents into batches of falling doc_id: the
largest holder of a key that is fresh in a batch is its largest holder of all. Of
keys that are not fresh only the numbers of documents go on, to be added up.

Batches: ``LEAST_BATCHES``, or as many as batches of ``LINES_A_BATCH`` lines make.
Their limits are doc_ids at equal steps of the ``LIMITS`` ids lowest in hash
order; results do not depend on them.

Very common lines: keys are counted with map-side combining before they are dealt
by bucket; lines themselves only go through the last join, with the keys that
lose lines, where AQE's skew join splits a common key. No group is collected,
only the dropped line numbers of one text.

Nulls and odd rows: a null or empty text is one empty line. Rows that repeat a
doc_id are one document, and each keeps or loses its lines as that document does.
Rows with a null doc_id are one document, which orders below every id. An empty
table gives an empty result. Further columns pass through ``without_lines``
whatever their names; it raises ValueError if they have the names of the columns
that it adds. They are not read elsewhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.shared import WHITE, ascii_lower, discard, shared_folder, staged, table, unused, whole_text

MIN_CHARS, MIN_DOCS, FANOUT, LEAST_BATCHES, LINES_A_BATCH, LIMITS = 20, 3, 4, 5, 1_000_000_000, 1_000


def line_hashes(docs: DataFrame, *, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, h, pos): each line that counts, with the hash of its text and of its key."""
    text = whole_text()
    lines = docs.select("doc_id", F.xxhash64(text).alias("th"), F.split(ascii_lower(text), "\n", -1).alias("lines"))
    keys = F.transform("lines", lambda line, i: F.struct(F.btrim(line, F.lit(WHITE)).alias("key"), i.alias("pos")))
    each = F.filter(keys, lambda x: F.length(x["key"]) >= int(min_chars))
    return lines.select("doc_id", "th", F.inline(each)).select("doc_id", "th", F.unhex(F.md5("key")).alias("h"), "pos")


def keys_of(lines: DataFrame) -> DataFrame:
    """(h, n_docs, last_doc) of line_hashes(): how many documents hold a key, and the largest."""
    held = lines.groupBy("h", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return held.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


class LineRuns:
    """Levelled sorted runs of line keys: bucketed tables in the shared folder, each key in one of them."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[DataFrame, str]]] = []

    def stored(self, rows: DataFrame, label: str) -> tuple[DataFrame, str]:
        """Rows (h, n_docs, last_doc) as a table with a sorted file a bucket."""
        name = f"factloom_{label}_{uuid.uuid4().hex}"
        (
            rows.repartition(self.buckets, "h").sortWithinPartitions("h").write.option("path", f"{shared_folder(self.spark)}/factloom/{name}")
            .bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        )
        return self.spark.table(name), name

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, f"{shared_folder(self.spark)}/factloom/{name}")

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.stored(rows, f"run{level}"))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(union([r for r, _ in old]), level + 1)
            self.drop(*(n for _, n in old))

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r, _ in level]

    def add(self, keys: DataFrame) -> DataFrame | None:
        """Adds a batch's keys_of() that no run has; those that some run has (h, n_docs), written out."""
        own, name = self.stored(keys, "batch")
        fresh, seen = own, []
        for run in self.runs():
            fresh = fresh.join(run.select("h").hint("merge"), "h", "left_anti")
            seen.append(own.join(run.select("h").hint("merge"), "h", "left_semi").select("h", "n_docs"))
        again = staged(union(seen), "again") if seen else None
        self._write(fresh, 0)
        self.drop(name)
        return again

    def clear(self) -> None:
        self.drop(*(n for level in self.levels for _, n in level))
        self.levels = []


def union(frames: list[DataFrame]) -> DataFrame:
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    return every


def fresh_lines(runs: LineRuns, docs: DataFrame, *, min_chars: int = MIN_CHARS) -> DataFrame:
    """Incremental form: (doc_id, pos) of the lines new to the runs, written out; then the batch joins the runs."""
    rows, path = staged(line_hashes(docs, min_chars=min_chars), "batch")
    new = rows
    for run in runs.runs():
        new = new.join(run.select("h"), "h", "left_anti")
    out, _ = staged(new.select("doc_id", "pos"), "fresh")
    runs.add(keys_of(rows))
    discard(runs.spark, path)
    return out


def batch_limits(docs: DataFrame, batches: int) -> list:
    """At most batches - 1 falling doc_ids that deal the documents into batches of about equal size."""
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull())
    some = sorted((r[0] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LIMITS).collect()), reverse=True)
    return sorted({some[len(some) * i // batches] for i in range(1, batches)}, reverse=True) if some else []


def repeated_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, th, gone): for each document that loses lines, their sorted 0-based numbers."""
    spark = docs.sparkSession
    rows, _ = staged(line_hashes(docs, min_chars=min_chars), "lines")
    limits = batch_limits(docs, batches or max(LEAST_BATCHES, -(-rows.count() // LINES_A_BATCH)))
    doc, runs, again = F.col("doc_id"), LineRuns(spark, fanout), []
    for above, below in zip([None, *limits], [*limits, None], strict=True):
        here = doc.isNotNull() if below is not None else F.lit(True)
        here = here & (doc > below) if below is not None else here
        here = here & (doc.isNull() | (doc <= above)) if above is not None else here
        if (found := runs.add(keys_of(rows.where(here)))) is not None:
            again.append(found)
    common = union(runs.runs())
    if again:
        more = union([a for a, _ in again]).groupBy("h").agg(F.sum("n_docs").alias("more"))
        common = common.join(more, "h", "left").withColumn("n_docs", F.col("n_docs") + F.coalesce("more", F.lit(0)))
    common, _ = staged(common.where(F.col("n_docs") >= min_docs).select("h", "last_doc"), "common")
    runs.clear()
    discard(spark, *(p for _, p in again))
    beaten = F.col("last_doc").isNotNull() & (doc.isNull() | (doc < F.col("last_doc")))
    gone, _ = staged(rows.join(common, "h").where(beaten).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "gone")
    return gone


def without_lines(docs: DataFrame, *, n_lines: str = "n_lines", n_dropped: str = "n_dropped", **options) -> DataFrame:
    """The input with text cleaned, and the columns n_lines (before dropping) and n_dropped under the names given."""
    if clash := {n_lines.lower(), n_dropped.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the input has columns {sorted(clash)}")
    doc, own, th, gone, lines = unused(docs, "doc", "own", "th", "gone", "lines")
    lost = repeated_lines(docs, **options).select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("gone").alias(gone))
    named = docs.withColumn(own, F.xxhash64(whole_text()))
    joined = named.join(lost, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(th)), "left")
    kept = F.expr(f"""
        array_join(flatten(transform(sequence(0, size({gone})), i -> slice({lines},
          if(i = 0, -1, {gone}[i - 1]) + 2,
          if(i = size({gone}), size({lines}), {gone}[i]) - if(i = 0, -1, {gone}[i - 1]) - 1))), '\\n')""")
    return (
        joined.withColumn(lines, F.split(whole_text(), "\n", -1))
        .withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept))
        .withColumn(n_lines, F.size(lines).cast("long"))
        .withColumn(n_dropped, F.coalesce(F.size(gone), F.lit(0)).cast("long"))
        .select(*docs.columns, n_lines, n_dropped)
    )


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(whole_text(), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS nth FROM documents),
l AS (
  SELECT nth, doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
  FROM (SELECT nth, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM d)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS INTEGER) >= 3),
f AS (SELECT k.*, c.key IS NOT NULL AND (doc_id IS NULL OR doc_id < last_doc) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY nth
"""
