r"""MinHash near-dedup with banding and full verification (operator 7).

Two documents are linked when the Jaccard similarity of their word-shingle sets
is at least ``percent`` / 100, compared as whole numbers on the full sets.

1. One scan gives each document its set's size and digest and ``BANDS * ROWS``
   universal-hash minima. Texts with equal sets form a class with a number of its
   own; only classes go on, so exact copies cost nothing.
2. A band's minima key a bucket. Round one compares each bucket's members with
   its smallest number: a line of pairs for a bucket, never all of them.
3. Links are confirmed on the full sets, and components built by large-star and
   small-star. Buckets whose members are all in one component are finished.
4. Rounds two and three look at the other buckets. Shingles that one open member
   alone has can be shared with nobody; a member or pair whose other shingles are
   too few for the threshold is settled by that exact bound. So is a pair whose
   bitmaps (one hashed bit a shingle) differ in more bits than the threshold lets
   shingles differ. The rest are dealt into blocks
   of ``BLOCK``; a task holds two blocks and compares their minima. Round two
   hands on each member's likeliest partner in another component, one a member
   and task; nearly all remaining links are found by it. Round three, over the
   components as they then are, hands on every pair of different components whose
   estimate is within four standard errors of the threshold, each pair only in
   the first band it shares. All are confirmed on the full sets, and the
   components joined up after each round.
5. Classes that one doc_id holds are joined up too; a component is named by the
   smallest doc_id in it. Tables of the steps before are removed.

No partner, bucket or candidate is capped. What can be missed is what banding
misses: a pair just at the threshold escapes all bands with a probability of
3e-6 at 0.8 and 1e-8 at 0.85, and the estimate's margin with 3e-5 in round three.

Nulls and odd rows: texts without words have an empty set and no links; a null
doc_id takes no part, is kept and has a null component. Rows that share a doc_id
are one node with the links of all their texts; each keeps its own set size. An
empty table gives an empty result. Other columns are not read, and pass through
``drop_near_copies`` whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.hashing import shingle_set
from factloom.llm.shared import discard, staged, table, unused

WORDS, PERCENT = 5, 80
BANDS, ROWS, BLOCK, BITS = 32, 5, 512, 4096
_RNG = np.random.default_rng(20_240_229)
_A = (_RNG.integers(0, 2**31, BANDS * ROWS, dtype=np.int64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.int64).astype(np.uint32)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The minima of the set under each universal hash a * x + b on 32 bits."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(out, (x[at : at + 256, None] * _A + _B).min(axis=0), out=out)
    return out


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, digest, sig) of each document."""

    def of(batches):
        for pdf in batches:
            sets = [shingle_set(t, words) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"],
                "n": [len(s) for s in sets],
                "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "sig": [minima(s).tobytes() if len(s) else b"" for s in sets],
            })

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(
        of, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, digest binary, sig binary"
    )


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, digest, n, hashes) of each document."""

    def of(batches):
        for pdf in batches:
            sets = [shingle_set(t, words) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "n": [len(s) for s in sets], "hashes": [s.view(np.int64) for s in sets],
            })

    return docs.select("doc_id", "text").mapInPandas(of, f"doc_id {dict(docs.dtypes)['doc_id']}, digest binary, n long, hashes array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    a = sets.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("hashes").alias("su"))
    b = sets.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("hashes").alias("sv"))
    sizes = (F.col("nu") * 100 >= F.col("nv") * percent) & (F.col("nv") * 100 >= F.col("nu") * percent)
    slim = pairs.join(a.drop("su"), "u").join(b.drop("sv"), "v").where(sizes).select("u", "v")
    both = F.size(F.array_intersect("su", "sv"))
    return (
        slim.join(a, "u").join(b, "v")
        .where(both * 100 >= (F.col("nu") + F.col("nv") - both) * percent)
        .select("u", "v")
    )


def _block_pairs(rows: pd.DataFrame, least: float, percent: int, best: bool) -> pd.DataFrame:
    """Pairs of one bucket's two blocks: of different components, near the threshold, first met in this band; or the best of each row."""
    sig = np.stack([np.frombuffer(s, np.uint32) for s in rows["sig"]])
    ids, comp, n, m, band = *(rows[c].to_numpy() for c in ("id", "comp", "n", "m")), int(rows["band"].iloc[0])
    bits = np.stack([np.frombuffer(s, np.uint64) for s in rows["bits"]])
    left = np.flatnonzero(rows["side"].to_numpy() != 1)
    right = np.flatnonzero(rows["side"].to_numpy() != 0)
    us, vs = [], []
    for i in left:
        j = right[comp[right] != comp[i]]
        if rows["side"].iloc[i] == 2 and not best:
            j = j[j > i]
        if not len(j):
            continue
        same = sig[j] == sig[i]
        agree = same.sum(axis=1)
        ok = (agree >= least * sig.shape[1]) & (n[j] * 100 >= n[i] * percent) & (n[i] * 100 >= n[j] * percent)
        ok &= np.minimum(m[i], m[j]) * (100 + percent) >= (n[i] + n[j]) * percent  # what both have in common is at most the lesser m
        near = np.flatnonzero(ok)
        own, other = np.bitwise_count(bits[i] & ~bits[j[near]]).sum(axis=1), np.bitwise_count(bits[j[near]] & ~bits[i]).sum(axis=1)
        ok[near] = np.minimum(n[i] - own, n[j[near]] - other) * (100 + percent) >= (n[i] + n[j[near]]) * percent
        if best and ok.any():
            likeliest = int(np.argmax(np.where(ok, agree, -1)))
            ok[:] = False
            ok[likeliest] = True
        elif band and ok.any():
            ok[ok] = ~same[ok, : band * ROWS].reshape(int(ok.sum()), band, ROWS).all(axis=2).any(axis=1)
        us.append(np.full(int(ok.sum()), ids[i]))
        vs.append(ids[j[ok]])
    return pd.DataFrame({"u": np.concatenate(us) if us else ids[:0], "v": np.concatenate(vs) if vs else ids[:0]})


def bucket_pairs(members: DataFrame, percent: int, best: bool) -> DataFrame:
    """A round's pairs from (band, key, id, comp, n, m, sig, bits, bi, bj, side), dealt by bucket and pair of blocks."""
    share = percent / 100
    least = share - 4 * math.sqrt(share * (1 - share) / (BANDS * ROWS))
    names = ["key", "bi", "bj"]

    def of(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            group = pdf[names].to_numpy()
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            edges = [0, *cuts.tolist()]
            out = [_block_pairs(pdf.iloc[a:b], least, percent, best) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]
            if out:
                yield pd.concat(out, ignore_index=True)
            rest = pdf.iloc[edges[-1] :]
        if rest is not None and len(rest) > 1:
            yield _block_pairs(rest, least, percent, best)

    kind = dict(members.dtypes)["id"]
    return members.repartition(*names).sortWithinPartitions(*names, "id").mapInPandas(of, f"u {kind}, v {kind}")


def _placed_members(buckets: DataFrame, placed: DataFrame) -> DataFrame:
    """(band, key, id, n, comp) of the members of buckets with more than one component."""
    now = buckets.select("band", "key", "id", "n").join(placed.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    open_ = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return now.join(open_, "key")


def lone_shingles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, lone): how many of a member's shingles no other member has; ids without any are left out."""
    each = sets.join(members.select("id").distinct().hint("shuffle_hash"), "id", "left_semi").select("id", F.explode("hashes").alias("h"))
    return (
        each.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1")
        .groupBy("id").agg(F.count(F.lit(1)).alias("lone"))
    )


def bitmaps(sets: DataFrame) -> DataFrame:
    """(id, bits): a bitmap of BITS bits with the bit of each shingle set."""

    def of(batches):
        for pdf in batches:
            out = []
            for h in pdf["hashes"]:
                marks = np.zeros(BITS, np.uint8)
                marks[np.asarray(h, np.int64).view(np.uint64) % np.uint64(BITS)] = 1
                out.append(np.packbits(marks).tobytes())
            yield pd.DataFrame({"id": pdf["id"], "bits": out})

    return sets.select("id", "hashes").mapInPandas(of, f"id {dict(sets.dtypes)['id']}, bits binary")


def _unsettled(members: DataFrame, lone: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, brief) -> DataFrame:
    """Members that may yet have a link to another component of their bucket, dealt into pairs of blocks."""
    known = members.join(lone, "id", "left").withColumn("m", F.col("n") - F.coalesce("lone", F.lit(0))).drop("lone")
    least = known.groupBy("key").agg(F.min("n").alias("least_n"))
    partner = F.greatest(F.col("least_n") * 100, F.col("n") * percent)
    able = known.join(least, "key").where(F.col("m") * (100 + percent) * 100 >= (F.col("n") * 100 + partner) * percent).drop("least_n")
    open_ = able.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi").drop("lo", "hi")
    blocks = F.ceil(F.col("members") / BLOCK)
    able = brief(able.join(open_, "key"), "able")
    ids = able.select("id").distinct().hint("shuffle_hash")
    marks = bitmaps(sets.join(ids, "id", "left_semi"))
    return (
        able.join(classes.select("id", "sig").join(ids, "id", "left_semi").join(marks, "id"), "id")
        .withColumn("own", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select("band", "key", "id", "comp", "n", "m", "sig", "bits", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"),
                F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
    )


def _joined(placed: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) once more links are in: components of components."""
    lifted = (
        links.join(placed.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left")
        .join(placed.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
        .select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    )
    above = components(lifted)
    moved = placed.join(above.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left").select("node", F.coalesce("c", "component").alias("component"))
    return moved.unionByName(above.join(placed.select("node"), "node", "left_anti"))


def linked_components(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    spark, passing = docs.sparkSession, []

    def brief(df: DataFrame, label: str) -> DataFrame:
        """A table that is removed at the end."""
        found, path = staged(df, label)
        passing.append(path)
        return found

    sigs = brief(signatures(docs, words), "signatures")
    classes = brief(
        sigs.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        .withColumn("id", F.monotonically_increasing_id()),
        "classes",
    )
    bands = classes.select("id", "n", F.posexplode(F.expr(
        f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sig, i * {4 * ROWS} + 1, {4 * ROWS})))"
    )).alias("band", "key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("hub")).where("members > 1")
    buckets = brief(bands.join(shared, "key"), "buckets")
    wanted = classes.join(buckets.select("id").distinct().hint("shuffle_hash"), "id", "left_semi").select("doc", "digest", "id")
    some = docs.join(wanted.select(F.col("doc").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    sets = brief(shingle_sets(some, words).join(wanted.withColumnRenamed("doc", "doc_id"), ["doc_id", "digest"]).dropDuplicates(["id"]).select("id", "n", "hashes"), "sets")
    star = brief(confirmed(buckets.select(F.col("hub").alias("u"), F.col("id").alias("v")).where("u <> v").distinct(), sets, percent), "links")
    placed = brief(components(star), "components")
    lone = None
    for best in (True, False):
        members = brief(_placed_members(buckets, placed), "members")
        lone = lone if lone is not None else brief(lone_shingles(members, sets), "lone")
        pairs = bucket_pairs(_unsettled(members, lone, classes, sets, percent, brief), percent, best)
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        more = brief(confirmed(pairs, sets, percent), "links")
        placed = brief(_joined(placed, more), "components")
    own = brief(sigs.join(classes.select("digest", "id"), "digest").select("doc_id", "id"), "own")
    first = own.groupBy("doc_id").agg(F.min("id").alias("u"), F.max("id").alias("most")).where("u <> most")
    placed = brief(_joined(placed, own.join(first, "doc_id").where("id <> u").select("u", F.col("id").alias("v")).distinct()), "components")
    there = own.join(placed.withColumnRenamed("node", "id"), "id", "left").select("doc_id", F.coalesce("component", "id").alias("component"))
    there = brief(there.distinct(), "there")
    named = there.join(there.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("doc_id", "component_id")
    linked, _ = staged(
        sigs.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")),
        "linked",
    )
    discard(spark, *passing)
    nameless = docs.where(F.col("doc_id").isNull())
    if not nameless.isEmpty():
        linked = linked.unionByName(shingle_sets(nameless, words).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return linked.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The input's rows that stay, with all their columns: one document of each component."""
    (gone,) = unused(docs, "gone")
    lost = linked_components(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(lost, F.col("doc_id") == F.col(gone), "left_anti")


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)
