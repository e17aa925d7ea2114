"""Approximate nearest neighbours by collision counting (operator 6).

Vectors are projected on ``PROJECTIONS`` random directions; each projection is
one sorted array. A query's window is centred on its own projection, and widens
in all arrays together as the search radius grows (virtual rehashing). A vector
found in the windows of at least ``THRESHOLD`` projections is verified by its
exact inner product. The search ends when the k-th best verified vector lies
within the radius searched, at which a true neighbour has been counted often
enough with a probability of about 0.97, nearer ones with more. Every vector
over the collision threshold is verified; none is capped. The radius starts at
the distance that ``SCOUTS`` rows of the block suggest and grows to that of the
scout twice as far in rank, but not beyond the k-th best verified so far.

Largest inner product becomes smallest distance by one more coordinate that
lifts every vector of a block to the length of its longest. Vectors are hashed
into index blocks of about ``BLOCK`` rows (fewer of more than 64 components) and
queries into blocks too; a task holds one block of each, so its memory is
bounded at any size, and per-block answers are merged by a grouped top-k. Scores
are computed in double precision from the original vectors, one by one in a
fixed order, so equal vectors tie.

Each block of queries meets each block of rows, so with a fixed share of the
rows as queries the work grows with the square of the table. What a query costs
in a block follows its windows: few places near a dense group, half of each
array where all directions are alike.

Nulls and odd rows: vectors that are null, empty, zero or hold null or
non-finite components take no part, nor do rows with a null vec_id; vectors are
compared with those of their own length only; rows that repeat a vec_id are
separate candidates (a query never meets its own vec_id), kept as one row with
a count where the vector repeats too. A vec_id that asks with several vectors
gets one list, the best k found for any of them. Fewer than k candidates are
all returned. Only vec_id, embedding and what is_query reads are used; other
columns may have any name.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import staged, table

K, PROJECTIONS, WIDTH, GROWTH, BLOCK, QUERIES_A_TASK, SEED = 20, 64, 1.0, 1.06, 16_384, 4_096, 11
#: Rows of a block whose exact distances tell how a query's radius grows; queries searched together.
SCOUTS, BATCH = 2_048, 256
#: P(|N(0, 1)| <= WIDTH): how often a vector at the radius falls into a window; less 1.9 standard deviations of the count.
_NEAR = math.erf(WIDTH / math.sqrt(2))
THRESHOLD = math.ceil(PROJECTIONS * _NEAR - 1.9 * math.sqrt(PROJECTIONS * _NEAR * (1 - _NEAR)))


class CollisionIndex:
    """Sorted projections of one block of vectors (rows of x)."""

    def __init__(self, x: np.ndarray, seed: int = SEED):
        self.original = x
        self.x = x = x / np.abs(x).max()
        squares = (x * x).sum(axis=1)
        self.top = float(squares.max())
        lifted = np.hstack([x, np.sqrt(np.maximum(self.top - squares, 0))[:, None]])
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(size=(PROJECTIONS, lifted.shape[1]))
        # near copies differ from their queries by the lift alone: its components are evenly spread normal quantiles, so no seed is unlucky for all of them
        self.directions[:, -1] = [NormalDist().inv_cdf((i + 0.5) / PROJECTIONS) for i in rng.permutation(PROJECTIONS)]
        p = lifted @ self.directions.T
        self.order = np.argsort(p, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(p.T, self.order, axis=1)
        #: Where each vector stands in each sorted array: it is in a window if its place is.
        self.places = np.empty(self.order.shape, np.uint32 if len(x) > 65_000 else np.uint16)
        np.put_along_axis(self.places, self.order, np.arange(len(x), dtype=self.places.dtype)[None, :], axis=1)
        self.scouts = x[np.random.default_rng(seed + 1).permutation(len(x))[:SCOUTS]]

    def _colliding(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rows that stand in at least THRESHOLD of the windows [a, b): narrow windows are walked, wide ones compared with all places."""
        if 10 * int((b - a).sum()) < self.places.size:
            found = np.concatenate([o[i:j] for o, i, j in zip(self.order, a.tolist(), b.tolist(), strict=True)])
            hits = np.bincount(found, minlength=len(self.x))
        else:
            kind = self.places.dtype
            hits = ((self.places - a.astype(kind)[:, None]) < (b - a).astype(kind)[:, None]).sum(axis=0, dtype=np.uint8)
        return np.flatnonzero(hits >= THRESHOLD)

    def search(self, asked: np.ndarray, k: int, forbidden: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (row of asked) the rows and exact scores of its best k or more (all ties of the k-th)."""
        n, out = len(self.x), [(np.zeros(0, np.int64), np.zeros(0))] * len(asked)
        # a query's length does not change its ranking; at the length of the rows, near and far differ most
        q = asked / np.abs(asked).max(axis=1, keepdims=True)
        q *= np.sqrt(self.top / (q * q).sum(axis=1, keepdims=True))
        centres, bases = self.directions[:, :-1] @ q.T, 2 * self.top
        rank, ranks = min(math.ceil(k * len(self.scouts) / n), len(self.scouts) - 1), []
        while rank < len(self.scouts):
            ranks.append(rank)
            rank = 2 * rank + 1
        steps = np.partition(bases - 2 * (q @ self.scouts.T), ranks, axis=1)[:, ranks]
        steps = np.sqrt(np.maximum(steps, 1e-12))
        radius, turn = steps[:, 0].copy(), 0
        active = np.array([i for i in range(len(q)) if len(forbidden[i]) < n], np.int64)
        while len(active):
            turn += 1
            following, left = steps[:, min(turn, len(ranks) - 1)], []
            reach = WIDTH * radius[active]
            # virtual rehashing: the windows of all arrays at these radii, as ranges of places
            a = np.array([np.searchsorted(s, c[active] - reach, "left") for s, c in zip(self.sorted, centres, strict=True)]).T
            b = np.array([np.searchsorted(s, c[active] + reach, "right") for s, c in zip(self.sorted, centres, strict=True)]).T
            for i, low, high in zip(active, a, b, strict=True):
                rows = self._colliding(low, high)
                if len(forbidden[i]):
                    rows = rows[~np.isin(rows, forbidden[i])]
                allowed, kth_at = n - len(forbidden[i]), math.inf
                want = min(k, allowed)
                if len(rows) >= want:
                    light = self.x[rows] @ q[i]
                    kth = np.partition(light, len(rows) - want)[len(rows) - want]
                    kth_at = math.sqrt(max(bases - 2 * kth, 0))
                    if kth_at <= radius[i] or len(rows) == allowed:
                        rows = rows[light >= kth - 1e-9 * max(1.0, abs(kth))]
                        out[i] = rows, (self.original[rows] * asked[i]).sum(axis=1)
                        continue
                radius[i] = max(radius[i] * GROWTH, min(kth_at, following[i]))
                left.append(i)
            active = np.array(left, np.int64)
        return out


def _block_search(k: int):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        base, asked = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        out = {"query_id": [np.zeros(0, np.int64)], "vec_id": [np.zeros(0, np.int64)], "score": [np.zeros(0)]}
        if len(base) and len(asked):
            ids, copies = base["vec_id"].to_numpy(), np.minimum(base["copies"].to_numpy(), k)
            index = CollisionIndex(np.stack(base["v"].to_numpy()).astype(np.float64))
            by_id = pd.Series(np.arange(len(ids))).groupby(ids).indices
            asking, none = asked["vec_id"].to_numpy(), np.zeros(0, np.int64)
            for at in range(0, len(asked), BATCH):
                some = asking[at : at + BATCH]
                q = np.stack(asked["v"].iloc[at : at + BATCH].to_numpy()).astype(np.float64)
                for qid, (rows, scores) in zip(some, index.search(q, k, [by_id.get(i, none) for i in some]), strict=True):
                    pick = np.lexsort((ids[rows], -scores))
                    pick = np.repeat(pick, copies[rows[pick]])[:k]
                    out["query_id"].append(np.full(len(pick), qid))
                    out["vec_id"].append(ids[rows[pick]])
                    out["score"].append(scores[pick])
        return pd.DataFrame({name: np.concatenate(parts) for name, parts in out.items()}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return of


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def nearest(vectors: DataFrame, is_query: Column, *, k: int = K, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row among all other rows."""
    fine = "embedding IS NOT NULL AND size(embedding) > 0 AND vec_id IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("transform(embedding, x -> double(x))").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # rows that repeat id and vector would hash into one block; combined before the shuffle, they are one row with a count
    good, _ = staged(rows.groupBy("vec_id", "v").agg(F.max("asks").alias("asks"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("v")), "vectors")
    one, own = F.lit(1), F.col("asks").cast("long")
    n, values, asked, asked_values = good.agg(F.count(one), *(F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("dim").cast("long"), own, own * F.col("dim")))).first()
    blocks = max(1, math.ceil(n / block), math.ceil(values / (block * 64)))
    groups = max(1, math.ceil(asked / QUERIES_A_TASK), math.ceil(asked_values / (QUERIES_A_TASK * 64)))
    salt = F.xxhash64("vec_id", "v")
    base = good.select("dim", F.pmod(salt, F.lit(blocks)).alias("b"), F.explode(F.sequence(_long(0), _long(groups - 1))).alias("g"), "vec_id", "v", "copies", F.lit(False).alias("asks"))
    queries = good.where("asks").select("dim", F.explode(F.sequence(_long(0), _long(blocks - 1))).alias("b"), F.pmod(salt, F.lit(groups)).alias("g"), "vec_id", "v", "copies", F.lit(True).alias("asks"))
    found = base.unionByName(queries).groupBy("dim", "b", "g").applyInPandas(_block_search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
