"""Quality from supervised subword embeddings (operator 2).

A document is the average of the learned vectors of its words, of words said
twice running (one row for them all), and of its character 3- to 5-grams (over
UTF-8 bytes, case and punctuation kept), all hashed into 2**17 rows, with
``PRIOR`` zero vectors so that a few words do not decide; softmax on top; trained
by stochastic gradient descent in numpy.
As the average meets a linear layer, scoring needs one number a row: a 0.5 MB
table is broadcast, whatever the corpus, and every whole text is scored.

Training is on a bounded sample: ``PER_CLASS`` labelled rows of each class, the
lowest in hash order. Its texts become hashed counts on the executors, so the
driver holds at most 2 * PER_CLASS sparse rows. Classes are weighed back to
their shares among the labels.

Nulls and odd rows: null and empty texts score as the softmax of the bias
alone; several labels of one doc_id count by their largest; null labels are left
out. If either class has no row, every score is 0.5. Repeated rows agree. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.hashing import IS_WORD
from factloom.llm.shared import table
from factloom.llm.toxicity import held_out, scorer

BITS, DIM, PER_CLASS, EPOCHS, RATE, THRESHOLD = 17, 8, 1_500, 5, 0.5, 0.7
BLOCK = 1 << 20
#: The row of a word that repeats the word before it, and the tokens without a vector that every text is given.
REPEAT, PRIOR = 0, 300
_MULT = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint32)
_POW: list[np.ndarray] = []


def _word_hashes(b: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each run of bytes that are no ASCII white space."""
    word = IS_WORD[b]
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint32)
    longest = int((ends - starts).max())
    if not _POW or len(_POW[0]) < longest:
        powers = np.full(max(256, longest), 0x01000193, np.uint32)
        powers[0] = 1
        _POW[:] = [np.cumprod(powers, dtype=np.uint32)]
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    base = np.add.reduceat((b[word].astype(np.uint32) + np.uint32(1)) * _POW[0][place], first, dtype=np.uint32)
    return base * np.uint32(0x9E3779B1)


def token_rows(text: str | None):
    """Yields the table rows of a text's words and character n-grams, in blocks that end before white space: the same tokens at any size."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    shift = np.uint32(32 - BITS)
    at, before = 0, -1  # the row of the last word so far
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        while end < len(raw) and IS_WORD[raw[end]]:
            gap = np.flatnonzero(~IS_WORD[raw[end : end + BLOCK]])
            end = end + int(gap[0]) if len(gap) else min(end + BLOCK, len(raw))
        words = _word_hashes(raw[at:end]) >> shift
        yield words
        if len(words):
            again = int((words[1:] == words[:-1]).sum()) + int(words[0] == before)
            before = int(words[-1])
            yield np.full(again, REPEAT, np.uint32)
        u = raw[at : end + 4].astype(np.uint32) + np.uint32(1)  # n-grams that start in the block
        h = u * _MULT[0]
        for n in range(2, 6):
            if len(u) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) + u[n - 1 :] * _MULT[n - 1]
            if n >= 3:
                yield (h[: end - at] * np.uint32(0x85EBCA6B)) >> shift
        at = end


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a text and their shares of all its tokens."""
    tally = np.zeros(1 << BITS, np.int64)
    for rows in token_rows(text):
        tally += np.bincount(rows, minlength=1 << BITS)
    at = np.flatnonzero(tally)
    return at.astype(np.int32), (tally[at] / (PRIOR + tally.sum())).astype(np.float32)


def _as_counts(batches):
    for pdf in batches:
        found = [counts(t) for t in pdf["text"]]
        yield pd.DataFrame({"label": pdf["label"], "rows": [a.tobytes() for a, _ in found], "shares": [s.tobytes() for _, s in found]})


class QualityModel:
    """One number a table row, and the bias; their average over a text is its logit."""

    def __init__(self, per_row: np.ndarray | None = None, bias: float = 0.0):
        self.per_row, self.bias = per_row, bias

    def score(self, texts) -> np.ndarray:
        if self.per_row is None:
            return np.full(len(texts), 0.5)
        z = np.empty(len(texts))
        for i, t in enumerate(texts):
            total, n = 0.0, 0
            for rows in token_rows(t):
                total += float(self.per_row[rows].sum(dtype=np.float64))
                n += len(rows)
            z[i] = self.bias + total / (PRIOR + n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], prior: float, *, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> QualityModel:
    """Stochastic gradient descent over (rows, shares, label); prior: the share of label 1 to calibrate to."""
    rng = np.random.default_rng(seed)
    table_ = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    n, step = len(examples), 0
    weight = [0.0, 0.0]
    for y in (0, 1):
        weight[y] = n / (2 * max(1, sum(e[2] == y for e in examples)))
    for _ in range(epochs):
        for i in rng.permutation(n):
            rows, shares, y = examples[i]
            lr = rate * (1 - step / (epochs * n))
            step += 1
            hidden = shares @ table_[rows]
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = (p * weight[y]).astype(np.float32)
            back = out @ g
            out -= lr * np.outer(hidden, g)
            bias -= lr * g
            # sparse step: a row moves by its share of the text, scaled so that short and long texts learn alike
            table_[rows] -= (lr * 20 * np.sqrt(shares))[:, None] * back[None, :] * np.float32(0.05)
    per_row = (table_ @ (out[:, 1] - out[:, 0])).astype(np.float32)
    z = np.array([float(s @ per_row[r]) for r, s, _ in examples]) + float(bias[1] - bias[0])
    y = np.array([e[2] for e in examples], float)
    a, b = _platt(z, y, np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9)))
    return QualityModel(per_row * np.float32(a), float(a * (bias[1] - bias[0]) + b))


def _platt(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic regression on one logit, kept gentle by a ridge."""
    x = np.stack([z, np.ones_like(z)], 1)
    v = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        h = (x * (w * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag([0.5, 0.01])
        g = x.T @ (w * (y - p)) - np.diag([0.5, 0.01]) @ (v - np.array([1.0, 0.0]))
        s = np.linalg.solve(h, g)
        v += s * min(1.0, 2 / (np.abs(s).max() + 1e-9))
    return float(max(v[0], 0.1)), float(v[1])


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    """Learns from at most per_class labelled rows of each class; the caller leaves out what is held out."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(
        F.max(F.when(F.col(column) > 0, 1).otherwise(0)).alias("label")
    )
    share = told.agg(F.avg("label")).first()[0]
    if share is None or share in (0.0, 1.0):
        return QualityModel()
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    chosen = [told.where(F.col("label") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    sample = (
        docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
        .select("text", "label").mapInPandas(_as_counts, "label int, rows binary, shares binary").collect()
    )
    examples = sorted(((bytes(r["rows"]), bytes(r["shares"]), r["label"]) for r in sample))
    examples = [(np.frombuffer(a, np.int32), np.frombuffer(s, np.float32), y) for a, s, y in examples]
    return train(examples, share) if len({y for *_, y in examples}) == 2 else QualityModel()


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(4, 2)
    score = scorer(spark, fit(docs.where(~out), table(spark, sf_dir, "labels").where(~out)))
    return docs.select("doc_id", out.alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
