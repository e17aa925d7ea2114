"""Toxicity from class-conditional Kneser-Ney models (operator 8).

Texts become strings over 32 symbols (a-z with accents folded, one separator,
digits, and four classes for other letters). There is a pair of interpolated
Kneser-Ney models, toxic and ordinary, at two levels: of symbols, of order 4, and
of words, hashed into 2**WORD_BITS cells. The two of a pair differ in their highest
order only. Below it are continuation counts shared by both classes (different
symbols before, different documents of a word), so a rare expression gets the same
backed-off probability on either side and adds next to nothing; words in up to
``WORD_DISCOUNT`` documents of a class have nothing else. All conditional
log-likelihood ratios fit in one table of 5 MB, whatever the corpus; it is all
that is broadcast.

The counts cover every labelled training row: they are taken on the executors,
one partial table a task, and added up in a shuffle by cell. A text's features
are length-normalised: its mean ratio a symbol and a word, and the ratios of its
most toxic words set against what the text's length makes likely; a logistic
regression, fitted on a fold of the training rows that the counts leave out
(at most ``CALIBRATION`` rows, the lowest in hash order), turns them into a score.

Nulls and odd rows: null and empty texts have no symbols and get the
intercept's score; several labels of one doc_id count as toxic if any says so;
labels with null in either column are left out. If either class has no training
row, every score is 0.5. If the fold lacks a class (few labels), the regression is
fitted on all training rows of which features can be had, within the same bound.
Rows are scored one by one, so repeated rows agree; other columns are not read.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.shared import table

SYMBOLS, DISCOUNT, CALIBRATION, THRESHOLD = 32, 0.75, 20_000, 0.7
HOT, WORD_BITS, WORD_DISCOUNT, FEATURES = 4.0, 18, 2.0, 9


def _symbol_table() -> np.ndarray:
    """Code point to symbol for the first plane: 0 separator, 1-26 letters, 27 digit, 28-31 other letters."""
    out = np.zeros(0x10000, np.uint8)
    for cp in range(0x10000):
        ch = chr(cp)
        if cp < 128:
            out[cp] = cp - 96 if "a" <= ch <= "z" else cp - 64 if "A" <= ch <= "Z" else 27 if ch.isdigit() else 0
            continue
        base = unicodedata.normalize("NFKD", ch)[:1].lower() if cp < 0x2100 else ""
        if len(base) == 1 and "a" <= base <= "z":
            out[cp] = ord(base) - 96
        elif ch.isalpha() or unicodedata.category(ch)[0] == "M":
            out[cp] = 28 + cp % 4
        elif ch.isdigit():
            out[cp] = 27
    return out


_TABLE: list[np.ndarray] = []


def symbols(text: str | None) -> np.ndarray:
    """The text's symbols, runs of separators as one, with one separator at the end; empty for no symbols."""
    if not _TABLE:
        _TABLE.append(_symbol_table())
    cps = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _TABLE[0][np.minimum(cps, 0xFFFF)]
    s = np.concatenate([s, np.zeros(1, np.uint8)])
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    keep[0] = s[0] != 0
    return s[keep]


def grams(s: np.ndarray) -> np.ndarray:
    """The 4-gram cell of each symbol, with separators before the text."""
    p = np.concatenate([np.zeros(3, np.int32), s.astype(np.int32)])
    return (p[:-3] << 15) | (p[1:-2] << 10) | (p[2:-1] << 5) | p[3:]


def word_starts(s: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(s == 0)[:-1] + 1])


def word_cells(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The cell of each word, by a polynomial hash of its symbols."""
    sizes = np.diff(np.append(starts, len(s)))
    place = np.arange(len(s)) - np.repeat(starts, sizes)
    powers = np.full(max(int(sizes.max()), 1), 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    h = np.add.reduceat(s.astype(np.uint64) * np.cumprod(powers, dtype=np.uint64)[place], starts)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _count_cells(batches):
    """(cell, toxic, ordinary) of one task's rows (text, label): symbols' cells, then words' with one count a document."""
    seen = np.zeros((2, SYMBOLS**4 + (1 << WORD_BITS)), np.int64)
    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["label"], strict=True):
            s = symbols(text)
            if len(s):
                cells, n = np.unique(grams(s), return_counts=True)
                seen[int(label), cells] += n
                seen[int(label), SYMBOLS**4 + np.unique(word_cells(s, word_starts(s)))] += 1
    cells = np.flatnonzero(seen.sum(axis=0))
    for at in range(0, len(cells), 50_000):
        c = cells[at : at + 50_000]
        yield pd.DataFrame({"cell": c.astype(np.int32), "toxic": seen[1, c], "ordinary": seen[0, c]})


def word_ratios(toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """log P(word | toxic) - log P(word | ordinary) of each cell; both back off to the documents of either class that hold it."""
    shared = (toxic + ordinary + 0.5) / (toxic + ordinary + 0.5).sum()
    p = [(np.maximum(c - WORD_DISCOUNT, 0) + np.minimum(c, WORD_DISCOUNT).sum() * shared) / max(c.sum(), 1) for c in (toxic, ordinary)]
    return (np.log(p[0]) - np.log(p[1])).astype(np.float32)


def ratio_table(toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """log P(symbol | 3 before, toxic) - log P(symbol | 3 before, ordinary) for each of the 32**4 cells."""
    k = SYMBOLS
    pooled = (toxic + ordinary).reshape(k, k, k, k)
    cont3 = (pooled > 0).sum(axis=0).astype(float)
    cont2 = (cont3 > 0).sum(axis=0).astype(float)
    cont1 = (cont2 > 0).sum(axis=0).astype(float)

    def interpolated(c: np.ndarray, lower: np.ndarray) -> np.ndarray:
        total = c.sum(axis=-1, keepdims=True)
        kinds = (c > 0).sum(axis=-1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = (np.maximum(c - DISCOUNT, 0) + DISCOUNT * kinds * lower) / total
        return np.where(total > 0, p, lower)

    p1 = (cont1 + 1) / (cont1 + 1).sum()
    p2 = interpolated(cont2, p1)
    p3 = interpolated(cont3, p2)
    high = [interpolated(c.reshape(k, k, k, k).astype(float), p3) for c in (toxic, ordinary)]
    return (np.log(high[0]) - np.log(high[1])).astype(np.float32).ravel()


def features(text: str | None, ratios: np.ndarray) -> list[float]:
    s = symbols(text)
    if not len(s):
        return [0.0] * FEATURES
    r = ratios[grams(s)]
    starts = word_starts(s)
    spelled = np.add.reduceat(r.astype(np.float64), starts)
    whole = ratios[SYMBOLS**4 + word_cells(s, starts)].astype(np.float64)
    out = [100 * float(r.mean())]
    for words in (spelled, whole):
        top = np.sort(words)[-2:]
        out += [float(top[-1]), float(top[0]), float(np.log1p(np.maximum(words - HOT, 0).sum()))]
    return [*out, float(whole.mean()), float(np.log(len(starts)))]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method on standardised columns: weights with the intercept last, means, scales."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = l2 * len(x) / 100 * np.eye(len(w)) + 1e-6 * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, scale


class ToxicityModel:
    """What scoring needs: the ratio table, and the logistic regression over features()."""

    def __init__(self, ratios=None, weights=None, mean=None, scale=None):
        self.ratios, self.weights, self.mean, self.scale = ratios, weights, mean, scale

    def score(self, texts) -> np.ndarray:
        if self.ratios is None:
            return np.full(len(texts), 0.5)
        x = np.array([features(t, self.ratios) for t in texts], float).reshape(len(texts), FEATURES)
        z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the doc_id as text has the remainder; a null doc_id hashes as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == remainder


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> ToxicityModel:
    """Learns from the labelled rows of docs; the caller leaves out what is held out."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(
        F.max(F.when(F.col(column) > 0, 1).otherwise(0)).alias("label")
    )
    told_here = told.hint("shuffle_hash")  # labels grow with the texts: never a broadcast
    rank = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("calibration")), F.lit(1_000_000))
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    n = told.count()
    fold = max(1, int(1_000_000 * min(0.2, CALIBRATION / max(n, 1))))
    counts = (
        texts.where(rank >= fold).join(told_here, "doc_id").select("text", "label")
        .mapInPandas(_count_cells, "cell int, toxic long, ordinary long")
        .groupBy("cell").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toPandas()
    )
    full = np.zeros((2, SYMBOLS**4 + (1 << WORD_BITS)))
    full[0, counts["cell"]], full[1, counts["cell"]] = counts["toxic"], counts["ordinary"]
    if not full[0].any() or not full[1].any():
        return ToxicityModel()
    letters, words = full[:, : SYMBOLS**4], full[:, SYMBOLS**4 :]
    ratios = np.concatenate([ratio_table(*letters), word_ratios(*words)])
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    as_features = F.pandas_udf(lambda t: pd.Series([features(x, shared.value) for x in t]), T.ArrayType(T.DoubleType()))

    def sample(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        found = rows.join(told_here, "doc_id").orderBy(rank, "doc_id").limit(CALIBRATION).select("label", as_features("text").alias("x")).collect()
        return np.array([r["x"] for r in found], float), np.array([r["label"] for r in found], float)

    x, y = sample(texts.where(rank < fold))
    if len(set(y.tolist())) < 2:
        x, y = sample(texts)
    return ToxicityModel(ratios, *logistic(x, y)) if len(set(y.tolist())) == 2 else ToxicityModel()


def scorer(spark, model):
    """A column function: the model's score of each whole text."""
    kind, shared = type(model), spark.sparkContext.broadcast(vars(model))

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(kind(**shared.value).score(list(texts)), dtype="float64")

    return score


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(3, 1)
    score = scorer(spark, fit(docs.where(~out), table(spark, sf_dir, "labels").where(~out)))
    return docs.select("doc_id", out.alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
