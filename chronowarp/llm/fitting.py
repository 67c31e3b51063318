"""A bounded sample of labelled texts for fitting, and small numeric helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops

#: Labelled documents of each class that a classifier is fitted on, at most, and the longest text taken for it.
PER_CLASS, MOST_CHARS = 2000, 20_000
#: Times as many labelled documents are read, since long texts and near copies among them are left out.
OVERDRAW = 1.5


def held_out(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _apart(texts: pa.Array, order: np.ndarray, most: int) -> list[int]:
    """The first ``most`` of ``order`` that are no near copies of one before: of its four smallest five-word shingle
    hashes a text shares less than half with any of them."""
    low = [np.unique(run)[:4].tolist() for words in textops.chunks(texts) for run in words.shingles(5)]
    holders: dict[int, list[int]] = {}
    kept: list[int] = []
    for i in order.tolist():
        met: dict[int, int] = {}
        for v in low[i]:
            for j in holders.get(v, ()):
                met[j] = met.get(j, 0) + 1
        if len(kept) < most and 2 * max(met.values(), default=0) < max(len(low[i]), 1):
            kept.append(i)
            for v in low[i]:
                holders.setdefault(v, []).append(i)
    return kept


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, most_chars: int = MOST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> tuple[pa.Array, np.ndarray, float]:
    """(texts, labels 0/1, share of 1 among all labels) of up to ``per_class`` documents of each class, chosen by a
    hash of the id among those of up to ``most_chars`` characters; no two of a class are near copies. At most
    ``OVERDRAW`` times as many are looked at. ``labels``: doc_id and the label (null: none; several: the largest)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picks = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(int(OVERDRAW * per_class)) for y in (0, 1)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") <= most_chars)
    rows = rows.join(F.broadcast(picks[0].union(picks[1])), "doc_id")  # 2 * OVERDRAW * per_class rows at most
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    found = rows.withColumn("h", F.xxhash64("doc_id")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    y = found["y"].to_numpy().astype(np.int64)
    texts = found["text"].combine_chunks()
    own = np.sort(np.array([i for c in (0, 1) for i in _apart(texts, np.flatnonzero(y == c), per_class)], dtype=np.int64))
    total = sum(shares.values())
    return texts.take(pa.array(own)), y[own], shares.get(1, 0) / total if total else 0.5


def prior_shift(y: np.ndarray, share: float) -> float:
    """What to add to the log odds of a model fitted on ``y`` for a population with ``share`` of ones."""
    ones, share = (y.sum() + 0.5) / (len(y) + 1), min(max(share, 1e-3), 1 - 1e-3)
    return float(np.log(share / (1 - share)) - np.log(ones / (1 - ones)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def adam(parameters: list[np.ndarray], gradient, steps: int, rate: float) -> None:
    """Minimise in place; ``gradient(step)`` gives one array a parameter."""
    m, v = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for t in range(1, steps + 1):
        for p, g, a, b in zip(parameters, gradient(t), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 600) -> np.ndarray:
    """Weights (the last for a constant) of a ridge logistic regression."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    adam([w], lambda _: [x.T @ (sigmoid(x @ w) - y) / max(len(y), 1) + penalty * np.r_[w[:-1], 0] / max(len(y), 1) ** 0.5], steps, 0.05)
    return w
