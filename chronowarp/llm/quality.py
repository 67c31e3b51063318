"""Quality probabilities from random-indexing word vectors and a small calibrated network.

Every token (run of letters, of digits or of punctuation) falls by hash into one of ``VOCABULARY`` buckets.  A bucket's
index vector is fixed, sparse and ternary; its context vector is the sum of the index vectors of the tokens beside it
over the whole corpus, in integers, so the result does not depend on the order of addition.  Tasks add up their own
part first; the shuffle carries one row for each bucket and task.  The word vector is index plus scaled context.

A document pools its tokens' vectors (mean and spread) with the log of their number; a network of two layers in numpy,
fitted on a bounded sample of labelled documents, gives the log odds.  A temperature is fitted on documents left out of
the network's fit, then the log odds are corrected for the classes' shares.

Defined results: null and empty texts pool to zero and are scored like any other; without labelled documents of both
classes every score is the share of label 1 (0.5 if there are none); repeated rows are scored each; an empty table
gives no rows; columns of any name pass through, those named like outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowed import map_arrow
from . import fitting, textops

VOCABULARY, DIMENSIONS, NONZERO, HIDDEN = 8192, 32, 4, 24
THRESHOLD = 0.7
OUTPUTS = ("score", "predicted")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of every bucket's index vector."""
    rng = np.random.default_rng(20)
    places = np.argsort(rng.random((VOCABULARY, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places, rng.choice(np.array([-1, 1]), size=(VOCABULARY, NONZERO))


def _tokens(words: textops.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token, and each text's first token."""
    starts, ends, first = words.runs()
    return (words.spans_hashed(starts, ends) % np.uint64(VOCABULARY)).astype(np.int64), first


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(VOCABULARY, DIMENSIONS) float32 from every text of the corpus."""
    columns = [f"c{i}" for i in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(VOCABULARY * DIMENSIONS)
        for b in batches:
            for words in textops.chunks(b.column(0)):
                t, first = _tokens(words)
                if len(t) < 2:
                    continue
                inside = np.ones(len(t) - 1, dtype=bool)  # neighbours of one text
                cut = first[1:-1]
                inside[cut[(cut > 0) & (cut < len(t))] - 1] = False
                left, right = t[:-1][inside], t[1:][inside]
                for a, n in ((left, right), (right, left)):
                    for j in range(NONZERO):
                        total += np.bincount(a * DIMENSIONS + places[n, j], weights=signs[n, j], minlength=len(total))
        table = total.reshape(VOCABULARY, DIMENSIONS).astype(np.int64)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(table[used, i]) for i in range(DIMENSIONS))], names=["bucket", *columns])

    parts = map_arrow(docs.select(text_col), run, "bucket long, " + ", ".join(f"{c} long" for c in columns))
    found = parts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()  # VOCABULARY rows at most
    context = np.zeros((VOCABULARY, DIMENSIONS))
    context[found["bucket"].to_numpy()] = np.column_stack([found[c].to_numpy() for c in columns])
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1)
    places, signs = index_vectors()
    vectors = context
    np.add.at(vectors, (np.arange(VOCABULARY)[:, None], places), signs / NONZERO**0.5)
    return vectors.astype(np.float32)


def pooled(words: textops.Words, vectors: np.ndarray) -> np.ndarray:
    """Each text's features: mean and spread of its word vectors, log of their number."""
    t, first = _tokens(words)
    n = np.diff(first)
    out = np.zeros((len(n), 2 * DIMENSIONS + 1))
    full = np.flatnonzero(n)
    if len(full):
        v = vectors[t]
        at = first[:-1][full]
        mean = np.add.reduceat(v, at, axis=0) / n[full, None]
        square = np.add.reduceat(v * v, at, axis=0) / n[full, None]
        out[full, :DIMENSIONS] = mean
        out[full, DIMENSIONS:-1] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[full, -1] = np.log1p(n[full])
    return out


@dataclass
class Model:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    shift: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return _network(self.layers, (x - self.centre) / self.scale)[1] / self.temperature + self.shift


def _network(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2[0]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = fitting.PER_CLASS) -> Model:
    """Word vectors from all of ``docs``; the network from a bounded sample of labelled ones (see ``fitting``)."""
    vectors = word_vectors(docs)
    texts, y, share = fitting.sample(docs, labels, label, per_class)
    size = 2 * DIMENSIONS + 1
    rng = np.random.default_rng(7)
    layers = [rng.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)]
    model = Model(vectors, np.zeros(size), np.ones(size), layers, 1.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if len(set(y.tolist())) < 2:
        return model
    x = np.concatenate([pooled(words, vectors) for words in textops.chunks(texts)])
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-3
    x = (x - model.centre) / model.scale
    order = rng.permutation(len(y))
    aside, own = order[: len(y) // 5], order[len(y) // 5 :]
    weight = np.where(y == 1, 0.5 / max(y[own].mean(), 1e-3), 0.5 / max(1 - y[own].mean(), 1e-3))

    def gradient(_: int) -> list[np.ndarray]:
        batch = rng.choice(own, size=min(256, len(own)), replace=False)
        hidden, odds = _network(layers, x[batch])
        d = weight[batch] * (fitting.sigmoid(odds) - y[batch]) / len(batch)
        back = np.outer(d, layers[2]) * (1 - hidden**2)
        return [x[batch].T @ back + 1e-4 * layers[0], back.sum(0), hidden.T @ d + 1e-4 * layers[2], np.array([d.sum()])]

    fitting.adam(layers, gradient, 1500, 0.01)
    if len(set(y[aside].tolist())) == 2:
        odds = _network(layers, x[aside])[1]
        trials = np.geomspace(0.25, 8, 60)
        loss = [np.mean(weight[aside] * np.logaddexp(0, np.where(y[aside] == 1, -odds, odds) / t)) for t in trials]
        model.temperature = float(trials[int(np.argmin(loss))])
    share = min(max(share, 1e-3), 1 - 1e-3)
    model.shift = float(np.log(share / (1 - share)))  # the network saw the classes in equal weight
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (score >= threshold)."""
    docs = docs.drop(*OUTPUTS)
    text_at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [pooled(words, model.vectors) for words in textops.chunks(b.column(text_at))]
            s = fitting.sigmoid(model.log_odds(np.concatenate(x))) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return map_arrow(docs, run, schema)
