"""Toxic spans and document scores by a linear-chain conditional random field.

Two states, clean and toxic, one step a token.  Tokens are white-space words without outer punctuation, lower-cased.
Features of a token are its word, its first 4 to 8 bytes, its last 4, its shape, and the words before and after it.
Only documents are labelled, so token labels are projected: features that go with toxic documents beyond chance (a
likelihood ratio that allows for how many features were tried, over documents no two of which are near copies) are
kept, and tokens of toxic documents that have a kept feature of their own are toxic.  The field has a weight for each
kept feature, one for tokens without any, and a transition matrix, fitted to the conditional likelihood of whole texts.

Runs of tokens without kept features are powers of one 2 x 2 matrix, taken through its eigenvalues, so that
forward-backward is exact over whole texts and its work grows with the tokens that have features.  A document's score
is a logistic regression on -log P(all tokens clean), beyond that of a text of its length without such tokens, and on
the largest marginal.  It is fitted to scores of fields that were fitted on other documents, then corrected for the
classes' shares.  Offending offsets are the tokens with a marginal of one half or more.

Defined results: null and empty texts and texts without features get about one base score; without labelled documents
of both classes every score is the share of toxic labels (0.5 if there are none); repeated rows are scored each; an
empty table gives no rows; columns of any name pass through, those named like outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowed import give_back, map_arrow
from . import fitting, textops

#: A kept feature stands in so many documents at least, with such log odds; ``CLEAR`` is added to what the number of
#: features tried demands of its likelihood ratio.
LEAST_DOCS, LEAST_LOG_ODDS, CLEAR = 3, 1.5, 8.0
THRESHOLD = 0.7
#: Steps of the fit.
STEPS = 80
OUTPUTS = ("score", "predicted", "spans")
SPANS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("start", T.IntegerType()), ("end", T.IntegerType()), ("p", T.DoubleType()))]))
PREFIXES, SUFFIX = (4, 5, 6, 7, 8), 4
#: Features of a token itself; ``before`` and ``after`` are its neighbours'.
OWN = ("word", *(f"first{n}" for n in PREFIXES), "last", "shape")
KINDS = (*OWN, "before", "after")


@dataclass
class Model:
    """For each kind its sorted feature hashes, all weights in that order, the weight of other tokens, transitions, the
    score's weights."""

    features: dict[str, np.ndarray]
    weights: np.ndarray
    other: float
    transitions: np.ndarray
    score: np.ndarray
    base: float


def _hashed(words: textops.Words, kind: str, spans: tuple[np.ndarray, np.ndarray], word: np.ndarray) -> np.ndarray:
    """The feature of one kind of every token (0: none)."""
    starts, ends = spans
    if kind == "word":
        return word
    if kind == "before" or kind == "after":
        out = np.zeros_like(word)
        edge = words.first[1:-1]
        if kind == "before":
            out[1:] = word[:-1]
            out[edge[edge < len(word)]] = 0
        else:
            out[:-1] = word[1:]
            out[edge[edge > 0] - 1] = 0
        return out
    if kind == "shape":
        return words.shapes(starts, ends)
    n = SUFFIX if kind == "last" else int(kind[5:])
    h = words.spans_hashed(np.maximum(starts, ends - n), ends) if kind == "last" else words.spans_hashed(starts, np.minimum(ends, starts + n))
    h[ends - starts <= n] = 0
    return h


def _found(words: textops.Words, features: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(token, feature) of every kept feature of a chunk, and the spans of all its tokens."""
    spans = words.stems()
    tokens, which, base = [], [], 0
    word = words.spans_hashed(*spans) if features else np.zeros(0, dtype=np.uint64)
    for kind, known in features.items():
        h = _hashed(words, kind, spans, word)
        likely = np.zeros(1 << 16, dtype=bool)
        likely[known >> np.uint64(48)] = True
        at = np.flatnonzero(likely[h >> np.uint64(48)])
        i = np.searchsorted(known, h[at])
        i[i == len(known)] = 0
        good = known[i] == h[at]
        tokens.append(at[good])
        which.append(i[good] + base)
        base += len(known)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(tokens or [none]), np.concatenate(which or [none]), spans


class Chains:
    """Texts as chains of tokens with features (hits) and runs of other tokens between them.

    Texts lie in falling order of their number of hits (``order``), so that the first ``live[i]`` of them have an i-th
    hit.  Hits lie flat: all first ones, then all second ones, and so on; ``slot`` gives the place of each hit given.
    ``gaps``: other tokens before each hit; ``tail``: after a text's last one; ``size``: tokens of each text."""

    def __init__(self, place: np.ndarray, text: np.ndarray, size: np.ndarray):
        """Hits at ``place`` in ``text``, in order of text and place; ``size``: tokens of each text."""
        count = np.bincount(text, minlength=len(size))
        self.order = np.argsort(-count, kind="stable")
        rank = np.empty_like(self.order)
        rank[self.order] = np.arange(len(size))
        first = np.r_[0, np.cumsum(count)][:-1]
        column = np.arange(len(text)) - first[text]
        self.live = np.bincount(column)
        self.begin = np.r_[0, np.cumsum(self.live)]
        self.slot = self.begin[column] + rank[text]
        self.row = np.empty(len(text), dtype=np.int64)
        self.row[self.slot] = rank[text]
        self.gaps = np.empty(len(text), dtype=np.int64)
        self.gaps[self.slot] = np.where(column > 0, place - np.r_[0, place[:-1]] - 1, place)
        last = np.full(len(size), -1)
        last[text] = place  # the last one written stays
        self.size = size[self.order]
        self.tail = self.size - 1 - last[self.order]


def forward_backward(c: Chains, emit: np.ndarray, other: float, transitions: np.ndarray, counted: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) at each hit, -log P(all tokens clean) of each text, and expected transitions (2, 2) of all texts (zeros
    if not ``counted``), in the order of the chains.

    ``emit``: score of toxic over clean at each hit; ``other``: at every other token; ``transitions``: scores (from,
    to); before its first token a text is clean.  A run of other tokens is a power of one matrix, scaled by its larger
    eigenvalue: one + ratio**length * two."""
    t = np.exp(transitions)
    m = t * np.array([1.0, np.exp(other)])
    half = (m[0, 0] - m[1, 1]) / 2
    root = np.sqrt(half * half + m[0, 1] * m[1, 0])
    high = (m[0, 0] + m[1, 1]) / 2 + root
    low = high - 2 * root
    ratio, one, two = low / high, (m - low * np.eye(2)) / (high - low), (high * np.eye(2) - m) / (high - low)
    n, total = len(c.size), len(emit)
    up, fade, fade_tail = np.exp(np.clip(emit, -30, 30)), ratio ** c.gaps.astype(float), ratio ** c.tail.astype(float)
    log_z = np.full(n, 0.0)
    np.add.at(log_z, c.row, c.gaps * np.log(high))
    log_z += c.tail * np.log(high)

    def ahead(a, b, f):
        return a * one[0, 0] + b * one[1, 0] + f * (a * two[0, 0] + b * two[1, 0]), a * one[0, 1] + b * one[1, 1] + f * (a * two[0, 1] + b * two[1, 1])

    def back(a, b, f):
        return one[0, 0] * a + one[0, 1] * b + f * (two[0, 0] * a + two[0, 1] * b), one[1, 0] * a + one[1, 1] * b + f * (two[1, 0] * a + two[1, 1] * b)

    a0, a1 = np.ones(n), np.zeros(n)
    start, after, scale = np.empty((2, total)), np.empty((2, total)), np.empty(total)  # of the run before each hit
    for i, k in enumerate(c.live.tolist()):
        at = slice(c.begin[i], c.begin[i] + k)
        start[0, at], start[1, at] = x, y = a0[:k], a1[:k]
        x, y = ahead(x, y, fade[at])
        after[0, at], after[1, at] = x, y
        x, y = x * t[0, 0] + y * t[1, 0], (x * t[0, 1] + y * t[1, 1]) * up[at]
        scale[at] = s = x + y
        a0[:k], a1[:k] = x / s, y / s
    x, y = ahead(a0, a1, fade_tail)
    z = x + y
    np.add.at(log_z, c.row, np.log(scale))
    log_z += np.log(z)
    b0, b1 = back(np.ones(n), np.ones(n), fade_tail)
    then, gone = np.empty((2, total)), np.empty((2, total))  # after each hit; before it
    for i in range(len(c.live) - 1, -1, -1):
        k = int(c.live[i])
        at = slice(c.begin[i], c.begin[i] + k)
        then[0, at], then[1, at] = x, y = b0[:k], b1[:k]
        y = y * up[at]
        gone[0, at], gone[1, at] = x, y = t[0, 0] * x + t[0, 1] * y, t[1, 0] * x + t[1, 1] * y
        x, y = back(x, y, fade[at])
        s = x + y
        b0[:k], b1[:k] = x / s, y / s
    step = after[:, None, :] * t[:, :, None] * np.stack([then[0], then[1] * up])[None]
    step /= step.sum((0, 1))
    expected = np.zeros((2, 2))
    if counted:
        expected += step.sum(2)
        for left, right, gap, f in ((start, gone, c.gaps, fade), (np.stack([a0, a1]), np.ones((2, n)), c.tail, fade_tail)):
            whole = sum(p * q for p, q in zip(ahead(*left, f), right, strict=True))
            from_, to = (one.T @ left, two.T @ left), (one @ right, two @ right)
            mixed = (1 - f) / (1 - ratio)
            low_part = np.where(gap > 0, gap * ratio ** np.maximum(gap - 1, 0).astype(float), 0.0)
            for p, q, w in ((0, 0, gap), (0, 1, mixed), (1, 0, mixed), (1, 1, low_part)):
                expected += (from_[p] @ (to[q] * (w / whole)).T) * m / high
    return step[:, 1].sum(0), log_z - c.size * transitions[0, 0], expected


def _rate(other: float, transitions: np.ndarray) -> float:
    """What a further token without features adds to -log P(all clean) of a long text."""
    m = np.exp(transitions) * np.array([1.0, np.exp(other)])
    half = (m[0, 0] - m[1, 1]) / 2
    return float(np.log((m[0, 0] + m[1, 1]) / 2 + np.sqrt(half * half + m[0, 1] * m[1, 0])) - transitions[0, 0])


def _hits(words: textops.Words, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Tokens with features in order, the score of each, the text of each, and the spans of all tokens."""
    token, feature, spans = _found(words, model.features)
    at, where = np.unique(token, return_inverse=True)
    emit = np.bincount(where, weights=model.weights[feature], minlength=len(at))
    return at, emit, np.searchsorted(words.first, at, side="right") - 1, spans


def evidence(words: textops.Words, model: Model) -> tuple[np.ndarray, tuple]:
    """(-log P(all clean) beyond a text of the same length without features, largest marginal) of each text, and its
    hits: text, token, marginal, spans."""
    at, emit, text, spans = _hits(words, model)
    out, p, size = np.zeros((len(words.rows), 2)), np.zeros(len(at)), np.diff(words.first)
    if len(at):
        some, local = np.unique(text, return_inverse=True)
        c = Chains(at - words.first[text], local, size[some])
        flat = np.empty(len(at))
        flat[c.slot] = emit
        m, nothing, _ = forward_backward(c, flat, model.other, model.transitions, counted=False)
        p = m[c.slot]
        out[some[c.order], 0] = np.maximum(nothing - c.size * _rate(model.other, model.transitions), 0)
        np.maximum.at(out[:, 1], text, p)
    return out, (text, at, p, spans)


def _squashed(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(x[:, 0]), x[:, 1]])


def _presence(texts: pa.Array) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind the feature hashes found in ``LEAST_DOCS`` texts or more, and for every text and such a feature in
    it the feature's index and the text. One kind at a time: the driver holds little of what is rare."""
    out = {}
    for kind in KINDS:
        found, owner = [], []
        for words in textops.chunks(texts):
            spans = words.stems()
            h = _hashed(words, kind, spans, words.spans_hashed(*spans) if kind in ("word", "before", "after") else np.zeros(0, np.uint64))
            for row, a, b in zip(words.rows, words.first[:-1], words.first[1:], strict=True):
                u = np.unique(h[a:b])
                found.append(u[u != 0])
                owner.append(np.full(len(found[-1]), row, dtype=np.int32))
        h, who = np.concatenate(found or [np.zeros(0, np.uint64)]), np.concatenate(owner or [np.zeros(0, np.int32)])
        del found, owner
        by = np.argsort(h, kind="stable")
        h, who = h[by], who[by]
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True]) if len(h) else np.zeros(1, dtype=np.int64)
        count = np.diff(edge)
        often = count >= LEAST_DOCS
        keep = np.repeat(often, count)
        out[kind] = (h[edge[:-1][often]], np.repeat(np.arange(int(often.sum())), count[often]), who[keep])
    return out


def _kept(presence: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, use: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features tied to toxic texts among those in ``use``, by kind, and their log odds."""
    ones, zeros = (use & (y == 1)).sum(), (use & (y == 0)).sum()
    q = ones / max(ones + zeros, 1)
    counts = {k: (np.bincount(code[(use & (y == 1))[who]], minlength=len(known)), np.bincount(code[(use & (y == 0))[who]], minlength=len(known))) for k, (known, code, who) in presence.items()}
    tried = sum(int((a + b >= LEAST_DOCS).sum()) for a, b in counts.values())  # rarer ones cannot be kept
    features, odds = {}, []
    for kind, (a, b) in counts.items():
        n = a + b
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(a > 0, a * np.log(a / (n * q)), 0) + np.where(b > 0, b * np.log(b / (n * (1 - q))), 0))
        lean = np.log((a + 0.5) / (ones + 1)) - np.log((b + 0.5) / (zeros + 1))
        good = np.flatnonzero((a >= LEAST_DOCS) & (lean >= LEAST_LOG_ODDS) & (ratio >= 2 * np.log(max(tried, 1)) + CLEAR))
        if len(good):
            features[kind] = presence[kind][0][good]
            odds.append(lean[good])
    return features, np.concatenate(odds) if odds else np.zeros(0)


def _fitted(texts: pa.Array, y: np.ndarray, use: np.ndarray, presence: dict) -> Model:
    """The field of the texts in ``use``."""
    features, odds = _kept(presence, y, use)
    start = np.array([[0.0, -2.0], [0.0, -1.0]])
    model = Model(features, odds.copy(), -4.0, start, np.zeros(3), 0.0)
    if not len(odds):
        return model
    own = sum(len(v) for k, v in features.items() if k in OWN)
    place, text, size, token, feature, marked = [], [], [], [], [], []
    hits = texts_so_far = 0
    for words in textops.chunks(texts):
        rows = np.flatnonzero(use[words.rows])
        of, which, _ = _found(words, features)
        owner = np.searchsorted(words.first, of, side="right") - 1
        mine = use[words.rows[owner]]
        at, where = np.unique(of[mine], return_inverse=True)
        owner = np.searchsorted(words.first, at, side="right") - 1
        place.append(at - words.first[owner])
        text.append(np.searchsorted(rows, owner) + texts_so_far)
        size.append(np.diff(words.first)[rows])
        token.append(where + hits)
        feature.append(which[mine])
        marked.append((np.bincount(where, weights=which[mine] < own, minlength=len(at)) > 0) & (y[words.rows[owner]] == 1))
        hits, texts_so_far = hits + len(at), texts_so_far + len(rows)
    token, feature = np.concatenate(token), np.concatenate(feature)
    c = Chains(np.concatenate(place), np.concatenate(text), np.concatenate(size))
    gold = np.empty(hits)
    gold[c.slot] = np.concatenate(marked)
    token = c.slot[token]
    # what the labels say: a run between hits is clean
    after = np.zeros(hits)
    joined = np.flatnonzero((c.gaps == 0) & (np.arange(hits) >= c.begin[1:2].sum()))
    column = np.searchsorted(c.begin, joined, side="right") - 1
    after[joined] = gold[c.begin[column - 1] + c.row[joined]]
    count = np.bincount(c.row, minlength=len(c.size))
    full = np.flatnonzero(count)
    ends = (gold[c.begin[count[full] - 1] + full] * (c.tail[full] == 0)).sum()
    truth = np.zeros((2, 2))
    truth[1, 1] = (after * gold).sum()
    truth[0, 1] = gold.sum() - truth[1, 1]
    truth[1, 0] = truth[0, 1] - ends  # each toxic stretch is left, unless it ends the text
    truth[0, 0] = c.size.sum() - truth.sum()
    w, rest, t = model.weights.copy(), np.array([model.other]), model.transitions.copy()

    def gradient(_: int) -> list[np.ndarray]:
        p, _, expected = forward_backward(c, np.bincount(token, weights=w[feature], minlength=hits), float(rest[0]), t)
        gw = np.bincount(feature, weights=(p - gold)[token], minlength=len(w))
        go = expected[:, 1].sum() - p.sum()
        return [(g + 0.01 * v) / len(c.size) ** 0.5 for g, v in ((gw, w), (go, rest), (expected - truth, t))]

    fitting.adam([w, rest, t], gradient, STEPS, 0.15)
    model.weights, model.other, model.transitions = w, float(rest[0]), t
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = fitting.PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded sample of the labelled documents (see ``fitting``)."""
    texts, y, share = fitting.sample(docs, labels, label, per_class, id_col=id_col, text_col=text_col)
    base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if len(set(y.tolist())) < 2:
        return Model({}, np.zeros(0), -4.0, np.zeros((2, 2)), np.zeros(3), base)
    presence = _presence(texts)
    half = np.zeros(len(y), dtype=bool)
    for c in (0, 1):
        half[np.flatnonzero(y == c)[::2]] = True
    x = np.zeros((len(y), 2))
    for use in (half, ~half):
        other = _fitted(texts, y, use, presence)
        for words in textops.chunks(texts):
            rows = ~use[words.rows]
            x[words.rows[rows]] = evidence(words, other)[0][rows]
    model = _fitted(texts, y, np.ones(len(y), dtype=bool), presence)
    if not len(model.weights):
        model.base = base
        return model
    model.score = fitting.logistic(_squashed(x), y)
    model.score[-1] += fitting.prior_shift(y, share)
    del presence, texts
    give_back()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (score >= threshold) and spans (start, end in code points; p)."""
    docs = docs.drop(*OUTPUTS)
    text_at = docs.columns.index(text_col)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", SPANS)]
    schema = T.StructType([*docs.schema.fields, *fields])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, spans = [], []
            for words in textops.chunks(b.column(text_at)):
                x, (text, at, p, (starts, ends)) = evidence(words, model)
                scores.append(fitting.sigmoid(_squashed(x) @ model.score[:-1] + model.score[-1] + model.base))
                own: list[list[dict]] = [[] for _ in words.rows]
                bad = np.flatnonzero(p >= 0.5)
                if len(bad):
                    ends_at = words.points(ends[at[bad]], text[bad])
                    for i, s, e, q in zip(text[bad], words.points(starts[at[bad]], text[bad]), ends_at, p[bad], strict=True):
                        own[i].append({"start": int(s), "end": int(e), "p": float(q)})
                spans += own
            s = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(spans, span_type)], names=schema.names)

    return map_arrow(docs, run, schema)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (same columns) that the field, fitted on all labels, does not call toxic."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))
    return score(rows, model, threshold=threshold).where("predicted = 0").select("row.*")
