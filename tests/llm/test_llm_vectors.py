"""Vector operators against brute force, with unusable, equal and differently wide vectors."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from chronowarp.llm import ann, embedding_dedup, vectors

RNG = np.random.default_rng(12)
SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [None, [], [0.0] * 16, [math.nan] * 16, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0]]


def table(spark, n=600, width=16):
    rows, at = [], 0
    bases = RNG.normal(size=(40, width))
    for i in range(n):
        x = bases[i % 40] + RNG.normal(size=width) * random.Random(i).choice((0.05, 0.2, 0.35, 1.0))
        rows.append((i, [float(np.float32(v)) for v in x], i % 3 if i % 11 else None))
    rows += [(n + k, rows[40][1], 1) for k in range(80)]  # many copies
    at = len(rows)
    rows += [(at + k, x, 1) for k, x in enumerate(ODD)]
    return rows, spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "home", "n_links", "members")}).repartition(3)


def usable(x):
    return x is not None and len(x) > 0 and all(v is not None and math.isfinite(v) for v in x) and any(x)


def test_near_duplicate_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    monkeypatch.setattr(embedding_dedup, "CELL", 16)
    rows, df = table(spark)
    got = {r.id: r for r in embedding_dedup.near_duplicates(df, 0.9).collect()}
    good = [r for r in rows if usable(r[1]) and r[2] is not None]
    unit = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in good}
    linked = {r[0]: set() for r in rows}
    for a in good:
        for b in good:
            if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and float(unit[a[0]] @ unit[b[0]]) >= 0.9:
                linked[a[0]].add(b[0])
                linked[b[0]].add(a[0])
    want = sum(map(len, linked.values()))
    found = sum(r.n_links for r in got.values())
    assert len(got) == len(rows) and want > 3000 and found >= 0.99 * want
    assert all(got[i].n_links <= len(linked[i]) for i in linked)
    component = {i: i for i in linked}
    changed = True
    while changed:
        changed = False
        for i, others in linked.items():
            low = min([component[i], *(component[o] for o in others)])
            if low < component[i]:
                component[i], changed = low, True
    wrong = [i for i in linked if got[i].component_id != component[i]]
    assert len(wrong) <= 0.01 * len(rows)
    assert all(got[i].kept == (got[i].component_id == i) for i in linked)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_grid_of_many_cells(spark, monkeypatch):
    """Codebooks of ten codes a half, text labels: most cells are not visited, and nearly every link is found."""
    monkeypatch.setattr(embedding_dedup, "CELL", 8)
    rng = np.random.default_rng(4)
    bases = rng.normal(size=(250, 32))
    x = (bases[np.arange(800) % 250] + rng.normal(size=(800, 32)) * rng.choice((0.05, 0.15, 0.25), size=(800, 1))).astype(np.float32)
    df = spark.createDataFrame([(i, x[i].tolist(), "one") for i in range(800)], "vec_id long, embedding array<float>, label string")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    got = {r.id: r.n_links for r in embedding_dedup.near_duplicates(df, 0.93).collect()}
    assert all(got[i] <= near[i].sum() for i in range(800)) and sum(got.values()) >= 0.98 * near.sum() > 500


def test_traversal_is_in_order():
    left, right = np.array([0.3, 0.0, 0.7]), np.array([0.1, 0.0, 0.2, 0.9])
    cells = list(embedding_dedup.traverse(left, right, 0.75))
    sums = [left[i] ** 2 + right[j] ** 2 for i, j in cells]
    assert sums == sorted(sums)
    assert set(cells) == {(i, j) for i in range(3) for j in range(4) if left[i] ** 2 + right[j] ** 2 <= 0.75**2}


def test_search(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 256)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    rows, df = table(spark)
    got: dict = {}
    for r in ann.search(df, (F.col("vec_id") % 20 == 0) | (F.col("vec_id") == 686), 20, rerank=100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [r for r in rows if usable(r[1])]
    hits = total = 0
    for q in good:
        if q[0] % 20 == 0 or q[0] == 686:
            x = np.array(q[1])
            like = [c for c in good if len(c[1]) == len(x)]  # each width is searched apart
            every = sorted(((-float(np.array(c[1]) @ x), c[0]) for c in like if c[0] != q[0]))[:20]
            mine = sorted(got[q[0]])
            assert [m[0] for m in mine] == list(range(1, len(every) + 1))
            scores = {c[0]: float(np.array(c[1]) @ x) for c in like}
            assert all(abs(scores[v] - s) < 1e-12 for _, v, s in mine)
            assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
            hits += len({v for _, v in every} & {v for _, v, _ in mine})
            total += len(every)
    assert total and set(got) == {r[0] for r in good if r[0] % 20 == 0 or r[0] == 686} and hits >= 0.95 * total
    assert ann.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 1.0], 1)], SCHEMA)
    assert [(r["rank"], r.vec_id) for r in ann.search(few, F.col("vec_id") == 0, 20).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_encoding_improves_with_levels_and_beam():
    x = RNG.normal(size=(400, 12))
    books = ann.codebooks(x, levels=6, words=16)
    flat = books.reshape(-1, 12)

    def error(levels, beam):
        c = ann.encode(x, books[:levels], beam)
        return float(((x - flat[c + np.arange(levels) * 16].sum(1)) ** 2).sum())

    assert error(6, 4) <= error(6, 1) < error(3, 1) < error(1, 1)


def test_kmeans_takes_few_points():
    x = np.array([[0.0, 0.0], [1.0, 1.0]])
    assert len(vectors.kmeans(x, 8)) == 2
