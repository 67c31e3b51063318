"""The searches in which every vector asks, compared with their SQL and counted over a whole table."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronowarp import queries
from chronowarp.functions import arrow
from chronowarp.functions.arrow import Distance
from chronowarp.operators import search

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """Ids that are not divisible by 100 but for one, two vectors that are alike, and rows without an id or a vector."""
    path = str(tmp_path_factory.mktemp("few"))
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id between 95 and 122")
    copy = rows.where("vec_id = 110").withColumn("vec_id", F.lit(700).cast("long"))
    odd = rows.where("vec_id < 97").select(F.when(F.col("vec_id") == 95, 800).cast("long").alias("vec_id"), F.when(F.col("vec_id") == 96, F.col("embedding")).alias("embedding"), "label")
    rows.unionByName(copy).unionByName(odd).coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return path


def same(spark, few, name):
    found = queries.queries()[name](spark, few)
    with duckdb.connect() as c:
        c.execute(f"create view embeddings as select * from '{few}/embeddings.parquet/*.parquet'")
        c.execute("set threads = 2")
        want = c.execute(f"select {', '.join(found.columns)} from ({queries.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r) for r in found.collect()), key=key)
    assert got == sorted(want, key=key)
    return got


def test_accuracy_of_every_vector(spark, few):
    assert sum(r[1] for r in same(spark, few, "accuracy_rollup") if r[0] is not None) == 29
    assert {r.label: r.n for r in queries.queries()["accuracy_rollup"](spark, DATA).collect()}[None] == 500


def test_neighbours_of_every_vector(spark, few):
    got = {r[0] for r in same(spark, few, "has_neighbour")}
    assert {110, 700} <= got and any(i % 100 for i in got)


def test_five_nearest_of_every_vector(spark, few):
    got = same(spark, few, "knn5_dtw")
    assert len(got) == 29 * 5 and (110, 1, 700, 0.0) in got and (700, 1, 110, 0.0) in got


def test_windowed_nearest_of_every_vector(spark, few):
    got = same(spark, few, "nn1_dtw_w5")
    assert len({r[0] for r in got}) == len(got) == 29 and (700, 1, 110, 0.0) in got


def test_novel_among_every_vector(spark, few):
    got = {r[0] for r in same(spark, few, "novel")}
    assert {None, 800} <= got and not {110, 700} & got and len(got) > 20


@pytest.mark.parametrize("k,radius,once", [(1, np.inf, False), (3, np.inf, False), (1, 0.4, True)])
@pytest.mark.parametrize("window", [None, 4])
@pytest.mark.parametrize("two", [False, True])
def test_both_ways_at_once(k, radius, once, window, two):
    """A pair of blocks gives what comparing every pair does, with equal series, a far one and one of 1e6."""
    rng = np.random.default_rng(3)
    z = rng.normal(0, 0.2, (160, 24)).astype(np.float32).astype(float)
    z[5] = z[9] = z[120]
    z[6] *= 4
    z[130] += 1e6
    ids, half, distance = np.arange(160) * 7, 60, Distance("dtw", {"window": window})
    d = arrow.crossed(distance, z, z)
    one, other = ({24: (ids[:half], z[:half])}, {24: (ids[half:], z[half:])}) if two else ({24: (ids, z)}, None)
    got: dict = {int(i): [] for i in ids}
    for found in search._met(distance, one, other, None, k, radius, once):
        for i, j, far in zip(*found, strict=True):
            got[int(i)].append((float(far), int(j)))
    for i in range(160):
        want = sorted((float(d[i, j]), int(ids[j])) for j in range(160) if i != j and d[i, j] <= radius and (not two or (i < half) != (j < half)))
        assert set(got[i * 7]) <= set(want) and bool(got[i * 7]) == bool(want)
        assert once or sorted(got[i * 7]) == want[:k]


def test_blocks_of_a_table_that_asks_itself(spark, monkeypatch):
    """Many blocks give what one does."""
    monkeypatch.setattr(search, "OWN_LEAST", 30)
    df = queries.vectors(spark, DATA).where("series_id < 120")
    other = df.select("*")
    d = Distance("dtw", {})
    rows = lambda found: sorted(tuple(r) for r in found.collect())
    assert rows(search.knn(df, df, d, 2)) == rows(search.knn(df, other, d, 2))
    for radius in (0.36, 0.42):
        near = rows(search.has_neighbour(df, df, d, radius).select("series_id"))
        assert near == rows(search.has_neighbour(df, other, d, radius).select("series_id")) and 0 < len(near) < 120 + (radius > 0.4)
        assert len(rows(search.novel(df, df, d, radius).select("series_id"))) == 120 - len(near)
