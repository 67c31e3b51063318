"""Search plans, classification, sources, envelopes over rows, streaming, and the driver's entry."""

import random

import naive
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronowarp.functions import arrow, costs, elastic, envelopes
from chronowarp.functions.arrow import Distance, vectorised
from chronowarp.operators import search
from chronowarp.sources import series as source
from chronowarp.streaming import matching, sink

RNG = random.Random(5)


def made(spark, lengths, n=60):
    rows, x = [], 0.0
    for i in range(n):
        values = []
        for _ in range(RNG.choice(lengths)):
            x = 0.9 * x + RNG.uniform(-1, 1)
            values.append(x)
        rows.append((i, i % 4, values))
    rows.append((n, 1, rows[10][2]))
    return rows, spark.createDataFrame(rows + [(n + 1, 0, None)], "series_id long, label int, values array<double>").repartition(3)


@pytest.mark.parametrize(
    "distance,plain,lengths",
    [
        (Distance("dtw", {"window": 3}), lambda a, b: naive.dtw(a, b, 2, 3), [16]),
        (Distance("dtw", {}), naive.dtw, [12, 15, 18]),
        (Distance("msm", {"price": 0.1}), lambda a, b: naive.msm(a, b, 0.1), [12]),
        (Distance("lcss", {"epsilon": 0.3}), lambda a, b: naive.lcss(a, b, 0.3), [10, 14]),
        (Distance("erp", {"gap_value": 0.0, "window": 4}), lambda a, b: naive.erp(a, b, 0.0, 2, 4), [12, 14]),
    ],
)
def test_nearest(spark, monkeypatch, distance, plain, lengths):
    monkeypatch.setattr(search, "BLOCK", 16)
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(search, "BATCH", 8)
    rows, df = made(spark, lengths)
    asked = df.where(F.col("series_id") % 3 == 0)
    got: dict = {}
    for r in search.knn(asked, df, distance, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.candidate_id, r.distance))
    for i, _, a in rows:
        if i % 3 == 0:
            every = sorted((d, j) for j, _, b in rows if j != i and (d := plain(a, b)) < naive.INF)[:3]
            mine = sorted(got.get(i, []))
            assert [m[1] for m in mine] == [j for _, j in every]
            assert [m[2] for m in mine] == pytest.approx([d for d, _ in every])


@pytest.mark.parametrize(
    "distance",
    [
        Distance("dtw", {}),
        Distance("dtw", {"window": 3}),
        Distance("dtw", {"exponent": costs.both(lambda a, b: F.least((a - b) * (a - b), F.lit(0.5)), lambda a, b: np.minimum((a - b) * (a - b), 0.5))}),
        Distance("adtw", {"penalty": 0.1}),
        Distance("wdtw", {"weights": [0.1 + i / 40 for i in range(20)]}),
        Distance("erp", {"gap_value": 0.01}),
        Distance("lcss", {"epsilon": 0.2}),
        Distance("msm", {"price": 0.1}),
        Distance("twe", {"nu": 0.01, "penalty": 0.05}),
    ],
)
@pytest.mark.parametrize("exact", [True, False])
def test_few_compared_in_full(monkeypatch, distance, exact):
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.normal(size=(300, 20)), np.full((1, 20), np.nan)])
    x[150] = x[0]
    x = x.astype(np.float32).astype(np.float64) if exact else x
    ids, whole, full = np.arange(301), distance.batch, []
    want = {}
    for i in (0, 1, 2):
        d = whole(np.repeat(x[i : i + 1], 300, axis=0), x[:300])
        want[i] = sorted((float(d[j]), j) for j in range(300) if j != i)[:3]
    assert all((d == whole(x[i : i + 1], x[j : j + 1])[0]) for i in want for d, j in want[i])
    monkeypatch.setattr(Distance, "batch", lambda self, a, b, cutoff=None: full.append(len(a)) or arrow._batch(self.name, self.parameters, a, b, cutoff))
    ((asked, found, far),) = search._nearest(distance, {20: (ids[:3], x[:3])}, {20: (ids, x)}, 3, float("inf"), False)
    got = {i: [(float(d), int(j)) for q, j, d in zip(asked, found, far, strict=True) if q == i] for i in (0, 1, 2)}
    assert got == want
    assert sum(full) < 3 * 300 / 2
    assert np.array_equal(arrow.crossed(distance, x[:7], x[290:]), np.array([whole(np.repeat(x[i : i + 1], 11, axis=0), x[290:]) for i in range(7)]), equal_nan=True)


def test_joins_and_votes(spark):
    rows, df = made(spark, [12])
    asked, d, radius = df.where("series_id % 3 = 0"), Distance("dtw", {"window": 2}), 2.0
    pairs = {(i, j) for i, _, a in rows for j, _, b in rows if i % 3 == 0 and i != j and naive.dtw(a, b, 2, 2) <= radius}
    assert {(r.query_id, r.candidate_id) for r in search.similarity_join(asked, df, d, radius).collect()} == pairs
    near = {r.series_id for r in search.has_neighbour(asked, df, d, radius).collect()}
    far = {r.series_id for r in search.novel(asked, df, d, radius).collect()}
    assert near == {i for i, _ in pairs} and near | far == {r.series_id for r in asked.collect()} and not near & far
    voted = search.classify(asked, df, d, 1).collect()
    assert len(voted) == sum(i % 3 == 0 for i, _, _ in rows)
    report = {r.label: r for r in search.accuracy(search.classify(asked, df, d, 1)).collect()}
    assert report[None].n == len(voted) and report[None].n_right == sum(v.label == v.predicted for v in voted)


@pytest.mark.parametrize("lengths", [[9], [7, 10]])
def test_matrix_and_medoids(spark, monkeypatch, lengths):
    monkeypatch.setattr(search, "BLOCK", 4)  # a group of fifteen is four blocks
    rows, df = made(spark, lengths)
    df = df.union(spark.sql("select 900L, cast(null as int), array(1D) union all select 901L, 77, array(1D, 2D) union all select 902L, 78, cast(null as array<double>)"))
    d = Distance("dtw", {})
    want = {(i, j): naive.dtw(a, b) for i, x, a in rows for j, y, b in rows if x == y and i < j}
    got = search.distance_matrix(df, d, "label").collect()
    assert len(got) == len(want) and {(r.a_id, r.b_id): r.distance for r in got} == pytest.approx(want)
    assert search.distance_matrix(df.where("series_id < 12"), d).count() == 66
    totals = {i: sum(v for k, v in want.items() if i in k) for i, _, _ in rows}
    best = {label: min((round(totals[i], 9), i) for i, x, _ in rows if x == label) for label in range(4)}
    found = {r.label: (r.total, r.series_id) for r in search.medoids(df, d).collect()}
    assert found == {**{k: (pytest.approx(t), i) for k, (t, i) in best.items()}, 77: (0.0, 901)}
    assert search.medoids(df.limit(0), d).count() == 0
    twice = search.distance_matrix(df.where("series_id < 2").union(df.where("series_id < 2")), d).collect()
    assert {(r.a_id, r.b_id) for r in twice} == {(0, 1)} and len(twice) == 4  # rows of one id are not compared


def test_own_costs(spark):
    steep = costs.both(lambda a, b: F.least(F.abs(a - b), F.lit(0.5)), lambda a, b: np.minimum(np.abs(a - b), 0.5))
    rows, df = made(spark, [10])
    rows = [r for r in rows if r[0] < 8]
    df = df.where("series_id < 8")
    pairs = df.select("series_id", F.col("values").alias("a")).join(df.select((F.col("series_id") - 1).alias("series_id"), F.col("values").alias("b")), "series_id")
    for distance in (Distance("dtw", {"exponent": steep, "window": 3}), Distance("erp", {"exponent": steep, "gap_value": 0.1})):
        for r in pairs.select("a", "b", distance.column("a", "b").alias("x"), vectorised(distance)("a", "b").alias("y")).collect():
            assert r.x == r.y
        near = {r.query_id: (r.candidate_id, r.distance) for r in search.nn1(df, df, distance).collect()}
        for i, _, a in rows:
            assert near[i] == min(((float(distance.batch([a], [b])[0]), j) for j, _, b in rows if j != i))[::-1]


def test_series_as_text(spark, tmp_path):
    rows = [(1, 3, [0.1, 1e300, -2.5e-7]), (2, -4, [1.0, None, float("nan")]), (3, 5, [])]
    df = spark.createDataFrame(rows, "series_id long, label int, values array<double>")
    source.write_ucr(df, f"{tmp_path}/x")
    got = {r.label: r["values"] for r in source.read_ucr(spark, f"{tmp_path}/x").collect()}
    assert got[3] == rows[0][2] and got[5] == [] and got[-4][0] == 1.0 and all(v != v for v in got[-4][1:])
    with pytest.raises(Exception, match="label"):
        source.write_ucr(spark.sql("select 1L series_id, cast(null as int) label, array(1D) values"), f"{tmp_path}/y")


def test_sources(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("# comment\n1\t0.5\t1e2\t-3\n2,1,?,2\n\n@x\n3 7\n")
    rows = {r.label: r["values"] for r in source.read_ucr(spark, str(path)).collect()}
    assert rows[1] == [0.5, 100.0, -3.0] and rows[2][1] != rows[2][1] and rows[3] == [7.0]
    long = spark.createDataFrame([(1, 2, 5.0), (1, 1, 4.0), (2, 1, None)], "id int, t int, v double")
    got = {r.series_id: r["values"] for r in source.from_long(long, "id", ["t"], "v").collect()}
    assert got == {1: [4.0, 5.0], 2: [None]}
    again = source.to_long(source.from_long(long, "id", ["t"], "v")).collect()
    assert {(r.series_id, r.i, r.value) for r in again} == {(1, 0, 4.0), (1, 1, 5.0), (2, 0, None)}
    days = spark.sql("select 'a' k, timestamp'2024-01-01 10:00' t, 1D v union all select 'b', timestamp'2024-01-03 01:00', 2D")
    assert {r.series_id: r["values"] for r in source.calendar(days, "k", F.col("t"), F.col("v")).collect()} == {"a": [1.0, 0.0, 0.0], "b": [0.0, 0.0, 2.0]}


def test_envelope_rows(spark):
    s = [RNG.uniform(0, 9) for _ in range(20)]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(s)], "series_id int, i int, value double")
    got = sorted((r.i, r.upper, r.lower) for r in envelopes.envelope_rows(rows, 3).collect())
    assert [g[1] for g in got] == naive.envelope(s, 3, max) and [g[2] for g in got] == naive.envelope(s, 3, min)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.sql("select id event_id, id % 5 user_id, timestamp'2024-01-01 00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 7 as int)) ts, cast(id % 13 as double) value from range(2000)")
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    distance, templates = Distance("dtw", {}), [(1, [1.0, 2.0]), (2, [9.0, 3.0, 1.0])]
    whole = lambda df: matching.matched(matching.windowed_series(df, "user_id", "ts", "event_id", "value", "6 hours", late="30 days"), templates, distance)
    batch = {(r.series_id, r.window_start): (r["values"], r.template_id, r.distance) for r in whole(events).collect()}
    # a last event far ahead moves the watermark past every window
    spark.sql("select 99999 event_id, 0 user_id, timestamp'2025-01-01 00:00' ts, 0D value").select(*events.columns).write.mode("append").parquet(f"{tmp_path}/events")
    got = {(r.series_id, r.window_start): (r["values"], r.template_id, r.distance) for r in sink.run_to_end(whole(stream), "test-stream").collect()}
    assert batch and got == batch
    held = matching.sessions(events, "user_id", "ts", "event_id", "value", "1 hour").collect()
    assert sum(len(r["values"]) for r in held) == 2000


def test_paths_in_bulk(spark):
    from chronowarp import queries

    found = queries.queries()["dtw_path"](spark, "/root/testdata/sf0.001")
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    rows = queries.next_pairs(queries.vectors(spark, "/root/testdata/sf0.001")).where("id < 20").select("id", elastic.dtw_path("a", "b").alias("p")).collect()
    got = {r.id: (r.distance, r.max_deviation) for r in found.where("id < 20").collect()}
    assert got == {r.id: (r.p.cost, r.p.max_deviation) for r in rows} and len(got) == 20


def test_entry(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 80
    frame = entry.entry(spark)
    assert frame.columns == ["query_id", "rank", "candidate_id", "distance"] and frame.count() == 5
