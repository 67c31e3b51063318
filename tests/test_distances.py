"""Column and Arrow forms against full matrices, edge rules, relations, bounds."""

import math
import random

import naive
import pytest
from pyspark.sql import functions as F

from chronowarp.functions import bounds, elastic, envelopes, transforms
from chronowarp.functions.arrow import Distance, vectorised, vectorised_path

RNG = random.Random(11)


def series(n):
    return [RNG.uniform(-10, 10) for _ in range(n)]


LENGTHS = [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5), (7, 7), (12, 12), (9, 12), (12, 8), (20, 20)]
PAIRS = [(series(n), series(m)) for n, m in LENGTHS for _ in range(2)]
W40 = naive.weights(0.1, 40)

CASES = {
    "directa_1": (Distance("directa", {"exponent": 1}), lambda a, b: naive.directa(a, b, 1)),
    "directa_2": (Distance("directa", {}), lambda a, b: naive.directa(a, b)),
    "directa_3": (Distance("directa", {"exponent": 3}), lambda a, b: naive.directa(a, b, 3)),
    "dtw": (Distance("dtw", {}), naive.dtw),
    "dtw_1": (Distance("dtw", {"exponent": 1}), lambda a, b: naive.dtw(a, b, 1)),
    "dtw_1.5": (Distance("dtw", {"exponent": 1.5}), lambda a, b: naive.dtw(a, b, 1.5)),
    "dtw_w0": (Distance("dtw", {"window": 0}), lambda a, b: naive.dtw(a, b, 2, 0)),
    "dtw_w3": (Distance("dtw", {"window": 3}), lambda a, b: naive.dtw(a, b, 2, 3)),
    "dtw_w50": (Distance("dtw", {"window": 50}), lambda a, b: naive.dtw(a, b, 2, 50)),
    "adtw": (Distance("adtw", {"penalty": 4.0}), lambda a, b: naive.dtw(a, b, p=4.0)),
    "wdtw": (Distance("wdtw", {"weights": W40}), lambda a, b: naive.dtw(a, b, weights=W40)),
    "erp": (Distance("erp", {"gap_value": 0.5}), lambda a, b: naive.erp(a, b, 0.5)),
    "erp_w0": (Distance("erp", {"window": 0}), lambda a, b: naive.erp(a, b, 0.0, 2, 0)),
    "erp_w3": (Distance("erp", {"gap_value": 1.0, "window": 3}), lambda a, b: naive.erp(a, b, 1.0, 2, 3)),
    "lcss": (Distance("lcss", {"epsilon": 2.0}), lambda a, b: naive.lcss(a, b, 2.0)),
    "lcss_w3": (Distance("lcss", {"epsilon": 2.0, "window": 3}), lambda a, b: naive.lcss(a, b, 2.0, 3)),
    "msm": (Distance("msm", {"price": 0.5}), lambda a, b: naive.msm(a, b, 0.5)),
    "twe": (Distance("twe", {"nu": 0.01, "penalty": 0.1}), lambda a, b: naive.twe(a, b, 0.01, 0.1)),
    "ddtw": (Distance("ddtw", {}), lambda a, b: naive.dtw(naive.derive(a), naive.derive(b))),
    "wddtw": (Distance("wddtw", {"weights": W40}), lambda a, b: naive.dtw(naive.derive(a), naive.derive(b), weights=W40)),
}


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(PAIRS)]
    return spark.createDataFrame(rows, "i int, a array<double>, b array<double>").repartition(4).cache()


def close(x, y):
    return (math.isinf(x) and math.isinf(y)) or x == pytest.approx(y, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("name", CASES)
def test_both_forms(pairs, name):
    distance, plain = CASES[name]
    found = pairs.select("i", distance.column("a", "b").alias("x"), vectorised(distance)("a", "b").alias("y")).collect()
    for r in found:
        want = plain(*PAIRS[r.i])
        assert close(r.x, want) and close(r.y, want), (r, want, PAIRS[r.i])


def test_symmetry_and_identity(pairs):
    for name in ("dtw", "adtw", "wdtw", "erp", "lcss", "msm", "twe"):
        d = CASES[name][0]
        for r in pairs.select(d.column("a", "b").alias("x"), d.column("b", "a").alias("y"), d.column("a", "a").alias("z")).collect():
            assert close(r.x, r.y) and r.z == 0


def test_cutoff_nulls_and_nan(spark):
    df = spark.sql("select array(1D,2D,3D) a, array(2D,4D,6D) b, array(1D,null,3D) c, array(1D,double('NaN')) n, cast(null as array<double>) z")
    full = df.select(elastic.dtw("a", "b")).first()[0]
    for cut, want in ((full - 1e-9, math.inf), (full, full), (full + 1, full), (None, full), (math.inf, full), (-math.inf, full), (math.nan, full)):
        d = Distance("dtw", {})
        r = df.select(elastic.dtw("a", "b", cutoff=cut).alias("x"), vectorised(d)("a", "b", cut).alias("y")).first()
        assert r.x == want and r.y == want, cut
    r = df.select(elastic.dtw("a", "c"), elastic.dtw("n", "a"), elastic.dtw("a", "z"), elastic.lcss("a", "c", 1), elastic.directa("z", "z")).first()
    assert math.isnan(r[0]) and math.isnan(r[1]) and r[2] is None and math.isnan(r[3]) and r[4] is None
    with pytest.raises(ValueError):
        elastic.dtw("a", "b", window=-1)
    with pytest.raises(Exception):
        spark.sql("select array(array(1D)) a").select(elastic.dtw("a", "a")).collect()


def test_path(pairs):
    found = pairs.select("i", elastic.dtw_path("a", "b").alias("p"), elastic.dtw_path("a", "b", cutoff=0.0).alias("q"), vectorised_path()("a", "b").alias("v"), elastic.dtw_path("a", "b", window=4).alias("w"), vectorised_path(2, 4)("a", "b").alias("x")).collect()
    for r in found:
        a, b = PAIRS[r.i]
        want = naive.dtw(a, b)
        assert close(r.p.cost, want) and close(r.v.cost, want) and r.v.max_deviation == r.p.max_deviation
        assert close(r.w.cost, r.x.cost) and r.w.max_deviation == r.x.max_deviation
        if math.isinf(want):
            assert r.p.max_deviation is None
        else:
            assert close(naive.dtw(a, b, 2, r.p.max_deviation), want)
        assert r.q.max_deviation is None if r.q.cost == math.inf else r.q.cost == 0


def test_relations(spark):
    rows = [(series(24), series(24)) for _ in range(10)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    r = df.select(
        elastic.directa("a", "b").alias("lock"),
        elastic.dtw("a", "b", window=0).alias("w0"),
        elastic.dtw("a", "b", window=3).alias("w3"),
        elastic.dtw("a", "b").alias("full"),
        elastic.adtw("a", "b", penalty=0.0).alias("p0"),
        elastic.adtw("a", "b", penalty=math.inf).alias("pinf"),
        elastic.lcss("a", "b", 2.0).alias("l"),
        elastic.msm("a", "b", 0.1).alias("m1"),
        elastic.msm("a", "b", 1.0).alias("m2"),
        elastic.twe("a", "b", 0.01, 0.001).alias("t1"),
        elastic.twe("a", "b", 0.01, 0.005).alias("t2"),
    )
    for x in r.collect():
        assert close(x.lock, x.w0) and x.w0 >= x.w3 >= x.full and close(x.p0, x.full) and close(x.pinf, x.lock)
        assert 0 <= x.l <= 1 and x.m1 <= x.m2 and x.t1 <= x.t2


def test_transforms(spark):
    rows = [(i, series(n)) for i, n in enumerate((0, 1, 2, 3, 10))]
    for r in spark.createDataFrame(rows, "i int, s array<double>").select("i", transforms.derive("s").alias("d")).collect():
        assert r.d == pytest.approx(naive.derive(rows[r.i][1]))
    r = spark.range(1).select(transforms.wdtw_weights(0.1, 46).alias("w"), transforms.wdtw_weights(0.1, 0).alias("e"), transforms.wdtw_weights(0.01, 5, 2.0).alias("t")).first()
    assert r.w == pytest.approx(naive.weights(0.1, 46)) and r.e == [] and r.t == pytest.approx(naive.weights(0.01, 5, 2.0))


def test_envelopes_and_bounds(spark):
    rows = [(i, series(n), series(n)) for i, n in enumerate((0, 1, 2, 3, 9, 16, 31)) for _ in range(3)]
    rows = [(k, a, b) for k, (_, a, b) in enumerate(rows)]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>").cache()
    for w in (0, 1, 2, 5, 40, 1000):
        e = df.select("i", "a", "b", envelopes.webb_envelopes("a", w).alias("ea"), envelopes.webb_envelopes("b", w).alias("eb"))
        e = e.select("*", envelopes.upper_envelope("a", F.lit(w)).alias("u2"), elastic.dtw("a", "b", window=w).alias("d"))
        r = e.select(
            "*",
            bounds.lb_keogh("a", "eb.upper", "eb.lower").alias("k1"),
            bounds.lb_keogh("b", "ea.upper", "ea.lower").alias("k2"),
            bounds.lb_keogh2j("a", "ea.upper", "ea.lower", "b", "eb.upper", "eb.lower").alias("k"),
            *(bounds.lb_enhanced("a", "b", "eb.upper", "eb.lower", v, w).alias(f"e{v}") for v in (0, 1, 2, 5)),
            bounds.lb_enhanced2j("a", "ea.upper", "ea.lower", "b", "eb.upper", "eb.lower", 3, w).alias("ej"),
            bounds.lb_webb("a", F.col("ea"), "b", F.col("eb"), w).alias("webb"),
        ).collect()
        for x in r:
            u, low = naive.envelope(x.a, w, max), naive.envelope(x.a, w, min)
            assert x.ea.upper == u and x.ea.lower == low and x.u2 == u
            assert x.ea.lower_upper == naive.envelope(u, w, min) and x.ea.upper_lower == naive.envelope(low, w, max)
            assert x.k1 == pytest.approx(naive.keogh(x.a, x.eb.upper, x.eb.lower)) and x.k == pytest.approx(max(x.k1, x.k2))
            limit = x.d * (1 + 1e-9) + 1e-9
            for name in ("k", "e0", "e1", "e2", "e5", "ej", "webb"):
                assert x[name] <= limit, (name, w, x)
            assert x.e0 == pytest.approx(x.k1) and x.webb >= x.k1 - 1e-9




def test_known_values(spark):
    a = [0.0, 1.0, 2.0, 3.0, 2.0]
    b = [0.0, 0.0, 1.0, 2.0, 3.0]
    r = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(elastic.dtw("a", "b"), elastic.directa("a", "b"), elastic.erp(F.array(F.lit(-1.0)), F.array(F.lit(1.0)), 0.0, window=0), elastic.lcss("a", "a", 0.0)).first()
    assert (r[0], r[1], r[2], r[3]) == (1.0, 4.0, 2.0, 1.0)
