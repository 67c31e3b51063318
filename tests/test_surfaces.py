"""The functions outside of Spark and those in SQL agree with the Column forms."""

import math
import random
import subprocess
import sys
from pathlib import Path

import naive
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronowarp import univariate as u
from chronowarp.functions import bounds, elastic, envelopes
from chronowarp.functions.sql import register

RNG = random.Random(31)


def series(n):
    return [RNG.uniform(-3, 3) for _ in range(n)]


def test_outside_of_spark(spark):
    rows = [(series(n), series(n)) for n in (1, 2, 5, 17, 30) for _ in range(2)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    w = 3
    e = df.select("a", "b", envelopes.webb_envelopes("a", w).alias("ea"), envelopes.webb_envelopes("b", w).alias("eb"))
    got = e.select(
        "a",
        "b",
        bounds.lb_enhanced("a", "b", "eb.upper", "eb.lower", 2, w).alias("e"),
        bounds.lb_enhanced2j("a", "ea.upper", "ea.lower", "b", "eb.upper", "eb.lower", 2, w).alias("ej"),
        bounds.lb_webb("a", F.col("ea"), "b", F.col("eb"), w).alias("w"),
        bounds.lb_keogh2j("a", "ea.upper", "ea.lower", "b", "eb.upper", "eb.lower").alias("k"),
    ).collect()
    for r in got:
        a, b = r.a, r.b
        ea, eb = u.webb_envelopes(a, w), u.webb_envelopes(b, w)
        v = min(2, len(a) // 2)
        assert u.lb_enhanced(a, b, eb[0], eb[1], 2, v, w) == pytest.approx(r.e)
        assert u.lb_enhanced2j(a, *ea[:2], b, *eb[:2], 2, v, w) == pytest.approx(r.ej)
        assert u.lb_webb(a, *ea, b, *eb, 2, w) == pytest.approx(r.w)
        assert u.lb_keogh2j(a, *ea[:2], b, *eb[:2]) == pytest.approx(r.k)
        assert u.dtw(a, b) == pytest.approx(naive.dtw(a, b)) and u.directa(a, b) == pytest.approx(naive.directa(a, b))
        assert u.erp(a, b, 2, 0.5, 3) == pytest.approx(naive.erp(a, b, 0.5, 2, 3)) and u.lcss(a, b, 0.5, 2) == pytest.approx(naive.lcss(a, b, 0.5, 2))
        assert u.msm(a, b, 0.1) == pytest.approx(naive.msm(a, b, 0.1)) and u.twe(a, b, 0.1, 0.2) == pytest.approx(naive.twe(a, b, 0.1, 0.2))
        weights = u.wdtw_weights(0.1, 30)
        assert u.wdtw(a, b, 2, weights) == pytest.approx(naive.dtw(a, b, weights=weights.tolist())) and u.adtw(a, b, 2, 0.1) == pytest.approx(naive.dtw(a, b, p=0.1))
        assert u.derive(a) == pytest.approx(naive.derive(a)) and list(u.upper_envelope(a, w)) == naive.envelope(a, w, max)
        d = u.dtw(a, b)
        assert u.dtw(a, b, cutoff=d) == d and (d == 0 or u.dtw(a, b, cutoff=d * 0.99) == math.inf)


def test_what_is_refused():
    with pytest.raises(ValueError):
        u.dtw(np.zeros((2, 2)), [1.0])
    with pytest.raises(ValueError):
        u.lb_keogh([1.0], [1.0, 2.0], [1.0])
    with pytest.raises(ValueError):
        u.lb_enhanced([1.0, 2.0], [1.0, 2.0], [2.0, 2.0], [1.0, 1.0], 2, 2, None)
    with pytest.raises(ValueError):
        u.wdtw([1.0, 2.0], [1.0, 2.0], 2, [1.0])
    with pytest.raises(ValueError):
        u.dtw([1.0], [2.0], window=-1)


def test_sql(spark):
    names = register(spark)
    assert len(names) == 17
    rows = [(i, series(n), series(m)) for i, (n, m) in enumerate([(4, 4), (5, 7), (0, 3)])] + [(3, None, [1.0])]
    spark.createDataFrame(rows, "i int, a array<double>, b array<double>").createOrReplaceTempView("sql_pairs")
    got = spark.sql("select i, ts_dtw(a, b, 2, null, null) d, ts_dtw(a, b, 1, if(i = 0, 1, null), null) w, ts_msm(a, b, 0.5, 1e9) m, ts_wdtw(a, b, 2, array(1D, 2D, 3D, 4D, 5D, 6D, 7D), null) g, ts_lcss(a, b, 0.5, null, null) l from sql_pairs")
    forms = spark.table("sql_pairs").select("i", elastic.dtw("a", "b").alias("d"), elastic.dtw("a", "b", 1, window=F.when(F.col("i") == 0, 1)).alias("w"), elastic.msm("a", "b", 0.5).alias("m"), elastic.wdtw("a", "b", F.array(*(F.lit(float(x)) for x in range(1, 8)))).alias("g"), elastic.lcss("a", "b", 0.5).alias("l"))
    want = {r.i: r for r in forms.collect()}
    for r in got.collect():
        for c in "dwmgl":
            assert r[c] == want[r.i][c] or r[c] == pytest.approx(want[r.i][c])


def test_sql_bounds_and_transforms(spark):
    register(spark)
    w = 2
    rows = [(0, series(9), series(9)), (1, series(1), series(1)), (2, [], []), (3, None, [1.0]), (4, series(3), series(4)), (5, [1.0, math.nan], [1.0, 2.0]), (6, [1.0, None], [1.0, 2.0])]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>")
    df.select("*", envelopes.webb_envelopes("a", w).alias("ea"), envelopes.webb_envelopes("b", w).alias("eb")).createOrReplaceTempView("sql_bounds")
    got = spark.sql(
        "select i, ts_lb_keogh(a, eb.upper, eb.lower, 2, null) k, ts_lb_keogh2j(a, ea.upper, ea.lower, b, eb.upper, eb.lower, 2, 0.5D) j, ts_lb_enhanced(a, b, eb.upper, eb.lower, 2, 2, 2, null) e,"
        " ts_lb_enhanced2j(a, ea.upper, ea.lower, b, eb.upper, eb.lower, 1.5D, 2, 2, null) f, ts_lb_webb(a, b, 2, 2, null) w, ts_derive(a) d, ts_upper_envelope(b, 2) u, ts_lower_envelope(b, 2) l, ts_wdtw_weights(0.05D, size(b)) g from sql_bounds order by i"
    ).collect()
    forms = spark.table("sql_bounds").select(
        "i",
        bounds.lb_keogh("a", "eb.upper", "eb.lower").alias("k"),
        bounds.lb_keogh2j("a", "ea.upper", "ea.lower", "b", "eb.upper", "eb.lower", cutoff=0.5).alias("j"),
        bounds.lb_enhanced("a", "b", "eb.upper", "eb.lower", 2, w).alias("e"),
        bounds.lb_enhanced2j("a", "ea.upper", "ea.lower", "b", "eb.upper", "eb.lower", 2, w, 1.5).alias("f"),
        bounds.lb_webb("a", F.col("ea"), "b", F.col("eb"), w).alias("w"),
    ).orderBy("i").collect()
    for r, want in zip(got, forms, strict=True):
        for c in "kjefw":
            assert r[c] is None if want[c] is None or want[c] != want[c] else r[c] == pytest.approx(want[c]), (r.i, c)
    assert got[0].d == pytest.approx(naive.derive(rows[0][1])) and got[0].u == naive.envelope(rows[0][2], w, max) and got[0].l == naive.envelope(rows[0][2], w, min)
    assert got[2].d == [] and got[2].u == [] and got[3].d is None and len(got[0].g) == 9
    assert got[5].d == [1.0, None] and got[6].d == [1.0, None]


def test_registry_without_a_session():
    """The driver reads the registry before any session exists."""
    root = Path(__file__).resolve().parent.parent
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
