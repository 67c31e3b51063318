"""The distances, bounds, envelopes and transforms as SQL functions.

``register(spark)`` adds ``ts_directa``, ``ts_dtw``, ``ts_adtw``, ``ts_wdtw``, ``ts_erp``, ``ts_lcss``, ``ts_msm`` and
``ts_twe``.  Their arguments are two series, then the distance's own in the order of ``ARGUMENTS``; rows of a batch with
equal parameters are worked on together.  Null stands for no window and no cutoff.

The others are named in ``BOUNDS`` and ``TRANSFORMS`` with their arguments.  No function of this module gives NaN:
what would be NaN is null.  Bounds: a null series, different lengths and a null or NaN element give null, empty series
0; ``ts_lb_webb`` works out its envelopes itself.  Transforms: a null argument gives null, and elements that a null or
NaN one takes part in are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import univariate
from .arrow import Distance, grouped

ARGUMENTS = {
    "directa": ("exponent", "cutoff"),
    "dtw": ("exponent", "window", "cutoff"),
    "adtw": ("exponent", "penalty", "cutoff"),
    "wdtw": ("exponent", "weights", "cutoff"),
    "erp": ("exponent", "gap_value", "window", "cutoff"),
    "lcss": ("epsilon", "window", "cutoff"),
    "msm": ("price", "cutoff"),
    "twe": ("nu", "penalty", "cutoff"),
}


def _function(name: str):
    names = ARGUMENTS[name]

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for a, b, *rest in parts:
            values = dict(zip(names, rest, strict=True))
            cutoff = values.pop("cutoff").to_numpy(dtype=np.float64)
            found = np.full(len(a), np.nan)
            keys = pd.Series([tuple(tuple(v) if isinstance(v, np.ndarray | list) else None if pd.isna(v) else float(v) for v in row) for row in zip(*values.values(), strict=True)], dtype=object)
            for key in keys.unique():
                some = np.flatnonzero(keys.map(lambda k, key=key: k == key).to_numpy(dtype=bool))
                p = {n: int(v) if n == "window" else v for n, v in zip(values, key, strict=True) if v is not None}
                found[some] = grouped(Distance(name, p), a.iloc[some].tolist(), b.iloc[some].tolist(), cutoff[some])
            yield pd.Series(found).where(a.notna().to_numpy() & b.notna().to_numpy(), None)

    return F.pandas_udf(run, T.DoubleType(), F.PandasUDFType.SCALAR_ITER)


def _enhanced(*series, e, bands, window, cutoff):
    bands = min(bands, len(series[0]) // 2)
    both = univariate.lb_enhanced if len(series) == 4 else univariate.lb_enhanced2j
    return both(*series, e, bands, window, cutoff)


def _webb(a, b, e, window, cutoff):
    return univariate.lb_webb(a, *univariate.webb_envelopes(a, window), b, *univariate.webb_envelopes(b, window), e, window, cutoff)


#: name: (how many series come first, the function of them and of the other arguments)
BOUNDS = {
    # query, upper, lower; exponent, cutoff
    "lb_keogh": (3, lambda *s, p: univariate.lb_keogh(*s, p[0], _limit(p[1]))),
    # a, its upper and lower, b, its upper and lower; exponent, cutoff
    "lb_keogh2j": (6, lambda *s, p: univariate.lb_keogh2j(*s, p[0], _limit(p[1]))),
    # a, b, the upper and lower of b; exponent, bands, window, cutoff
    "lb_enhanced": (4, lambda *s, p: _enhanced(*s, e=p[0], bands=int(p[1]), window=_width(p[2]), cutoff=_limit(p[3]))),
    # a, its upper and lower, b, its upper and lower; exponent, bands, window, cutoff
    "lb_enhanced2j": (6, lambda *s, p: _enhanced(*s, e=p[0], bands=int(p[1]), window=_width(p[2]), cutoff=_limit(p[3]))),
    # a, b; exponent, window, cutoff
    "lb_webb": (2, lambda *s, p: _webb(*s, p[0], _width(p[1]), _limit(p[2]))),
}
TRANSFORMS = {
    # values
    "derive": lambda s: univariate.derive(_numbers(s)),
    # steepness, length
    "wdtw_weights": lambda g, n: univariate.wdtw_weights(float(g), int(n)),
    # values, window
    "upper_envelope": lambda s, w: univariate.upper_envelope(_numbers(s), int(w)),
    "lower_envelope": lambda s, w: univariate.lower_envelope(_numbers(s), int(w)),
}


def _numbers(s) -> np.ndarray:
    return np.array(s, dtype=np.float64)


def _plain(values: np.ndarray) -> list[float | None]:
    return [None if v != v else v for v in values.tolist()]


def _limit(cutoff) -> float:
    return float("inf") if pd.isna(cutoff) else float(cutoff)


def _width(window) -> int | None:
    return None if pd.isna(window) else int(window)


def _bounding(name: str):
    count, work = BOUNDS[name]

    def one(row: tuple) -> float | None:
        if any(s is None for s in row[:count]) or len({len(s) for s in row[:count]}) > 1:
            return None
        s = [_numbers(x) for x in row[:count]]
        if any(np.isnan(x).any() for x in s):
            return None
        return work(*s, p=row[count:]) if len(s[0]) else 0.0

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([one(row) for row in zip(*columns, strict=True)], dtype=object)

    return F.pandas_udf(run, T.DoubleType(), F.PandasUDFType.SCALAR)


def _transforming(name: str):
    def run(*columns: pd.Series) -> pd.Series:
        missing = lambda x: x is None or (np.isscalar(x) and pd.isna(x))
        return pd.Series([None if any(map(missing, row)) else _plain(TRANSFORMS[name](*row)) for row in zip(*columns, strict=True)], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.DoubleType()), F.PandasUDFType.SCALAR)


def register(spark: SparkSession) -> list[str]:
    """Add the functions to the session and return their names."""
    made = {n: _function(n) for n in ARGUMENTS} | {n: _bounding(n) for n in BOUNDS} | {n: _transforming(n) for n in TRANSFORMS}
    for name, function in made.items():
        spark.udf.register(f"ts_{name}", function)
    return [f"ts_{name}" for name in made]
