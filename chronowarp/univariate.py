"""The functions on single numpy series, outside of Spark: for trying parameters and for small data.

Arguments are one-dimensional and numeric; a window of None is no constraint; a result above ``cutoff`` is infinity.
Series that must be of one length raise ValueError when they are not, as do arrays of more dimensions.
"""

from __future__ import annotations

import math

import numpy as np

from .constants import BAND_GUARD, WDTW_MAX_WEIGHT
from .functions import arrow
from .functions.arrow import Distance, point_cost


def _series(*values, equal: bool = False) -> list[np.ndarray]:
    out = [np.ascontiguousarray(v, dtype=np.float64) for v in values]
    if any(v.ndim != 1 for v in out):
        raise ValueError("series have one dimension")
    if equal and len({len(v) for v in out}) > 1:
        raise ValueError("series must have one length")
    return out


def _window(w: int | None, n: int) -> int:
    if w is not None and w < 0:
        raise ValueError("a window is None or 0 and more")
    return n if w is None else min(int(w), n)


def _pair(name: str, s1, s2, cutoff: float, **parameters) -> float:
    a, b = _series(s1, s2)
    if parameters.get("window", 0) is not None:
        _window(parameters.get("window", 0), 0)
    limit = np.array([cutoff if math.isfinite(cutoff) else math.inf])
    return float(Distance(name, parameters).batch(a[None], b[None], limit)[0])


def _kept(value: float, cutoff: float) -> float:
    return math.inf if math.isfinite(cutoff) and value > cutoff else float(value)


def directa(s1, s2, cf_exponent: float = 2, cutoff: float = math.inf) -> float:
    return _pair("directa", s1, s2, cutoff, exponent=cf_exponent)


def dtw(s1, s2, cf_exponent: float = 2, window: int | None = None, cutoff: float = math.inf) -> float:
    return _pair("dtw", s1, s2, cutoff, exponent=cf_exponent, window=window)


def adtw(s1, s2, cf_exponent: float, penalty: float, cutoff: float = math.inf) -> float:
    return _pair("adtw", s1, s2, cutoff, exponent=cf_exponent, penalty=penalty)


def wdtw(s1, s2, cf_exponent: float, weights, cutoff: float = math.inf) -> float:
    a, b = _series(s1, s2)
    if len(weights) < max(len(a), len(b)):
        raise ValueError("a weight is needed for every place of the longer series")
    return _pair("wdtw", a, b, cutoff, exponent=cf_exponent, weights=[float(w) for w in weights])


def wdtw_weights(g: float, length: int, wmax: float = WDTW_MAX_WEIGHT) -> np.ndarray:
    return wmax / (1 + np.exp(-g * (np.arange(length) - length / 2)))


def erp(s1, s2, cf_exponent: float, gap_value: float, window: int | None = None, cutoff: float = math.inf) -> float:
    return _pair("erp", s1, s2, cutoff, exponent=cf_exponent, gap_value=gap_value, window=window)


def lcss(s1, s2, epsilon: float, window: int | None = None, cutoff: float = math.inf) -> float:
    return _pair("lcss", s1, s2, cutoff, epsilon=epsilon, window=window)


def msm(s1, s2, cost: float, cutoff: float = math.inf) -> float:
    return _pair("msm", s1, s2, cutoff, price=cost)


def twe(s1, s2, nu: float, lambda_: float, cutoff: float = math.inf) -> float:
    return _pair("twe", s1, s2, cutoff, nu=nu, penalty=lambda_)


def derive(series) -> np.ndarray:
    return arrow.derive(_series(series)[0][None])[0]


def envelopes(series, window: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(upper, lower)."""
    s = _series(series)[0]
    upper, lower = arrow.envelope(s[None], _window(window, len(s)))
    return upper[0], lower[0]


def upper_envelope(series, window: int | None) -> np.ndarray:
    return envelopes(series, window)[0]


def lower_envelope(series, window: int | None) -> np.ndarray:
    return envelopes(series, window)[1]


def webb_envelopes(series, window: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(upper, lower, lower of the upper, upper of the lower)."""
    upper, lower = envelopes(series, window)
    return upper, lower, lower_envelope(upper, window), upper_envelope(lower, window)


def _keogh(q: np.ndarray, upper: np.ndarray, lower: np.ndarray, e: float) -> float:
    return float(arrow.keogh(q[None], upper[None], lower[None], point_cost(e))[0])


def lb_keogh(query, upper, lower, cf_exponent: float = 2, cutoff: float = math.inf) -> float:
    return _kept(_keogh(*_series(query, upper, lower, equal=True), cf_exponent), cutoff)


def lb_keogh2j(s1, upper1, lower1, s2, upper2, lower2, cf_exponent: float = 2, cutoff: float = math.inf) -> float:
    a, au, al, b, bu, bl = _series(s1, upper1, lower1, s2, upper2, lower2, equal=True)
    return _kept(max(_keogh(a, bu, bl, cf_exponent), _keogh(b, au, al, cf_exponent)), cutoff)


def _bands(a: np.ndarray, b: np.ndarray, bands: int, w: int, e: float) -> float:
    point, total = point_cost(e), BAND_GUARD
    total += float(point(a[0], b[0])) + float(point(a[-1], b[-1]))
    for i in range(1, bands):
        for x, y in ((a, b), (a[::-1], b[::-1])):
            near = slice(max(0, i - w), i + 1)
            total += float(min(point(x[i], y[near]).min(), point(x[near], y[i]).min()))
    return total


def _enhanced(a: np.ndarray, b: np.ndarray, bridges: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bands: int, window: int | None, e: float, cutoff: float) -> float:
    n = len(a)
    if bands < 0 or bands > n // 2:
        raise ValueError("bands are at most half the length")
    if n == 1:
        return _kept(float(point_cost(e)(a[0], b[0])), cutoff)
    inner = slice(bands, n - bands)
    best = max(_keogh(q[inner], u[inner], low[inner], e) for q, u, low in bridges)
    return _kept(best if not bands else _bands(a, b, bands, _window(window, n), e) + best, cutoff)


def lb_enhanced(s1, s2, s2_upper, s2_lower, cf_exponent: float, nb_bands: int, window: int | None, cutoff: float = math.inf) -> float:
    a, b, u, low = _series(s1, s2, s2_upper, s2_lower, equal=True)
    return _enhanced(a, b, [(a, u, low)], nb_bands, window, cf_exponent, cutoff)


def lb_enhanced2j(s1, s1_upper, s1_lower, s2, s2_upper, s2_lower, cf_exponent: float, nb_bands: int, window: int | None, cutoff: float = math.inf) -> float:
    a, au, al, b, bu, bl = _series(s1, s1_upper, s1_lower, s2, s2_upper, s2_lower, equal=True)
    return _enhanced(a, b, [(a, bu, bl), (b, au, al)], nb_bands, window, cf_exponent, cutoff)


def _runs(counts: np.ndarray, resets: np.ndarray, start: int) -> np.ndarray:
    """Running numbers of ``counts`` since the last of ``resets``, from ``start``."""
    total = np.cumsum(counts)
    since = np.maximum.accumulate(np.where(resets, total, -1))
    return np.where(since >= 0, total - since, total + start)


def lb_webb(s1, upper1, lower1, lower_upper1, upper_lower1, s2, upper2, lower2, lower_upper2, upper_lower2, cf_exponent: float, window: int | None, cutoff: float = math.inf) -> float:
    a, au, al, alu, aul, b, bu, bl, blu, bul = _series(s1, upper1, lower1, lower_upper1, upper_lower1, s2, upper2, lower2, lower_upper2, upper_lower2, equal=True)
    n = len(a)
    if not n:
        return 0.0
    w, point = _window(window, n), point_cost(cf_exponent)
    over, under = a > bu, a < bl
    inside = ~over & ~under
    reset_above, reset_below = under & ~(bl <= alu), over & ~(bu >= aul)
    above = _runs(inside | (under & ~reset_above), reset_above, w)
    below = _runs(inside | (over & ~reset_below), reset_below, w)
    j = np.arange(n)
    seen = np.minimum(j + w, n - 1)
    late = j + w > n - 1
    free_above = np.where(late, j >= n - above[seen] + w, above[seen] > 2 * w)
    free_below = np.where(late, j >= n - below[seen] + w, below[seen] > 2 * w)
    high = np.where(free_above, point(b, au), np.where((b > bul) & (bul >= au), point(b, au) - point(bul, au), 0.0))
    low = np.where(free_below, point(b, al), np.where((b < blu) & (blu <= al), point(b, al) - point(blu, al), 0.0))
    back = np.where(b > au, high, np.where(b < al, low, 0.0)).sum()
    return _kept(_keogh(a, bu, bl, cf_exponent) + float(back), cutoff)
