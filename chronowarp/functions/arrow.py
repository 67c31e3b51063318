"""The distances in numpy for bulk work: all pairs of a batch advance together, diagonal by diagonal.

Values agree with the Column forms: same recurrences, same order of additions.  A cutoff drops pairs from the batch
once two successive diagonals lie above it wholly, as no path can come below it again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import series

Point = Callable[[np.ndarray, np.ndarray], np.ndarray]


def point_cost(exponent: float | Point) -> Point:
    """The cost for an exponent; a function of two arrays is taken as it is."""
    if callable(exponent):
        return exponent
    if exponent == 1:
        return lambda a, b: np.abs(a - b)
    if exponent == 2:
        return lambda a, b: (a - b) * (a - b)
    return lambda a, b: np.abs(a - b) ** exponent


@dataclass(frozen=True)
class Distance:
    """A distance by name with its parameters, for both forms."""

    name: str
    parameters: dict = field(default_factory=dict)

    def column(self, a: Column | str, b: Column | str, cutoff=None) -> Column:
        from . import elastic

        p = dict(self.parameters)
        if "weights" in p:
            p["weights"] = F.array(*(F.lit(float(w)) for w in p["weights"]))
        return getattr(elastic, self.name)(a, b, **p, cutoff=cutoff)

    def batch(self, a: np.ndarray, b: np.ndarray, cutoff: np.ndarray | None = None) -> np.ndarray:
        """Distances of the rows of ``a`` (pairs, n) and ``b`` (pairs, m)."""
        return _batch(self.name, self.parameters, np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64), cutoff)


def derive(x: np.ndarray) -> np.ndarray:
    if x.shape[1] <= 2:
        return x
    inner = ((x[:, 1:-1] - x[:, :-2]) + (x[:, 2:] - x[:, :-2]) / 2) / 2
    return np.concatenate([inner[:, :1], inner, inner[:, -1:]], axis=1)


def envelope(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower envelopes of the rows, by doubling."""
    n = x.shape[1]
    w = min(w, max(n - 1, 0))
    out = []
    for op, fill in ((np.maximum, -np.inf), (np.minimum, np.inf)):
        pad = np.full((len(x), w), fill)
        y, have = np.concatenate([pad, x, pad], axis=1), 1
        while have < 2 * w + 1:
            by = min(have, 2 * w + 1 - have)
            y = op(y[:, : y.shape[1] - by], y[:, by:])
            have += by
        out.append(y)
    return out[0], out[1]


def keogh(q: np.ndarray, upper: np.ndarray, lower: np.ndarray, point: Point) -> np.ndarray:
    return np.where(q > upper, point(q, upper), np.where(q < lower, point(q, lower), 0.0)).sum(axis=1)


#: Distances that are others of the slopes.
OF_SLOPES = {"ddtw": "dtw", "wddtw": "wdtw"}


def _batch(name: str, p: dict, a: np.ndarray, b: np.ndarray, cutoff: np.ndarray | None) -> np.ndarray:
    if name in OF_SLOPES:
        return _batch(OF_SLOPES[name], p, derive(a), derive(b), cutoff)
    (pairs, n), m = a.shape, b.shape[1]
    out = np.empty(pairs)
    some = together(n, m)
    for at in range(0, pairs, some):
        part = slice(at, at + some)
        wrong = np.isnan(a[part]).any(axis=1) | np.isnan(b[part]).any(axis=1)
        x, y, limit = np.ascontiguousarray(a[part].T), np.ascontiguousarray(b[part].T), None if cutoff is None else cutoff[part]
        out[part] = np.where(wrong, np.nan, places_first(name, p, x, y, limit))
    if cutoff is not None:
        out = np.where(np.isfinite(cutoff) & (out > cutoff), np.inf, out)
    return out


def together(n: int, m: int) -> int:
    """How many pairs of these lengths go together: the diagonals of a batch keep to some megabytes."""
    return max(16, min(4096, 2**20 // max(n + m, 1)))


def crossed(distance: Distance, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of every row of ``a`` (rows, n) and every row of ``b`` (rows, m): the values of ``batch``."""
    a, b = np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)
    if distance.name in OF_SLOPES:
        return crossed(Distance(OF_SLOPES[distance.name], distance.parameters), derive(a), derive(b))
    out = np.empty((len(a), len(b)))
    wide = max(1, min(len(b), together(a.shape[1], b.shape[1])))
    high = max(1, 2 * together(a.shape[1], b.shape[1]) // wide)
    left, right = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for at in range(0, len(b), wide):
        y = np.ascontiguousarray(right[:, None, at : at + wide])
        for up in range(0, len(a), high):
            out[up : up + high, at : at + wide] = places_first(distance.name, distance.parameters, left[:, up : up + high, None], y, None)
    out[np.isnan(a).any(axis=1)] = np.nan
    out[:, np.isnan(b).any(axis=1)] = np.nan
    return out


def places_first(name: str, p: dict, a: np.ndarray, b: np.ndarray, cutoff: np.ndarray | float | None) -> np.ndarray:
    """Distances of series that lie along the first axis; the other axes broadcast. Those above their cutoff may come
    out as infinity (with two axes at most). NaN is not looked for, nor are slopes taken. Single precision gives estimates, see ``single``."""
    n, m = len(a), len(b)
    shape = np.broadcast_shapes(a.shape[1:], b.shape[1:])
    w = p.get("window")
    if n == 0 or m == 0 or (w is not None and abs(n - m) > w) or (name == "directa" and n != m):
        return np.full(shape, 0.0 if n == m == 0 else np.inf)
    point = point_cost(p.get("exponent", 2))
    if name == "directa":
        out = np.zeros(shape, a.dtype)
        for x, y in zip(a, b, strict=True):
            out += point(x, y)
        return out
    return _diagonals(name, p, a, b, point, max(n, m) if w is None else min(w, max(n, m)), cutoff)


def single(distance: Distance, n: int, m: int) -> float | None:
    """By what share single precision may miss a distance of series that it holds exactly, or None where that is not
    known. Every cost is a difference of two such values or worked out beforehand, and none is negative."""
    p = distance.parameters
    plain = all(np.all((np.abs(v) < 1e12) & (np.asarray(v) >= 0)) for k, v in p.items() if k in ("penalty", "price", "nu", "weights"))
    if distance.name not in ("directa", "dtw", "adtw", "wdtw", "erp", "msm", "twe") or p.get("exponent", 2) not in (1, 2) or not plain:
        return None
    return 8 * (n + m + 16) * 2.0**-24


def _sides(name: str, p: dict, a: np.ndarray, b: np.ndarray, point: Point) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What a step needs of each side: the values and what depends on one series alone."""
    sides = []
    for x in (a, b):
        wide, before = x.astype(np.float64), np.concatenate([x[:1], x[:-1]]).astype(np.float64)
        if name == "erp":
            more = [point(wide, p.get("gap_value", 0.0))]
        elif name == "msm":
            more = [np.where(before == wide, 0.0, before - wide)]
        elif name == "twe":
            more = [(wide - before) * (wide - before) + (p["nu"] + p["penalty"])]
        else:
            more = []
        sides.append([x, *(y.astype(x.dtype) for y in more)])
    return sides[0], sides[1]


def _diagonals(name: str, p: dict, a: np.ndarray, b: np.ndarray, point: Point, w: int, cutoff: np.ndarray | float | None) -> np.ndarray:
    """All pairs advance together. Cell (i, j) lies at j - i, whose last value is that of two diagonals before, so that
    a diagonal overwrites the one before the last; cells out of reach are never written."""
    border, most = name == "erp", name == "lcss"
    n, m = len(a), len(b)
    shape = np.broadcast_shapes(a.shape[1:], b.shape[1:])
    low, high = min(n - 1 + border, w + border), min(m - 1 + border, w + border)
    c = low + 1
    # a similarity counts in whole numbers: a cell out of reach is as good as 0
    cells = np.full((low + high + 3, *shape), 0 if most else np.inf, (np.int16 if min(n, m) < 2**15 else np.int32) if most else a.dtype)
    buffers = [np.empty((min(n, m, w + 1), *shape), a.dtype) for _ in range(4 if name == "msm" else 2)]
    if name == "twe":
        buffers.append(np.zeros_like(cells))
    apart = np.abs(np.arange(len(cells)) - c)
    column = lambda x: x.astype(a.dtype).reshape(-1, *(1,) * len(shape))
    if name == "wdtw":
        weights = np.asarray(p["weights"], dtype=np.float64)
        far = column(np.where(apart < len(weights), np.append(weights, np.inf)[np.minimum(apart, len(weights))], np.inf))
    elif name == "twe":
        far = column(p["nu"] * 2 * apart)
    else:
        far = None
    one, two = _sides(name, p, a, b, point)
    one = [x[::-1] for x in one]  # so that places of both grow along a diagonal
    alive = result = None
    if cutoff is not None and not most and len(shape) == 1:
        cutoff = np.broadcast_to(np.where(np.isnan(cutoff), np.inf, cutoff), shape)
        alive, result = np.arange(shape[0]), np.full(shape, np.inf, a.dtype)
    if border:
        cells[c] = 0
        cells[c - 1], cells[c + 1] = one[1][n - 1], two[1][0]
    for k in range(n + m - 1):
        lo, hi = max(0, k - m + 1, -((w - k) // 2)), min(n, k + 1, (k + w) // 2 + 1)
        if border and k == w + 1:  # the border ends before the window does
            cells[[x for x in (c - w - 1, c + w + 1) if 0 <= x < len(cells)]] = np.inf
        if hi > lo:
            at = slice(k - 2 * (hi - 1) + c, k - 2 * lo + c + 1, 2)
            _step(name, p, k, at, cells, [x[n - hi : n - lo] for x in one], [y[k - hi + 1 : k - lo + 1] for y in two], point, far, buffers)
        if border and k + 2 <= min(m, w + 1):
            np.add(cells[c + k + 1], two[1][k + 1], out=cells[c + k + 2])
        if border and k + 2 <= min(n, w + 1):
            np.add(cells[c - k - 1], one[1][n - k - 2], out=cells[c - k - 2])
        if alive is not None and k % 16 == 15 and hi > lo and k < n + m - 2:
            stay = ~(cells[max(0, at.start - 2) : at.stop + 2].min(axis=0) > cutoff)
            if not stay.any():
                return result
            if np.count_nonzero(stay) < 0.6 * len(stay):
                stay = np.flatnonzero(stay)
                alive, cutoff, cells = alive[stay], cutoff[stay], cells.take(stay, axis=1)
                one, two = ([x.take(stay, axis=1) if x.shape[1] > 1 else x for x in side] for side in (one, two))
                buffers = [x.take(stay, axis=1) if name == "twe" and x is buffers[2] else np.empty((len(x), len(stay)), x.dtype) for x in buffers]
    last = cells[m - n + c]
    if most:
        last = 1.0 - last.astype(np.float64) / min(n, m)
    if alive is None:
        return last
    result[alive] = last
    return result


def _step(name: str, p: dict, k: int, at: slice, cells: np.ndarray, one: list[np.ndarray], two: list[np.ndarray], point: Point, far: np.ndarray | None, buffers: list[np.ndarray]) -> None:
    """The cells of diagonal ``k`` from those before, in place."""
    x, y, now = one[0], two[0], cells[at]
    left, top = cells[at.start - 1 : at.stop - 1 : 2], cells[at.start + 1 : at.stop + 1 : 2]
    here, spare = (z[: len(now)] for z in buffers[:2])
    if name in ("lcss", "msm", "twe") or not callable(p.get("exponent", 2)) and p.get("exponent", 2) in (1, 2):
        np.subtract(x, y, out=here)
        if name == "lcss":
            np.abs(here, out=here)
        elif name == "twe" or name != "msm" and p.get("exponent", 2) == 2:
            np.multiply(here, here, out=here)
        elif name != "msm":
            np.abs(here, out=here)
    else:
        here[...] = point(x, y)
    if name == "lcss":
        # cells beside one are at most one more than the one before both
        np.add(now, here < p["epsilon"], out=now)
        np.maximum(now, left, out=now)
        np.maximum(now, top, out=now)
        return
    if name == "wdtw":
        np.multiply(here, far[at], out=here)
    if name == "erp":
        np.add(now, here, out=now)
        for before, gap in ((left, two[1]), (top, one[1])):
            np.minimum(now, np.add(before, gap, out=spare), out=now)
    elif name == "twe":
        last = buffers[2][at]
        np.add(here, last, out=spare)
        last[...] = here
        if k == 0:
            now[...] = here
            return
        spare += far[at]
        np.add(now, spare, out=now)
        for before, warp in ((left, two[1]), (top, one[1])):
            np.minimum(now, np.add(before, warp, out=spare), out=now)
    elif name == "msm":
        if k == 0:
            now[...] = np.abs(here)
            return
        np.add(now, np.abs(here, out=spare), out=now)
        high, low = (z[: len(now)] for z in buffers[2:])
        for before, back in ((left, two[1]), (top, one[1])):
            # nothing where a value lies between the two others, else the way to the nearer one
            if before is top:
                np.negative(here, out=here)
            np.maximum(back, here, out=high)
            np.minimum(back, here, out=low)
            np.negative(high, out=high)
            np.maximum(low, high, out=low)
            np.maximum(low, 0, out=low)
            low += p["price"]
            np.minimum(now, np.add(before, low, out=low), out=now)
    elif k == 0:
        now[...] = here
    elif name == "adtw":
        np.minimum(left, top, out=spare)
        spare += here
        spare += p["penalty"]
        np.add(now, here, out=now)
        np.minimum(now, spare, out=now)
    else:
        np.minimum(now, left, out=now)
        np.minimum(now, top, out=now)
        np.add(now, here, out=now)


def grouped(distance: Distance, left: list, right: list, cutoff: np.ndarray | None = None) -> np.ndarray:
    """Distances of pairs of any lengths: those of one pair of lengths go together. None: null becomes NaN."""
    out = np.full(len(left), np.nan)
    by: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if x is not None and y is not None:
            by.setdefault((len(x), len(y)), []).append(i)
    for (n, m), rows in by.items():
        for at in range(0, len(rows), 4096):
            some = rows[at : at + 4096]
            x = np.array([left[i] for i in some], dtype=np.float64).reshape(len(some), n)
            y = np.array([right[i] for i in some], dtype=np.float64).reshape(len(some), m)
            out[some] = distance.batch(x, y, None if cutoff is None else cutoff[some])
    return out


def vectorised(distance: Distance) -> Callable[..., Column]:
    """``distance`` as an Arrow function of two series, and a cutoff if wanted (null: none)."""

    @F.pandas_udf(T.DoubleType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b, c in parts:
            found = grouped(distance, a.tolist(), b.tolist(), c.to_numpy(dtype=np.float64))
            yield pd.Series(found).where(a.notna().to_numpy() & b.notna().to_numpy() & ~np.isnan(found), None) if len(a) else pd.Series(dtype=float)

    def call(a: Column | str, b: Column | str, cutoff: Column | float | None = None) -> Column:
        limit = cutoff if isinstance(cutoff, Column) else F.lit(None if cutoff is None else float(cutoff)).cast("double")
        a, b = series(a), series(b)
        wrong = F.exists(a, lambda v: v.isNull() | F.isnan(v)) | F.exists(b, lambda v: v.isNull() | F.isnan(v))
        return F.when(a.isNotNull() & b.isNotNull() & wrong, float("nan")).otherwise(run(a, b, limit))

    return call


def path_batch(a: np.ndarray, b: np.ndarray, exponent: float = 2, window: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Warping distances of the rows and how far their paths leave the diagonal on steps off it (-1: no path). Of equal
    steps the diagonal one is taken, then the one along b."""
    (pairs, n), m, point = a.shape, b.shape[1], point_cost(exponent)
    if n == 0 or m == 0:
        return np.full(pairs, 0.0 if n == m else np.inf), np.full(pairs, 0 if n == m else -1)
    w = max(n, m) if window is None else window
    d_two = d_one = np.full((pairs, n + 1), np.inf)
    w_two = w_one = np.zeros((pairs, n + 1), dtype=np.int64)
    for k in range(n + m - 1):
        i = np.arange(max(0, k - m + 1), min(n - 1, k) + 1)
        i = i[np.abs(2 * i - k) <= w]
        j = k - i
        d_now, w_now = np.full((pairs, n + 1), np.inf), np.zeros((pairs, n + 1), dtype=np.int64)
        if len(i):
            here = point(a[:, i], b[:, j])
            if k == 0:
                d_now[:, 1:2] = here
            else:
                across, left, top = d_two[:, i], d_one[:, i + 1], d_one[:, i]
                straight, along = (across <= left) & (across <= top), left <= top
                d_now[:, i + 1] = np.where(straight, across, np.where(along, left, top)) + here
                off = np.maximum(np.where(along, w_one[:, i + 1], w_one[:, i]), np.abs(i - j))
                w_now[:, i + 1] = np.where(straight, w_two[:, i], off)
        d_two, d_one, w_two, w_one = d_one, d_now, w_one, w_now
    cost = d_one[:, n]
    wrong = np.isnan(a).any(axis=1) | np.isnan(b).any(axis=1)
    return np.where(wrong, np.nan, cost), np.where(np.isfinite(cost) & ~wrong, w_one[:, n], -1)


def vectorised_path(exponent: float = 2, window: int | None = None) -> Callable[..., Column]:
    """``elastic.dtw_path`` as an Arrow function of two series: struct(cost, max_deviation)."""

    @F.pandas_udf(T.StructType([T.StructField("cost", T.DoubleType()), T.StructField("max_deviation", T.IntegerType())]))
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in parts:
            cost, far = np.full(len(a), np.nan), np.full(len(a), -1)
            by: dict[tuple[int, int], list[int]] = {}
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                if x is not None and y is not None:
                    by.setdefault((len(x), len(y)), []).append(i)
            for (n, m), rows in by.items():
                for at in range(0, len(rows), 2048):
                    some = rows[at : at + 2048]
                    x, y = (np.array([s.iloc[i] for i in some], dtype=np.float64).reshape(len(some), k) for s, k in ((a, n), (b, m)))
                    cost[some], far[some] = path_batch(x, y, exponent, window)
            missing = a.isna().to_numpy() | b.isna().to_numpy()
            yield pd.DataFrame({"cost": pd.Series(cost).where(~missing, None), "max_deviation": pd.Series(far, dtype="Int32").where(far >= 0)})

    return lambda a, b: run(series(a), series(b))
