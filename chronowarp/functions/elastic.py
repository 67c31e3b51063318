"""Lockstep and elastic distances between two series as Column expressions.

Shared rules: a null series gives null; a null or NaN element gives NaN; two empty series are at 0, an empty and a
non-empty one at infinity; a result above a finite cutoff is infinity, one that equals it stays; None, NaN and infinite
cutoffs do not abandon.  Windows count points; two lengths further apart than the window are at infinity.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.wavefront import Cell, wavefront
from .columns import Number, abandon, bind, broken, lit, series, total, window_or_all
from .costs import Cost, ad1, ad2, cost, msm_move, similar, twe_match, twe_warp


def _guarded(a: Column | str, b: Column | str, body: Callable[..., Column], window=None, cutoff: Number | None = None, **more: Column) -> Column:
    def whole(a: Column, b: Column, **rest: Column) -> Column:
        n, m = F.size(a), F.size(b)
        w = window_or_all(window, n, m)
        value = F.coalesce(body(a=a, b=b, w=w, **rest), F.lit(math.inf))
        return (
            F.when(a.isNull() | b.isNull(), None)
            .when(broken(a) | broken(b), math.nan)
            .when((n == 0) & (m == 0), 0.0)
            .when((n == 0) | (m == 0), math.inf)
            .when(F.abs(n - m) > w, math.inf)
            .otherwise(value)
        )

    return abandon(bind({"a": series(a), "b": series(b), **more}, whole), cutoff)


def directa(a: Column | str, b: Column | str, exponent: Number | Cost = 2, cutoff: Number | None = None) -> Column:
    """Sum of the costs of values at one place; infinite for different lengths."""
    point = cost(exponent)
    return _guarded(a, b, lambda a, b, w: F.when(F.size(a) == F.size(b), total(F.zip_with(a, b, point))), cutoff=cutoff)


def dtw(a: Column | str, b: Column | str, exponent: Number | Cost = 2, window=None, cutoff: Number | None = None) -> Column:
    """Dynamic time warping, within a window if there is one."""
    point = cost(exponent)

    def body(a: Column, b: Column, w: Column) -> Column:
        return wavefront(a, b, lambda c: point(c.a, c.b), lambda c: F.least(c.left, c.top, c.diagonal) + point(c.a, c.b), None if window is None else w)

    return _guarded(a, b, body, window, cutoff)


def dtw_path(a: Column | str, b: Column | str, exponent: Number | Cost = 2, window=None, cutoff: Number | None = None) -> Column:
    """struct(cost, max_deviation): the distance and how far its path leaves the diagonal on steps off it.  Of equal
    steps the diagonal one is taken, then the one along b. Abandoned: (infinity, null)."""
    point = cost(exponent)

    def body(a: Column, b: Column, w: Column) -> Column:
        inf = F.lit(math.inf)

        def chosen(q: Column, left: Column, top: Column, here: Column, apart: Column) -> Column:
            dq, dl, dt = (F.coalesce(x["d"], inf) for x in (q, left, top))
            made = lambda before, dev: F.struct((before["d"] + here).alias("d"), dev.alias("w"))
            off = lambda x: F.greatest(x["w"], apart)
            best = F.when((dq <= dl) & (dq <= dt), made(q, q["w"])).when(dl <= dt, made(left, off(left))).otherwise(made(top, off(top)))
            return F.when(F.least(dq, dl, dt) < inf, best)

        def step(c: Cell) -> Column:
            return bind({"q": c.diagonal, "left": c.left, "top": c.top, "here": point(c.a, c.b), "apart": F.abs(c.i - c.j)}, chosen)

        return wavefront(a, b, lambda c: F.struct(point(c.a, c.b).alias("d"), F.lit(0).alias("w")), step, w, state="struct<d:double,w:int>")

    def whole(a: Column, b: Column) -> Column:
        n, m = F.size(a), F.size(b)
        w = window_or_all(window, n, m)
        out = lambda d, dev: F.struct(d.alias("cost"), dev.cast("int").alias("max_deviation"))
        none, inf = F.lit(None), F.lit(math.inf)
        found = body(a, b, w)
        return (
            F.when(a.isNull() | b.isNull(), out(F.lit(None).cast("double"), none))
            .when(broken(a) | broken(b), out(F.lit(math.nan), none))
            .when((n == 0) & (m == 0), out(F.lit(0.0), F.lit(0)))
            .when((n == 0) | (m == 0) | (F.abs(n - m) > w), out(inf, none))
            .otherwise(out(F.coalesce(found["d"], inf), found["w"]))
        )

    found = bind({"a": series(a), "b": series(b)}, whole)
    value = abandon(found["cost"], cutoff)
    return F.struct(value.alias("cost"), F.when(value != math.inf, found["max_deviation"]).alias("max_deviation"))


def adtw(a: Column | str, b: Column | str, exponent: Number | Cost = 2, penalty: Number = 0.0, cutoff: Number | None = None) -> Column:
    """Warping with a fixed penalty for every step off the diagonal."""
    point, p = cost(exponent), lit(penalty)

    def step(c: Cell) -> Column:
        here = point(c.a, c.b)
        return F.least(c.left + here + p, c.diagonal + here, c.top + here + p)

    return _guarded(a, b, lambda a, b, w: wavefront(a, b, lambda c: point(c.a, c.b), step), cutoff=cutoff)


def wdtw(a: Column | str, b: Column | str, weights: Column | str, exponent: Number | Cost = 2, cutoff: Number | None = None) -> Column:
    """Warping with each cost weighted by how far apart the two places are; too few weights give null cells, and so
    infinity where no path avoids them."""
    point = cost(exponent)

    def body(a: Column, b: Column, w: Column, weights: Column) -> Column:
        here = lambda c: point(c.a, c.b) * F.get(weights, F.abs(c.i - c.j))
        return wavefront(a, b, here, lambda c: F.least(c.left, c.top, c.diagonal) + here(c))

    return _guarded(a, b, body, cutoff=cutoff, weights=series(weights))


def erp(a: Column | str, b: Column | str, gap_value: Number = 0.0, exponent: Number | Cost = 2, window=None, cutoff: Number | None = None) -> Column:
    """Edit distance with real penalty: what is left out is compared with the gap value."""
    point, g = cost(exponent), lit(gap_value)

    def body(a: Column, b: Column, w: Column) -> Column:
        def step(c: Cell) -> Column:
            return F.least(c.left + point(c.b, g), c.diagonal + point(c.a, c.b), c.top + point(c.a, g))

        return wavefront(a, b, lambda c: F.lit(0.0), step, None if window is None else w, border=1)

    return _guarded(a, b, body, window, cutoff)


def lcss(a: Column | str, b: Column | str, epsilon: Number, window=None, cutoff: Number | None = None) -> Column:
    """One less the share of the shorter series that the longest common subsequence covers; values less than epsilon
    apart are the same."""

    def body(a: Column, b: Column, w: Column) -> Column:
        zero = F.lit(0)

        def step(c: Cell) -> Column:
            return F.when(similar(c.a, c.b, epsilon), F.coalesce(c.diagonal, zero) + 1).otherwise(F.coalesce(F.greatest(c.left, c.top, c.diagonal), zero))

        found = wavefront(a, b, lambda c: F.when(similar(c.a, c.b, epsilon), 1).otherwise(0), step, None if window is None else w, state="int")
        return 1.0 - F.coalesce(found, zero) / F.least(F.size(a), F.size(b))

    return _guarded(a, b, body, window, cutoff)


def msm(a: Column | str, b: Column | str, price: Number, cutoff: Number | None = None) -> Column:
    """Move-split-merge."""

    def step(c: Cell) -> Column:
        return F.least(c.diagonal + ad1(c.a, c.b), c.top + msm_move(c.a, c.a1, c.b, price), c.left + msm_move(c.b, c.b1, c.a, price))

    return _guarded(a, b, lambda a, b, w: wavefront(a, b, lambda c: ad1(c.a, c.b), step), cutoff=cutoff)


def twe(a: Column | str, b: Column | str, nu: Number, penalty: Number, cutoff: Number | None = None) -> Column:
    """Time warp edit distance for time steps of one."""
    fixed = lit(nu) + lit(penalty)

    def step(c: Cell) -> Column:
        return F.least(c.left + twe_warp(c.b, c.b1, fixed), c.diagonal + twe_match(c.a, c.b, c.a1, c.b1, F.abs(c.i - c.j), nu), c.top + twe_warp(c.a, c.a1, fixed))

    return _guarded(a, b, lambda a, b, w: wavefront(a, b, lambda c: ad2(c.a, c.b), step), cutoff=cutoff)


def ddtw(a: Column | str, b: Column | str, exponent: Number | Cost = 2, window=None, cutoff: Number | None = None) -> Column:
    """Warping of the derivatives."""
    from .transforms import derive

    return dtw(derive(a), derive(b), exponent, window, cutoff)


def wddtw(a: Column | str, b: Column | str, weights: Column | str, exponent: Number | Cost = 2, cutoff: Number | None = None) -> Column:
    """Weighted warping of the derivatives."""
    from .transforms import derive

    return wdtw(derive(a), derive(b), weights, exponent, cutoff)
