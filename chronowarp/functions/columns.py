"""Helpers for building expressions over arrays."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = float | int | Column


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit(x: Number) -> Column:
    """A double literal, or the column as it is."""
    return x if isinstance(x, Column) else F.lit(float(x))


def series(x: Column | str) -> Column:
    """A series as array<double>; arrays of arrays fail when the query is analysed (one variable only)."""
    return col(x).cast("array<double>")


def bind(values: dict[str, Column], body: Callable[..., Column]) -> Column:
    """``body`` over ``values`` worked out once: inside lambdas an expression would be evaluated for every element."""
    packed = F.array(F.struct(*(v.alias(k) for k, v in values.items())))
    return F.get(F.transform(packed, lambda s: body(**{k: s[k] for k in values})), F.lit(0))


def indices(n: Column) -> Column:
    """0 to n - 1, none for 0 (a bare sequence would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def total(x: Column) -> Column:
    """Sum of an array from left to right."""
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def broken(x: Column) -> Column:
    """Whether a series holds a null or NaN."""
    return F.exists(x, lambda v: v.isNull() | F.isnan(v))


def check_window(w: int | Column | None) -> None:
    if isinstance(w, int) and w < 0:
        raise ValueError("a window is None or 0 and more")


def window_or_all(w: int | Column | None, n: Column, m: Column) -> Column:
    """The window as a column, no larger than the longer series; null is no constraint."""
    check_window(w)
    longest = F.greatest(n, m)
    if w is None:
        return longest
    return F.least(F.coalesce((w if isinstance(w, Column) else F.lit(min(w, 2**31 - 1))).cast("int"), longest), longest)


def abandon(value: Column, cutoff: Number | None) -> Column:
    """Infinity where ``value`` is above a finite cutoff; None, NaN and infinite cutoffs change nothing."""
    if cutoff is None or (not isinstance(cutoff, Column) and not math.isfinite(cutoff)):
        return value
    c = lit(cutoff)
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != math.inf)
    return F.when(finite & ~F.isnan(value) & (value > c), math.inf).otherwise(value)
