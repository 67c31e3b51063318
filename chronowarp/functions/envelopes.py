"""Sliding minima and maxima around a series: as arrays, and over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .columns import bind, check_window, series


def _slide(s: Column, w: int | Column, pick) -> Column:
    """``pick`` of s over i - w to i + w, by doubling: slices of growing width are combined, so that the work grows
    with the logarithm of the window and not with the window. Nothing for an empty series."""
    n = F.size(s)
    wide = w.cast("int") if isinstance(w, Column) else F.lit(min(w, 2**31 - 1))

    def whole(reach: Column) -> Column:
        nulls = lambda count: F.array_repeat(F.lit(None).cast("double"), count)
        width = 2 * reach + 1

        def grow(state: Column, _: Column) -> Column:
            by = F.least(state["have"], width - state["have"])
            x = state["x"]
            moved = F.slice(F.concat(x, nulls(by)), by + 1, F.size(x))  # ``by`` places to the left, nulls behind
            return F.struct(F.zip_with(x, moved, lambda p, q: pick(p, q)).alias("x"), (state["have"] + by).alias("have"))

        # forward windows of 2w + 1 on the series with w nulls in front are centred ones on the series
        start = F.struct(F.concat(nulls(reach), s).alias("x"), F.lit(1).alias("have"))
        rounds = F.when(width > 1, F.sequence(F.lit(1), F.ceil(F.log2(width.cast("double"))).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(rounds, start, grow, lambda state: F.slice(state["x"], 1, n))

    return F.when(n > 0, bind({"reach": F.least(wide, F.greatest(n - 1, F.lit(0)))}, whole)).otherwise(s)


def upper_envelope(s: Column | str, w: int | Column) -> Column:
    check_window(w)
    return bind({"s": series(s)}, lambda s: _slide(s, w, F.greatest))


def lower_envelope(s: Column | str, w: int | Column) -> Column:
    check_window(w)
    return bind({"s": series(s)}, lambda s: _slide(s, w, F.least))


def envelopes(s: Column | str, w: int | Column) -> Column:
    """struct(upper, lower)."""
    return F.struct(upper_envelope(s, w).alias("upper"), lower_envelope(s, w).alias("lower"))


def webb_envelopes(s: Column | str, w: int | Column) -> Column:
    """struct(upper, lower, lower_upper, upper_lower): the envelopes and the lower one of the upper, and conversely."""

    def body(e: Column) -> Column:
        return F.struct(e["upper"].alias("upper"), e["lower"].alias("lower"), lower_envelope(e["upper"], w).alias("lower_upper"), upper_envelope(e["lower"], w).alias("upper_lower"))

    return bind({"e": envelopes(s, w)}, body)


def envelope_rows(rows: DataFrame, w: int, id_col: str = "series_id", order_col: str = "i", value_col: str = "value") -> DataFrame:
    """Long form: each row with ``upper`` and ``lower`` of the 2w + 1 rows around it."""
    around = W.Window.partitionBy(id_col).orderBy(order_col).rowsBetween(-w, w)
    return rows.withColumns({"upper": F.max(value_col).over(around), "lower": F.min(value_col).over(around)})
