"""Dynamic programmes over two arrays as one expression: a fold over anti-diagonals.

Diagonal k holds the cells (i, k - i).  The fold keeps the last two diagonals, so a pair of series costs memory in
proportion to their length.  A null cell is out of reach; least and greatest skip nulls.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Cell:
    """What a step sees: its place, the three cells before it, the values at it and before it."""

    i: Column
    j: Column
    left: Column
    top: Column
    diagonal: Column
    a: Column
    b: Column
    a1: Column
    b1: Column


def wavefront(
    a: Column,
    b: Column,
    first: Callable[[Cell], Column],
    step: Callable[[Cell], Column],
    window: Column | None = None,
    border: int = 0,
    state: str = "double",
) -> Column:
    """The last cell. ``border`` 1 puts a row and a column before the series; ``window``: cells with |i - j| above it do
    not exist, but for those of the border up to window + 1; ``state``: type of a cell. A diagonal holds the cells that
    exist and where it begins, so that the work follows the window."""
    n, m = F.size(a) + border, F.size(b) + border
    none = F.array().cast(f"array<{state}>")

    def diagonal(acc: Column, k: Column) -> Column:
        low, high = F.greatest(F.lit(0), k - m + 1), F.least(n - 1, k)
        if window is not None:
            low = F.greatest(low, F.when(k > window + border, F.ceil((k - window) / 2).cast("int")).otherwise(0))
            high = F.least(high, F.when(k > window + border, F.floor((k + window) / 2).cast("int")).otherwise(k))

        def cell(i: Column) -> Column:
            j = k - i
            x, y = i - border, j - border
            one, two = i - acc["from_one"], i - acc["from_two"]
            here = Cell(i, j, F.get(acc["one"], one), F.get(acc["one"], one - 1), F.get(acc["two"], two - 1), F.get(a, x), F.get(b, y), F.get(a, x - 1), F.get(b, y - 1))
            return F.when(k == 0, first(here)).otherwise(step(here))

        cells = F.when(low <= high, F.transform(F.when(low <= high, F.sequence(low, high)), cell)).otherwise(none)
        return F.struct(cells.alias("one"), acc["one"].alias("two"), low.alias("from_one"), acc["from_one"].alias("from_two"))

    start = F.struct(none.alias("one"), none.alias("two"), F.lit(0).alias("from_one"), F.lit(0).alias("from_two"))
    return F.aggregate(F.sequence(F.lit(0), n + m - 2), start, diagonal, lambda acc: F.get(acc["one"], n - 1 - acc["from_one"]))
