"""Derivative and logistic weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import WDTW_MAX_WEIGHT
from .columns import Number, bind, indices, lit, series


def derive(s: Column | str) -> Column:
    """Slope at each place: mean of the step before it and half of the step across it; the ends take their
    neighbours' slope; two values or fewer stay as they are."""

    def body(s: Column) -> Column:
        n = F.size(s)

        def slope(i: Column) -> Column:
            k = F.least(F.greatest(i, F.lit(1)), n - 2)
            before, here, after = F.get(s, k - 1), F.get(s, k), F.get(s, k + 1)
            return ((here - before) + (after - before) / 2) / 2

        return F.when(s.isNull(), None).when(n <= 2, s).otherwise(F.transform(F.when(n > 2, F.sequence(F.lit(0), n - 1)), slope))

    return bind({"s": series(s)}, body)


def compute_weight(g: Number, half: Number, i: Column, wmax: Number = WDTW_MAX_WEIGHT) -> Column:
    """Logistic weight of a distance i in time: steepness g, midpoint ``half``."""
    return lit(wmax) / (F.lit(1.0) + F.exp(-lit(g) * (i - lit(half))))


def wdtw_weights(g: Number, length: int | Column, wmax: Number = WDTW_MAX_WEIGHT) -> Column:
    """Weights for the distances 0 to length - 1, with the midpoint at half the length."""
    n = (length if isinstance(length, Column) else F.lit(length)).cast("int")
    return F.transform(indices(n), lambda i: compute_weight(g, n / 2, i.cast("double"), wmax))
