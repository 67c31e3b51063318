"""Point costs: what aligning two values costs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Number, lit

Cost = Callable[[Column, Column], Column]


def ad1(a: Column, b: Column) -> Column:
    """Absolute difference."""
    return F.abs(a - b)


def ad2(a: Column, b: Column) -> Column:
    """Squared difference, as a product."""
    return (a - b) * (a - b)


def ade(exponent: Number) -> Cost:
    """Absolute difference to a power."""
    return lambda a, b: F.pow(F.abs(a - b), lit(exponent))


def cost(exponent: Number | Cost) -> Cost:
    """The cost for an exponent: the cheap forms for 1 and 2. A function of two columns is taken as it is."""
    if callable(exponent) and not isinstance(exponent, Column):
        return exponent
    if isinstance(exponent, Column):
        return ade(exponent)
    return ad1 if exponent == 1 else ad2 if exponent == 2 else ade(exponent)


def both(column: Cost, arrays: Callable) -> Callable:
    """One cost in two forms, for functions that Columns and numpy arrays do not share: it can stand for an exponent in
    the Column forms, in ``Distance`` and in searches."""
    return lambda a, b: column(a, b) if isinstance(a, Column) else arrays(a, b)


def indexed(a: Column, b: Column, point: Cost) -> Callable[[Column, Column], Column]:
    """(i, j) to the cost between a[i] and b[j]."""
    return lambda i, j: point(F.get(a, i), F.get(b, j))


def gap(s: Column, value: Number, point: Cost) -> Callable[[Column], Column]:
    """i to the cost between s[i] and the gap value."""
    return lambda i: point(F.get(s, i), lit(value))


def similar(a: Column, b: Column, epsilon: Number) -> Column:
    """Whether two values differ by less than epsilon."""
    return F.abs(a - b) < lit(epsilon)


def msm_move(new: Column, before: Column, other: Column, price: Number) -> Column:
    """Splitting or merging at ``new``: the price, and how far it lies outside of its two neighbours."""
    between = ((before <= new) & (new <= other)) | ((other <= new) & (new <= before))
    return F.when(between, lit(price)).otherwise(lit(price) + F.least(F.abs(new - before), F.abs(new - other)))


def twe_warp(new: Column, before: Column, fixed: Column) -> Column:
    """Deleting ``new`` after ``before``; ``fixed``: stiffness plus penalty."""
    return (new - before) * (new - before) + fixed


def twe_match(a: Column, b: Column, a1: Column, b1: Column, apart: Column, nu: Number) -> Column:
    """Matching a and b and the values before them, ``apart`` time steps from one another."""
    return ad2(a, b) + ad2(a1, b1) + lit(nu) * 2 * apart
