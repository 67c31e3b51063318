"""Lower bounds of windowed time warping between series of one length.

Null series give null; a null or NaN element NaN; empty series 0; different lengths are an error in the data and give
null.  Cutoffs work as for the distances.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BAND_GUARD
from .columns import Number, abandon, bind, broken, series, total, window_or_all
from .costs import Cost, cost

#: Places whose running numbers are worked out together.
_CHUNK = 32


def _outside(q: Column, upper: Column, lower: Column, point: Cost) -> Column:
    return F.when(q > upper, point(q, upper)).when(q < lower, point(q, lower)).otherwise(0.0)


def _keogh(q: Column, upper: Column, lower: Column, point: Cost) -> Column:
    both = F.zip_with(upper, lower, lambda u, l: F.struct(u.alias("u"), l.alias("l")))
    return total(F.zip_with(q, both, lambda x, e: _outside(x, e["u"], e["l"], point)))


def _guarded(parts: dict[str, Column | str], body, cutoff: Number | None, watched: tuple[str, ...]) -> Column:
    def whole(**p: Column) -> Column:
        nulls, wrong, lengths = F.lit(False), F.lit(False), F.lit(True)
        first = p[watched[0]]
        for x in p.values():
            nulls = nulls | x.isNull()
            lengths = lengths & (F.size(x) == F.size(first))
        for name in watched:
            wrong = wrong | broken(p[name])
        return F.when(nulls | ~lengths, None).when(wrong, math.nan).when(F.size(first) == 0, 0.0).otherwise(body(**p))

    return abandon(bind({k: series(v) for k, v in parts.items()}, whole), cutoff)


def lb_keogh(query: Column | str, upper: Column | str, lower: Column | str, exponent: Number | Cost = 2, cutoff: Number | None = None) -> Column:
    """Costs of what lies outside of the other series' envelope."""
    point = cost(exponent)
    return _guarded({"q": query, "u": upper, "l": lower}, lambda q, u, l: _keogh(q, u, l, point), cutoff, ("q",))


def lb_keogh2j(a: Column | str, a_upper: Column | str, a_lower: Column | str, b: Column | str, b_upper: Column | str, b_lower: Column | str, exponent: Number | Cost = 2, cutoff: Number | None = None) -> Column:
    """The larger of the bounds both ways."""
    return F.greatest(lb_keogh(a, b_upper, b_lower, exponent, cutoff), lb_keogh(b, a_upper, a_lower, exponent, cutoff))


def _bands(a: Column, b: Column, v: Column, w: Column, point: Cost) -> Column:
    """Ends, and for each of the outer places the cheapest cell of its elbow, from both ends."""
    n = F.size(a)
    at = lambda s, i: F.get(s, i)

    def elbow(i: Column) -> Column:
        near = F.greatest(F.lit(0), i - w)
        back = n - 1 - i
        reach = F.sequence(near, i)
        left = F.array_min(F.transform(reach, lambda j: F.least(point(at(a, i), at(b, j)), point(at(a, j), at(b, i)))))
        right = F.array_min(F.transform(reach, lambda j: F.least(point(at(a, back), at(b, n - 1 - j)), point(at(a, n - 1 - j), at(b, back)))))
        return left + right

    ends = F.lit(BAND_GUARD) + point(at(a, F.lit(0)), at(b, F.lit(0))) + point(at(a, n - 1), at(b, n - 1))
    outer = F.when(v >= 2, F.aggregate(F.when(v >= 2, F.sequence(F.lit(1), v - 1)), F.lit(0.0), lambda s, i: s + elbow(i))).otherwise(0.0)
    return ends + outer


def _bridge(q: Column, upper: Column, lower: Column, v: Column, point: Cost) -> Column:
    inner = lambda s: F.slice(s, v + 1, F.greatest(F.size(s) - 2 * v, F.lit(0)))
    return _keogh(inner(q), inner(upper), inner(lower), point)


def _count(bands: int | Column, n: Column) -> Column:
    if isinstance(bands, int) and bands < 0:
        raise ValueError("the number of bands is 0 or more")
    return F.least((bands if isinstance(bands, Column) else F.lit(bands)).cast("int"), F.floor(n / 2).cast("int"))


def lb_enhanced(a: Column | str, b: Column | str, b_upper: Column | str, b_lower: Column | str, bands: int | Column, window=None, exponent: Number | Cost = 2, cutoff: Number | None = None) -> Column:
    """Elbow bands at both ends and Keogh's bound between them. No bands: Keogh's bound."""
    point = cost(exponent)

    def body(a: Column, b: Column, u: Column, l: Column) -> Column:
        n = F.size(a)
        v = _count(bands, n)
        plain = _keogh(a, u, l, point)
        return F.when(n == 1, point(F.get(a, F.lit(0)), F.get(b, F.lit(0)))).when(v == 0, plain).otherwise(_bands(a, b, v, window_or_all(window, n, n), point) + _bridge(a, u, l, v, point))

    return _guarded({"a": a, "b": b, "u": b_upper, "l": b_lower}, body, cutoff, ("a", "b"))


def lb_enhanced2j(a: Column | str, a_upper: Column | str, a_lower: Column | str, b: Column | str, b_upper: Column | str, b_lower: Column | str, bands: int | Column, window=None, exponent: Number | Cost = 2, cutoff: Number | None = None) -> Column:
    """Shared bands, and the larger of the bridges both ways."""
    point = cost(exponent)

    def body(a: Column, au: Column, al: Column, b: Column, bu: Column, bl: Column) -> Column:
        n = F.size(a)
        v = _count(bands, n)
        plain = F.greatest(_keogh(a, bu, bl, point), _keogh(b, au, al, point))
        bridges = F.greatest(_bridge(a, bu, bl, v, point), _bridge(b, au, al, v, point))
        return F.when(n == 1, point(F.get(a, F.lit(0)), F.get(b, F.lit(0)))).when(v == 0, plain).otherwise(_bands(a, b, v, window_or_all(window, n, n), point) + bridges)

    return _guarded({"a": a, "au": a_upper, "al": a_lower, "b": b, "bu": b_upper, "bl": b_lower}, body, cutoff, ("a", "b"))


def lb_webb(
    a: Column | str,
    a_envelopes: dict[str, Column | str] | Column,
    b: Column | str,
    b_envelopes: dict[str, Column | str] | Column,
    window: int | Column,
    exponent: Number | Cost = 2,
    cutoff: Number | None = None,
) -> Column:
    """Keogh's bound of a in b's envelope, and what of Keogh's bound of b in a's envelope it does not count already.

    ``a_envelopes`` and ``b_envelopes`` hold upper, lower, lower_upper and upper_lower.  A place of b counts in full
    where the run of places of a that leave that side free is longer than two windows; otherwise only what lies beyond
    b's own inner envelope counts.
    """
    point = cost(exponent)

    def body(a: Column, au: Column, al: Column, alu: Column, aul: Column, b: Column, bu: Column, bl: Column, blu: Column, bul: Column) -> Column:
        n = F.size(a)
        w = window_or_all(window, n, n)
        places = F.sequence(F.lit(0), n - 1)

        def since(counted, broken) -> Column:
            """Running numbers of ``counted`` places since the last ``broken`` one, from w. Sums over chunks come first,
            then those within: an accumulator is copied at every step, and so is kept short."""
            chunk = lambda c: F.sequence(c * _CHUNK, F.least(c * _CHUNK + _CHUNK, n) - 1)
            after = lambda state, i: F.when(broken(i), 0).otherwise(state + F.when(counted(i), 1).otherwise(0))
            chunks = F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int"))

            def ends(starts: Column, c: Column) -> Column:
                return F.concat(starts, F.array(F.aggregate(chunk(c), F.element_at(starts, -1), after)))

            def given(starts: Column) -> Column:
                grown = lambda c: F.slice(F.aggregate(chunk(c), F.array(F.get(starts, c)), lambda runs, i: F.concat(runs, F.array(after(F.element_at(runs, -1), i)))), 2, _CHUNK)
                return F.flatten(F.transform(chunks, grown))

            return bind({"starts": F.aggregate(chunks, F.array(w), ends)}, given)

        over, under = (lambda i: F.get(a, i) > F.get(bu, i)), (lambda i: F.get(a, i) < F.get(bl, i))
        low_fits, high_fits = (lambda i: F.get(bl, i) <= F.get(alu, i)), (lambda i: F.get(bu, i) >= F.get(aul, i))
        free = F.struct(
            since(lambda i: ~over(i), lambda i: ~over(i) & under(i) & ~low_fits(i)).alias("above"),
            since(lambda i: over(i) | ~under(i), lambda i: over(i) & ~high_fits(i)).alias("below"),
        )

        def reverse(runs: Column) -> Column:
            def extra(j: Column) -> Column:
                y, up, low = F.get(b, j), F.get(au, j), F.get(al, j)
                seen = lambda side: F.get(runs[side], F.least(j + w, n - 1))  # when the window around j has been passed
                late = j + w > n - 1
                is_free = lambda side: F.when(late, j >= n - seen(side) + w).otherwise(seen(side) > 2 * w)
                inner_low, inner_up = F.get(bul, j), F.get(blu, j)
                over = F.when(is_free("above"), point(y, up)).when((y > inner_low) & (inner_low >= up), point(y, up) - point(inner_low, up)).otherwise(0.0)
                under = F.when(is_free("below"), point(y, low)).when((y < inner_up) & (inner_up <= low), point(y, low) - point(inner_up, low)).otherwise(0.0)
                return F.when(y > up, over).when(y < low, under).otherwise(0.0)

            return total(F.transform(places, extra))

        return _keogh(a, bu, bl, point) + bind({"runs": free}, reverse)

    parts: dict[str, Column | str] = {"a": a, "b": b}
    for name, e in (("a", a_envelopes), ("b", b_envelopes)):
        parts |= {f"{name}u": e["upper"], f"{name}l": e["lower"], f"{name}lu": e["lower_upper"], f"{name}ul": e["upper_lower"]}
    return _guarded(parts, body, cutoff, ("a", "b"))
