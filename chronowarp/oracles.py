"""DuckDB SQL for the registered queries, put together from a few parts."""

from __future__ import annotations

VECTORS = "vectors as (select vec_id id, label, [x::double for x in embedding] s from embeddings)"
EVENTS = "series as (select user_id id, list(value order by ts, event_id) s from events group by user_id)"
#: Every series and the one with the next id.
NEXT = {
    "embeddings": VECTORS + ", pairs as (select x.id, 0 c, x.s a, y.s b, len(x.s) n, len(y.s) m from vectors x join vectors y on y.id = x.id + 1)",
    "events": EVENTS + ", pairs as (select x.id, 0 c, x.s a, y.s b, len(x.s) n, len(y.s) m from series x join series y on y.id = x.id + 1)",
}
#: Every vector whose id is divisible by 100 and every other vector.
SEARCH = VECTORS + ", pairs as (select x.id, y.id c, x.s a, y.s b, len(x.s) n, len(y.s) m from vectors x join vectors y on x.id % 100 = 0 and y.id <> x.id)"
#: Every vector and every other vector.
EVERY = VECTORS + ", pairs as (select x.id, y.id c, x.s a, y.s b, len(x.s) n, len(y.s) m from vectors x join vectors y on y.id <> x.id)"


def point(e: float, x: str = "A", y: str = "B") -> str:
    return f"abs({x}-{y})" if e == 1 else f"(({x}-{y})*({x}-{y}))" if e == 2 else f"pow(abs({x}-{y}), {e}e0)"


def programme(pairs: str, first: str, step: str, band: str | None = None, border: int = 0, kind: str = "double") -> str:
    """CTEs that end in ``found`` (id, c, n, m, d): the last cell. In ``first`` and ``step``: A, B values, A1, B1 those
    before, L, T, Q cells left, above and across, I and J the places."""

    def put(text: str, k: str) -> str:
        shift = 1 - border
        words = {"A1": f"a[i+{shift}-1]", "B1": f"b[{k}-i+{shift}-1]", "A": f"a[i+{shift}]", "B": f"b[{k}-i+{shift}]", "L": "one[i+1]", "T": "one[i]", "Q": "two[i]", "I": "i", "J": f"({k}-i)"}
        import re

        return re.sub(r"\b(A1|B1|A|B|L|T|Q|I|J)\b", lambda m: words[m[1]], text)

    n, m = (f"(n+{border})", f"(m+{border})") if border else ("n", "m")
    inside = f" and ({put(band, '(k+1)')})" if band else ""
    return (
        f"{pairs}, w as (select id, c, a, b, n, m, 0::bigint k, [case when i = 0 then ({put(first, '0')})::{kind} end for i in range({n})] one, [null::{kind} for i in range({n})] two from pairs"
        f" union all select id, c, a, b, n, m, k+1, [case when k+1-i between 0 and {m}-1{inside} then ({put(step, '(k+1)')})::{kind} end for i in range({n})], one from w where k < {n}+{m}-2),"
        f" found as (select id, c, n, m, one[{n}] d from w where k = {n}+{m}-2)"
    )


def _msm(c: float) -> tuple[str, str]:
    move = lambda x, x1, y: f"(case when ({x1} <= {x} and {x} <= {y}) or ({y} <= {x} and {x} <= {x1}) then {c}e0 else {c}e0 + least(abs({x}-{x1}), abs({x}-{y})) end)"
    return "abs(A-B)", f"least(Q + abs(A-B), T + {move('A', 'A1', 'B')}, L + {move('B', 'B1', 'A')})"


def _twe(nu: float, penalty: float) -> tuple[str, str]:
    fixed = f"({nu}e0+{penalty}e0)"
    return "(A-B)*(A-B)", f"least(L + ((B-B1)*(B-B1) + {fixed}), Q + (((A-B)*(A-B) + (A1-B1)*(A1-B1)) + {nu}e0*2*abs(I-J)), T + ((A-A1)*(A-A1) + {fixed}))"


def distance(pairs: str, name: str, e: float = 2, window: int | None = None, **p: float) -> str:
    """CTEs up to ``found`` for a distance; the value d may be null where no path exists."""
    band = None if window is None else f"abs(I-J) <= {window}"
    c = point(e)
    if name == "directa":
        return f"{pairs}, found as (select id, c, n, m, list_reduce([0e0] || [{c.replace('A', 'a[i]').replace('B', 'b[i]')} for i in range(1, n+1)], lambda x, y: x + y) d from pairs where n = m)"
    if name == "dtw":
        return programme(pairs, c, f"least(L, T, Q) + {c}", band)
    if name == "adtw":
        return programme(pairs, c, f"least(L + {c} + {p['penalty']}e0, Q + {c}, T + {c} + {p['penalty']}e0)")
    if name == "wdtw":
        weight = f"(1e0/(1e0+exp(-{p['g']}e0*(abs(I-J)-{p['length'] / 2}e0))))"
        return programme(pairs, f"{c}*{weight}", f"least(L, T, Q) + {c}*{weight}")
    if name == "msm":
        return programme(pairs, *_msm(p["price"]))
    if name == "twe":
        return programme(pairs, *_twe(p["nu"], p["penalty"]))
    if name == "lcss":
        same = f"abs(A-B) < {p['epsilon']}e0"
        return programme(pairs, f"case when {same} then 1 else 0 end", f"case when {same} then coalesce(Q, 0) + 1 else coalesce(greatest(L, T, Q), 0) end", band, kind="integer").replace("one[n] d from w", "1e0 - coalesce(one[n], 0)/least(n, m) d from w")
    if name == "erp":
        g = f"{p['gap_value']}e0"
        inside = None if window is None else f"abs(I-J) <= {window} or ((I = 0 or J = 0) and I+J <= {window}+1)"
        return programme(pairs, "0e0", f"least(L + {point(e, 'B', g)}, Q + {c}, T + {point(e, 'A', g)})", inside, border=1)
    raise KeyError(name)


def whole(ctes: str, select: str) -> str:
    return f"with recursive {ctes} {select}"


def derived(pairs: str) -> str:
    """The pairs with both series replaced by their derivatives."""
    slope = lambda s: f"case when len({s}) <= 2 then {s} else [(({s}[k]-{s}[k-1])+({s}[k+1]-{s}[k-1])/2)/2 for k in [least(greatest(i, 2), len({s})-1) for i in range(1, len({s})+1)]] end"
    return f"{pairs.replace('pairs as', 'raw as')}, pairs as (select id, c, {slope('a')} a, {slope('b')} b, n, m from raw)"


def around(s: str, w: int, n: str = "len(s)") -> tuple[str, str]:
    """Upper and lower envelopes of a list."""
    return tuple(f"[{f}({s}[greatest(i-{w}, 1):least(i+{w}, {n})]) for i in range(1, {n}+1)]" for f in ("list_max", "list_min"))


def bounded(pairs: str, w: int) -> str:
    """The pairs with envelopes au, al, bu, bl and Webb's alu, aul, blu, bul."""
    au, al = around("a", w, "n")
    bu, bl = around("b", w, "m")
    return (
        f"{pairs}, e as (select *, {au} au, {al} al, {bu} bu, {bl} bl from pairs), "
        f"env as (select *, {around('au', w, 'n')[1]} alu, {around('al', w, 'n')[0]} aul, {around('bu', w, 'm')[1]} blu, {around('bl', w, 'm')[0]} bul from e)"
    )


def fold(items: str) -> str:
    return f"list_reduce([0e0] || {items}, lambda x, y: x + y)"


def keogh(q: str, u: str, low: str, first: str = "1", last: str = "n") -> str:
    part = f"case when {q}[i] > {u}[i] then ({q}[i]-{u}[i])*({q}[i]-{u}[i]) when {q}[i] < {low}[i] then ({q}[i]-{low}[i])*({q}[i]-{low}[i]) else 0e0 end"
    return fold(f"[{part} for i in range({first}, {last}+1)]")


def enhanced(v: int, w: int) -> str:
    """The bands of the enhanced bound (v of 1 or more)."""
    sq = lambda x, y: f"({x}-{y})*({x}-{y})"
    left = f"list_min([least({sq('a[i+1]', 'b[j+1]')}, {sq('a[j+1]', 'b[i+1]')}) for j in range(greatest(0, i-{w}), i+1)])"
    right = f"list_min([least({sq('a[n-i]', 'b[n-j]')}, {sq('a[n-j]', 'b[n-i]')}) for j in range(greatest(0, i-{w}), i+1)])"
    return f"(-1e-14 + {sq('a[1]', 'b[1]')} + {sq('a[n]', 'b[n]')} + {fold(f'[{left}+{right} for i in range(1, {v})]')})"


def webb(pairs: str, w: int) -> str:
    """CTEs up to ``found`` (id, d): a pass over places that carries both run lengths, then the reverse part."""
    sq = lambda x, y: f"({x}-{y})*({x}-{y})"
    above = "case when a[k+1] > bu[k+1] then f when a[k+1] < bl[k+1] then case when bl[k+1] <= alu[k+1] then f+1 else 0 end else f+1 end"
    below = "case when a[k+1] > bu[k+1] then case when bu[k+1] >= aul[k+1] then g+1 else 0 end when a[k+1] < bl[k+1] then g else g+1 end"
    free = lambda runs: f"(case when j+{w} > n then j-1 >= n-{runs}[n]+{w} else {runs}[j+{w}] > {2 * w} end)"
    over = f"case when {free('fs')} then {sq('b[j]', 'au[j]')} when b[j] > bul[j] and bul[j] >= au[j] then {sq('b[j]', 'au[j]')}-{sq('bul[j]', 'au[j]')} else 0e0 end"
    under = f"case when {free('gs')} then {sq('b[j]', 'al[j]')} when b[j] < blu[j] and blu[j] <= al[j] then {sq('b[j]', 'al[j]')}-{sq('blu[j]', 'al[j]')} else 0e0 end"
    back = fold(f"[case when b[j] > au[j] then {over} when b[j] < al[j] then {under} else 0e0 end for j in range(1, n+1)]")
    return (
        f"{bounded(pairs, w)}, r as (select id, 0::bigint k, {w}::bigint f, {w}::bigint g, []::bigint[] fs, []::bigint[] gs from env"
        f" union all select r.id, k+1, {above}, {below}, list_append(fs, ({above})::bigint), list_append(gs, ({below})::bigint) from r join env using (id) where k < n),"
        f" found as (select env.id, {keogh('a', 'bu', 'bl')} + {back} d from env join r on r.id = env.id and r.k = env.n)"
    )
