"""Nearest neighbours, classification and similarity joins over series tables (series_id, label, values).

Queries and candidates are dealt to blocks by hash; each block of queries meets each block of candidates in one task.
There the likeliest candidates of every query are compared first, for a best so far. The others are sifted: all of them
advance together along the diagonals, in single precision where the series hold nothing finer, and those above the best
so far are dropped on the way. What is left, within the error of single precision, is compared in double precision.
Results do not depend on the order: ties go to the smaller id.  Memory follows the block, and the rows between the steps
are the k best of each block.

Where a table asks itself (the same DataFrame on both sides), every pair of blocks is one task, which compares a pair of
series once and gives it to both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import arrow, sieve
from ..functions.arrow import Distance

#: Rows of a block where there are few; blocks grow to the second figures as long as there are ``TASKS`` tasks.
QUERY_BLOCK, BLOCK = 64, 512
QUERIES, CANDIDATES, TASKS = 256, 4096, 256
#: The same for a table that asks itself (larger blocks for windows, which cost less), and how many blocks there are before they grow.
OWN_LEAST, OWN_BLOCK, OWN_WINDOWED, OWN_PARTS = 128, 2048, 4096, 6
#: Pairs compared in double precision at once, candidates of a query compared first, and those a bound is tried on.
BATCH, FIRST, TRIED = 4096, 16, 64
#: Slack for bounds, which add in another order than distances.
SLACK = 1 + 1e-9

Rows = dict[int, tuple[np.ndarray, np.ndarray]]


def _sizes(n: int, m: int) -> tuple[int, int]:
    """Numbers of blocks of ``n`` queries and ``m`` candidates."""
    blocks = lambda count, size: max(1, -(-count // size))
    cells = max(blocks(m, CANDIDATES), min(blocks(m, BLOCK), blocks(TASKS, blocks(n, QUERY_BLOCK))))
    return max(blocks(n, QUERIES), min(blocks(n, QUERY_BLOCK), blocks(TASKS, cells))), cells


def _blocks(queries: DataFrame, candidates: DataFrame, sides: tuple[int, int] | None) -> DataFrame:
    parts, cells = _sizes(*(sides or (queries.count(), candidates.count())))
    dealt = lambda count: F.pmod(F.xxhash64("series_id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    values = F.col("values").cast("array<double>").alias("values")
    q = queries.select(dealt(parts).alias("p"), every(cells).alias("c"), F.col("series_id").cast("long"), F.lit(True).alias("query"), values)
    c = candidates.select(every(parts).alias("p"), dealt(cells).alias("c"), F.col("series_id").cast("long"), F.lit(False).alias("query"), values)
    # few bytes, much work: not to be put together into few tasks
    return q.union(c).where("values is not null and series_id is not null").repartition(min(parts * cells, 1024), "p", "c")


def _by_length(ids: np.ndarray, values: pa.ChunkedArray) -> Rows:
    """Ids and values of the series of each length; a null value is NaN."""
    whole = values.combine_chunks()
    sizes = pc.list_value_length(whole).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(whole.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    return {int(n): (ids[at], flat[starts[at, None] + np.arange(n)].reshape(len(at), n)) for n in np.unique(sizes) for at in [np.flatnonzero(sizes == n)]}


def _bound(distance: Distance, q: np.ndarray, x: np.ndarray) -> np.ndarray | None:
    """A lower bound on the distances of one query and the rows of ``x``, or None where there is none to be had."""
    if distance.name != "dtw" or distance.parameters.get("window") is None or len(q) != x.shape[1] or not len(q) or callable(distance.parameters.get("exponent")):
        return None
    w, point = distance.parameters["window"], arrow.point_cost(distance.parameters.get("exponent", 2))
    upper, lower = arrow.envelope(q[None], w)
    return np.maximum(arrow.keogh(x, upper, lower, point), arrow.keogh(np.broadcast_to(q, x.shape), *arrow.envelope(x, w), point))


class _Found:
    """The k best of each query so far, of those within ``radius``."""

    def __init__(self, queries: int, k: int, radius: float) -> None:
        self.k, self.radius = k, radius
        self.ids, self.distances = ([np.empty(0, dtype=t) for _ in range(queries)] for t in (np.int64, np.float64))

    def limit(self, i: int) -> float:
        return min(self.radius, self.distances[i][self.k - 1]) if len(self.distances[i]) >= self.k else self.radius

    def add(self, distance: Distance, q: np.ndarray, ids: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Compares rows ``i`` of ``q`` (in rising order) with rows ``j`` of ``x`` in full."""
        for at in range(0, len(i), BATCH):
            a, b = i[at : at + BATCH], j[at : at + BATCH]
            cutoff = np.array([self.limit(r) for r in a])
            d = distance.batch(q[a], x[b], cutoff if np.isfinite(cutoff).any() else None)
            good = np.isfinite(d) & (d <= self.radius)
            a, b, d = a[good], b[good], d[good]
            for r, start in zip(*np.unique(a, return_index=True), strict=True):
                end = start + np.count_nonzero(a == r)
                some, far = np.concatenate([self.ids[r], ids[b[start:end]]]), np.concatenate([self.distances[r], d[start:end]])
                best = np.lexsort((some, far))[: self.k]
                self.ids[r], self.distances[r] = some[best], far[best]


def _sifted(distance: Distance, q: np.ndarray, x: np.ndarray, columns: np.ndarray, row: np.ndarray, skip: np.ndarray | None, k: int, limit: float, share: float) -> np.ndarray:
    """Places of the candidates that may be among the ``k`` nearest within ``limit``. ``columns`` and ``row`` are the
    candidates and the query as they are compared here, with an error of at most ``share``."""
    here = np.arange(len(x))
    if not np.isfinite(limit):
        return here if skip is None else np.setdiff1d(here, skip)
    tried = _bound(distance, q, x[:TRIED])
    if tried is not None and np.mean(tried > limit * SLACK + 1e-12) > 0.5:
        here = here[_bound(distance, q, x) <= limit * SLACK + 1e-12]
    left, estimates = [], []
    for at in range(0, len(here), arrow.together(len(q), x.shape[1])):
        some = here[at : at + arrow.together(len(q), x.shape[1])]
        most = limit * (1 + 3 * share) + (1e-30 if share else 0)
        with np.errstate(over="ignore"):
            d = arrow.places_first(distance.name, distance.parameters, row[:, None], columns if len(some) == len(x) else columns[:, some], most)
        if skip is not None:
            d[np.isin(some, skip)] = np.inf
        if k <= len(d):
            limit = min(limit, float(np.partition(d, k - 1)[k - 1]))
        near = d <= most
        left.append(some[near])
        estimates.append(d[near])
    if not left:
        return here
    return np.concatenate(left)[np.concatenate(estimates) <= limit * (1 + 3 * share) + (1e-30 if share else 0)]


def _nearest(distance: Distance, asked: Rows, known: Rows, k: int, radius: float, keep_self: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, candidate ids, distances) of the ``k`` nearest of each query."""
    for own, q in asked.values():
        found = _Found(len(q), k, radius)
        whole = np.flatnonzero(~np.isnan(q).any(axis=1))
        for ids, x in known.values():
            some = ~np.isnan(x).any(axis=1)
            ids, x = ids[some], x[some]
            if not len(x) or not len(whole):
                continue
            skips = [None if keep_self else np.flatnonzero(ids == r) for r in own]
            first = max(FIRST, k) if 2 * max(FIRST, k) < len(x) else 0
            likely, plain = [np.empty(0, dtype=np.int64)] * len(q), q.shape[1] == x.shape[1]
            for r in whole if first else ():
                far = np.abs(x - q[r]).sum(axis=1) if plain else np.zeros(len(x))
                if skips[r] is not None:
                    far[skips[r]] = np.inf
                likely[r] = np.setdiff1d(np.argpartition(far, first - 1)[:first], [] if skips[r] is None else skips[r])
            found.add(distance, q, ids, x, np.repeat(np.arange(len(q)), [len(r) for r in likely]), np.concatenate(likely))
            sifter, a, b = distance, q, x
            if distance.name in arrow.OF_SLOPES:
                sifter, a, b = Distance(arrow.OF_SLOPES[distance.name], distance.parameters), arrow.derive(q), arrow.derive(x)
            share = arrow.single(sifter, a.shape[1], b.shape[1])
            if share is not None and all(np.all(np.abs(y) < 1e12) and np.all(y.astype(np.float32) == y) for y in (a[whole], b)):
                low = np.float32
            else:
                share, low = 0.0, np.float64
            columns, rows = np.ascontiguousarray(b.T.astype(low)), a.astype(low)
            left: list[np.ndarray] = []
            waiting: list[int] = []
            for r in [*whole, None]:
                if r is not None:
                    skip = likely[r] if skips[r] is None else np.union1d(likely[r], skips[r])
                    left.append(_sifted(sifter, a[r], b, columns, rows[r], skip, k, found.limit(r), share))
                    waiting.append(r)
                if left and (r is None or sum(map(len, left)) >= 16 * BATCH):
                    found.add(distance, q, ids, x, np.repeat(waiting, [len(y) for y in left]), np.concatenate(left))
                    left, waiting = [], []
        yield np.repeat(own, [len(y) for y in found.ids]), np.concatenate(found.ids), np.concatenate(found.distances)


def _block_best(queries: DataFrame, candidates: DataFrame, distance: Distance, k: int, radius: float, keep_self: bool, sides: tuple[int, int] | None) -> DataFrame:
    """(query_id, candidate_id, distance): the k best within ``radius`` of each block."""

    def run(block: pa.Table) -> pa.Table:
        asks = block.column("query").to_numpy()
        ids = block.column("series_id").to_numpy()
        asked, known = (_by_length(ids[side], block.column("values").filter(pa.array(side))) for side in (asks, ~asks))
        parts = list(zip(*_nearest(distance, asked, known, k, radius, keep_self), strict=True)) or [[np.empty(0)]] * 3
        names, types = ["query_id", "candidate_id", "distance"], (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(np.concatenate(x).astype(t.to_pandas_dtype()), t) for x, t in zip(parts, types, strict=True)], names=names)

    return _blocks(queries, candidates, sides).groupBy("p", "c").applyInArrow(run, "query_id long, candidate_id long, distance double")


class _Own:
    """The ``k`` best of all series of a pair of blocks, where every pair counts for both. ``limit``: what is still worth
    giving to a series, below 0 where nothing is; ``last``: at equal distance only ids below this one."""

    def __init__(self, distance: Distance, ids: np.ndarray, z: np.ndarray, asks: np.ndarray, k: int, radius: float, once: bool) -> None:
        self.distance, self.ids, self.z, self.once = distance, ids, z, once
        self.found = _Found(len(ids), k, radius)
        self.limit = np.where(asks, radius, -1.0)
        self.last = np.where(asks, np.iinfo(np.int64).max, np.iinfo(np.int64).min)
        share = arrow.single(distance, z.shape[1], z.shape[1])
        self.low = z.astype(np.float32) if share is not None and np.all(np.abs(z) < 1e12) else None
        if self.low is None or not np.all(self.low == z):
            self.low, share = None, 0.0
        self.share = share

    def worth(self, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        one, two = ((self.limit[i] > 0) | (self.limit[i] == 0) & (self.ids[j] < self.last[i]) for i, j in ((a, b), (b, a)))
        return (one | two) & (self.ids[a] != self.ids[b])

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), BATCH):
            i, j = a[at : at + BATCH], b[at : at + BATCH]
            good = self.worth(i, j)
            i, j = i[good], j[good]
            most = np.maximum(self.limit[i], self.limit[j])
            if self.low is not None and np.isfinite(most).any():
                wide = most * (1 + 3 * self.share) + 1e-30
                with np.errstate(over="ignore"):
                    near = arrow.places_first(self.distance.name, self.distance.parameters, np.ascontiguousarray(self.low[i].T), np.ascontiguousarray(self.low[j].T), wide) <= wide
                i, j, most = i[near], j[near], most[near]
            d = self.distance.batch(self.z[i], self.z[j], most if np.isfinite(most).any() else None)
            self.give(np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([d, d]))

    def give(self, to: np.ndarray, other: np.ndarray, d: np.ndarray) -> None:
        good = np.isfinite(d) & (d <= self.limit[to])
        order = np.flatnonzero(good)[np.argsort(to[good], kind="stable")]
        to, other, d = to[order], other[order], d[order]
        rows, starts = np.unique(to, return_index=True)
        for r, start, end in zip(rows, starts, np.append(starts, len(to))[1:], strict=True):
            f = self.found
            some, far = np.concatenate([f.ids[r], self.ids[other[start:end]]]), np.concatenate([f.distances[r], d[start:end]])
            best = np.lexsort((some, far))[: f.k]
            f.ids[r], f.distances[r] = some[best], far[best]
            if self.once:
                self.limit[r], self.last[r] = -1.0, np.iinfo(np.int64).min
            elif len(best) >= f.k:
                self.limit[r], self.last[r] = f.limit(r), f.ids[r][-1]


def _sievable(distance: Distance, one: Rows, two: Rows | None) -> bool:
    n = {*one, *(two or one)}
    exponent = distance.parameters.get("exponent", 2)
    return distance.name == "dtw" and not callable(exponent) and exponent == 2 and len(n) == 1 and min(n) >= sieve.SHORTEST and all(np.isfinite(x).all() for side in (one, two or one) for _, x in side.values())


def _met(distance: Distance, one: Rows, two: Rows | None, asking: set[int] | None, k: int, radius: float, once: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, candidate ids, distances) of the ``k`` nearest of each series of a block among those of another, both
    ways, or among its own; with ``once`` any one of them. ``asking``: the ids that ask, None for all."""
    one, two = ({n: (ids[some], x[some]) for n, (ids, x) in side.items() for some in [~np.isnan(x).any(axis=1)] if some.any()} if side is not None else None for side in (one, two))
    asks = lambda ids: np.ones(len(ids), dtype=bool) if asking is None else np.isin(ids, list(asking))
    if not one or two is not None and not two:
        return
    plain = not _sievable(distance, one, two)
    if not plain:
        (n, (ids, x)), same = next(iter(one.items())), two is None
        if same:
            z, half, start = x, 0, len(x)
        else:
            z, half, start = np.concatenate([x, two[n][1]]), len(x), len(x)
            ids = np.concatenate([ids, two[n][0]])
        own, y = _Own(distance, ids, z, asks(ids), k, radius, once), z[half:]
        first = min(k + 4, len(y) - same, len(x) - same)
        plain = first < k and not np.isfinite(radius)
    if plain:
        for asked, known in ((one, one if two is None else two), *(() if two is None else ((two, one),))):
            some = {n: (ids[at], x[at]) for n, (ids, x) in asked.items() for at in [asks(ids)] if at.any()}
            yield from _nearest(distance, some, known, k, radius, False)
        return
    # the nearest by squared differences, which a path along the diagonal costs, are compared first
    done = np.zeros((len(x), len(y)), dtype=bool)
    for to, u, v, own_ids, ids_there in ((done, x, y, ids[:start], ids[half:]), *(() if same else ((done.T, y, x, ids[half:], ids[:start]),))):
        for at in range(0, len(u) if first > 0 else 0, 256):
            far = (v * v).sum(axis=1)[None] - 2 * (u[at : at + 256] @ v.T)
            far[own_ids[at : at + 256, None] == ids_there[None]] = np.inf
            to[np.arange(at, at + len(far))[:, None], np.argpartition(far, first - 1, axis=1)[:, :first]] = True
    if same:
        done = np.triu(done | done.T, 1)
    a, b = np.nonzero(done)
    own.compare(a, b + half)
    open_limits = own.limit[own.limit >= 0]
    if not len(open_limits):
        open_limits = np.zeros(1)
    if np.isfinite(open_limits).any():
        s = sieve.Sieve(y, float(min(open_limits.max(), 1.5 * np.median(open_limits) + 1e-12)), distance.parameters.get("window"))
        q, waiting, n = s.rounded(x), [], 0
        for r in range(len(x)):
            at = r + 1 if same else 0
            left = s.left(q[r], s.thresholds(np.maximum(own.limit[r], own.limit[half + at :])), at)
            left = left[~done[r, left]]
            waiting.append((np.full(len(left), r), left + half))
            n += len(left)
            if r == len(x) - 1 or n >= 2 * BATCH:
                own.compare(*(np.concatenate(w) for w in zip(*waiting, strict=True)))
                waiting, n = [], 0
    else:
        a, b = np.nonzero(~done if not same else np.triu(~done, 1))
        own.compare(a, b + half)
    f = own.found
    yield np.repeat(ids, [len(v) for v in f.ids]), np.concatenate(f.ids), np.concatenate(f.distances)


def _apart(tasks: int) -> list[int]:
    """Whole numbers that Spark's hash deals to ``tasks`` partitions, one each."""

    def partition(i: int) -> int:
        turn = lambda v, by: (v << by | v >> 32 - by) & 0xFFFFFFFF
        h = turn(42 ^ turn(i * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF, 13) * 5 + 0xE6546B64 & 0xFFFFFFFF
        h ^= 4
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        h ^= h >> 16
        return (h - 2**32 if h >= 2**31 else h) % tasks

    found: dict[int, int] = {}
    i = 0
    while len(found) < tasks:
        found.setdefault(partition(i), i)
        i += 1
    return list(found.values())


def _own_best(series: DataFrame, distance: Distance, k: int, radius: float, once: bool = False, sides: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, candidate_id, distance): the k best within ``radius`` of each pair of blocks of a table that asks itself;
    with ``once`` at least one row for every series that has any."""
    n = sides[0] if sides else series.count()
    size = OWN_BLOCK if distance.parameters.get("window") is None else OWN_WINDOWED
    parts = max(1, -(-n // size), min(-(-n // OWN_LEAST), OWN_PARTS))
    rows = series.where("values is not null and series_id is not null").select(F.col("series_id").cast("long").alias("id"), F.col("values").cast("array<double>").alias("values"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))

    def run(block: pa.Table) -> pa.Table:
        own, ids = block.column("own").to_numpy(), block.column("id").to_numpy()
        first, second = block.column("first")[0].as_py(), block.column("second")[0].as_py()
        sides = [_by_length(ids[side], block.column("values").filter(pa.array(side))) for side in (own == first, own == second)]
        asks = block.column("asks").to_numpy(zero_copy_only=False)
        found = list(_met(distance, sides[0], None if first == second else sides[1], None if asks.all() else set(ids[asks].tolist()), k, radius, once))
        if first == second and not asks.all():  # what a step before has found
            found.append((ids[~asks], ids[~asks], np.zeros(np.count_nonzero(~asks))))
        types = (pa.int64(), pa.int64(), pa.float64())
        parts = list(zip(*found, strict=True)) or [[np.empty(0)]] * 3
        return pa.table([pa.array(np.concatenate(x).astype(t.to_pandas_dtype()), t) for x, t in zip(parts, types, strict=True)], names=["query_id", "candidate_id", "distance"])

    def met(some: DataFrame, tasks: int) -> DataFrame:
        if tasks == parts:
            pair = F.col("first")
        else:
            pair = (F.col("first") * (2 * parts - 1 - F.col("first")) / 2).cast("int") + F.col("second")
        if tasks <= 1024:  # few tasks, much work: no two of them to one partition
            pair = F.get(F.array(*map(F.lit, _apart(tasks))), pair)
        return some.withColumn("pair", pair).repartition(min(tasks, 1024), "pair").groupBy("pair").applyInArrow(run, "query_id long, candidate_id long, distance double")

    asks = F.lit(True).alias("asks")
    if once and parts > 1:  # most find one in their own block, and do not ask the others
        alone = met(rows.select(F.col("own").alias("first"), F.col("own").alias("second"), "own", "id", "values", asks), parts)
        near = alone.select(F.col("query_id").alias("id"), F.lit(False).alias("found")).distinct()
        rows, asks = rows.join(near, "id", "left"), F.coalesce("found", F.lit(True)).alias("asks")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return met(rows.select(F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "id", "values", asks), parts * (parts + 1) // 2)


def knn(queries: DataFrame, candidates: DataFrame, distance: Distance, k: int = 1, radius: float = float("inf"), keep_self: bool = False, sides: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, rank, candidate_id, distance): the ``k`` nearest candidates within ``radius`` of each query, itself
    left out by id. Null series and null ids neither ask nor answer; NaN and infinite distances are no neighbours. ``sides``: row
    counts of both sides, if known."""
    if queries is candidates and not keep_self:
        found = _own_best(queries, distance, k, radius, sides=sides)
    else:
        found = _block_best(queries, candidates, distance, k, radius, keep_self, sides)
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy("distance", "candidate_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "candidate_id", "distance")


def nn1(queries: DataFrame, candidates: DataFrame, distance: Distance) -> DataFrame:
    """(query_id, candidate_id, distance): the nearest candidate of each query."""
    return knn(queries, candidates, distance, 1).drop("rank")


def similarity_join(queries: DataFrame, candidates: DataFrame, distance: Distance, radius: float, sides: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, candidate_id, distance) for all pairs within ``radius``."""
    return _block_best(queries, candidates, distance, 2**31 - 1, radius, False, sides)


def _near(queries: DataFrame, candidates: DataFrame, distance: Distance, radius: float) -> DataFrame:
    """(series_id): the queries with a candidate within ``radius``, some of them more than once."""
    found = _own_best(queries, distance, 1, radius, True) if queries is candidates else _block_best(queries, candidates, distance, 1, radius, False, None)
    return found.select(F.col("query_id").alias("series_id"))


def has_neighbour(queries: DataFrame, candidates: DataFrame, distance: Distance, radius: float) -> DataFrame:
    """The queries with a candidate within ``radius``."""
    near = _near(queries, candidates, distance, radius)
    return queries.join(near, "series_id", "left_semi")


def novel(queries: DataFrame, candidates: DataFrame, distance: Distance, radius: float) -> DataFrame:
    """The queries without a candidate within ``radius``."""
    near = _near(queries, candidates, distance, radius)
    return queries.join(near, "series_id", "left_anti")


def _every_pair(series: DataFrame, by: str | None, work, schema: str, types: tuple[pa.DataType, ...]) -> DataFrame:
    """``work`` over every pair of blocks of a group, the pair of a block with itself included. Series are dealt to
    blocks of some ``BLOCK`` by a hash, so that a large group is many tasks; a series goes out once for every block of
    its group. ``work`` gets the members of both blocks, the second None for a block with itself."""
    rows = series.where("values is not null").select((F.col(by) if by else F.lit(0)).alias("g"), F.col("series_id").cast("long").alias("id"), "values").where("g is not null")
    sizes = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    rows = rows.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first, second = F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second")
    names = ["g", *(f.split()[0] for f in schema.split(", "))]

    def run(block: pa.Table) -> pa.Table:
        group, own, ids = block.column("g")[0], block.column("own").to_numpy(), block.column("id").to_numpy()
        one, two = block.column("first")[0].as_py(), block.column("second")[0].as_py()
        sides = [_by_length(ids[side], block.column("values").filter(pa.array(side))) for side in (own == one, own == two)]
        parts = list(zip(*work(sides[0], None if one == two else sides[1]), strict=True)) or [[np.empty(0)]] * len(types)
        columns = [pa.array(np.concatenate(x).astype(t.to_pandas_dtype()), t) for x, t in zip(parts, types, strict=True)]
        return pa.table([pa.repeat(group, len(columns[0])), *columns], names=names)

    values = F.col("values").cast("array<double>").alias("values")
    tasks = rows.select("g", first, second, "own", "id", values)
    kind = tasks.schema["g"].dataType.simpleString()
    return tasks.groupBy("g", "first", "second").applyInArrow(run, f"g {kind}, {schema}")


def _compared(distance: Distance, one: Rows, two: Rows | None) -> Iterator[tuple[tuple[int, slice], tuple[int, slice], np.ndarray, np.ndarray]]:
    """(length and rows of ``one``, length and rows of the other, distances, whether they count) of all pairs of
    different ids, each once, some rows at a time."""
    for n, (left, x) in one.items():
        for m, (right, y) in (one if two is None else two).items():
            if two is None and m < n:
                continue
            for at in range(0, len(x), 64):
                up, across = slice(at, at + 64), slice(at if two is None and n == m else 0, len(y))
                counts = left[up, None] != right[None, across]
                if two is None and n == m:
                    counts = np.triu(counts, 1)
                yield (n, up), (m, across), arrow.crossed(distance, x[up], y[across]), counts


def distance_matrix(series: DataFrame, distance: Distance, by: str | None = None) -> DataFrame:
    """(a_id, b_id, distance), a_id below b_id, for all pairs of series, or of those with equal ``by``: the half of a
    symmetric matrix. Null series and null groups are in no pair, nor are rows of one id; NaN distances stay. As many
    rows as there are pairs: ``medoids`` sums them where they arise instead."""

    def work(one: Rows, two: Rows | None) -> Iterator[tuple]:
        for (n, up), (m, across), d, counts in _compared(distance, one, two):
            i, j = np.nonzero(counts)
            a, b = one[n][0][up][i], (one if two is None else two)[m][0][across][j]
            yield np.minimum(a, b), np.maximum(a, b), d[counts]

    return _every_pair(series, by, work, "a_id long, b_id long, distance double", (pa.int64(), pa.int64(), pa.float64())).drop("g")


def medoids(series: DataFrame, distance: Distance, by: str = "label", digits: int = 9) -> DataFrame:
    """(``by``, series_id, total): of each group the series with the least sum of distances to the others, the smaller
    id of those equal to ``digits`` places. A series alone has a total of 0. Only sums leave the tasks."""

    def work(one: Rows, two: Rows | None) -> Iterator[tuple]:
        sums = [{n: np.zeros(len(ids)) for n, (ids, _) in side.items()} for side in (one, two or {})]
        for (n, up), (m, across), d, counts in _compared(distance, one, two):
            d = np.where(counts, d, 0.0)
            sums[0][n][up] += d.sum(axis=1)
            sums[0 if two is None else 1][m][across] += d.sum(axis=0)
        for side, total in zip((one, two or {}), sums, strict=True):
            for n, (ids, _) in side.items():
                yield ids, total[n]

    sums = _every_pair(series, by, work, "id long, total double", (pa.int64(), pa.float64())).groupBy("g", "id").agg(F.round(F.sum("total"), digits).alias("total"))
    best = sums.groupBy("g").agg(F.min(F.struct("total", "id")).alias("best"))
    return best.select(F.col("g").alias(by), F.col("best.id").alias("series_id"), F.col("best.total").alias("total"))


def classify(queries: DataFrame, candidates: DataFrame, distance: Distance, k: int = 1) -> DataFrame:
    """(query_id, label, predicted, distance): most frequent label of the k nearest, the smaller one of equals; with
    the nearest distance."""
    near = knn(queries, candidates, distance, k)
    voted = near.join(candidates.select(F.col("series_id").cast("long").alias("candidate_id"), F.col("label").alias("vote")), "candidate_id")
    votes = voted.groupBy("query_id", "vote").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("d"))
    best = votes.groupBy("query_id").agg(F.max_by("vote", F.struct("n", -F.col("vote"))).alias("predicted"), F.min("d").alias("distance"))
    own = queries.select(F.col("series_id").cast("long").alias("query_id"), "label")
    return own.join(best, "query_id").select("query_id", "label", "predicted", "distance")


def accuracy(classified: DataFrame) -> DataFrame:
    """(label, n, n_right, accuracy) for each label and, with a null label, over all."""
    right = (F.col("label") == F.col("predicted")).cast("int")
    return classified.rollup("label").agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("n_right"), F.avg(right).alias("accuracy"))
