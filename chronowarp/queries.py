"""Registered queries over the test tables and the SQL that gives the same rows.

Distances are taken between every series and the one with the next id; searches ask with every vector whose id is
divisible by 100, among all vectors. In ``accuracy_rollup``,
``has_neighbour``, ``novel``, ``knn5_dtw`` and ``nn1_dtw_w5`` every vector asks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles as sql
from .functions import bounds, costs, elastic, envelopes, transforms
from .functions import sql as sql_names
from .functions.arrow import Distance, vectorised, vectorised_path
from .operators import search
from .sources import series as source
from .streaming import matching

WINDOW, LENGTH, G = 5, 64, 0.05
LONGEST = 128
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.from_array(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.from_long(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


def next_pairs(series: DataFrame) -> DataFrame:
    """(id, a, b): every series and the one with the next id."""
    other = series.select((F.col("series_id") - 1).alias("id"), F.col("values").alias("b"))
    return series.select(F.col("series_id").alias("id"), F.col("values").alias("a")).join(other, "id")


INPUTS = {"embeddings": vectors, "events": event_series}


def _pairwise(kind: str, expression: Callable[..., object], digits: int | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = expression("a", "b")
        return next_pairs(INPUTS[kind](spark, sf_dir)).select("id", (F.round(value, digits) if digits else value).alias("distance"))

    return run


def _pair_sql(kind: str, name: str, digits: int | None = None, **p) -> str:
    value = f"round(d, {digits})" if digits else "d"
    return sql.whole(sql.distance(sql.NEXT[kind], name, **p), f"select id, {value} distance from found")


def _wdtw_weights(n: int) -> list[float]:
    import math

    return [1 / (1 + math.exp(-G * (i - n / 2))) for i in range(n)]


#: name: (distance, parameters of the SQL form, digits to round to where powers or exponentials come in)
DISTANCES: dict[str, tuple[Distance, dict, int | None]] = {
    "directa_e1": (Distance("directa", {"exponent": 1}), {"name": "directa", "e": 1}, None),
    "directa_e2": (Distance("directa", {"exponent": 2}), {"name": "directa"}, None),
    "directa_e3": (Distance("directa", {"exponent": 3}), {"name": "directa", "e": 3}, 9),
    "dtw": (Distance("dtw", {}), {"name": "dtw"}, None),
    "dtw_w5": (Distance("dtw", {"window": WINDOW}), {"name": "dtw", "window": WINDOW}, None),
    "dtw_e1": (Distance("dtw", {"exponent": 1}), {"name": "dtw", "e": 1}, None),
    "dtw_e15": (Distance("dtw", {"exponent": 1.5}), {"name": "dtw", "e": 1.5}, 9),
    "adtw": (Distance("adtw", {"penalty": 0.025}), {"name": "adtw", "penalty": 0.025}, None),
    "adtw_e1": (Distance("adtw", {"penalty": 0.025, "exponent": 1}), {"name": "adtw", "penalty": 0.025, "e": 1}, None),
    "adtw_e15": (Distance("adtw", {"penalty": 0.025, "exponent": 1.5}), {"name": "adtw", "penalty": 0.025, "e": 1.5}, 9),
    "wdtw_e1": (Distance("wdtw", {"weights": _wdtw_weights(LENGTH), "exponent": 1}), {"name": "wdtw", "g": G, "length": LENGTH, "e": 1}, 9),
    "wdtw_e15": (Distance("wdtw", {"weights": _wdtw_weights(LENGTH), "exponent": 1.5}), {"name": "wdtw", "g": G, "length": LENGTH, "e": 1.5}, 9),
    "erp_e1": (Distance("erp", {"gap_value": 0.01, "exponent": 1}), {"name": "erp", "gap_value": 0.01, "e": 1}, None),
    "erp_e15": (Distance("erp", {"gap_value": 0.01, "exponent": 1.5}), {"name": "erp", "gap_value": 0.01, "e": 1.5}, 9),
    "erp_g1": (Distance("erp", {"gap_value": 1.0}), {"name": "erp", "gap_value": 1.0}, None),
    "erp_g15_w5": (Distance("erp", {"gap_value": 1.5, "window": WINDOW}), {"name": "erp", "gap_value": 1.5, "window": WINDOW}, None),
    "wdtw": (Distance("wdtw", {"weights": _wdtw_weights(LENGTH)}), {"name": "wdtw", "g": G, "length": LENGTH}, 9),
    "erp": (Distance("erp", {"gap_value": 0.01}), {"name": "erp", "gap_value": 0.01}, None),
    "erp_w5": (Distance("erp", {"gap_value": 0.01, "window": WINDOW}), {"name": "erp", "gap_value": 0.01, "window": WINDOW}, None),
    "lcss": (Distance("lcss", {"epsilon": 0.1}), {"name": "lcss", "epsilon": 0.1}, None),
    "lcss_w5": (Distance("lcss", {"epsilon": 0.1, "window": WINDOW}), {"name": "lcss", "epsilon": 0.1, "window": WINDOW}, None),
    "msm": (Distance("msm", {"price": 0.05}), {"name": "msm", "price": 0.05}, None),
    "twe": (Distance("twe", {"nu": 0.01, "penalty": 0.005}), {"name": "twe", "nu": 0.01, "penalty": 0.005}, None),
}
EVENT_DISTANCES: dict[str, tuple[Distance, dict, int | None]] = {
    "dtw_events": (Distance("dtw", {}), {"name": "dtw"}, None),
    "dtw_events_w60": (Distance("dtw", {"window": 60}), {"name": "dtw", "window": 60}, None),
    "adtw_events": (Distance("adtw", {"penalty": 4.0}), {"name": "adtw", "penalty": 4.0}, None),
    "wdtw_events": (Distance("wdtw", {"weights": _wdtw_weights(LONGEST)}), {"name": "wdtw", "g": G, "length": LONGEST}, 6),
    "erp_events": (Distance("erp", {"gap_value": 0.5}), {"name": "erp", "gap_value": 0.5}, None),
    "lcss_events": (Distance("lcss", {"epsilon": 5.0}), {"name": "lcss", "epsilon": 5.0}, None),
    "msm_events": (Distance("msm", {"price": 0.5}), {"name": "msm", "price": 0.5}, None),
    "twe_events": (Distance("twe", {"nu": 0.001, "penalty": 0.1}), {"name": "twe", "nu": 0.001, "penalty": 0.1}, None),
}
#: Distances that searches are run with.
SEARCHED = ("directa_e2", "dtw", "dtw_w5", "adtw", "wdtw", "erp", "lcss", "msm", "twe")
#: Those of them that every vector asks with.
EVERY = ("dtw_w5",)
RADIUS, ALONE = 0.42, 0.3


def _arrow_pairs(kind: str, distance: Distance, digits: int | None) -> Query:
    return _pairwise(kind, vectorised(distance), digits)


def _asked(series: DataFrame) -> DataFrame:
    return series.where(F.col("series_id") % 100 == 0)


def _nn1(distance: Distance, k: int = 1, digits: int | None = None, every: bool = False) -> Query:
    """``every``: all series ask."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        series = vectors(spark, sf_dir)
        found = search.knn(series if every else _asked(series), series, distance, k)
        return found.withColumn("distance", F.round("distance", digits)) if digits else found

    return run


def _nn1_sql(p: dict, k: int = 1, digits: int | None = None, pairs: str = sql.SEARCH) -> str:
    value = f"round(d, {digits})" if digits else "d"
    return sql.whole(
        sql.distance(pairs, **p),
        f"select id query_id, r::integer rank, c candidate_id, {value} distance from (select *, row_number() over (partition by id order by d, c) r from found where d is not null) where r <= {k}",
    )


def series_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events gathered to series: length, ends, and a sum that depends on the order."""
    turn = F.aggregate(F.transform("values", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return event_series(spark, sf_dir).select("series_id", F.size("values").alias("n_values"), F.get("values", F.lit(0)).alias("first_value"), F.element_at("values", -1).alias("last_value"), F.round(turn, 4).alias("turn"))


def calendar_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order totals of each priority over all days of the table, one row a day."""
    days = source.calendar(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderdate"), F.col("o_totalprice"))
    return source.to_long(days).select("series_id", "i", F.round("value", 2).alias("value"))


#: Cutoffs that some pairs are above.
CUTOFFS = {"directa_e2": 2.0, "dtw": 0.5, "dtw_w5": 0.6, "adtw": 0.9, "erp": 1.2, "lcss": 0.3, "msm": 4.0, "twe": 2.0}


def _cut(distance: Distance, cutoff: float, arrow: bool = False) -> Query:
    """A distance abandoned above a cutoff."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = (vectorised(distance) if arrow else distance.column)("a", "b", cutoff)
        d = next_pairs(vectors(spark, sf_dir)).select("id", value.alias("d"))
        return d.select("id", (F.col("d") == float("inf")).alias("abandoned"), F.when(F.col("d") != float("inf"), F.col("d")).alias("distance"))

    return run


def dtw_infeasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows smaller than the difference of lengths."""
    d = next_pairs(event_series(spark, sf_dir)).select("id", elastic.dtw("a", "b", window=3).alias("d"), elastic.erp("a", "b", window=3).alias("e"), elastic.lcss("a", "b", 5.0, window=3).alias("l"))
    far = lambda c: (F.col(c) == float("inf")).alias(f"{c}_infinite")
    return d.select("id", far("d"), far("e"), far("l"))


def dtw_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warping with the largest deviation of its path, in bulk: the Column form keeps a struct for each cell."""
    return dtw_path_arrow(spark, sf_dir)


def dtw_path_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under the name of its form."""
    found = next_pairs(vectors(spark, sf_dir)).select("id", vectorised_path()("a", "b").alias("p"))
    return found.select("id", F.col("p.cost").alias("distance"), "p.max_deviation")


def _dtw_path_sql() -> str:
    # both parts of a cell in one struct; of equal steps the diagonal one, then the one along b
    cost = "(A-B)*(A-B)"
    inf = "'infinity'::double"
    q, left, top = (f"coalesce({x}.d, {inf})" for x in ("Q", "L", "T"))
    step = (
        f"case when {q} <= {left} and {q} <= {top} then {{'d': {q} + {cost}, 'w': Q.w}} "
        f"when {left} <= {top} then {{'d': {left} + {cost}, 'w': greatest(L.w, abs(I-J)::integer)}} else {{'d': {top} + {cost}, 'w': greatest(T.w, abs(I-J)::integer)}} end"
    )
    ctes = sql.programme(sql.NEXT["embeddings"], f"{{'d': {cost}, 'w': 0::integer}}", step, kind="struct(d double, w integer)")
    return sql.whole(ctes, "select id, d.d distance, d.w max_deviation from found")


def ddtw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warping of derivatives, plain, windowed and weighted."""
    weights = F.array(*(F.lit(w) for w in _wdtw_weights(LENGTH)))
    slopes = next_pairs(vectors(spark, sf_dir)).select("id", transforms.derive("a").alias("a"), transforms.derive("b").alias("b"))
    return slopes.select("id", F.round(elastic.dtw("a", "b"), 12).alias("distance"), F.round(elastic.wdtw("a", "b", weights), 9).alias("weighted"))


def derive(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        slopes = INPUTS[kind](spark, sf_dir).select("series_id", transforms.derive("values").alias("values"))
        return source.to_long(slopes)

    return run


def wdtw_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights for the length of every series."""
    weights = event_series(spark, sf_dir).select("series_id", transforms.wdtw_weights(G, F.size("values")).alias("values"))
    return source.to_long(weights).select("series_id", "i", F.round("value", 9).alias("value"))


def point_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point cost at every place of every pair."""
    rows = next_pairs(vectors(spark, sf_dir))
    at = lambda s, i: F.get(s, i)
    a, b, a1, b1 = F.col("x"), F.col("y"), F.col("x1"), F.col("y1")
    i = F.col("i")
    rows = rows.select("id", "a", "b", F.explode(F.sequence(F.lit(1), F.size("a") - 1)).alias("i"))
    rows = rows.select("id", "i", at("a", i).alias("x"), at("b", i).alias("y"), at("a", i - 1).alias("x1"), at("b", i - 1).alias("y1"))
    return rows.select(
        "id",
        "i",
        costs.ad1(a, b).alias("ad1"),
        costs.ad2(a, b).alias("ad2"),
        F.round(costs.ade(1.5)(a, b), 9).alias("ade"),
        costs.ad2(a, F.lit(0.01)).alias("gap"),
        costs.similar(a, b, 0.1).alias("similar"),
        costs.msm_move(a, a1, b, 0.05).alias("msm"),
        costs.twe_warp(a, a1, F.lit(0.015)).alias("twe_warp"),
        costs.twe_match(a, b, a1, b1, F.lit(2), 0.01).alias("twe_match"),
    )


def _enveloped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with the envelopes of both series, worked out once a series."""
    series = vectors(spark, sf_dir).select("series_id", "values", envelopes.webb_envelopes("values", WINDOW).alias("e"))
    other = series.select((F.col("series_id") - 1).alias("id"), F.col("values").alias("b"), F.col("e").alias("eb"))
    return series.select(F.col("series_id").alias("id"), F.col("values").alias("a"), F.col("e").alias("ea")).join(other, "id")


def _bound(value: Callable[[], object]) -> Query:
    return lambda spark, sf_dir: _enveloped(spark, sf_dir).select("id", F.round(value(), 9).alias("bound"))


def _envelope_rows(parts: tuple[str, ...]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = vectors(spark, sf_dir).select("series_id", envelopes.webb_envelopes("values", WINDOW).alias("e"))
        items = F.arrays_zip(*(F.col(f"e.{p}").alias(p) for p in parts))
        return e.select("series_id", F.posexplode(items).alias("i", "x")).select("series_id", "i", *(F.col(f"x.{p}").alias(p) for p in parts))

    return run


def envelope_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes over rows instead of arrays, for the event series."""
    rows = source.to_long(event_series(spark, sf_dir))
    return envelopes.envelope_rows(rows, WINDOW).select("series_id", "i", "upper", "lower")


def _envelope_sql(parts: tuple[str, ...]) -> str:
    u, low = sql.around("s", WINDOW)
    lists = {"upper": "u", "lower": "l", "lower_upper": sql.around("u", WINDOW)[1], "upper_lower": sql.around("l", WINDOW)[0]}
    picked = ", ".join(f"unnest({lists[p]}) {p}" for p in parts)
    return sql.whole(f"{sql.VECTORS}, e as (select id, s, {u} u, {low} l from vectors)", f"select id series_id, unnest(range(len(s)))::integer i, {picked} from e")


def similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = vectors(spark, sf_dir)
    return search.similarity_join(_asked(series), series, Distance("dtw", {"window": WINDOW}), 0.55)


def has_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = vectors(spark, sf_dir)
    return search.has_neighbour(series, series, Distance("dtw", {}), RADIUS).select("series_id", "label")


def novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = vectors(spark, sf_dir)
    return search.novel(series, series, Distance("dtw", {}), ALONE).select("series_id", "label")


def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all pairs with one label."""
    return search.distance_matrix(vectors(spark, sf_dir), Distance("dtw", {"window": WINDOW}), "label")


def medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most central series of each label."""
    return search.medoids(vectors(spark, sf_dir), Distance("dtw", {"window": WINDOW}))


def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label voted by the three nearest."""
    series = vectors(spark, sf_dir)
    return search.classify(_asked(series), series, Distance("dtw", {"window": WINDOW}), 3)


def accuracy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = vectors(spark, sf_dir)
    return search.accuracy(search.classify(series, series, Distance("dtw", {}), 1)).withColumn("accuracy", F.round("accuracy", 9))


def _classified_sql(p: dict, k: int, pairs: str = sql.SEARCH) -> str:
    """CTEs up to ``classified``."""
    return (
        sql.distance(pairs, **p)
        + f", near as (select * from (select *, row_number() over (partition by id order by d, c) r from found where d is not null) where r <= {k}),"
        " votes as (select near.id, y.label vote, count(*) n, min(d) d from near join vectors y on y.id = near.c group by all),"
        " ranked as (select *, row_number() over (partition by id order by n desc, vote) r, min(d) over (partition by id) best from votes),"
        " classified as (select x.id query_id, x.label, vote predicted, best distance from ranked join vectors x on x.id = ranked.id where r = 1)"
    )


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user and day as series, matched with two templates."""
    series = matching.windowed_series(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", "1 day")
    found = matching.matched(series, TEMPLATES, Distance("dtw", {}), 1e12)
    return found.select("series_id", "window_start", F.size("values").alias("n_values"), "template_id", "distance")


TEMPLATES = [(1, [10.0, 20.0, 30.0]), (2, [60.0, 40.0, 20.0])]


def _daily_sql(where: str = "") -> str:
    days = "series as (select user_id id, date_trunc('day', ts) w, list(value order by ts, event_id) s from events group by all)"
    templates = "templates as (select * from (values (1, [10e0, 20e0, 30e0]), (2, [60e0, 40e0, 20e0])) t(t, v))"
    pairs = f"{days}, {templates}, keyed as (select *, row_number() over () id2 from series), pairs as (select id2 id, t c, s a, v b, len(s) n, len(v) m from keyed, templates)"
    return sql.whole(
        sql.distance(pairs, "dtw"),
        f"select k.id series_id, k.w window_start, len(k.s)::integer n_values, f.c::bigint template_id, f.d distance from keyed k join (select *, row_number() over (partition by id order by d, c) r from found) f on f.id = k.id2 and r = 1{where}",
    )


def stream_daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream that reads all there is and ends; windows still open at the end are not yet given."""
    import uuid

    from .streaming import sink

    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant
    series = matching.windowed_series(events, "user_id", "ts", "event_id", "value", "1 day")
    found = matching.matched(series, TEMPLATES, Distance("dtw", {}), 1e12).select("series_id", "window_start", F.size("values").alias("n_values"), "template_id", "distance")
    return sink.run_to_end(found, f"stream-{uuid.uuid4().hex}")


def _spans(series: DataFrame) -> DataFrame:
    ends = (F.get("values", F.lit(0)).alias("first_value"), F.element_at("values", -1).alias("last_value"))
    return series.select("series_id", "window_start", "window_end", F.size("values").alias("n_values"), *ends)


SLIDING, SESSION = ("2 days", "1 day"), "36 hours"


def _sliding(events: DataFrame) -> DataFrame:
    return _spans(matching.windowed_series(events, "user_id", "ts", "event_id", "value", *SLIDING))


def _sessions(events: DataFrame) -> DataFrame:
    return _spans(matching.sessions(events, "user_id", "ts", "event_id", "value", SESSION))


def _batch(work: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: work(table(spark, sf_dir, "events"))


def _streamed(work: Callable[[DataFrame], DataFrame]) -> Query:
    """The same from a stream that reads all there is and ends, without what is still open then."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        import uuid

        from .streaming import sink

        events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
        return sink.run_to_end(work(events.withColumn("ts", F.col("ts").cast("timestamp"))), f"stream-{uuid.uuid4().hex}")

    return run


#: Windows over before the watermark, an hour behind the newest event.
_CLOSED = " where window_end <= (select max(ts) from events) - interval 1 hour"


def _sliding_sql(where: str = "") -> str:
    return (
        "with spans as (select user_id, unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day]) w, ts, event_id, value from events),"
        " found as (select user_id series_id, w window_start, w + interval 2 day window_end, count(*)::integer n_values, arg_min(value, (ts, event_id)) first_value, arg_max(value, (ts, event_id)) last_value from spans group by all)"
        f" select * from found{where}"
    )


def _sessions_sql(where: str = "") -> str:
    return (
        "with steps as (select *, case when ts - lag(ts) over u > interval 36 hour then 1 else 0 end new from events window u as (partition by user_id order by ts, event_id)),"
        " runs as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) run from steps),"
        " found as (select user_id series_id, min(ts) window_start, max(ts) + interval 36 hour window_end, count(*)::integer n_values, arg_min(value, (ts, event_id)) first_value, arg_max(value, (ts, event_id)) last_value from runs group by user_id, run)"
        f" select * from found{where}"
    )


#: A cost that grows no further beyond a point, in both forms.
CAP = 0.01
CAPPED = costs.both(lambda a, b: F.least((a - b) * (a - b), F.lit(CAP)), lambda a, b: np.minimum((a - b) * (a - b), CAP))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances, bounds and transforms through SQL."""
    sql_names.register(spark)
    next_pairs(vectors(spark, sf_dir)).createOrReplaceTempView("series_pairs")
    return spark.sql(
        "with e as (select *, ts_upper_envelope(b, 5) u, ts_lower_envelope(b, 5) l from series_pairs) "
        "select id, ts_dtw(a, b, 2, 5, null) dtw, round(ts_lb_keogh(a, u, l, 2, null), 9) keogh, round(ts_lb_enhanced(a, b, u, l, 2, 5, 5, null), 9) enhanced,"
        " round(ts_lb_webb(a, b, 2, 5, null), 9) webb, ts_derive(a)[3] slope, round(ts_wdtw_weights(0.05D, size(a))[2], 9) weight from e"
    )


def _sql_functions_sql() -> str:
    env = sql.bounded(sql.NEXT["embeddings"], WINDOW)
    bound = f"{sql.enhanced(5, WINDOW)}+{sql.keogh('a', 'bu', 'bl', first='6', last='n-5')}"
    parts = {
        "x": sql.whole(sql.distance(sql.NEXT["embeddings"], "dtw", window=WINDOW), "select id, d dtw from found"),
        "y": sql.whole(sql.webb(sql.NEXT["embeddings"], WINDOW), "select id, round(d, 9) webb from found"),
        "z": sql.whole(env, f"select id, round({sql.keogh('a', 'bu', 'bl')}, 9) keogh, round({bound}, 9) enhanced, ((a[4]-a[3])+(a[5]-a[3])/2)/2 slope, round(1e0/(1e0+exp(-{G}e0*(2-n/2e0))), 9) weight from env"),
    }
    return f"select * from ({parts['x']}) x join ({parts['y']}) y using (id) join ({parts['z']}) z using (id)"


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {"series_assemble": series_assemble, "calendar_orders": calendar_orders}
    for kind, named in (("embeddings", DISTANCES), ("events", EVENT_DISTANCES)):
        for name, (distance, _, digits) in named.items():
            found[name] = _pairwise(kind, distance.column, digits)
            found[f"{name}_arrow"] = _arrow_pairs(kind, distance, digits)
    for name, cutoff in CUTOFFS.items():
        short = "directa" if name == "directa_e2" else name
        found[f"{short}_cutoff"] = _cut(DISTANCES[name][0], cutoff)
        found[f"{short}_cutoff_arrow"] = _cut(DISTANCES[name][0], cutoff, True)
    found |= {"dtw_infeasible": dtw_infeasible, "dtw_path": dtw_path, "dtw_path_arrow": dtw_path_arrow, "ddtw": ddtw}
    found |= {"derive": derive("embeddings"), "derive_events": derive("events"), "wdtw_weights": wdtw_weights, "point_costs": point_costs}
    found |= {"envelopes": _envelope_rows(("upper", "lower")), "upper_envelope": _envelope_rows(("upper",)), "lower_envelope": _envelope_rows(("lower",))}
    found |= {"webb_envelopes": _envelope_rows(("upper", "lower", "lower_upper", "upper_lower")), "envelope_long": envelope_long}
    found |= {
        "lb_keogh": _bound(lambda: bounds.lb_keogh("a", "eb.upper", "eb.lower")),
        "lb_keogh2j": _bound(lambda: bounds.lb_keogh2j("a", "ea.upper", "ea.lower", "b", "eb.upper", "eb.lower")),
        "lb_enhanced": _bound(lambda: bounds.lb_enhanced("a", "b", "eb.upper", "eb.lower", 5, WINDOW)),
        "lb_enhanced2j": _bound(lambda: bounds.lb_enhanced2j("a", "ea.upper", "ea.lower", "b", "eb.upper", "eb.lower", 5, WINDOW)),
        "lb_webb": _bound(lambda: bounds.lb_webb("a", F.col("ea"), "b", F.col("eb"), WINDOW)),
    }
    for name in SEARCHED:
        found[f"nn1_{name}"] = _nn1(DISTANCES[name][0], 1, DISTANCES[name][2], name in EVERY)
    found |= {"knn5_dtw": _nn1(DISTANCES["dtw"][0], 5, every=True), "similarity_join": similarity_join, "has_neighbour": has_neighbour, "novel": novel, "classify_knn3": classify, "accuracy_rollup": accuracy_rollup}
    capped = Distance("dtw", {"exponent": CAPPED})
    found |= {"dtw_user_cost": _pairwise("embeddings", capped.column), "dtw_user_cost_arrow": _arrow_pairs("embeddings", capped, None), "nn1_user_cost": _nn1(capped)}
    found |= {"distance_matrix": distance_matrix, "medoids": medoids, "sql_functions": sql_functions}
    for name, work in (("sliding_series", _sliding), ("session_series", _sessions)):
        found[name], found[f"stream_{name}"] = _batch(work), _streamed(work)
    return found | {"daily_series": daily_series, "stream_daily_series": stream_daily_series}


def oracle_sql() -> dict[str, str]:
    long = "select id series_id, unnest(range(len(s)))::integer i, unnest(s) value from "
    found = {
        "series_assemble": sql.whole(sql.EVENTS, f"select id series_id, len(s)::integer n_values, s[1] first_value, s[len(s)] last_value, round({sql.fold('[s[i]*i for i in range(1, len(s)+1)]')}, 4) turn from series"),
        "calendar_orders": "with d as (select o_orderpriority k, o_orderdate::date d, sum(o_totalprice) v from orders group by all), r as (select min(d) a, max(d) b from d), days as (select unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date d, a from r), k as (select distinct k from d) "
        "select k.k series_id, (days.d - days.a)::integer i, round(coalesce(d.v, 0), 2) \"value\" from k cross join days left join d on d.k = k.k and d.d = days.d",
    }
    for kind, named in (("embeddings", DISTANCES), ("events", EVENT_DISTANCES)):
        for name, (_, p, digits) in named.items():
            found[name] = found[f"{name}_arrow"] = _pair_sql(kind, digits=digits, **p)
    for name, cut in CUTOFFS.items():
        short = "directa" if name == "directa_e2" else name
        found[f"{short}_cutoff"] = found[f"{short}_cutoff_arrow"] = sql.whole(sql.distance(sql.NEXT["embeddings"], **DISTANCES[name][1]), f"select id, d > {cut}e0 abandoned, case when d <= {cut}e0 then d end distance from found")
    found["dtw_infeasible"] = sql.whole(sql.NEXT["events"], "select id, abs(n-m) > 3 d_infinite, abs(n-m) > 3 e_infinite, abs(n-m) > 3 l_infinite from pairs")
    found["dtw_path"] = found["dtw_path_arrow"] = _dtw_path_sql()
    slopes = sql.derived(sql.NEXT["embeddings"])
    plain, weighted = sql.distance(slopes, "dtw"), sql.distance(slopes, "wdtw", g=G, length=LENGTH)
    found["ddtw"] = (
        f"select p.id, round(p.d, 12) distance, round(w.d, 9) weighted from (with recursive {plain} select id, d from found) p join (with recursive {weighted} select id, d from found) w on w.id = p.id"
    )
    slope = "case when len(s) <= 2 then s else [((s[k]-s[k-1])+(s[k+1]-s[k-1])/2)/2 for k in [least(greatest(i, 2), len(s)-1) for i in range(1, len(s)+1)]] end s"
    found["derive"] = sql.whole(f"{sql.VECTORS}, x as (select id, {slope} from vectors)", long + "x")
    found["derive_events"] = sql.whole(f"{sql.EVENTS}, x as (select id, {slope} from series)", long + "x")
    found["wdtw_weights"] = sql.whole(f"{sql.EVENTS}, x as (select id, [round(1e0/(1e0+exp(-{G}e0*(i-len(s)/2e0))), 9) for i in range(len(s))] s from series)", long + "x")
    found["point_costs"] = sql.whole(
        f"{sql.NEXT['embeddings']}, p as (select id, unnest(range(1, n))::integer i, a, b from pairs), v as (select id, i, a[i+1] x, b[i+1] y, a[i] x1, b[i] y1 from p)",
        "select id, i, abs(x-y) ad1, (x-y)*(x-y) ad2, round(pow(abs(x-y), 1.5e0), 9) ade, (x-0.01e0)*(x-0.01e0) gap, abs(x-y) < 0.1e0 \"similar\", "
        "case when (x1 <= x and x <= y) or (y <= x and x <= x1) then 0.05e0 else 0.05e0 + least(abs(x-x1), abs(x-y)) end msm, "
        "(x-x1)*(x-x1)+0.015e0 twe_warp, (x-y)*(x-y)+(x1-y1)*(x1-y1)+0.01e0*2*2 twe_match from v",
    )
    found["envelopes"] = _envelope_sql(("upper", "lower"))
    found["upper_envelope"], found["lower_envelope"] = _envelope_sql(("upper",)), _envelope_sql(("lower",))
    found["webb_envelopes"] = _envelope_sql(("upper", "lower", "lower_upper", "upper_lower"))
    found["envelope_long"] = sql.whole(
        f"{sql.EVENTS}, x as (select id, unnest(range(len(s)))::integer i, unnest(s) v from series)",
        f"select id series_id, i, max(v) over w upper, min(v) over w lower from x window w as (partition by id order by i rows between {WINDOW} preceding and {WINDOW} following)",
    )
    env = sql.bounded(sql.NEXT["embeddings"], WINDOW)
    one, two = sql.keogh("a", "bu", "bl"), sql.keogh("b", "au", "al")
    inner = [sql.keogh(*x, first="6", last="n-5") for x in (("a", "bu", "bl"), ("b", "au", "al"))]
    bands = sql.enhanced(5, WINDOW)
    for name, value in (("lb_keogh", one), ("lb_keogh2j", f"greatest({one}, {two})"), ("lb_enhanced", f"{bands}+{inner[0]}"), ("lb_enhanced2j", f"{bands}+greatest({inner[0]}, {inner[1]})")):
        found[name] = sql.whole(env, f"select id, round({value}, 9) bound from env")
    found["lb_webb"] = sql.whole(sql.webb(sql.NEXT["embeddings"], WINDOW), "select id, round(d, 9) bound from found")
    for name in SEARCHED:
        found[f"nn1_{name}"] = _nn1_sql(DISTANCES[name][1], 1, DISTANCES[name][2], sql.EVERY if name in EVERY else sql.SEARCH)
    found["knn5_dtw"] = _nn1_sql(DISTANCES["dtw"][1], 5, pairs=sql.EVERY)
    found["similarity_join"] = sql.whole(sql.distance(sql.SEARCH, "dtw", window=WINDOW), f"select id query_id, c candidate_id, d distance from found where d <= 0.55e0")
    near = sql.distance(sql.EVERY, "dtw")
    for name, word, radius in (("has_neighbour", "exists", RADIUS), ("novel", "not exists", ALONE)):
        found[name] = sql.whole(near, f"select id series_id, label from vectors v where {word} (select 1 from found where found.id = v.id and d <= {radius}e0)")
    found["classify_knn3"] = sql.whole(_classified_sql(DISTANCES["dtw_w5"][1], 3), "select query_id, label, predicted, distance from classified")
    found["accuracy_rollup"] = sql.whole(
        _classified_sql(DISTANCES["dtw"][1], 1, sql.EVERY),
        "select label, count(*) n, sum((label = predicted)::integer)::bigint n_right, round(avg((label = predicted)::integer), 9) accuracy from classified group by rollup (label)",
    )
    capped = f"least((A-B)*(A-B), {CAP}e0)"
    warped = lambda pairs: sql.programme(pairs, capped, f"least(L, T, Q) + {capped}")
    found["dtw_user_cost"] = found["dtw_user_cost_arrow"] = sql.whole(warped(sql.NEXT["embeddings"]), "select id, d distance from found")
    found["nn1_user_cost"] = sql.whole(warped(sql.SEARCH), "select id query_id, 1::integer rank, c candidate_id, d distance from (select *, row_number() over (partition by id order by d, c) r from found) where r = 1")
    alike = sql.VECTORS + ", pairs as (select x.id, y.id c, x.label, x.s a, y.s b, len(x.s) n, len(y.s) m from vectors x join vectors y on x.label = y.label and x.id < y.id)"
    near = sql.distance(alike, "dtw", window=WINDOW)
    found["distance_matrix"] = sql.whole(near, "select id a_id, c b_id, d distance from found")
    found["medoids"] = sql.whole(
        near + ", ends as (select id, d from found union all select c, d from found), sums as (select label, v.id, round(coalesce(sum(d), 0), 9) total from vectors v left join ends on ends.id = v.id where label is not null group by all)",
        "select label, id series_id, total from (select *, row_number() over (partition by label order by total, id) r from sums) where r = 1",
    )
    found["sql_functions"] = _sql_functions_sql()
    found["sliding_series"], found["stream_sliding_series"] = _sliding_sql(), _sliding_sql(_CLOSED)
    found["session_series"], found["stream_session_series"] = _sessions_sql(), _sessions_sql(_CLOSED)
    found["daily_series"] = _daily_sql()
    # windows are given once the watermark, an hour behind the newest event, has passed their end
    found["stream_daily_series"] = _daily_sql(" where k.w + interval 1 day <= (select max(ts) from events) - interval 1 hour")
    return found
