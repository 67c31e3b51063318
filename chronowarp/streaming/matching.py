"""Series from an event stream: windows of events become series and are compared with fixed templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import Distance


def windowed_series(events: DataFrame, id_col: str, time_col: str, order_col: str, value_col: str, window: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(series_id, window_start, window_end, values) of a stream or a table: the values of each id in each tumbling (or
    sliding) window, in time order. Events later than ``late`` behind the newest are dropped by the watermark."""
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    item = F.struct(F.col(time_col).alias("t"), F.col(order_col).alias("o"), F.col(value_col).cast("double").alias("v"))
    gathered = events.withWatermark(time_col, late).groupBy(F.col(id_col).alias("series_id"), span.alias("w")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return gathered.select("series_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.transform("items", lambda x: x["v"]).alias("values"))


def sessions(events: DataFrame, id_col: str, time_col: str, order_col: str, value_col: str, gap: str, late: str = "1 hour") -> DataFrame:
    """As ``windowed_series``, with a window for each run of events less than ``gap`` apart."""
    item = F.struct(F.col(time_col).alias("t"), F.col(order_col).alias("o"), F.col(value_col).cast("double").alias("v"))
    gathered = events.withWatermark(time_col, late).groupBy(F.col(id_col).alias("series_id"), F.session_window(time_col, gap).alias("w")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return gathered.select("series_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.transform("items", lambda x: x["v"]).alias("values"))


def matched(series: DataFrame, templates: list[tuple[int, list[float]]], distance: Distance, radius: float = float("inf")) -> DataFrame:
    """``series`` with the nearest of the ``templates`` (id, values) within ``radius``: template_id and distance, null
    where there is none. Templates are part of the query, and few."""
    tried = F.array(*(F.struct(distance.column("values", F.array(*(F.lit(float(v)) for v in values)), cutoff=radius).alias("d"), F.lit(i).cast("long").alias("t")) for i, values in templates))
    best = F.array_min(F.filter(tried, lambda x: ~F.isnan(x["d"]) & (x["d"] != float("inf")) & (x["d"] <= radius)))
    return series.withColumn("__best", best).select(*series.columns, F.col("__best.t").alias("template_id"), F.col("__best.d").alias("distance"))
