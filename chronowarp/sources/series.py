"""Series tables: (series_id, label, values) from arrays, from rows, from text files and from calendars; and to text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_array(df: DataFrame, id_col: str, values_col: str, label_col: str | None = None) -> DataFrame:
    """One row a series already."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    return df.select(F.col(id_col).alias("series_id"), label.alias("label"), F.col(values_col).cast("array<double>").alias("values"))


def from_long(df: DataFrame, id_col: str, order_cols: list[str], value_col: str) -> DataFrame:
    """One row a value: gathered by id (a series must fit one row) and ordered; null values stay in place."""
    item = F.struct(*order_cols, F.col(value_col).cast("double").alias("__v"))
    ordered = F.array_sort(F.collect_list(item))
    return df.groupBy(F.col(id_col).alias("series_id")).agg(F.transform(ordered, lambda x: x["__v"]).alias("values")).select("series_id", F.lit(None).cast("int").alias("label"), "values")


def to_long(series: DataFrame) -> DataFrame:
    """(series_id, i, value), one row a value."""
    return series.select("series_id", F.posexplode("values").alias("i", "value"))


def calendar(df: DataFrame, id_col: str, day: Column, value: Column) -> DataFrame:
    """Daily sums as series over the days from the first to the last of the whole table; days without rows are 0."""
    daily = df.groupBy(F.col(id_col).alias("series_id"), F.to_date(day).alias("day")).agg(F.sum(value).alias("v"))
    span = daily.agg(F.min("day").alias("first"), F.max("day").alias("last"))  # one row
    days = F.sequence("first", "last", F.expr("interval 1 day"))
    by = daily.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("day", "v"))).alias("m"))
    filled = F.transform(days, lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0)))
    return by.crossJoin(F.broadcast(span)).select("series_id", F.lit(None).cast("int").alias("label"), filled.alias("values"))


def read_ucr(spark: SparkSession, path: str) -> DataFrame:
    """Text files of labelled series, one a line: the label first, then the values, apart by tabs, commas or spaces.
    Lines that begin with # or @ are comments; ``?`` and ``NaN`` are missing values. Ids follow file and line order."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*([#@].*)?$"))
    parts = F.split(F.trim("value"), r"[\s,]+")
    numbers = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.when(x == "?", float("nan")).otherwise(x.cast("double")))
    return lines.select(F.monotonically_increasing_id().alias("series_id"), F.get(parts, F.lit(0)).cast("double").cast("int").alias("label"), numbers.alias("values"))


def write_ucr(series: DataFrame, path: str) -> None:
    """Labelled series as text files that ``read_ucr`` reads: the label, then the values, apart by tabs. Null values are
    written as ``?``; ids and the order of rows are not kept. A null label or series is an error when written."""
    refused = F.raise_error(F.lit("a label and values are needed")).cast("string")
    parts = F.concat(F.array(F.col("label").cast("string")), F.transform("values", lambda v: F.coalesce(v.cast("string"), F.lit("?"))))
    series.select(F.when(F.col("label").isNull() | F.col("values").isNull(), refused).otherwise(F.concat_ws("\t", parts)).alias("value")).write.text(path)
