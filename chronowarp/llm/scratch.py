"""Materialised intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a lost executor then costs a re-read, not a
re-computation.  Where a local session names no folder (unit tests) a temporary one is set; on a cluster that is an error.

Every table belongs to a scope, the name given to the innermost ``scoped`` block that wrote it; ``clear`` drops the
tables of one scope and leaves those of others, which unread frames may still need.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LIVE: dict[tuple[str, str], list[str]] = {}
_SCOPES: list[str] = [""]


@contextmanager
def scoped(name: str) -> Iterator[None]:
    """Tables written inside belong to ``name``."""
    _SCOPES.append(name)
    try:
        yield
    finally:
        _SCOPES.pop()


def _live(spark: SparkSession, scope: str | None = None) -> list[str]:
    return _LIVE.setdefault((spark.sparkContext.applicationId, _SCOPES[-1] if scope is None else scope), [])


def base_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one only if a local session has none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chronowarp-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def write(df: DataFrame, tag: str) -> str:
    """Write ``df`` as Parquet under a fresh path and return that path."""
    spark = df.sparkSession
    path = f"{base_dir(spark)}/chronowarp/{tag}-{uuid.uuid4().hex}"
    _live(spark).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return path


#: Rows for each file of a table whose size is known, and files at least.
ROWS_A_FILE, LEAST_FILES = 100_000, 8


def materialise(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """``df`` written and read back: same rows, no lineage. ``rows``: about how many there are at most; small tables
    then do not end in as many tasks and files as there are shuffle partitions. Only for plans that end in a shuffle
    and little work after it."""
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // ROWS_A_FILE)))
    return df.sparkSession.read.schema(df.schema).parquet(write(df, tag))


def keep(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` written and read back, and its path; ``clear`` leaves it alone."""
    path = write(df, tag)
    _live(df.sparkSession).remove(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete one written table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    for (application, _), live in _LIVE.items():
        if application == spark.sparkContext.applicationId and path in live:
            live.remove(path)


def paths(spark: SparkSession, scope: str | None = None) -> list[str]:
    """Tables of a scope (None: the present one) written so far by this application and not dropped."""
    return list(_live(spark, scope))


def clear(spark: SparkSession, scope: str) -> None:
    """Drop every table of a scope; call it only when results built on them have been saved."""
    for path in paths(spark, scope):
        drop(spark, path)
