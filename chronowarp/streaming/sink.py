"""Running a stream over all there is, with its result as a table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Write a stream's rows as Parquet below the shared folder of the session (a temporary one if a local session names none) until its
    source is exhausted, and read them back."""
    spark = stream.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="chronowarp-")
    path = f"{base.rstrip('/')}/chronowarp/{name}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
