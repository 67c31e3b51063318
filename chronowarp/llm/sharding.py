"""Two-pass external shuffle into shards.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash of their place in the input, so
neither a hot key nor a group of copies makes a bucket large.  A place must be the same when a lost task runs again:
input that is not read from files in one step is written first.  Pass two loads one bucket at a time, shuffles it by
Fisher-Yates and writes it.  A record's global position is its bucket's offset plus its place in the bucket; shards
take positions in turn, which keeps their row counts at most one apart and their slots gapless.

Defined results: a null text has size 1 and a null checksum text of "" (0); repeated rows are records of their own;
an empty table gives no rows; columns of any name pass through, those named like the outputs are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from . import scratch

BUCKET_BYTES = 32 << 20
#: At least so many buckets, so that small inputs are spread too.
LEAST_BUCKETS = 64
OUTPUTS = ("shard", "slot")
#: Offsets of up to so many buckets (64 MB) are sent to every executor; more are joined by a shuffle.
BROADCAST_BUCKETS, GROUP = 1 << 22, 4096
_BUCKET, _PLACE = "__bucket", "__place"


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of range(n): swap each place, from the last, with one at or before it."""
    rng = np.random.default_rng(seed)
    order = np.arange(n)
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64)
    listed = order.tolist()
    for i in range(n - 1, 0, -1):
        j = int(picks[i])
        listed[i], listed[j] = listed[j], listed[i]
    return np.array(listed, dtype=np.int64)


def _steady(docs: DataFrame) -> bool:
    """Whether the rows come from files in one step, so that their places do not change when a task runs again."""

    def names(node) -> list[str]:
        children = node.children()
        return [node.nodeName(), *(n for i in range(children.size()) for n in names(children.apply(i)))]

    return all(n.startswith(("Scan ", "FileScan", "Project", "Filter", "ColumnarToRow")) and "ExistingRDD" not in n for n in names(docs._jdf.queryExecution().sparkPlan()))


def shuffled(docs: DataFrame, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, text_col: str = "text") -> DataFrame:
    """Scatter and shuffle: the rows of ``docs`` with ``__bucket`` and ``__place``, written once in shuffled order."""
    docs = docs.drop(_BUCKET, _PLACE)
    docs = docs if _steady(docs) else scratch.materialise(docs, "to-shuffle")
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 64)).first()[0] or 1
    buckets = max(LEAST_BUCKETS, math.ceil(size / bucket_bytes))
    dealt = docs.withColumn(_BUCKET, F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    schema = T.StructType([*dealt.schema.fields, T.StructField(_PLACE, T.LongType())])

    def one(rows: pa.Table) -> pa.Table:
        order = fisher_yates(rows.num_rows, seed * 1_000_003 + rows.column(_BUCKET)[0].as_py())
        return rows.take(pa.array(order)).append_column(_PLACE, pa.array(np.arange(rows.num_rows, dtype=np.int64)))

    return scratch.materialise(dealt.groupBy(_BUCKET).applyInArrow(one, schema), "shuffled")


def shard(docs: DataFrame, shards: int = 16, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in uniformly random order, dealt to ``shards`` shards: plus ``shard`` and ``slot``."""
    rows = shuffled(docs.drop(*OUTPUTS), seed, bucket_bytes, text_col)
    # buckets are counted one row each (input size / bucket_bytes), their groups one row for each GROUP buckets
    counts = rows.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("n")).withColumn("group", F.floor(F.col(_BUCKET) / GROUP))
    counts = scratch.materialise(counts, "bucket-counts")
    groups = counts.groupBy("group").agg(F.sum("n").alias("all"))
    groups = groups.select("group", (F.sum("all").over(W.Window.orderBy("group")) - F.col("all")).alias("earlier"))
    within = F.sum("n").over(W.Window.partitionBy("group").orderBy(_BUCKET)) - F.col("n")
    offsets = counts.select(_BUCKET, "group", within.alias("within")).join(F.broadcast(groups), "group")
    offsets = offsets.select(_BUCKET, (F.col("within") + F.col("earlier")).alias("__before"))
    small = counts.count() <= BROADCAST_BUCKETS
    at = F.col("__before") + F.col(_PLACE)
    return (
        rows.join(F.broadcast(offsets) if small else offsets, _BUCKET)
        .withColumn("shard", F.pmod(at, F.lit(shards)).cast("int"))
        .withColumn("slot", F.floor(at / shards).cast("long"))
        .drop(_BUCKET, _PLACE, "__before")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; inside it rows lie by slot within each file."""
    sharded.write.partitionBy("shard").mode("overwrite").parquet(path)
