"""Arrow functions over a frame with bounded batches, and memory given back between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A batch ends at either; texts and gathered groups are long, and a batch is held several times over.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_HELD: dict[str, object] = {}
_ASKED: set[str] = set()


def held(key: str, make: Callable[[], object]):
    """What ``make`` gave, kept in the worker process from task to task until one ends that did not ask for it: workers
    go from one operator to the next."""
    _ASKED.add(key)
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its task, and others share its machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _ended() -> None:
    """What the task that ends did not ask for is no longer held, and freed memory goes back."""
    for key in _HELD.keys() - _ASKED:
        del _HELD[key]
    _ASKED.clear()
    give_back()


def bounded(run: Run) -> Run:
    """``run`` as a task of a worker that others use after it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _ended()  # by name: a worker's copy of this function has its own copies of tables

    return task


def map_arrow(df: DataFrame, run: Run, schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of at most ``BATCH_ROWS`` rows or about ``BATCH_BYTES``; sets the
    session's batch limits where they are larger. Put no map above another in one stage: each takes a Python worker of
    its own for every task, and an executor keeps as many workers as it once needed."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = str(conf.get(name)).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))

    return df.mapInArrow(bounded(run), schema)
