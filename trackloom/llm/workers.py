"""What a Python worker does when a task is over."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame


def release() -> None:
    """Free memory goes back to the system: workers outlive tasks, and an idle one should not hold a peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        # not the GNU C library; what is free is then used again by the next task
        pass


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over batches, with release at its end."""
    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


#: Bytes of the Arrow batches that go to workers, and the setting of it with its default.
BATCH, SETTING, UNSET = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def mapped(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """df.mapInArrow(run, schema) in small batches, with release at the end of each task.

    A batch of long texts would otherwise fill 64 MB outside the heap of an executor and again in its workers.
    The size is a setting of the session; one that is set already stays.
    """
    conf = df.sparkSession.conf
    if conf.get(SETTING) == UNSET:
        conf.set(SETTING, BATCH)
    return df.mapInArrow(releasing(run), schema)
