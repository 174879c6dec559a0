"""Memory of Python workers.

Spark keeps a worker for the next task, and the C library keeps what the last one freed: idle workers then hold as much as
busy ones. Here large arrays are returned to the system as soon as they are freed, and the rest when a task is over.

What rows take on their way to a worker counts too: the executor builds each Arrow batch outside its heap, in buffers that
double as they grow, and copies it once more to send it. ``small_batches`` bounds that.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Sizes from which an array is the system's again when it is freed, and of the unused end of the heap.
LARGE, UNUSED = 4 << 20, 16 << 20
#: Most bytes of the rows that are sent to a worker at once.
BATCH_BYTES = 2 << 20
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3


@functools.cache
def _library() -> ctypes.CDLL | None:
    """The C library, told of the sizes once; none where it isn't GNU's."""
    library = ctypes.CDLL(None)
    if not hasattr(library, "malloc_trim"):
        return None
    library.mallopt(_MMAP_THRESHOLD, LARGE)
    library.mallopt(_TRIM_THRESHOLD, UNUSED)
    pa.set_memory_pool(pa.system_memory_pool())
    return library


def let_go() -> None:
    """Return all memory that is free. To be called in tasks, before the work and after it."""
    if (library := _library()) is not None:
        library.malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function on batches, returning memory when it is through."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        yield from run(batches)
        let_go()

    return each


def small_batches(spark: SparkSession) -> None:
    """Send rows to workers in batches of about ``BATCH_BYTES`` at most, from now on in this session.

    Spark reads the setting when it plans a job, which may be after the function that made the rows has returned, so it is
    not set back.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
