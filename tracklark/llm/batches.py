"""Arrow helpers for the operators that run Python on executors."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and bytes worked on, and put into one output batch, at most; a longer row is a batch of its own.
ROWS, BYTES = 4096, 2 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows and about `most` bytes."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and (part.num_rows > rows or part.nbytes > most):
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part


def give_back() -> None:
    """Return freed memory of this worker to the system; workers live on after their task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: Spark's setting for the bytes of a batch that it sends to Python, and the bound for it here.
SENT, MOST_SENT = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """`df.mapInArrow(run, schema)` that gives memory back at the end of each task.

    The session sends batches of at most `MOST_SENT` bytes from then on: both sides hold a batch as a whole, and a count
    of rows is no bound where texts are long.
    """
    df.sparkSession.conf.set(SENT, str(MOST_SENT))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def per_row(df: DataFrame, schema: str | StructType, start: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """Map each row of `df` to one row of `schema`.

    `start()` runs once in each task and returns the function that takes a row's values in column order and returns
    the new row's values. Nothing is kept between rows but what that function keeps.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(kind)
        f = start()
        for part in slices(batches):
            rows = [f(*values) for values in zip(*(c.to_pylist() for c in part.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), into, strict=True)], schema=into)

    return mapped(df, run, kind)
