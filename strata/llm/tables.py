"""Reading the corpus tables and passing Arrow batches through Python."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def every(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names hold."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of fewer rows than Spark's 10,000: an executor holds
    each task's batch several times, off its heap and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about BATCH_BYTES each, whatever the rows' sizes."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * BATCH_BYTES / max(1, batch.column(column).nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def release() -> None:
    """Give memory that a task no longer uses back to the system; workers live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def map_batches(
    df: DataFrame, column: str, schema: str | StructType, f: Callable[[pa.RecordBatch], dict | None]
) -> DataFrame:
    """``f`` gives the output columns for a slice of a batch (None: no rows)."""
    names = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            if batch.num_rows and (out := f(batch)) is not None:
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names
                )

    return df.mapInArrow(run, schema)


def row_number(df: DataFrame, name: str) -> DataFrame:
    """Number the rows, within one read: another read may be split, and so numbered, in another
    way. Who needs a number twice stores it."""
    return df.withColumn(name, F.monotonically_increasing_id())
