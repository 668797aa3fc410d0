"""Structured Streaming ingest: batch sinks, running stores and windowed counts."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.operators.records import daily_tag_counts, latest_per_key
from strata.streaming.store import Store


def distinct_stream(stream: DataFrame, keys: Sequence[str], watermark: str) -> DataFrame:
    """Distinct across batches, with state bounded by the watermark on ``ts``."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))


def batch_sink(
    path: str, prepare: Callable[[DataFrame], DataFrame]
) -> Callable[[DataFrame, int], None]:
    """Each non-empty micro-batch, prepared, becomes one directory named by its id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        prepare(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def distinct_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Per-batch distinct, appended."""
    return batch_sink(path, lambda batch: batch.distinct())


def latest_batches(
    path: str, keys: Sequence[str], order_cols: Sequence[str]
) -> Callable[[DataFrame, int], None]:
    """Per-batch latest row of each key, appended."""
    return batch_sink(path, lambda batch: latest_per_key(batch, keys, order_cols))


def _store_sink(
    store: Store, prepare: Callable[[DataFrame], DataFrame], compact_every: int
) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        store.append(prepare(batch), batch_id)
        if (batch_id + 1) % compact_every == 0:
            store.compact()
            store.remove_unused()

    return write


def distinct_store(spark, path: str, schema, **layout) -> Store:
    """A running store of distinct rows (first batch that brought a row). ``layout``: see Store."""
    names = schema.names

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*names).agg(F.min("batch_id").alias("batch_id"))

    return Store(spark, path, schema, merge, names, **layout)


def latest_store(
    spark, path: str, schema, keys: Sequence[str], order_cols: Sequence[str], **layout
) -> Store:
    """A running store of the latest row per key; a later batch wins a tie."""

    def merge(rows: DataFrame) -> DataFrame:
        return latest_per_key(rows, keys, [*order_cols, "batch_id"])

    return Store(spark, path, schema, merge, keys, **layout)


def distinct_sink(store: Store, compact_every: int = 20) -> Callable[[DataFrame, int], None]:
    return _store_sink(store, lambda batch: batch.distinct(), compact_every)


def upsert_sink(
    store: Store, keys: Sequence[str], order_cols: Sequence[str], compact_every: int = 20
) -> Callable[[DataFrame, int], None]:
    return _store_sink(store, lambda batch: latest_per_key(batch, keys, order_cols), compact_every)


def start(
    stream: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = "60 seconds",
    mode: str = "append",
) -> StreamingQuery:
    """Start a micro-batch query. ``every=None`` takes what is there and stops."""
    writer = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    )
    if every is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()


def stream_daily_counts(uses: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Uses per (user, tag, day) of a stream; rows later than the watermark are dropped.

    ``ts`` must be TIMESTAMP: a watermark does not take TIMESTAMP_NTZ.
    """
    return daily_tag_counts(uses, watermark)


def run_together(
    spark: SparkSession,
    feeds: Sequence[tuple[DataFrame, Callable[[DataFrame, int], None], str]],
    meanwhile: Callable[[], None],
    every: str | None = "60 seconds",
    pause: float = 1.0,
) -> None:
    """Several feeds (stream, sink, checkpoint) at the same time, in one application with the
    batch work ``meanwhile``, which is called again and again while a feed runs and once after.

    With ``every=None`` the feeds end when they have read what is there. A feed that fails stops
    the others and raises its error; started again, all go on from their checkpoints.
    """
    running = []
    try:
        for stream, sink, checkpoint in feeds:
            running.append(start(stream, sink, checkpoint, every))
        while any(query.isActive for query in running):
            for query in running:
                if query.exception() is not None:
                    raise query.exception()
            meanwhile()
            time.sleep(pause)
        for query in running:
            query.awaitTermination()
        meanwhile()
    finally:
        for query in running:
            query.stop()
