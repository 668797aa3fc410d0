"""Salting of hot keys for joins that loops repeat.

A loop joins the same edge table every round. The table is therefore partitioned by its
join key once and kept, so that only the small frontier moves. Adaptive execution cannot
split a partition that is already laid out, so the hot keys are salted here: their rows
are spread over several partitions and the frontier's few rows for them are repeated.

A key is hot if it holds more than two partitions' worth of rows, so there are fewer hot
keys than half the partitions, of which there are at most ``max_partitions``; that bounds
the hot-key table, which is broadcast, to some 50,000 rows whatever the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import save_counted

@dataclass(frozen=True)
class Limits:
    """Sizes that steer the layout; results never depend on them.

    Partitions of fewer than ``full_partition`` rows are made only as far as there are cores
    to share them: every round of a loop starts a task for each partition.
    """

    hot_min_rows: int = 1_000_000
    keep_rows: int = 1_000_000
    rows_per_partition: int = 4_000_000
    full_partition: int = 4_000_000
    tasks_per_core: int = 4
    max_partitions: int = 100_000
    settled_rows: int = 1_000_000


LIMITS = Limits()


def partitions(rows: int, least: int, cores: int, limits: Limits = LIMITS) -> int:
    """Of how many partitions a kept table of ``rows`` rows is, ``least`` at least."""
    useful = max(limits.tasks_per_core * cores, rows // limits.full_partition)
    return min(max(least, min(rows // limits.rows_per_partition, useful)), limits.max_partitions)


def hot_keys(df: DataFrame, key: str, rows: int, parts: int, min_rows: int = LIMITS.hot_min_rows) -> DataFrame | None:
    """(key, splits) of the keys that fill more than two of ``parts`` partitions, None if
    there are none."""
    threshold = max(min_rows, 2 * rows // parts)
    if rows <= threshold:
        return None
    hot = (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > threshold)
        .select(key, F.ceil(F.col("n") / F.lit(threshold)).cast("int").alias("splits"))
    )
    table, n = save_counted(hot, "hot")
    return table if n else None


def spread(df: DataFrame, key: str, by: str, hot: DataFrame) -> DataFrame:
    """Add ``salt``: rows of a hot key are spread by the hash of ``by``."""
    splits = F.coalesce("splits", F.lit(1))
    salt = F.pmod(F.xxhash64(by), splits).cast("int")
    return df.join(F.broadcast(hot), key, "left").withColumn("salt", salt).drop("splits")


def replicate(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Repeat rows of a hot key once per salt; all splits together are at most as many as
    there are partitions."""
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1))
    return df.join(F.broadcast(hot), key, "left").withColumn("salt", salts).drop("splits")


class EdgeIndex:
    """Edges ready for repeated joins of a frontier with one of their ends.

    ``edges`` must be a stored table of distinct (src, dst). ``toward='src'`` walks edges
    backwards: a frontier row at ``dst`` reaches ``src``.
    """

    def __init__(self, edges: DataFrame, toward: str, limits: Limits = LIMITS):
        at = {"src": "dst", "dst": "src"}[toward]
        table = edges.select(F.col(at).alias("id"), F.col(toward).alias("nbr"))
        rows = table.count()  # from the file footers
        spark = table.sparkSession
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts = partitions(rows, least, spark.sparkContext.defaultParallelism, limits)
        self.hot = hot_keys(table, "id", rows, parts, limits.hot_min_rows)
        self._on = ["id"] if self.hot is None else ["id", "salt"]
        if self.hot is not None:
            table = spread(table, "id", "nbr", self.hot)
        self._kept = rows > limits.keep_rows
        if self._kept:
            # Sorted too, so that a sort-merge join finds its order and sorts the frontier only.
            table = table.repartition(parts, *self._on).sortWithinPartitions(*self._on)
            table = table.persist(StorageLevel.MEMORY_AND_DISK)
        self.table = table

    def expand(self, frontier: DataFrame) -> DataFrame:
        """``frontier`` (column ``id`` and others) with every neighbour ``nbr`` of each row."""
        if self.hot is not None:
            frontier = replicate(frontier, "id", self.hot)
        return frontier.join(self.table, self._on).drop("salt")

    def close(self) -> None:
        if self._kept:
            self.table.unpersist()

    def __enter__(self) -> EdgeIndex:
        return self

    def __exit__(self, *exc) -> None:
        self.close()
