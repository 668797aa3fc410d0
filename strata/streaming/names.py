"""A dictionary of names that only grows: an id, once given, never changes.

Ids are hashes of names, so most names need no numbering and get the same id anywhere. Where
two names share a hash, the one that came first keeps it and the other is hashed anew with the
number of the attempt, as in a hash table with open addressing. Nothing is ever removed, so a
name is found by following its own attempts until its id holds it, or is free.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.graph import name_id
from strata.session import save, save_counted
from strata.streaming.store import Store

_MAX_ATTEMPTS = 32


class NameDictionary:
    """(name, id) in a store laid out by id. One writer at a time; readers see whole batches.

    ``add`` and ``ids`` read only the buckets that the names' ids fall into, and the names
    they are given, not the dictionary, are what a shuffle moves when they are few. ``hashed``
    gives a name's id, 60 bits by default.
    """

    def __init__(
        self, spark: SparkSession, path: str, buckets: int = 64, hashed: Callable[[Column], Column] = name_id
    ):
        schema = spark.createDataFrame([], "name string, id bigint").schema
        self._hashed = hashed
        # An id has one name, so there is nothing to merge but a batch that came twice.
        self._store = Store(spark, path, schema, lambda rows: rows.groupBy("name", "id").agg(
            F.min("batch_id").alias("batch_id")), ["id"], buckets=buckets)

    def _at(self, attempt: int) -> Column:
        name = F.col("name")
        return self._hashed(name if attempt == 0 else F.concat_ws("#", name, F.lit(str(attempt))))

    def _follow(self, names: DataFrame, before: int | None, give: bool) -> tuple[DataFrame, DataFrame]:
        """(known, new), both (name, id): the attempts of distinct ``names`` followed through
        the batches up to ``before``. With ``give``, names that are not there take the first
        free id, of several that want one the least name; without, they are in neither."""
        known = new = names.select("name", F.lit(0).cast("bigint").alias("id")).limit(0)
        left, n = save_counted(names, "names")
        for attempt in range(_MAX_ATTEMPTS):
            if n == 0:
                return known, new
            wanted = left.select("name", self._at(attempt).alias("id"))
            holders = self._store.read(before, like=wanted).select("id", F.col("name").alias("holder"))
            if attempt:
                holders = holders.unionByName(new.select("id", F.col("name").alias("holder")))
            probed = save(wanted.join(holders, "id", "left"), "probed")
            known = known.unionByName(probed.where("holder = name").select("name", "id"))
            free = probed.where("holder IS NULL")
            rest = probed.where("holder <> name").select("name")
            if give:
                first = save(free.groupBy("id").agg(F.min("name").alias("name")).select("name", "id"), "given")
                new = new.unionByName(first)
                rest = rest.unionByName(free.join(first, ["name", "id"], "left_anti").select("name"))
            left, n = save_counted(rest, "names")
        raise RuntimeError(f"{n} names found no free id in {_MAX_ATTEMPTS} attempts")

    def add(self, names: DataFrame, batch: int, name: str = "screen_name") -> None:
        """Give ids to the names that have none. Batches are numbered upwards from 0; one that
        is repeated with the same names changes nothing. Null names are left out."""
        wanted = names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
        _, new = self._follow(wanted, batch - 1, give=True)
        self._store.append(new, batch)

    def compact(self) -> None:
        self._store.compact()
        self._store.remove_unused()

    def ids(self, names: DataFrame, name: str = "screen_name") -> DataFrame:
        """(name, id) of the distinct names that the dictionary has."""
        wanted = names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
        known, _ = self._follow(wanted, None, give=False)
        return known.withColumnRenamed("name", name)

    def read(self, name: str = "screen_name") -> DataFrame:
        """All names with their ids."""
        return self._store.read().withColumnRenamed("name", name)
