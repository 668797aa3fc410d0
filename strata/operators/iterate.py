"""Loops over DataFrames: one stored table per round, no growing lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strata.operators.skew import LIMITS, Limits
from strata.session import new_path, save


def iterate(
    state: DataFrame,
    step: Callable[[DataFrame, int], DataFrame],
    max_iter: int,
    name: str = "iterate",
) -> DataFrame:
    """Apply ``step`` until no row is active.

    ``step(state, round)`` returns the next state with a boolean column ``active``, which
    the next step sees too. Each state is a table in the shared folder. Not converging within ``max_iter`` rounds
    raises.
    """
    for round_no in range(1, max_iter + 1):
        seen = Observation()
        active = F.count_if("active").alias("active")
        state = save(step(state, round_no).observe(seen, active), name)
        if not seen.get["active"]:
            return state.drop("active")
    raise RuntimeError(f"{name} did not converge within {max_iter} rounds")


class Stages:
    """The rows of a loop's rounds: one folder per round of one table.

    Reading it back gives all rounds with their number, whatever their count.
    """

    def __init__(self, first: DataFrame, name: str):
        self._spark = first.sparkSession
        self._root = new_path(self._spark, name)
        self._schema = first.schema
        self.round = 0
        self._write(first)

    def _write(self, df: DataFrame) -> int:
        path = f"{self._root}/round={self.round}"
        seen = Observation()
        rows = df.select(*self._schema.names).observe(seen, F.count(F.lit(1)).alias("rows"))
        rows.write.parquet(path)
        self.frontier = self._spark.read.schema(self._schema).parquet(path)
        return seen.get["rows"]

    def add(self, df: DataFrame) -> bool:
        """Store the next round; False if it is empty."""
        self.round += 1
        return self._write(df) > 0

    def all(self) -> DataFrame:
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._schema)
        return self._spark.read.schema(f"{ddl}, round int").parquet(self._root)


# Rounds that are read from their folders beside the bucketed table; beyond, Spark lists folders by a job.
_LOOSE_ROUNDS = 32


class Rounds(Stages):
    """The rows settled so far by a breadth-first loop.

    A round asks which of the rows it reached are settled. Beyond ``limits.settled_rows`` rows
    the settled keys are therefore also kept in a bucketed table: the rows a round reached are
    dealt like its buckets by the aggregate that made them, so settled rows stay where they are
    and only the frontier moves. Up to that many rows, the folders are read as they are, also
    those of the rounds since the table was last added to: small rounds go to the table many at
    a time, else a long loop writes and reads a file a bucket and round. Results never depend
    on the bounds.
    ``by`` are the columns that settled rows are looked up by, all of ``keys`` if not given.
    """

    def __init__(
        self, first: DataFrame, name: str, keys: list[str], by: list[str] | None = None, limits: Limits = LIMITS
    ):
        self._keys, self._by, self._limit = keys, by or keys, limits.settled_rows
        self._index, self._loose, self._loose_rows = None, [], 0
        super().__init__(first, name)

    @property
    def indexed(self) -> bool:
        return self._index is not None

    def _write(self, df: DataFrame) -> int:
        n = super()._write(df)
        if n:
            self._loose.append(f"{self._root}/round={self.round}")
            self._loose_rows += n
            many = self.indexed and len(self._loose) > _LOOSE_ROUNDS
            if many or self._loose_rows > self._limit:
                rows = self._loose_keys() if self.indexed else self.all()
                self._index = self._index or f"strata_{uuid.uuid4().hex}"
                self._settle(rows)
                self._loose, self._loose_rows = [], 0
        return n

    def _loose_keys(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(*self._loose).select(*self._keys)

    def _settle(self, rows: DataFrame) -> None:
        """Append keys to the bucketed table; its files lie with the other intermediate tables."""
        # As many buckets as a shuffle has partitions, so an aggregate's output fits them.
        buckets = int(self._spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.select(*self._keys).repartition(buckets, *self._by)
        writer = dealt.write.format("parquet").mode("append").bucketBy(buckets, *self._by).sortBy(*self._by)
        writer.option("path", f"{self._root}-index").saveAsTable(self._index)

    def _settled_parts(self) -> list[DataFrame]:
        """The keys of all rounds: those bucketed by ``by`` once they are many, and the others."""
        if not self.indexed:
            return [self.all().select(*self._keys)]
        return [self._spark.table(self._index)] + ([self._loose_keys()] if self._loose else [])

    def settled(self, at: DataFrame | None = None) -> DataFrame:
        """The keys of all rounds; only those found in ``at`` by its columns, if given."""
        # Each part is looked up by itself, since a union would not be bucketed.
        parts = self._settled_parts()
        return reduce(DataFrame.unionByName, parts if at is None else [p.join(at, at.columns, "left_semi") for p in parts])

    def without_settled(self, df: DataFrame) -> DataFrame:
        for part in self._settled_parts():
            df = df.join(part, self._keys, "left_anti")
        return df

    def close(self) -> None:
        """Forget the bucketed table; the rounds stay readable."""
        if self._index is not None:
            self._spark.sql(f"DROP TABLE IF EXISTS {self._index}")
            self._index = None

    def __enter__(self) -> Rounds:
        return self

    def __exit__(self, *exc) -> None:
        self.close()
