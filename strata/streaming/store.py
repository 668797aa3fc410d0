"""A growing store kept by micro-batches: appended increments over a base laid out by key.

Each micro-batch writes one increment named by its batch id; writing it again replaces it,
so a retried batch changes nothing. Rows lie in buckets by a hash of their key. A compaction
merges increments into the base bucket by bucket, and only where enough has come in, so a
row is rewritten about as often as its bucket doubles, however large the store is. A manifest
says which version of each bucket counts and up to which batch it is merged; like increments,
it counts once its success marker is there. Readers of a manifest see its buckets and the
batches behind them, whatever is compacted meanwhile, until ``remove_unused`` drops it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

_MANIFEST = "store_bucket int, version bigint, upto bigint, rows bigint"


def _per_bucket(df: DataFrame) -> list:
    """The rows of a table that has one per bucket (or per open batch), gathered in one row: its
    size is bounded by the store's layout and never grows with the rows stored."""
    return df.agg(F.collect_list(F.struct(*df.columns)).alias("found")).first()["found"]


class Store:
    """``merge`` turns all stored rows (column ``batch_id`` added) into the current rows; it must
    be idempotent, such as distinct or latest per key, and rows of different ``keys`` must not
    meet in it. ``keys`` are compared by value, null like any other, -0.0 like 0.0.

    A bucket is merged once its open rows reach ``ratio`` of its base, or the oldest of them is
    ``max_age`` batches old. The manifest has a row per bucket, so its size is bounded by
    ``buckets``, which a store keeps for life: choose it by the size that the store may reach.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: StructType,
        merge: Callable[[DataFrame], DataFrame],
        keys: Sequence[str],
        buckets: int = 64,
        ratio: float = 0.25,
        max_age: int = 1000,
    ):
        self._spark = spark
        self._path = path.rstrip("/")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self._names = schema.names
        self._base_schema = f"{fields}, batch_id bigint, store_bucket int, version bigint"
        self._increment_schema = f"{fields}, batch_id bigint, store_bucket int"
        self._stored = [*self._names, "batch_id"]
        self._merge = merge
        self._buckets, self._ratio, self._max_age = buckets, ratio, max_age
        self._bucket = F.pmod(F.xxhash64(*[self._comparable(schema, k) for k in keys]), F.lit(buckets)).cast("int")

    @staticmethod
    def _comparable(schema: StructType, name: str) -> Column:
        floating = isinstance(schema[name].dataType, (DoubleType, FloatType))
        column = F.col(f"`{name}`")
        return column + F.lit(0.0) if floating else column

    def _folder(self, kind: str):
        folder = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{kind}")
        return folder, folder.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())

    def _committed(self, kind: str) -> list[int]:
        """The numbers of the increments, or manifests, that count."""
        folder, fs = self._folder(kind)
        if not fs.exists(folder):
            return []
        found = []
        for status in fs.listStatus(folder):
            part = status.getPath()
            if fs.exists(self._spark._jvm.org.apache.hadoop.fs.Path(part, "_SUCCESS")):
                found.append(int(part.getName().split("=")[1]))
        return sorted(found)

    def append(self, batch: DataFrame, batch_id: int) -> None:
        # A file per bucket and batch; a prepared batch has a row per key, so buckets are even.
        rows = batch.select(*self._names).withColumn("store_bucket", self._bucket).repartition("store_bucket")
        rows.write.mode("overwrite").partitionBy("store_bucket").parquet(f"{self._path}/increment/batch_id={batch_id}")

    def version(self) -> int:
        """The newest batch that counts, -1 if there is none: all that ``read(at)`` needs to
        give the same rows later on."""
        return max([-1, *self._committed("increment"), *self._committed("manifest")])

    def _manifest(self, at: int) -> dict[int, tuple[int, int, int]]:
        """bucket -> (version, upto, rows) of the newest manifest up to batch ``at``."""
        numbers = [n for n in self._committed("manifest") if n <= at]
        if not numbers:
            return {}
        table = self._spark.read.schema(_MANIFEST).parquet(f"{self._path}/manifest/n={numbers[-1]}")
        return {r["store_bucket"]: (r["version"], r["upto"], r["rows"]) for r in _per_bucket(table)}

    def _base(self, manifest: dict) -> DataFrame | None:
        paths = [f"{self._path}/base/version={v}/store_bucket={b}" for b, (v, _, _) in sorted(manifest.items())]
        if not paths:
            return None
        reader = self._spark.read.schema(self._base_schema).option("basePath", f"{self._path}/base")
        return reader.parquet(*paths).select(*self._stored, "store_bucket")

    def _open(self, manifest: dict, at: int) -> DataFrame | None:
        """Rows of batches up to ``at`` that their bucket does not have in its base yet."""
        merged = min((upto for _, upto, _ in manifest.values()), default=-1)
        # A bucket without a base has nothing merged.
        least = -1 if len(manifest) < self._buckets else merged
        numbers = [n for n in self._committed("increment") if least < n <= at]
        if not numbers:
            return None
        paths = [f"{self._path}/increment/batch_id={n}" for n in numbers]
        reader = self._spark.read.schema(self._increment_schema).option("basePath", f"{self._path}/increment")
        rows = reader.parquet(*paths).select(*self._stored, "store_bucket")
        by_upto: dict[int, list[int]] = {}
        for bucket, (_, upto, _) in manifest.items():
            by_upto.setdefault(upto, []).append(bucket)
        done = F.lit(False)
        for upto, buckets in by_upto.items():
            done = done | (F.col("store_bucket").isin(buckets) & (F.col("batch_id") <= upto))
        return rows.where(~done)

    def read(self, at: int | None = None, like: DataFrame | None = None) -> DataFrame:
        """The current rows, or those up to batch ``at``. Buckets without open rows are read as
        they lie; only the others are merged. With ``like``, rows that have the key columns, only
        the buckets that these rows' keys fall into are read."""
        at = self.version() if at is None else at
        manifest = self._manifest(at)
        fresh = self._open(manifest, at)
        if like is not None:
            near = {r[0] for r in _per_bucket(like.select(self._bucket.alias("store_bucket")).distinct())}
            manifest = {b: m for b, m in manifest.items() if b in near}
            fresh = None if fresh is None else fresh.where(F.col("store_bucket").isin(sorted(near)))
        parts = []
        touched = set() if fresh is None else self._counts(fresh).keys()
        settled = self._base({b: m for b, m in manifest.items() if b not in touched})
        if settled is not None:
            parts.append(settled.select(*self._names))
        if touched:
            parts.append(self._merged(fresh, manifest, touched).select(*self._names))
        if not parts:
            ddl = self._increment_schema
            return self._spark.createDataFrame([], ddl).select(*self._names)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _counts(self, fresh: DataFrame) -> dict[int, tuple[int, int]]:
        """bucket -> (open rows, oldest open batch); a row per bucket comes to the driver."""
        counted = fresh.groupBy("store_bucket").agg(F.count(F.lit(1)).alias("n"), F.min("batch_id").alias("oldest"))
        return {r["store_bucket"]: (r["n"], r["oldest"]) for r in _per_bucket(counted)}

    def _merged(self, fresh: DataFrame, manifest: dict, buckets) -> DataFrame:
        rows = fresh.where(F.col("store_bucket").isin(sorted(buckets))).select(*self._stored)
        base = self._base({b: m for b, m in manifest.items() if b in buckets})
        if base is not None:
            rows = rows.unionByName(base.select(*self._stored))
        return self._merge(rows).select(*self._stored)

    def compact(self, everything: bool = False) -> list[int]:
        """Merge the buckets that are due, or all with open rows, into a new version named by the
        newest batch. Returns them."""
        at = self.version()
        if at in self._committed("manifest"):
            return []
        manifest = self._manifest(at)
        fresh = self._open(manifest, at)
        if fresh is None:
            return []
        due = [
            bucket
            for bucket, (n, oldest) in self._counts(fresh).items()
            if everything
            or n >= self._ratio * manifest.get(bucket, (0, 0, 0))[2]
            or oldest <= at - self._max_age
        ]
        if not due:
            return []
        merged = self._merged(fresh, manifest, due).withColumn("store_bucket", self._bucket)
        # One task writes a bucket, so a bucket is one file; merged keys are distinct, so even.
        base = f"{self._path}/base/version={at}"
        merged.repartition("store_bucket").write.mode("overwrite").partitionBy("store_bucket").parquet(base)
        written = self._spark.read.schema(self._increment_schema).parquet(base)
        sizes = {r["store_bucket"]: r["count"] for r in _per_bucket(written.groupBy("store_bucket").count())}
        kept = [(b, *m) for b, m in manifest.items() if b not in sizes]
        rows = kept + [(b, at, at, n) for b, n in sizes.items()]
        self._spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(
            f"{self._path}/manifest/n={at}"
        )
        return sorted(sizes)

    def remove_unused(self, keep: int = 2) -> None:
        """Remove what only manifests before the newest ``keep`` need: their own files, bucket
        versions that no kept one names, and increments that every bucket of the oldest kept one
        has merged. A reader of a removed manifest fails; it never sees other rows."""
        manifests = self._committed("manifest")
        if len(manifests) <= keep:
            return
        kept = [self._manifest(n) for n in manifests[-keep:]]
        first = manifests[-keep]
        used = {(v, b) for m in kept for b, (v, _, _) in m.items()}
        path = self._spark._jvm.org.apache.hadoop.fs.Path
        for n in manifests[:-keep]:
            folder, fs = self._folder(f"manifest/n={n}")
            fs.delete(folder, True)
        folder, fs = self._folder("base")
        for version in fs.listStatus(folder):
            number = int(version.getPath().getName().split("=")[1])
            if number > manifests[-1]:
                continue
            for part in fs.listStatus(version.getPath()):
                name = part.getPath().getName()
                if name.startswith("store_bucket=") and (number, int(name.split("=")[1])) not in used:
                    fs.delete(path(f"{self._path}/base/version={number}/{name}"), True)
        fresh = self._open(kept[0], first)
        still = set() if fresh is None else {r[0] for r in _per_bucket(fresh.select("batch_id").distinct())}
        for n in self._committed("increment"):
            if n <= first and n not in still:
                folder, fs = self._folder(f"increment/batch_id={n}")
                fs.delete(folder, True)


def snapshot(stores: dict[str, Store]) -> dict[str, DataFrame]:
    """The rows of several stores while batches go on: each store at the newest batch that
    counts, all versions taken before anything is read. No store shows half a batch."""
    versions = {name: store.version() for name, store in stores.items()}
    return {name: stores[name].read(at) for name, at in versions.items()}
