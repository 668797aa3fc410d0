"""The running store: buckets rewritten, versions read while others are written, what is removed."""

import pathlib

import pytest

from strata.streaming import ingest
from strata.streaming.store import snapshot

SCHEMA = "name string, value double, seq bigint"


@pytest.fixture
def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def latest(spark, path, schema, **layout):
    return ingest.latest_store(spark, str(path), schema, ["name"], ["seq"], **layout)


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path, kind):
    return {str(p.relative_to(path)) for p in pathlib.Path(path, kind).rglob("*.parquet")}


def test_only_buckets_with_enough_open_rows_are_rewritten(spark, tmp_path, schema):
    store = latest(spark, tmp_path, schema, buckets=16, ratio=0.5)
    store.append(batch(spark, [(f"n{i}", 1.0, i) for i in range(400)]), 0)
    assert len(store.compact()) == 16
    before = files(tmp_path, "base")
    store.append(batch(spark, [("n7", 2.0, 1000)]), 1)
    assert store.compact() == [], "one row is far below half a bucket"
    store.append(batch(spark, [("n7", float(i), 1001 + i) for i in range(60)]), 2)
    assert len(store.compact()) == 1
    new = files(tmp_path, "base") - before
    assert len(new) == 1 and all("version=2" in name for name in new)
    got = {r["name"]: r["value"] for r in store.read().collect()}
    assert len(got) == 400 and got["n7"] == 59.0 and got["n8"] == 1.0


def test_old_open_rows_are_merged_too(spark, tmp_path, schema):
    store = latest(spark, tmp_path, schema, buckets=2, ratio=100.0, max_age=3)
    for n in range(5):
        store.append(batch(spark, [("a", float(n), n)] + [(f"x{i}", 0.0, 0) for i in range(9)]), n)
        assert bool(store.compact()) == (n in (0, 4)), "a first version, then one by age"
    assert ("a", 4.0, 4) in rows(store.read())


def test_a_version_reads_the_same_while_others_are_written(spark, tmp_path, schema):
    store = latest(spark, tmp_path, schema, buckets=4, ratio=0.0)
    store.append(batch(spark, [("a", 1.0, 1), ("b", 1.0, 1)]), 0)
    store.compact()
    store.append(batch(spark, [("a", 2.0, 2)]), 1)
    at, reader = store.version(), store.read()
    seen = rows(reader)
    store.append(batch(spark, [("a", 3.0, 3), ("c", 3.0, 3)]), 2)
    store.compact()
    store.remove_unused()
    assert rows(reader) == seen == rows(store.read(at)) == [("a", 2.0, 2), ("b", 1.0, 1)]
    assert rows(store.read()) == [("a", 3.0, 3), ("b", 1.0, 1), ("c", 3.0, 3)]


def test_what_no_kept_version_needs_is_removed(spark, tmp_path, schema):
    store = latest(spark, tmp_path, schema, buckets=4, ratio=0.0)
    for n in range(6):
        store.append(batch(spark, [(f"k{i}", float(n), n) for i in range(20)]), n)
        store.compact()
        store.remove_unused(keep=2)
    assert store._committed("manifest") == [4, 5] and store._committed("increment") == [5]
    assert {name.split("/")[1] for name in files(tmp_path, "base")} == {"version=4", "version=5"}
    assert rows(store.read()) == sorted([(f"k{i}", 5.0, 5) for i in range(20)], key=str)
    assert rows(store.read(4)) == sorted([(f"k{i}", 4.0, 4) for i in range(20)], key=str)


def test_open_increments_outlive_a_collection(spark, tmp_path, schema):
    store = latest(spark, tmp_path, schema, buckets=8, ratio=0.5)
    store.append(batch(spark, [(f"k{i}", 0.0, 0) for i in range(200)]), 0)
    store.compact()
    store.append(batch(spark, [("k3", 9.0, 9)]), 1)
    for n in range(2, 6):
        store.append(batch(spark, [("k5", float(i), 10 * n + i) for i in range(40)]), n)
        store.compact()
        store.remove_unused(keep=1)
    got = {r["name"]: r["value"] for r in store.read().collect()}
    assert got["k3"] == 9.0 and got["k5"] == 39.0 and len(got) == 200


def test_a_batch_repeated_after_its_compaction_and_half_written_files(spark, tmp_path, schema):
    store = latest(spark, tmp_path, schema, buckets=4, ratio=0.0)
    store.append(batch(spark, [("a", 1.0, 1)]), 0)
    store.compact()
    store.append(batch(spark, [("a", 1.0, 1)]), 0)
    assert store.compact() == [] and rows(store.read()) == [("a", 1.0, 1)]
    store.append(batch(spark, [("b", 1.0, 1)]), 1)
    pathlib.Path(tmp_path, "increment/batch_id=1/_SUCCESS").unlink()
    assert store.version() == 0 and rows(store.read()) == [("a", 1.0, 1)]


def test_null_and_signed_zero_keys(spark, tmp_path, schema):
    store = ingest.distinct_store(spark, str(tmp_path), schema, buckets=16, ratio=0.0)
    store.append(batch(spark, [(None, 0.0, None), ("a", None, 1)]), 0)
    store.compact()
    store.append(batch(spark, [(None, -0.0, None), ("a", None, 1)]), 1)
    store.compact()
    assert store.read().count() == 2


def test_snapshot_of_stores_that_go_on(spark, tmp_path, schema):
    stores = {n: latest(spark, tmp_path / n, schema, buckets=4, ratio=0.0) for n in ("one", "two")}
    for store in stores.values():
        store.append(batch(spark, [("a", 1.0, 1)]), 0)
    seen = snapshot(stores)
    stores["two"].append(batch(spark, [("a", 2.0, 2)]), 1)
    stores["two"].compact()
    assert rows(seen["one"]) == rows(seen["two"]) == [("a", 1.0, 1)]
    assert rows(snapshot(stores)["two"]) == [("a", 2.0, 2)]
