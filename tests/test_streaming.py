"""Streams in several batches give what one batch gives."""

import datetime as dt

import pytest

from strata.operators.records import daily_tag_counts, latest_per_key
from strata.sources.streams import table_stream, wire_stream
from strata.streaming import ingest
from strata.streaming.store import snapshot

USE = "screen_name string, hashtag string, ts timestamp, seq bigint"


@pytest.fixture
def uses(spark):
    at = [(f"u{i % 7}", "ab"[i % 2], dt.datetime(2024, 1, 1 + i % 5, i % 24), i) for i in range(200)]
    return spark.createDataFrame(at, USE)


def run(stream, sink, where, mode="append"):
    ingest.start(stream, sink, str(where), every=None, mode=mode).awaitTermination()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_running_distinct_store(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    for i, text in enumerate(["a,b:a,c:", "", "a,b:d,e:", "a,c:f,g:a,c:"]):
        (feed / f"{i}.txt").write_text(text)
    stream = wire_stream(spark, str(feed), "relations", max_files=1)
    store = ingest.distinct_store(spark, str(tmp_path / "store"), stream.schema)
    run(stream, ingest.distinct_sink(store, compact_every=2), tmp_path / "offsets")
    assert rows(store.read()) == [("a", "b"), ("a", "c"), ("d", "e"), ("f", "g")]
    assert store._committed("manifest"), "compaction has run"
    store.compact()
    assert rows(store.read()) == [("a", "b"), ("a", "c"), ("d", "e"), ("f", "g")]


def test_empty_store_reads_as_empty(spark, tmp_path, uses):
    store = ingest.distinct_store(spark, str(tmp_path / "none"), uses.schema)
    assert store.read().isEmpty() and store.read().columns == uses.columns


@pytest.mark.parametrize("compact_every", [1, 3, 100])
def test_latest_store_equals_one_batch(spark, tmp_path, uses, compact_every):
    uses.repartition(5).write.parquet(str(tmp_path / "feed"))
    stream = table_stream(spark, str(tmp_path / "feed"), uses.schema, max_files=1)
    keys, order = ["screen_name", "hashtag"], ["ts", "seq"]
    store = ingest.latest_store(spark, str(tmp_path / "store"), uses.schema, keys, order)
    run(stream, ingest.upsert_sink(store, keys, order, compact_every), tmp_path / "offsets")
    assert rows(store.read()) == rows(latest_per_key(uses, keys, order))


def test_a_repeated_batch_changes_nothing(spark, tmp_path, uses):
    keys, order = ["screen_name"], ["ts"]
    store = ingest.latest_store(spark, str(tmp_path / "store"), uses.schema, keys, order)
    sink = ingest.upsert_sink(store, keys, order, compact_every=2)
    sink(uses.where("seq < 100"), 0)
    sink(uses.where("seq >= 100"), 1)
    before = rows(store.read())
    sink(uses.where("seq >= 100"), 1)
    assert rows(store.read()) == before
    sink(uses.where("seq < 0"), 2)
    assert store._committed("increment") == [0, 1]


def test_batches_are_directories_and_empty_ones_are_skipped(spark, tmp_path, uses):
    sink = ingest.distinct_batches(str(tmp_path / "out"))
    sink(uses.union(uses), 0)
    sink(uses.where("seq < 0"), 1)
    ingest.latest_batches(str(tmp_path / "out"), ["screen_name"], ["seq"])(uses, 2)
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"batch=0", "batch=2"}
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("batch = 0").count() == 200 and got.where("batch = 2").count() == 7


def test_windowed_counts_equal_the_batch(spark, tmp_path, uses):
    uses.repartition(4).write.parquet(str(tmp_path / "feed"))
    stream = table_stream(spark, str(tmp_path / "feed"), uses.schema, max_files=1)
    counts = ingest.stream_daily_counts(stream, "30 days")
    keys = ["day", "screen_name", "hashtag"]
    store = ingest.latest_store(spark, str(tmp_path / "store"), counts.schema, keys, [])
    run(counts, ingest.upsert_sink(store, keys, ["uses"]), tmp_path / "offsets", mode="update")
    assert rows(store.read()) == rows(daily_tag_counts(uses))


def test_rows_past_the_watermark_are_dropped(spark, tmp_path):
    feed = tmp_path / "feed"
    for i, day in enumerate([1, 20, 21, 2]):
        at = [("u", "t", dt.datetime(2024, 1, day, 12), i)]
        spark.createDataFrame(at, USE).coalesce(1).write.mode("append").parquet(str(feed))
    stream = table_stream(spark, str(feed), spark.read.parquet(str(feed)).schema, max_files=1)
    counts = ingest.stream_daily_counts(stream, "1 day")
    keys = ["day", "screen_name", "hashtag"]
    store = ingest.latest_store(spark, str(tmp_path / "store"), counts.schema, keys, [])
    run(counts, ingest.upsert_sink(store, keys, ["uses"]), tmp_path / "offsets", mode="update")
    days = {r["day"].day for r in store.read().collect()}
    assert days == {1, 20, 21}, "the use of day 2 came after the watermark passed it"


def test_distinct_within_the_watermark(spark, tmp_path, uses):
    uses.select("ts", "screen_name").repartition(3).write.parquet(str(tmp_path / "feed"))
    schema = spark.read.parquet(str(tmp_path / "feed")).schema
    stream = table_stream(spark, str(tmp_path / "feed"), schema, max_files=1)
    seen = ingest.distinct_stream(stream, ["ts", "screen_name"], "30 days")
    run(seen, ingest.batch_sink(str(tmp_path / "out"), lambda b: b), tmp_path / "offsets")
    got = spark.read.parquet(str(tmp_path / "out")).select("ts", "screen_name")
    assert rows(got) == rows(uses.select("ts", "screen_name").distinct())


def test_looks_between_batches_see_whole_batches(spark, tmp_path):
    schema = spark.createDataFrame([], "name string, part int").schema
    feeds, stores = [], {}
    for feed in ("one", "two"):
        for part in range(4):
            at = [(f"{feed}{i}", part) for i in range(50)]
            spark.createDataFrame(at, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / feed))
        stores[feed] = ingest.distinct_store(spark, str(tmp_path / f"store-{feed}"), schema, buckets=4)
        stream = table_stream(spark, str(tmp_path / feed), schema, max_files=1)
        sink = ingest.distinct_sink(stores[feed], compact_every=2)
        feeds.append((stream, sink, str(tmp_path / f"offsets-{feed}")))
    looks = []

    def look():
        seen = snapshot(stores)
        looks.append({n: {r["part"]: r["count"] for r in d.groupBy("part").count().collect()} for n, d in seen.items()})

    ingest.run_together(spark, feeds, look, every=None, pause=0.1)
    assert len(looks) > 1, "at least one look while the feeds ran"
    assert all(set(parts.values()) <= {50} for seen in looks for parts in seen.values())
    for feed in stores:
        sizes = [len(seen[feed]) for seen in looks]
        assert sizes == sorted(sizes) and sizes[-1] == 4


def test_a_failing_feed_stops_the_others(spark, tmp_path, uses):
    uses.repartition(2).write.parquet(str(tmp_path / "feed"))
    stream = table_stream(spark, str(tmp_path / "feed"), uses.schema, max_files=1)

    def broken(batch, batch_id):
        raise ValueError("broken sink")

    feeds = [(stream, ingest.distinct_batches(str(tmp_path / "out")), str(tmp_path / "a")),
             (stream, broken, str(tmp_path / "b"))]
    with pytest.raises(Exception, match="broken sink"):
        ingest.run_together(spark, feeds, lambda: None, every="1 seconds", pause=0.2)
    assert not spark.streams.active
