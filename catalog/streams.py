"""Queries that run the tables through Structured Streaming and read the stores back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from strata.operators import graph
from strata.session import new_path
from strata.sources import wire
from strata.sources.streams import feeds, table_stream, wire_stream
from strata.streaming import ingest
from strata.streaming.names import NameDictionary
from strata.streaming.store import snapshot


def _folder(spark, df, name, files=4):
    """A feed directory of several files, so that a stream takes several batches."""
    path = new_path(spark, name)
    df.repartition(files).write.parquet(path)
    return path


def _run(spark, stream, sink, mode="append"):
    query = ingest.start(stream, sink, new_path(spark, "offsets"), every=None, mode=mode)
    query.awaitTermination()


def stream_relations(spark, sf):
    """Follow rows from wire text into a running store of distinct rows."""
    lines = wire.encode_wire(I.relations(spark, sf))
    path = new_path(spark, "feed")
    lines.repartition(4).write.text(path)
    stream = wire_stream(spark, path, "relations", max_files=1)
    store = ingest.distinct_store(spark, new_path(spark, "store"), stream.schema)
    _run(spark, stream, ingest.distinct_sink(store, compact_every=2))
    return store.read()


def stream_latest(spark, sf):
    """The latest use of every user, kept over micro-batches."""
    rows = I.uses(spark, sf).select("screen_name", "hashtag", "ts", "seq", "value")
    path = _folder(spark, rows, "feed")
    stream = table_stream(spark, path, rows.schema, max_files=1)
    keys, order = ["screen_name"], ["ts", "seq"]
    store = ingest.latest_store(spark, new_path(spark, "store"), rows.schema, keys, order)
    _run(spark, stream, ingest.upsert_sink(store, keys, order, compact_every=3))
    return store.read()


def stream_batches(spark, sf):
    """Per-batch distinct uses, one directory per batch, read back as one table."""
    rows = I.uses(spark, sf).select("screen_name", "hashtag", "time", "value")
    path = _folder(spark, rows, "feed")
    out = new_path(spark, "batches")
    stream = table_stream(spark, path, rows.schema, max_files=2)
    _run(spark, stream, ingest.distinct_batches(out))
    return spark.read.parquet(out).drop("batch").distinct()


def stream_daily_counts(spark, sf):
    """Windowed counts of a stream; updates are merged by (day, user, tag)."""
    rows = I.uses(spark, sf).select(
        F.col("ts").cast("timestamp").alias("ts"), "screen_name", "hashtag"
    )
    path = _folder(spark, rows, "feed")
    stream = table_stream(spark, path, rows.schema, max_files=2)
    counts = ingest.stream_daily_counts(stream, watermark="40 days")
    keys = ["day", "screen_name", "hashtag"]
    store = ingest.latest_store(spark, new_path(spark, "store"), counts.schema, keys, [])
    _run(spark, counts, ingest.upsert_sink(store, keys, ["uses"]), mode="update")
    return store.read().withColumn("day", F.col("day").cast("timestamp_ntz"))


def stream_distinct(spark, sf):
    """(user, tag, day) seen in the stream, de-duplicated within the watermark."""
    day = F.date_trunc("day", F.col("ts")).cast("timestamp")
    rows = I.uses(spark, sf).select(day.alias("ts"), "screen_name", "hashtag")
    path = _folder(spark, rows, "feed")
    stream = table_stream(spark, path, rows.schema, max_files=2)
    seen = ingest.distinct_stream(stream, ["ts", "screen_name", "hashtag"], "40 days")
    out = new_path(spark, "batches")
    _run(spark, seen, ingest.batch_sink(out, lambda batch: batch))
    return spark.read.parquet(out).select(
        F.col("ts").cast("timestamp_ntz").alias("day"), "screen_name", "hashtag"
    )


def _wire_folder(spark, df, files=3):
    path = new_path(spark, "feed")
    wire.encode_wire(df).repartition(files).write.text(path)
    return path


def _three_feeds(spark, sf):
    """Relations, tag uses and profiles as wire text, streamed into their three stores."""
    uses = I.uses(spark, sf).select(
        "screen_name", "hashtag", "time", F.col("seq").alias("quote_count"), *[F.lit(0).alias(c) for c in "abcd"],
        F.lit(True).alias("retweeted"), F.lit("low").alias("filter_level"), F.lit("line one,\nline: two").alias("text"),
    )
    people = I.profiles(spark, sf).select(
        "screen_name", "followers_count", "friends_count", F.lit(1).alias("listed_count"), F.lit(0).alias("time")
    )
    paths = [_wire_folder(spark, df) for df in (I.relations(spark, sf), uses, people)]
    relations, tag_uses, profiles = feeds(spark, *paths)
    names = ["screen_name"]
    pairs = ingest.distinct_store(spark, new_path(spark, "store"), relations.schema)
    latest = ingest.latest_store(spark, new_path(spark, "store"), profiles.schema, names, ["followers_count"])
    batches = new_path(spark, "batches")
    _run(spark, relations, ingest.distinct_sink(pairs))
    _run(spark, tag_uses, ingest.distinct_batches(batches))
    _run(spark, profiles, ingest.upsert_sink(latest, names, ["followers_count"]))
    return pairs.read(), spark.read.parquet(batches), latest.read()


def stream_feeds(spark, sf):
    """One run of all three feeds, read back from their stores."""
    pairs, uses, people = _three_feeds(spark, sf)
    shape = ["kind", "name", "other", "number"]
    return (
        pairs.select(F.lit("relation"), "user", "follower", F.lit(None).cast("int"))
        .union(uses.select(F.lit("use"), "screen_name", F.concat_ws("|", "hashtag", "text"), "quote_count"))
        .union(people.select(F.lit("profile"), "screen_name", F.lit(None), "followers_count"))
        .toDF(*shape)
    )


def stream_graph(spark, sf):
    """From the streamed stores to the follow graph: every known user with the degrees."""
    pairs, _, people = _three_feeds(spark, sf)
    vertices, edges = graph.follow_graph(pairs, people)
    return graph.attach_degrees(vertices, edges).select("screen_name", "followers_count", "out_degree", "in_degree")


def stream_live_graph(spark, sf):
    """The follow graph while relations and profiles still come in: at every look, both stores
    as of their last whole batch. Returned are the final degrees and whether no look has shown
    a user with more edges than there are in the end, or one who is not among the last."""
    people = I.profiles(spark, sf).select(
        "screen_name", "followers_count", "friends_count", F.lit(1).alias("listed_count"), F.lit(0).alias("time")
    )
    relations = wire_stream(spark, _wire_folder(spark, I.relations(spark, sf)), "relations", max_files=1)
    profiles = wire_stream(spark, _wire_folder(spark, people), "profiles", max_files=1)
    names, order = ["screen_name"], ["followers_count"]
    stores = {
        "pairs": ingest.distinct_store(spark, new_path(spark, "store"), relations.schema, buckets=8),
        "people": ingest.latest_store(spark, new_path(spark, "store"), profiles.schema, names, order, buckets=8),
    }
    looks = new_path(spark, "looks")

    def look():
        now = snapshot(stores)
        vertices, edges = graph.follow_graph(now["pairs"], now["people"])
        degrees = graph.attach_degrees(vertices, edges).select("screen_name", "out_degree", "in_degree")
        degrees.write.mode("append").parquet(looks)

    sinks = [
        (relations, ingest.distinct_sink(stores["pairs"], compact_every=2), new_path(spark, "offsets")),
        (profiles, ingest.upsert_sink(stores["people"], names, order, compact_every=2), new_path(spark, "offsets")),
    ]
    ingest.run_together(spark, sinks, look, every=None)
    most = spark.read.parquet(looks).groupBy("screen_name").agg(
        F.max("out_degree").alias("most_out"), F.max("in_degree").alias("most_in")
    )
    last = snapshot(stores)
    vertices, edges = graph.follow_graph(last["pairs"], last["people"])
    final = graph.attach_degrees(vertices, edges).select("screen_name", "out_degree", "in_degree")
    whole = (F.col("most_out") == F.col("out_degree")) & (F.col("most_in") == F.col("in_degree"))
    return final.join(most, "screen_name", "full").select(
        "screen_name", "out_degree", "in_degree", F.coalesce(whole, F.lit(False)).alias("never_more")
    )


def stream_names(spark, sf):
    """A kept dictionary that two loads of profiles add to, the second with names of the first;
    the follow graph's edges by its ids."""
    people, relations = I.profiles(spark, sf).drop("id"), I.relations(spark, sf)
    names = NameDictionary(spark, new_path(spark, "names"), buckets=8)
    names.add(people.where("verified"), 0)
    first = names.ids(people)
    names.compact()
    names.add(people, 1)
    ids = names.ids(people)
    _, edges = graph.follow_graph(relations, people, ids)
    users = ids.join(first.withColumnRenamed("id", "first_id"), "screen_name", "left")
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    return users.join(out, "id", "left").select(
        "screen_name", "id", "first_id", F.coalesce("out_degree", F.lit(0).cast("bigint")).alias("out_degree")
    )


def stream_latest_batches(spark, sf):
    """The latest use per user of every micro-batch; a batch is one month half here."""
    rows = I.uses(spark, sf).select("screen_name", "hashtag", "ts", "seq")
    path = new_path(spark, "feed")
    half = F.dayofmonth("ts") <= 15
    for part in (half, ~half):
        rows.where(part).coalesce(1).write.mode("append").parquet(path)
    out = new_path(spark, "batches")
    stream = table_stream(spark, path, rows.schema, max_files=1)
    _run(spark, stream, ingest.latest_batches(out, ["screen_name"], ["ts", "seq"]))
    return spark.read.parquet(out).select("screen_name", "hashtag", "ts", "seq", half.alias("first_half"))


def stream_late_rows(spark, sf):
    """Daily counts where the first days come last, far behind the watermark of one day.

    A batch's watermark is what the batches before the last one have seen, so the late file
    is the third.
    """
    rows = I.uses(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "screen_name", "hashtag")
    path = new_path(spark, "feed")
    day = F.dayofmonth("ts")
    for part in (day >= 20, day.between(10, 19), day < 10):
        rows.where(part).coalesce(1).write.mode("append").parquet(path)
    stream = table_stream(spark, path, rows.schema, max_files=1)
    counts = ingest.stream_daily_counts(stream, watermark="1 day")
    keys = ["day", "screen_name", "hashtag"]
    store = ingest.latest_store(spark, new_path(spark, "store"), counts.schema, keys, [])
    _run(spark, counts, ingest.upsert_sink(store, keys, ["uses"]), mode="update")
    return store.read().withColumn("day", F.col("day").cast("timestamp_ntz"))


QUERIES = {
    "stream_feeds": stream_feeds,
    "stream_graph": stream_graph,
    "stream_live_graph": stream_live_graph,
    "stream_names": stream_names,
    "stream_latest_batches": stream_latest_batches,
    "stream_late_rows": stream_late_rows,
    "stream_relations": stream_relations,
    "stream_latest": stream_latest,
    "stream_batches": stream_batches,
    "stream_daily_counts": stream_daily_counts,
    "stream_distinct": stream_distinct,
}

ORACLES = {
    "stream_feeds": f"""WITH {I.SQL_RELATIONS}, {I.SQL_USES}, {I.SQL_PROFILES}
SELECT DISTINCT 'relation' AS kind, "user" AS name, follower AS other, CAST(NULL AS INTEGER) AS number FROM relations
UNION ALL SELECT 'use', screen_name, hashtag || '|line one,' || chr(10) || 'line: two', CAST(seq AS INTEGER) FROM uses
UNION ALL SELECT 'profile', screen_name, NULL, followers_count FROM profiles""",
    "stream_graph": f"""WITH {I.SQL_FOLLOW}, {I.SQL_PROFILES}
SELECT screen_name, followers_count, (SELECT count(*) FROM follow WHERE src = id) AS out_degree,
  (SELECT count(*) FROM follow WHERE dst = id) AS in_degree FROM profiles""",
    "stream_live_graph": f"""WITH {I.SQL_FOLLOW}, {I.SQL_PROFILES}
SELECT screen_name, (SELECT count(*) FROM follow WHERE src = id) AS out_degree,
  (SELECT count(*) FROM follow WHERE dst = id) AS in_degree, true AS never_more FROM profiles""",
    "stream_names": f"""WITH {I.SQL_FOLLOW}, {I.SQL_PROFILES},
named AS (SELECT id AS key, screen_name, {I.SQL_NAME_ID.format("screen_name")} AS id, verified FROM profiles)
SELECT screen_name, id, CASE WHEN verified THEN id END AS first_id,
  (SELECT count(*) FROM follow JOIN profiles p ON p.id = dst WHERE src = key) AS out_degree FROM named""",
    "stream_latest_batches": f"""WITH {I.SQL_USES}
SELECT screen_name, hashtag, ts, seq, day(ts) <= 15 AS first_half FROM uses
QUALIFY row_number() OVER (PARTITION BY screen_name, day(ts) <= 15 ORDER BY ts DESC, seq DESC) = 1""",
    "stream_late_rows": f"""WITH {I.SQL_USES}
SELECT date_trunc('day', ts)::TIMESTAMP AS day, screen_name, hashtag, count(*) AS uses FROM uses
WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2, 3""",
    "stream_relations": f'WITH {I.SQL_RELATIONS} SELECT DISTINCT "user", follower FROM relations',
    "stream_latest": f"""WITH {I.SQL_USES}
SELECT screen_name, hashtag, ts, seq, value FROM uses
QUALIFY row_number() OVER (PARTITION BY screen_name ORDER BY ts DESC, seq DESC) = 1""",
    "stream_batches": f"WITH {I.SQL_USES} SELECT DISTINCT screen_name, hashtag, time, value FROM uses",
    "stream_daily_counts": f"""WITH {I.SQL_USES}
SELECT date_trunc('day', ts)::TIMESTAMP AS day, screen_name, hashtag, count(*) AS uses FROM uses GROUP BY 1, 2, 3""",
    "stream_distinct": f"""WITH {I.SQL_USES}
SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS day, screen_name, hashtag FROM uses""",
}
