"""Queries of the sources: wire text, stores, edge lists, JSON and LibSVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import inputs as I
from strata.functions import created_at_ms, escape_delimiters, unescape_delimiters
from strata.sources import edges as edge_sources
from strata.sources import sinks, store, tweets, wire
from strata.session import new_path


def _tag_use_rows(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return I.table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("screen_name"),
        F.col("event_type").alias("hashtag"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time"),
        k.alias("quote_count"),
        F.lit(0).alias("reply_count"),
        (k + 1).alias("retweet_count"),
        F.length("event_type").alias("favorite_count"),
        (F.col("value") > 50).alias("favorited"),
        (F.col("value") > 10).alias("retweeted"),
        F.lit("low").alias("filter_level"),
        F.concat_ws(", ", "event_type", "props").alias("text"),
    )


_SQL_TAG_USE_ROWS = """tag_use_rows AS (
  SELECT 'u' || user_id AS screen_name, event_type AS hashtag, epoch_us(ts) // 1000 AS time,
    CAST(props->>'$.k' AS INTEGER) AS quote_count, 0 AS reply_count, CAST(props->>'$.k' AS INTEGER) + 1 AS retweet_count,
    CAST(length(event_type) AS INTEGER) AS favorite_count, value > 50 AS favorited, value > 10 AS retweeted,
    'low' AS filter_level, event_type || ', ' || props AS text FROM events)"""


def wire_decode(spark, sf):
    return wire.decode_wire(wire.encode_wire(_tag_use_rows(spark, sf)), "tag_uses")


def wire_relations(spark, sf):
    # Two records per line and an empty one at its end.
    r = I.raw_follow(spark, sf)
    line = F.format_string("u%d,u%d:u%d,u%d:", "src", "dst", "dst", "src")
    return wire.decode_wire(r.select(line.alias("value")), "relations")


def wire_profiles(spark, sf):
    p = I.profiles(spark, sf).select(
        "screen_name",
        "followers_count",
        "friends_count",
        F.lit(1).alias("listed_count"),
        F.concat(F.col("id").cast("string"), F.lit("000.0")).alias("time"),
        F.lit(2).alias("favourites_count"),
        "verified",
        F.lit(3).alias("statuses_count"),
        F.lit(None).cast("string").alias("contributors_enabled"),
        F.lit(True).alias("default_profile"),
        F.lit(False).alias("default_profile_image"),
    )
    return wire.decode_wire(wire.encode_wire(p), "profiles")


def wire_key_value(spark, sf):
    lines = wire.encode_wire(I.relations(spark, sf))
    kv = wire.key_value(wire.records(lines))
    return kv.select("key", F.array_join("values", "|").alias("values"))


def store_tag_uses(spark, sf):
    rows = _tag_use_rows(spark, sf).drop("text")
    return store.parse_store(store.format_store(rows, "screen_name"), "tag_uses")


def store_tag_text(spark, sf):
    rows = _tag_use_rows(spark, sf).drop("time").withColumn(
        "text", escape_delimiters(F.col("text"))
    )
    return store.parse_store(store.format_store(rows, "screen_name"), "tag_uses_with_text")


def store_profiles(spark, sf):
    flag = F.col("verified")
    p = I.profiles(spark, sf).select(
        "screen_name",
        "followers_count",
        "friends_count",
        F.lit(1).alias("listed_count"),
        F.concat(F.col("id").cast("string"), F.lit("000.0")).alias("time"),
        F.lit(2).alias("favourites_count"),
        "time_zone",
        flag.alias("geo_enabled"),
        (~flag).alias("verified"),
        F.lit(3).alias("statuses_count"),
        *[flag.alias(f"flag_{i}") for i in range(8)],
        F.lit("none").alias("translator_type"),
    )
    return store.parse_store(store.format_store(p, "screen_name"), "profiles")


def store_relations(spark, sf):
    return store.parse_store(store.format_store(I.relations(spark, sf), "user"), "relations")


def edge_list(spark, sf):
    """Edge files with comment lines, written and read back."""
    lines = I.follow(spark, sf).select(F.concat_ws(" \t", "src", "dst").alias("value"))
    notes = I.table(spark, sf, "nation").select(F.concat(F.lit("# "), F.col("n_name")).alias("value"))
    path = new_path(spark, "edge-list")
    lines.unionByName(notes).write.text(path)
    return edge_sources.read_edges(spark, path, comment="#")


def _statuses(spark, sf):
    e = I.table(spark, sf, "events").join(
        I.table(spark, sf, "customer"), F.col("user_id") == F.col("c_custkey")
    )
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.struct(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("screen_name"),
        F.floor("c_acctbal").cast("int").alias("followers_count"),
        F.col("c_nationkey").alias("friends_count"),
        F.lit(0).alias("listed_count"),
        F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("created_at"),
        k.alias("favourites_count"),
        (F.col("c_acctbal") > 5000).alias("verified"),
        F.lit(7).alias("statuses_count"),
        F.lit(False).alias("contributors_enabled"),
        F.lit(True).alias("default_profile"),
        F.lit(False).alias("default_profile_image"),
    )
    tags = F.array(
        F.struct(F.initcap("event_type").alias("text")), F.struct(F.upper("c_mktsegment").alias("text"))
    )
    control = F.when(F.col("event_type") == "error", F.struct(F.lit(1).alias("track")))
    status = F.struct(
        F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("timestamp_ms"),
        F.concat_ws(": ", "event_type", "props").alias("text"),
        k.alias("quote_count"),
        F.lit(0).alias("reply_count"),
        F.lit(1).alias("retweet_count"),
        F.lit(2).alias("favorite_count"),
        (F.col("value") > 50).alias("favorited"),
        F.lit(False).alias("retweeted"),
        F.lit("low").alias("filter_level"),
        F.struct(tags.alias("hashtags")).alias("entities"),
        user.alias("user"),
        control.alias("limit"),
    )
    return e.select(F.to_json(status).alias("value"))


def json_extract(spark, sf):
    return tweets.tag_uses(tweets.parse_tweets(_statuses(spark, sf)))


def tweet_profiles(spark, sf):
    return tweets.author_profiles(tweets.parse_tweets(_statuses(spark, sf)))


def follower_pages(spark, sf):
    """Follower pages of up to a dozen users to follow edges and profiles."""
    c = I.table(spark, sf, "customer")
    user = F.struct(
        F.concat(F.lit("u"), F.col("dst").cast("string")).alias("screen_name"),
        F.col("c_nationkey").alias("followers_count"),
        F.lit("Wed Oct 10 20:19:24 +0000 2018").alias("created_at"),
    )
    ranked = Window.partitionBy("src").orderBy("dst")
    pages = (
        I.follow(spark, sf)
        .join(c, F.col("dst") == F.col("c_custkey"))
        .withColumn("page", F.floor((F.row_number().over(ranked) - 1) / 12))
        .groupBy("src", "page")
        .agg(F.collect_list(user).alias("users"))
    )
    page = F.struct(
        F.concat(F.lit("u"), F.col("src").cast("string")).alias("author"),
        (F.col("page") + 1).alias("next_cursor"),
        "users",
    )
    lines = pages.select(F.to_json(page).alias("value"))
    followers = tweets.parse_follower_pages(lines)
    edges = tweets.follower_relations(followers)
    found = (
        tweets.follower_profiles(followers)
        .select(F.col("screen_name").alias("follower"), "followers_count", "time")
        .distinct()
    )
    return edges.join(found, "follower").select("user", "follower", "followers_count", "time")


def created_at(spark, sf):
    o = I.table(spark, sf, "orders")
    text = F.date_format("o_orderdate", "EEE MMM dd HH:mm:ss '+0000' yyyy")
    return o.select("o_orderkey", created_at_ms(text).alias("time"))


def escape_text(spark, sf):
    escaped = escape_delimiters(F.col("text"))
    return I.table(spark, sf, "documents").select(
        "doc_id",
        F.md5(escaped).alias("escaped_md5"),
        F.md5(unescape_delimiters(escaped)).alias("restored_md5"),
    )


def tracked_tags(spark, sf):
    """Page links as tags, the words of the benchmark texts as the tracked list."""
    words = I.table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("value"))
    links = I.page_links(spark, sf).select(
        F.col("page_id").alias("id"), F.ltrim(F.col("href"), F.lit("/")).alias("hashtag")
    )
    return tweets.only_tracked(links, edge_sources.tracked_tags(words)).select("id", "hashtag")


def libsvm_source(spark, sf):
    c = I.table(spark, sf, "customer")
    vector = array_to_vector(
        F.array(F.col("c_nationkey").cast("double"), F.col("c_custkey").cast("double"), F.lit(1.0))
    )
    path = new_path(spark, "libsvm")
    c.select(F.col("c_acctbal").alias("label"), vector.alias("features")).write.format("libsvm").save(path)
    values = vector_to_array("features")
    return edge_sources.read_libsvm(spark, path, 3).select(
        "label",
        F.get(values, F.lit(0)).cast("bigint").alias("nation"),
        F.get(values, F.lit(1)).cast("bigint").alias("custkey"),
    )


def graph_payload(spark, sf):
    people = I.people(spark, sf).select("id", "name")
    return sinks.graph_payload(people, I.follow(spark, sf), I.uses(spark, sf))


def graph_payload_predictions(spark, sf):
    """The payload with scores: here a use's largest value rounded, per user and tag."""
    people = I.people(spark, sf).select("id", "name")
    uses = I.uses(spark, sf)
    scores = uses.groupBy("id", "hashtag").agg(F.ceil(F.max("value")).alias("prediction"))
    return sinks.graph_payload(people, I.follow(spark, sf), uses, scores)


QUERIES = {
    "wire_decode": wire_decode,
    "wire_relations": wire_relations,
    "wire_profiles": wire_profiles,
    "wire_key_value": wire_key_value,
    "store_tag_uses": store_tag_uses,
    "store_tag_text": store_tag_text,
    "store_profiles": store_profiles,
    "store_relations": store_relations,
    "edge_list": edge_list,
    "json_extract": json_extract,
    "tweet_profiles": tweet_profiles,
    "follower_pages": follower_pages,
    "created_at": created_at,
    "escape_text": escape_text,
    "tracked_tags": tracked_tags,
    "libsvm_source": libsvm_source,
    "graph_payload": graph_payload,
    "graph_payload_predictions": graph_payload_predictions,
}

_SQL_PAYLOAD = f"""{I.SQL_FOLLOW}, {I.SQL_USES},
linked AS (SELECT src AS id FROM follow UNION SELECT dst FROM follow),
nodes AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (SELECT id FROM linked)),
payload AS (
  SELECT 'node' AS kind, CAST(json_object('id', id, 'name', name) AS VARCHAR) AS payload FROM nodes
  UNION ALL SELECT 'use', CAST(json_object('id', id, 'hashtag', hashtag, 'time', time, 'uses', count(*)) AS VARCHAR)
  FROM uses WHERE id IN (SELECT id FROM nodes) GROUP BY id, hashtag, time
  UNION ALL SELECT 'link', CAST(json_object('source', src, 'target', dst) AS VARCHAR) FROM follow)"""

ORACLES = {
    "wire_decode": f"WITH {_SQL_TAG_USE_ROWS} SELECT * FROM tag_use_rows",
    "wire_relations": f"""WITH {I.SQL_RELATIONS}
SELECT "user", follower FROM relations UNION ALL SELECT follower, "user" FROM relations""",
    "wire_profiles": f"""WITH {I.SQL_PROFILES}
SELECT screen_name, followers_count, friends_count, 1 AS listed_count, id * 1000 AS time, 2 AS favourites_count,
  verified, 3 AS statuses_count, false AS contributors_enabled, true AS default_profile, false AS default_profile_image
FROM profiles""",
    "wire_key_value": f"""WITH {I.SQL_RELATIONS}
SELECT "user" AS key, follower || '|' AS "values" FROM relations""",
    "store_tag_uses": f"WITH {_SQL_TAG_USE_ROWS} SELECT * EXCLUDE (text) FROM tag_use_rows",
    "store_tag_text": f"""WITH {_SQL_TAG_USE_ROWS}
SELECT * EXCLUDE (time, text), replace(replace(text, ':', 'U+003A'), ',', 'U+002C') AS text FROM tag_use_rows""",
    "store_profiles": f"""WITH {I.SQL_PROFILES}
SELECT screen_name, followers_count, friends_count, 1 AS listed_count, id * 1000 AS time, 2 AS favourites_count, time_zone,
  verified AS geo_enabled, NOT verified AS verified, 3 AS statuses_count, verified AS contributors_enabled,
  verified AS is_translator, verified AS profile_use_background_image, verified AS default_profile,
  verified AS default_profile_image, verified AS following, verified AS follow_request_sent, verified AS notifications,
  'none' AS translator_type FROM profiles""",
    "store_relations": f'WITH {I.SQL_RELATIONS} SELECT "user", follower FROM relations',
    "edge_list": f"WITH {I.SQL_FOLLOW} SELECT src, dst, 1 AS weight FROM follow",
    "json_extract": """SELECT 'u' || user_id AS screen_name, tag AS hashtag, epoch_us(ts) // 1000 AS time,
  CAST(props->>'$.k' AS INTEGER) AS quote_count, 0 AS reply_count, 1 AS retweet_count, 2 AS favorite_count,
  value > 50 AS favorited, false AS retweeted, 'low' AS filter_level, event_type || ': ' || props AS text
FROM (SELECT *, unnest([event_type, lower(c_mktsegment)]) AS tag FROM events JOIN customer ON c_custkey = user_id
  WHERE event_type <> 'error')""",
    "tweet_profiles": """SELECT 'u' || user_id AS screen_name, CAST(floor(c_acctbal) AS INTEGER) AS followers_count,
  c_nationkey AS friends_count, 0 AS listed_count, epoch_ms(date_trunc('second', ts)) AS time,
  CAST(props->>'$.k' AS INTEGER) AS favourites_count, c_acctbal > 5000 AS verified, 7 AS statuses_count,
  false AS contributors_enabled, true AS default_profile, false AS default_profile_image
FROM events JOIN customer ON c_custkey = user_id WHERE event_type <> 'error'""",
    "follower_pages": f"""WITH {I.SQL_FOLLOW}
SELECT 'u' || src AS "user", 'u' || dst AS follower, c_nationkey AS followers_count,
  CAST(1539202764000 AS BIGINT) AS time FROM follow JOIN customer ON c_custkey = dst""",
    "created_at": "SELECT o_orderkey, epoch_ms(o_orderdate) AS time FROM orders",
    "escape_text": """SELECT doc_id,
  md5(replace(replace(replace(replace(text, ':', 'U+003A'), ',', 'U+002C'), chr(10), 'U+000A'), chr(13), 'U+000D')) AS escaped_md5,
  md5(text) AS restored_md5 FROM documents""",
    "tracked_tags": f"""WITH {I.SQL_PAGE_LINKS}, tags AS (
  SELECT DISTINCT lower(unnest(string_split(text, ' '))) AS hashtag FROM benchmark)
SELECT page_id AS id, lower(ltrim(href, '/')) AS hashtag FROM page_links
WHERE lower(ltrim(href, '/')) IN (SELECT hashtag FROM tags WHERE hashtag <> '')""",
    "libsvm_source": """SELECT c_acctbal AS label, CAST(c_nationkey AS BIGINT) AS nation, c_custkey AS custkey
FROM customer""",
    "graph_payload": f"""WITH {_SQL_PAYLOAD}
SELECT * FROM payload""",
    "graph_payload_predictions": f"""WITH {_SQL_PAYLOAD}
SELECT * FROM payload
UNION ALL SELECT 'prediction', CAST(json_object('id', id, 'hashtag', hashtag, 'prediction', CAST(ceil(max(value)) AS BIGINT)) AS VARCHAR)
FROM uses WHERE id IN (SELECT id FROM nodes) GROUP BY id, hashtag""",
}
