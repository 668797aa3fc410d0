"""Queries of joins, aggregates, per-vertex operators and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from strata.functions import keys as K
from strata.operators import components, graph, records
from strata.plans import features

_TAG = "click"


def distinct_edges(spark, sf):
    return graph.distinct_edges(I.raw_follow(spark, sf))


def latest_per_key(spark, sf):
    rows = I.uses(spark, sf).select("screen_name", "ts", "seq", "hashtag", "value")
    return records.latest_per_key(rows, ["screen_name"], ["ts", "seq"])


def first_per_key(spark, sf):
    rows = I.uses(spark, sf).select("screen_name", "hashtag", "ts", "seq", "value")
    return records.first_per_key(rows, ["screen_name", "hashtag"], ["ts", "seq"])


def tag_times(spark, sf):
    return records.tag_times(I.uses(spark, sf), "screen_name", "hashtag", "time")


def user_tag_join(spark, sf):
    joined = records.user_tag_join(
        I.profiles(spark, sf).drop("id"), I.uses(spark, sf).select("screen_name", "hashtag", "time", "seq")
    )
    return joined.select(
        "screen_name", "hashtag", "time", "seq", "followers_count", "friends_count", "time_zone", "verified"
    )


def resolve_edges(spark, sf):
    """Follow rows between users who used a tag, as ids."""
    ids = graph.surrogate_ids(I.uses(spark, sf))
    return graph.resolve_edges(I.relations(spark, sf), ids)


def follow_graph(spark, sf):
    v, e = graph.follow_graph(
        I.relations(spark, sf), I.profiles(spark, sf).withColumnRenamed("id", "custkey")
    )
    deg = graph.attach_degrees(v, e)
    return deg.select("id", "screen_name", "out_degree", "in_degree")


def ego_network(spark, sf):
    """Uses of the tag by the most followed user and the followers."""
    relations = I.relations(spark, sf).distinct()
    user = relations.groupBy("user").count().orderBy(F.desc("count"), "user").first()["user"]
    net = records.ego_network(
        relations,
        I.uses(spark, sf).select("screen_name", "hashtag", "time", "seq").withColumnRenamed("seq", "use"),
        I.profiles(spark, sf).drop("id"),
        user.upper(),
        _TAG.upper(),
    )
    return net.select("label", "screen_name", "hashtag", "time", "use", "followers_count", "time_zone")


def degrees(spark, sf):
    return graph.attach_degrees(I.vertices(spark, sf), I.follow(spark, sf))


def important_degree(spark, sf):
    return graph.important(graph.degrees(I.follow(spark, sf)), 5).select("id", "out_degree")


def isolated(spark, sf):
    """Customers that follow nobody and are not followed among those who used a tag."""
    users = I.uses(spark, sf).select("id").distinct()
    return graph.isolated(I.vertices(spark, sf), graph.edges_within(I.follow(spark, sf), users))


def induced_subgraph(spark, sf):
    _, edges = graph.induced(
        I.people(spark, sf), I.follow(spark, sf), F.col("nation").between(0, 9)
    )
    return edges


def marked_edges(spark, sf):
    marked = I.weighted_follow(spark, sf).withColumn("marked", F.col("weight") <= 2)
    return marked.where("marked").select("src", "dst", "weight")


def neighbor_sets(spark, sf):
    return graph.neighbor_sets(I.raw_follow(spark, sf))


def neighbor_attributes(spark, sf):
    seen = graph.neighbor_attributes(I.people(spark, sf), I.follow(spark, sf), "out")
    back = graph.neighbor_attributes(I.people(spark, sf), I.follow(spark, sf), "in")
    return seen.withColumn("side", F.lit("out")).unionByName(back.withColumn("side", F.lit("in")))


def triplets(spark, sf):
    return graph.triplets(I.people(spark, sf), I.follow(spark, sf)).select(
        "src", "src_name", "src_nation", "dst", "dst_name", "dst_nation"
    )


def default_vertices(spark, sf):
    known = I.profiles(spark, sf).where("verified").select("id", "time_zone", "followers_count")
    return graph.with_defaults(
        known, I.follow(spark, sf), {"time_zone": "None", "followers_count": 0}
    )


def symmetrize(spark, sf):
    return graph.symmetrize(I.follow(spark, sf))


def sample_vertices(spark, sf):
    v = I.vertices(spark, sf)
    kept, edges = graph.sample_vertices(v, I.follow(spark, sf), 500, seed=7)
    return graph.attach_degrees(kept, edges).select("id", "out_degree", "in_degree")


def sample_landmarks(spark, sf):
    return graph.sample_landmarks(I.vertices(spark, sf), 10, seed=0)


def topk_degree(spark, sf):
    return graph.top_degree(graph.degrees(I.follow(spark, sf)), 25).select("id", "degree")


def aggregate_messages(spark, sf):
    """Per vertex over both directions: messages, sum and extremes of the senders' nations."""
    return graph.aggregate_messages(
        I.people(spark, sf),
        I.follow(spark, sf),
        [
            F.count("msg").alias("messages"),
            F.sum("msg").alias("nation_sum"),
            F.min("msg").alias("nation_min"),
            F.max("msg").alias("nation_max"),
        ],
        to_src=F.col("dst_nation"),
        to_dst=F.when(F.col("src_nation") > 4, F.col("src_nation")),
    )


def available_edges(spark, sf):
    """Follow edges without those inside one region."""
    labels = I.geo(spark, sf).select("id", F.col("key_0").alias("component"))
    edges = I.follow(spark, sf)
    return components.available_edges(edges, components.within_components(edges, labels))


def asof_recency(spark, sf):
    return records.asof_recency(I.uses(spark, sf), "2024-01-25 12:00:00").select(
        "screen_name", "hashtag", "last_use", "days_ago", "shown"
    )


def tag_eligible(spark, sf):
    cutoff_ms = 1_704_931_200_000  # 2024-01-11
    return records.tag_recency_eligible(I.uses(spark, sf), cutoff_ms)


def prediction_buckets(spark, sf):
    """The display rule over event values as predictions."""
    p = I.uses(spark, sf).select("seq", "hashtag", (F.col("value") / 25 - 0.2).alias("prediction"))
    return records.prediction_buckets(p).select("seq", "hashtag", "shown", "bucket")


def daily_tag_counts(spark, sf):
    return records.daily_tag_counts(I.uses(spark, sf))


def tag_features(spark, sf):
    rows = features.tag_features(
        I.uses(spark, sf), I.follow(spark, sf), I.profiles(spark, sf), I.BEGIN, I.AS_OF
    )
    return rows.select(
        "id", "hashtag", "cutoff", "label", "num_tweets", "num_user_relations", "followers_count", "time_zone"
    )


def without_self_edges(spark, sf):
    """Customers of neighbouring orders, less those who ordered twice in a row."""
    orders = I.table(spark, sf, "orders")
    first = orders.select((F.col("o_orderkey") + 1).alias("k"), F.col("o_custkey").alias("src"))
    pairs = first.join(orders.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 10).alias("dst")), "k")
    return graph.without_self_edges(pairs.select(F.col("src") % 10, "dst").toDF("src", "dst"))


def score_features(spark, sf):
    rows = features.score_features(
        I.uses(spark, sf), I.follow(spark, sf), I.profiles(spark, sf), I.SCORE_AS_OF
    )
    return rows.select("id", "hashtag", "num_tweets", "num_user_relations", "followers_count", "time_zone")


# Keys for the column functions: two per line item, -1 where a level is not assigned.
def _keys(spark, sf):
    li = I.table(spark, sf, "lineitem")
    big = F.col("l_linenumber").cast("bigint")
    a = F.array(big, F.col("l_suppkey") % 3, F.col("l_partkey") % 3, F.col("l_partkey") % 3)
    b = F.array(F.col("l_orderkey") % 2, F.col("l_suppkey") % 3 - 1, F.col("l_partkey") % 2 - 1, big)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", a.alias("a"), b.alias("b"))


_ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _text(column, name):
    return F.array_join(column, ",").alias(name)


def key_level(spark, sf):
    return _keys(spark, sf).select(
        *_ROW,
        K.key_level(F.col("a")).alias("level_a"),
        K.key_level(F.col("b")).alias("level_b"),
        K.was_clustered(F.col("a")).alias("clustered"),
    )


def key_merge(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _keys(spark, sf).select(
        *_ROW,
        _text(K.key_merge(a, b), "merged"),
        _text(K.slot_update(b, a), "updated"),
        _text(K.slot_merge(a, b), "slots"),
    )


def state_update(spark, sf):
    def state(degree, flag, key):
        return F.struct(F.col(degree).alias("degree"), flag.alias("flag"), key.alias("key"))

    unset = F.array_repeat(F.lit(-1).cast("bigint"), 4)
    b = F.when(F.col("l_linenumber") == 1, unset).otherwise(F.col("b"))
    both = _keys(spark, sf).select(
        *_ROW,
        state("l_partkey", F.lit(False), F.col("a")).alias("x"),
        state("l_suppkey", F.lit(True), b).alias("y"),
    )
    merged = both.select(*_ROW, K.state_update(F.col("x"), F.col("y")).alias("s"))
    return merged.select(*_ROW, "s.degree", "s.flag", _text(F.col("s.key"), "key"))


def seed_levels(spark, sf):
    return I.vertices(spark, sf).select("id", K.seed_slot(F.col("id"), 10, 100).alias("slot"))


def path_functions(spark, sf):
    rows = _keys(spark, sf)
    a, b = F.array_distinct("a"), F.array_distinct("b")
    x = F.struct(F.col("l_partkey").alias("id"), (F.col("l_orderkey") % 5).alias("degree"))
    y = F.struct(F.col("l_suppkey").alias("id"), (F.col("l_partkey") % 5).alias("degree"))
    return rows.select(
        *_ROW,
        _text(K.path_prepend(F.col("l_partkey"), a), "longer"),
        _text(K.shorter_path(a, b), "shorter"),
        K.larger_second(x, y)["id"].alias("larger"),
    )


def jaccard(spark, sf):
    """Links and letters of consecutive pages compared on two sides."""
    pages = I.table(spark, sf, "pages").select(
        "page_id",
        F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("o"),
        F.array_distinct(F.regexp_extract_all("url", F.lit("([0-9])"), 1)).alias("i"),
    )
    following = pages.select(
        (F.col("page_id") - 1).alias("page_id"), F.col("o").alias("o2"), F.col("i").alias("i2")
    )
    args = [F.col(c) for c in ("o", "i", "o2", "i2")]
    return pages.join(following, "page_id").select(
        "page_id",
        F.round(K.jaccard_two_sided(*args), 6).alias("plain"),
        F.round(K.jaccard_two_sided(*args, mode="subset"), 6).alias("subset"),
    )


QUERIES = {
    "distinct_edges": distinct_edges,
    "latest_per_key": latest_per_key,
    "first_per_key": first_per_key,
    "tag_times": tag_times,
    "user_tag_join": user_tag_join,
    "resolve_edges": resolve_edges,
    "follow_graph": follow_graph,
    "ego_network": ego_network,
    "degrees": degrees,
    "important_degree": important_degree,
    "isolated": isolated,
    "induced_subgraph": induced_subgraph,
    "marked_edges": marked_edges,
    "neighbor_sets": neighbor_sets,
    "neighbor_attributes": neighbor_attributes,
    "triplets": triplets,
    "default_vertices": default_vertices,
    "symmetrize": symmetrize,
    "sample_vertices": sample_vertices,
    "sample_landmarks": sample_landmarks,
    "topk_degree": topk_degree,
    "aggregate_messages": aggregate_messages,
    "available_edges": available_edges,
    "asof_recency": asof_recency,
    "tag_eligible": tag_eligible,
    "prediction_buckets": prediction_buckets,
    "daily_tag_counts": daily_tag_counts,
    "tag_features": tag_features,
    "score_features": score_features,
    "without_self_edges": without_self_edges,
    "key_level": key_level,
    "key_merge": key_merge,
    "state_update": state_update,
    "seed_levels": seed_levels,
    "path_functions": path_functions,
    "jaccard": jaccard,
}

_SQL_DEGREES = """outs AS (SELECT src AS id, count(*) AS n FROM follow GROUP BY 1),
ins AS (SELECT dst AS id, count(*) AS n FROM follow GROUP BY 1),
degrees AS (
  SELECT id, coalesce(outs.n, 0) AS out_degree, coalesce(ins.n, 0) AS in_degree,
    coalesce(outs.n, 0) + coalesce(ins.n, 0) AS degree FROM outs FULL JOIN ins USING (id))"""

_SQL_PEOPLE = "people AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer)"

_SQL_KEYS = """ks AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    [CAST(l_linenumber AS BIGINT), l_suppkey % 3, l_partkey % 3, l_partkey % 3] AS a,
    [l_orderkey % 2, l_suppkey % 3 - 1, l_partkey % 2 - 1, CAST(l_linenumber AS BIGINT)] AS b FROM lineitem)"""


def _sql_level(k: str) -> str:
    return f"(1 + CAST({k}[1] <> {k}[2] AS INT) + CAST({k}[2] <> {k}[3] AS INT) + CAST({k}[3] <> {k}[4] AS INT))"


def _sql_merge(a: str, b: str) -> str:
    return f"({a}[1:{_sql_level(a)}] || {b}[{_sql_level(a)} + 1:4])"


_ROW_SQL = ", ".join(_ROW)


def _sql_slots(expr: str) -> str:
    parts = ", ".join("CAST(" + expr.replace("#", f"[{i}]") + " AS VARCHAR)" for i in range(1, 5))
    return f"concat_ws(',', {parts})"


ORACLES = {
    "without_self_edges": """SELECT a.o_custkey % 10 AS src, b.o_custkey % 10 AS dst FROM orders a
JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_custkey % 10 <> b.o_custkey % 10""",
    "distinct_edges": f"WITH {I.SQL_FOLLOW} SELECT src, dst FROM follow",
    "latest_per_key": f"""WITH {I.SQL_USES}
SELECT screen_name, ts, seq, hashtag, value FROM uses
QUALIFY row_number() OVER (PARTITION BY screen_name ORDER BY ts DESC, seq DESC) = 1""",
    "first_per_key": f"""WITH {I.SQL_USES}
SELECT screen_name, hashtag, ts, seq, value FROM uses
QUALIFY row_number() OVER (PARTITION BY screen_name, hashtag ORDER BY ts, seq) = 1""",
    "tag_times": f"""WITH {I.SQL_USES}
SELECT screen_name, hashtag, time, count(*) AS uses FROM uses GROUP BY ALL""",
    "user_tag_join": f"""WITH {I.SQL_USES}, {I.SQL_PROFILES}
SELECT u.screen_name, hashtag, time, seq, followers_count, friends_count, time_zone, verified
FROM uses u JOIN profiles p ON u.screen_name = p.screen_name""",
    "resolve_edges": f"""WITH {I.SQL_RELATIONS}, {I.SQL_USES}, names AS (SELECT DISTINCT screen_name FROM uses)
SELECT {I.SQL_NAME_ID.format('"user"')} AS src, {I.SQL_NAME_ID.format("follower")} AS dst FROM relations
WHERE "user" IN (SELECT screen_name FROM names) AND follower IN (SELECT screen_name FROM names)""",
    "follow_graph": f"""WITH {I.SQL_FOLLOW}, {_SQL_DEGREES}, {I.SQL_PROFILES}
SELECT {I.SQL_NAME_ID.format("screen_name")} AS id, screen_name, coalesce(out_degree, 0) AS out_degree,
  coalesce(in_degree, 0) AS in_degree FROM profiles LEFT JOIN degrees ON degrees.id = profiles.id""",
    "ego_network": f"""WITH {I.SQL_RELATIONS}, {I.SQL_USES}, {I.SQL_PROFILES},
pairs AS (SELECT DISTINCT "user", follower FROM relations),
ego AS (SELECT "user" AS name FROM pairs GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
members AS (SELECT follower AS name FROM pairs WHERE "user" = (SELECT name FROM ego) UNION SELECT name FROM ego)
SELECT 1 AS label, u.screen_name, hashtag, time, seq AS use, followers_count, time_zone
FROM uses u JOIN profiles p ON p.screen_name = u.screen_name
WHERE hashtag = '{_TAG}' AND u.screen_name IN (SELECT name FROM members)""",
    "degrees": f"""WITH {I.SQL_FOLLOW}, {_SQL_DEGREES}
SELECT c_custkey AS id, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree,
  coalesce(degree, 0) AS degree FROM customer LEFT JOIN degrees ON id = c_custkey""",
    "important_degree": f"""WITH {I.SQL_FOLLOW}
SELECT src AS id, count(*) AS out_degree FROM follow GROUP BY 1 HAVING count(*) > 5""",
    "isolated": f"""WITH {I.SQL_FOLLOW}, {I.SQL_USES}, inner_edges AS (
  SELECT * FROM follow WHERE src IN (SELECT id FROM uses) AND dst IN (SELECT id FROM uses))
SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT src FROM inner_edges)
  AND c_custkey NOT IN (SELECT dst FROM inner_edges)""",
    "induced_subgraph": f"""WITH {I.SQL_FOLLOW}, {_SQL_PEOPLE}
SELECT src, dst FROM follow JOIN people a ON a.id = src JOIN people b ON b.id = dst
WHERE a.nation BETWEEN 0 AND 9 AND b.nation BETWEEN 0 AND 9""",
    "marked_edges": f"""WITH {I.SQL_RAW_FOLLOW}
SELECT src, dst, min(weight) AS weight FROM raw_follow GROUP BY 1, 2 HAVING min(weight) <= 2""",
    "neighbor_sets": f"""WITH {I.SQL_FOLLOW}
SELECT src AS id, 'out' AS side, dst AS nbr FROM follow UNION ALL SELECT dst, 'in', src FROM follow""",
    "neighbor_attributes": f"""WITH {I.SQL_FOLLOW}, {_SQL_PEOPLE}
SELECT src AS id, dst AS nbr, name, nation, 'out' AS side FROM follow JOIN people ON people.id = dst
UNION ALL SELECT dst, src, name, nation, 'in' FROM follow JOIN people ON people.id = src""",
    "triplets": f"""WITH {I.SQL_FOLLOW}, {_SQL_PEOPLE}
SELECT src, a.name AS src_name, a.nation AS src_nation, dst, b.name AS dst_name, b.nation AS dst_nation
FROM follow JOIN people a ON a.id = src JOIN people b ON b.id = dst""",
    "default_vertices": f"""WITH {I.SQL_FOLLOW}, {I.SQL_PROFILES},
ids AS (SELECT src AS id FROM follow UNION SELECT dst FROM follow UNION SELECT id FROM profiles WHERE verified)
SELECT ids.id, coalesce(time_zone, 'None') AS time_zone, coalesce(followers_count, 0) AS followers_count
FROM ids LEFT JOIN (SELECT * FROM profiles WHERE verified) p ON p.id = ids.id""",
    "symmetrize": f"""WITH {I.SQL_FOLLOW}
SELECT src, dst FROM follow UNION ALL SELECT dst, src FROM follow""",
    "sample_vertices": f"""WITH {I.SQL_FOLLOW}, share AS (
  SELECT CAST(floor(least(500.0 / count(*), 1.0) * 1152921504606846976) AS BIGINT) AS bound FROM customer),
kept AS (SELECT c_custkey AS id FROM customer, share
  WHERE bound >= 1152921504606846976 OR CAST('0x' || substr(md5(c_custkey || ':7'), 1, 15) AS BIGINT) < bound),
e AS (SELECT * FROM follow WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept))
SELECT id, (SELECT count(*) FROM e WHERE src = id) AS out_degree, (SELECT count(*) FROM e WHERE dst = id) AS in_degree
FROM kept""",
    "sample_landmarks": "SELECT c_custkey AS id FROM customer ORDER BY md5(c_custkey || ':0'), c_custkey LIMIT 10",
    "topk_degree": f"""WITH {I.SQL_FOLLOW}, {_SQL_DEGREES}
SELECT id, degree FROM degrees WHERE degree >= (
  SELECT min(degree) FROM (SELECT degree FROM degrees ORDER BY degree DESC LIMIT 25))""",
    "aggregate_messages": f"""WITH {I.SQL_FOLLOW}, {_SQL_PEOPLE}, sent AS (
  SELECT src AS id, b.nation AS msg FROM follow JOIN people b ON b.id = dst
  UNION ALL SELECT dst, a.nation FROM follow JOIN people a ON a.id = src WHERE a.nation > 4)
SELECT id, count(msg) AS messages, CAST(sum(msg) AS BIGINT) AS nation_sum, min(msg) AS nation_min, max(msg) AS nation_max
FROM sent GROUP BY id""",
    "available_edges": f"""WITH {I.SQL_FOLLOW}, {I.SQL_GEO}
SELECT src, dst FROM follow JOIN geo a ON a.id = src JOIN geo b ON b.id = dst WHERE a.key_0 <> b.key_0""",
    "asof_recency": f"""WITH {I.SQL_USES}
SELECT screen_name, hashtag, max(ts) AS last_use,
  CAST(floor(date_diff('microsecond', max(ts), TIMESTAMP '2024-01-25 12:00:00') / 86400000000) AS BIGINT) AS days_ago,
  floor(date_diff('microsecond', max(ts), TIMESTAMP '2024-01-25 12:00:00') / 86400000000) <= 20 AS shown
FROM uses WHERE ts <= TIMESTAMP '2024-01-25 12:00:00' GROUP BY 1, 2""",
    "tag_eligible": f"""WITH {I.SQL_USES}
SELECT DISTINCT screen_name, hashtag FROM uses WHERE time < epoch_ms(TIMESTAMP '2024-01-10 00:00:00')""",
    "prediction_buckets": f"""WITH {I.SQL_USES}, p AS (SELECT seq, hashtag, value / 25 - 0.2 AS prediction FROM uses)
SELECT seq, hashtag, prediction >= 0.1 AS shown,
  CASE WHEN prediction >= 0.1 THEN CAST(ceil(prediction) AS BIGINT) END AS bucket FROM p""",
    "daily_tag_counts": f"""WITH {I.SQL_USES}
SELECT date_trunc('day', ts)::TIMESTAMP AS day, screen_name, hashtag, count(*) AS uses FROM uses GROUP BY 1, 2, 3""",
    "tag_features": f"""WITH {I.SQL_FOLLOW}, {I.SQL_USES}, {I.SQL_PROFILES},
cutoffs AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS t),
rows AS (
  SELECT id, hashtag, t FROM (SELECT id, hashtag, min(ts) AS first FROM uses GROUP BY 1, 2), cutoffs
  WHERE first < t - INTERVAL 1 DAY),
own AS (
  SELECT r.id, r.hashtag, r.t, count(*) FILTER (ts >= t - INTERVAL 1 DAY) AS label,
    count(*) FILTER (ts < t - INTERVAL 1 DAY) AS num_tweets
  FROM rows r JOIN uses u ON u.id = r.id AND u.hashtag = r.hashtag AND ts < t AND ts > t - INTERVAL 4 DAY GROUP BY 1, 2, 3),
act AS (
  SELECT u.id, u.hashtag, t, count(*) AS n FROM uses u, cutoffs
  WHERE ts < t - INTERVAL 1 DAY AND ts > t - INTERVAL 4 DAY GROUP BY 1, 2, 3),
theirs AS (SELECT src AS id, hashtag, t, CAST(sum(n) AS BIGINT) AS n FROM act JOIN follow ON dst = act.id GROUP BY 1, 2, 3)
SELECT r.id, r.hashtag, r.t AS cutoff, coalesce(label, 0) AS label, coalesce(num_tweets, 0) AS num_tweets,
  coalesce(theirs.n, 0) AS num_user_relations, followers_count, time_zone
FROM rows r JOIN profiles p ON p.id = r.id
LEFT JOIN own ON own.id = r.id AND own.hashtag = r.hashtag AND own.t = r.t
LEFT JOIN theirs ON theirs.id = r.id AND theirs.hashtag = r.hashtag AND theirs.t = r.t""",
    "score_features": f"""WITH {I.SQL_FOLLOW}, {I.SQL_USES}, {I.SQL_PROFILES},
own AS (SELECT id, hashtag, count(*) FILTER (ts > TIMESTAMP '2024-01-20' - INTERVAL 3 DAY) AS n FROM uses
  WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1, 2),
theirs AS (SELECT src AS id, hashtag, CAST(sum(n) AS BIGINT) AS n FROM own JOIN follow ON dst = own.id GROUP BY 1, 2)
SELECT own.id, own.hashtag, own.n AS num_tweets, coalesce(theirs.n, 0) AS num_user_relations, followers_count, time_zone
FROM own JOIN profiles p ON p.id = own.id
LEFT JOIN theirs ON theirs.id = own.id AND theirs.hashtag = own.hashtag""",
    "key_level": f"""WITH {_SQL_KEYS}
SELECT {_ROW_SQL}, {_sql_level("a")} AS level_a, {_sql_level("b")} AS level_b, len(list_distinct(a)) > 1 AS clustered FROM ks""",
    "key_merge": f"""WITH {_SQL_KEYS}
SELECT {_ROW_SQL}, array_to_string({_sql_merge("a", "b")}, ',') AS merged,
  {_sql_slots("CASE WHEN b# <> -1 THEN b# ELSE a# END")} AS updated,
  {_sql_slots("CASE WHEN a# = -1 THEN b# WHEN b# = -1 THEN a# ELSE least(a#, b#) END")} AS slots FROM ks""",
    "state_update": f"""WITH {_SQL_KEYS}, s AS (
  SELECT * REPLACE (CASE WHEN l_linenumber = 1 THEN [-1, -1, -1, -1]::BIGINT[] ELSE b END AS b) FROM ks)
SELECT {_ROW_SQL}, CASE WHEN a[1] = -1 THEN l_suppkey ELSE l_partkey END AS degree, b[1] <> -1 OR a[1] = -1 AS flag,
  array_to_string(CASE WHEN a[1] = -1 THEN b WHEN b[1] = -1 THEN a ELSE {_sql_merge("b", "a")} END, ',') AS key FROM s""",
    "seed_levels": """SELECT c_custkey AS id, CASE WHEN c_custkey < 1000 THEN CAST(c_custkey // 100 AS INTEGER) END AS slot
FROM customer""",
    "path_functions": f"""WITH {_SQL_KEYS}, d AS (
  SELECT {_ROW_SQL}, list_transform(list_filter(generate_series(1, 4), lambda i: list_position(a, a[i]) = i), lambda i: a[i]) AS a,
    list_transform(list_filter(generate_series(1, 4), lambda i: list_position(b, b[i]) = i), lambda i: b[i]) AS b FROM ks)
SELECT {_ROW_SQL}, array_to_string([l_partkey] || a, ',') AS longer,
  array_to_string(CASE WHEN len(a) < len(b) THEN a ELSE b END, ',') AS shorter,
  CASE WHEN l_orderkey % 5 > l_partkey % 5 THEN l_partkey ELSE l_suppkey END AS larger FROM d""",
    "jaccard": """WITH p AS (
  SELECT page_id, list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS o,
    list_distinct(regexp_extract_all(url, '([0-9])', 1)) AS i FROM pages),
n AS (
  SELECT p.page_id, len(p.o) AS o1, len(q.o) AS o2, len(p.i) AS i1, len(q.i) AS i2,
    len(list_intersect(p.o, q.o)) AS o12, len(list_intersect(p.i, q.i)) AS i12
  FROM p JOIN p q ON q.page_id = p.page_id + 1),
j AS (
  SELECT *, CASE WHEN o1 + o2 = 0 THEN 1.0::DOUBLE ELSE o12 / (o1 + o2 - o12) END
    + CASE WHEN i1 + i2 = 0 THEN 1.0::DOUBLE ELSE i12 / (i1 + i2 - i12) END AS total FROM n)
SELECT page_id, round(total, 6) AS plain,
  CASE WHEN o12 = o1 AND i12 = i1 AND o1 + o2 + i1 + i2 > 0 THEN round(total, 6) ELSE -1.0::DOUBLE END AS subset FROM j""",
}
