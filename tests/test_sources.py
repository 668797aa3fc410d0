"""Parsers, encoders and column functions on the samples of the feeds and stores."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strata.functions import keys as K
from strata.functions import text as X
from strata.operators import explore, graph, records
from strata.sources import edges, sinks, store, tweets, wire


@pytest.fixture
def lines(spark):
    return lambda *values: spark.createDataFrame([(v,) for v in values], "value string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def arr(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<bigint>")


def test_wire_relations(lines):
    assert rows(wire.decode_wire(lines("a,b:a,c:", "", "d,e:"), "relations")) == [
        ("a", "b"), ("a", "c"), ("d", "e"),
    ]


def test_wire_tag_use(lines):
    line = "alice,politics,1555912800000,0,1,2,3,False,True,low,textU+002C here,"
    assert rows(wire.decode_wire(lines(line), "tag_uses")) == [
        ("alice", "politics", 1555912800000, 0, 1, 2, 3, False, True, "low", "text, here")
    ]


def test_wire_profile_and_bad_fields(lines):
    line = "u1,5,6,7,1539202764000.0,8,True,9,None,False,true:u2,x:"
    first, second = rows(wire.decode_wire(lines(line), "profiles"))
    assert first == ("u1", 5, 6, 7, 1539202764000, 8, True, 9, False, False, True)
    assert second[:3] == ("u2", None, None) and second[6] is False


def test_wire_key_value(lines):
    got = wire.key_value(wire.records(lines("a,b,c:d:"))).collect()
    assert [(r["key"], r["values"]) for r in got] == [("a", ["b", "c"]), ("d", [])]


def test_store_layouts(lines):
    early = store.parse_store(lines("(some_user,politics 0 0 0 0 False False low some free text)"), "tag_uses_with_text")
    assert rows(early) == [
        ("some_user", "politics", 0, 0, 0, 0, False, False, "low", "some free text")
    ]
    late = store.parse_store(lines("(u1,news 1555912800000 1 2 3 4 true None low)"), "tag_uses")
    assert rows(late) == [("u1", "news", 1555912800000, 1, 2, 3, 4, True, False, "low")]
    assert rows(store.parse_store(lines("(first_user,second_user)"), "relations")) == [("first_user", "second_user")]


def test_edge_list(lines):
    text = lines("# From To", "1 2", "3\t4", "", "  5   6 ")
    assert rows(edges.parse_edges(text, comment="#")) == [(1, 2, 1), (3, 4, 1), (5, 6, 1)]


def test_tracked_tags_ignore_case_and_repeats(spark, lines):
    tags = edges.tracked_tags(lines("love", "Beautiful", "love", "TBT"))
    assert {r[0] for r in tags.collect()} == {"love", "beautiful", "tbt"}
    uses = spark.createDataFrame([("u", "BEAUTIFUL"), ("u", "tbt"), ("u", "other")], "screen_name string, hashtag string")
    assert {r["hashtag"] for r in tweets.only_tracked(uses, tags).collect()} == {"beautiful", "tbt"}


def test_tweets(lines):
    status = (
        '{"timestamp_ms":"1555912800000","text":"a: b","quote_count":1,"reply_count":2,"retweet_count":3,'
        '"favorite_count":4,"favorited":false,"retweeted":true,"filter_level":"low",'
        '"entities":{"hashtags":[{"text":"Love"},{"text":"Other"}]},'
        '"user":{"screen_name":"alice","followers_count":5,"created_at":"Wed Oct 10 20:19:24 +0000 2018"}}'
    )
    page = (
        '{"author":"alice","next_cursor":0,"users":[{"screen_name":"bob","created_at":'
        '"Wed Oct 10 20:19:24 +0000 2018"},{"screen_name":"eve"}]}'
    )
    relations, uses, profiles = tweets.tweets_to_relations(
        lines(status, '{"limit":{"track":9}}', "not json"), lines(page, '{"errors":1}'), edges.tracked_tags(lines("LOVE"))
    )
    assert rows(relations) == [("alice", "bob"), ("alice", "eve")]
    assert rows(uses.select("screen_name", "hashtag", "time", "retweeted", "text")) == [
        ("alice", "love", 1555912800000, True, "a: b")
    ]
    assert {(r["screen_name"], r["time"]) for r in profiles.collect()} == {
        ("alice", 1539202764000), ("bob", 1539202764000), ("eve", None),
    }


def test_text_functions(spark):
    assert value(spark, X.created_at_ms(F.lit("Wed Oct 10 20:19:24 +0000 2018"))) == 1539202764000
    assert value(spark, X.created_at_ms(F.lit("nonsense"))) is None
    assert value(spark, X.lenient_millis(F.lit("1539202764000.0"))) == 1539202764000
    for text, flag in [("False", False), ("None", False), ("true", True), (None, False)]:
        assert value(spark, X.lenient_boolean(F.lit(text).cast("string"))) is flag
    escaped = X.escape_delimiters(F.lit("a:b,c"))
    assert value(spark, escaped) == "aU+003AbU+002Cc"
    assert value(spark, X.unescape_delimiters(escaped)) == "a:b,c"
    assert value(spark, X.day_offset_ms(F.lit(10), 2)) == 172_800_010


def test_key_functions(spark):
    for key, level in [((1, 1, 1, 1), 1), ((2, 3, 3, 3), 2), ((1, 2, 3, 4), 4), ((7,), 1)]:
        assert value(spark, K.key_level(arr(*key))) == level
    assert value(spark, K.key_merge(arr(1, 2, 2, 2), arr(9, 9, 9, 9))) == [1, 2, 9, 9]
    assert value(spark, K.slot_update(arr(-1, 2, -1), arr(5, 6, -1))) == [5, 2, -1]
    assert value(spark, K.slot_merge(arr(-1, 9, 3), arr(5, 6, -1))) == [5, 6, 3]
    for vertex, slot in [(0, 0), (99, 0), (100, 1), (999, 9), (1000, None)]:
        assert value(spark, K.seed_slot(F.lit(vertex), 10, 100)) == slot


def test_state_update(spark):
    def state(degree, flag, *key):
        return F.struct(F.lit(degree).alias("degree"), F.lit(flag).alias("flag"), arr(*key).alias("key"))

    a, b, unset = state(1, False, 7, 7, 7), state(2, True, 5, 6, 6), state(0, False, -1, -1, -1)
    assert tuple(value(spark, K.state_update(a, b))) == (1, True, [5, 6, 7])
    assert tuple(value(spark, K.state_update(unset, b))) == (2, True, [5, 6, 6])
    assert tuple(value(spark, K.state_update(a, unset))) == (1, False, [7, 7, 7])


def test_jaccard(spark):
    none = F.array().cast("array<bigint>")
    j = K.jaccard_two_sided
    assert value(spark, j(none, none, none, none)) == 2.0
    assert value(spark, j(none, arr(1, 2), none, arr(2, 3))) == pytest.approx(1 + 1 / 3)
    assert value(spark, j(arr(1), arr(5), arr(2), arr(5))) == 1.0
    assert value(spark, j(none, none, none, none, "subset")) == -1.0
    assert value(spark, j(arr(1), arr(5), arr(1, 2), arr(5), "subset")) == 1.5
    assert value(spark, j(arr(1, 2), arr(5), arr(1), arr(5), "subset")) == -1.0
    with pytest.raises(ValueError):
        j(none, none, none, none, "other")


def test_paths_and_pairs(spark):
    assert value(spark, K.path_prepend(F.lit(1).cast("bigint"), arr(2, 3))) == [1, 2, 3]
    assert value(spark, K.shorter_path(arr(1), arr(2, 3))) == [1]
    assert value(spark, K.shorter_path(arr(1), arr(2))) == [2]
    none = F.lit(None).cast("array<bigint>")
    assert value(spark, K.shorter_path(none, arr(2))) == [2]
    assert value(spark, K.shorter_path(arr(1), none)) == [1]


def test_latest_and_first_per_key(spark):
    df = spark.createDataFrame([("u", 5, 1, "a"), ("u", 5, 2, "b"), ("u", 3, 9, None)], "k string, o int, seq int, v string")
    assert rows(records.latest_per_key(df, ["k"], ["o", "seq"])) == [("u", 5, 2, "b")]
    assert rows(records.first_per_key(df, ["k"], ["o", "seq"])) == [("u", 3, 9, None)]


def test_asof_recency(spark):
    uses = spark.sql(
        "SELECT 'u' screen_name, 't' hashtag, timestamp_ntz'2024-01-01' + make_dt_interval(d) AS ts "
        "FROM VALUES (1), (3), (9) AS v(d)"
    )
    got = records.asof_recency(uses, "2024-01-06").first()
    assert str(got["last_use"]).startswith("2024-01-04") and got["days_ago"] == 2 and got["shown"]


def test_surrogate_ids_survive_collisions(spark, monkeypatch):
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "screen_name string")
    real = graph.name_id
    calls = []

    def same_first(column):
        calls.append(1)
        return F.lit(7).cast("bigint") if len(calls) == 1 else real(column)

    monkeypatch.setattr(graph, "name_id", same_first)
    got = {r["screen_name"]: r["id"] for r in graph.surrogate_ids(names).collect()}
    assert len(got) == 3 and len(set(got.values())) == 3 and got["a"] == 7


def test_drill_down(spark):
    keys = {1: [1] * 5, 4: [4] * 5, 5: [5] * 5}
    keys.update({v: [1, v, v, v, v] for v in (2, 3)})
    keys.update({v: [5, v, v, v, v] for v in (6, 7)})
    h = explore.with_key_columns(spark.createDataFrame(list(keys.items()), "id bigint, key array<bigint>"), 5)
    links = [(1, 2), (1, 3), (1, 4), (4, 5), (5, 6), (5, 7)]
    e = spark.createDataFrame(links + [(b, a) for a, b in links], "src bigint, dst bigint")
    assert {tuple(r) for r in explore.drill_members(h, [1]).collect()} == {(1, 1), (2, 2), (3, 3)}
    assert {tuple(r) for r in explore.drill_members(h, [1, 2]).collect()} == {(2, 2)}
    assert {tuple(r) for r in explore.drill_members(h, [1, 2, 2, 2, 2]).collect()} == {(2, 2)}
    assert {r["id"] for r in explore.drill_adjacent(h, e, [1]).collect()} == {1, 4}
    assert explore.drill_adjacent(h, e, []).isEmpty()
    assert explore.drill_links(h, e, [1]).count() == 4


def test_cross_filter(spark):
    stats = {
        "degree": spark.createDataFrame([(1, 2), (2, 2), (3, 5)], "super bigint, degree bigint"),
        "num_nodes": spark.createDataFrame([(1, 1), (2, 4), (3, 4)], "super bigint, num_nodes bigint"),
    }
    got = lambda s: {tuple(r) for r in explore.cross_filter(stats, s, "degree").collect()}
    assert got({"num_nodes": [4]}) == {(2, 1), (5, 1)}
    assert got({}) == {(2, 2), (5, 1)} == got({"num_nodes": [99]})
    assert got({"degree": [2]}) == {(2, 2), (5, 1)}
    left = explore.selected(stats, {"num_nodes": [1, 4]}, {"num_nodes": [4]})
    assert {r["super"] for r in left.collect()} == {1}


def test_unassigned_cluster_counts_for_its_source(spark):
    members = spark.createDataFrame([(1, 5), (2, -1), (3, 6)], "id bigint, super bigint")
    links = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (1, 1)], "src bigint, dst bigint")
    assert {tuple(r) for r in explore.interior_edges(members, links).collect()} == {(5, 2), (-1, 1)}
    assert {tuple(r) for r in explore.super_edges(members, links).collect()} == {(5, 6, 1)}


def test_stored_hierarchy_prunes_by_prefix(spark, tmp_path):
    keys = spark.range(1000).select("id", F.array((F.col("id") % 7), F.col("id")).alias("key"))
    sinks.write_hierarchy(explore.with_key_columns(keys, 2), str(tmp_path / "h"))
    drilled = explore.drill_members(spark.read.parquet(str(tmp_path / "h")), [3])
    assert drilled.count() == 143
    plan = drilled._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key_0,3)" in plan and "ReadSchema: struct<id:bigint,key_0:bigint,key_1:bigint>" in plan


@pytest.fixture
def stored_graph(spark, tmp_path):
    """(hierarchy, edges, path): three levels, repeated edges, unassigned and missing ends."""
    rnd = random.Random(5)
    keys = {v: [v % 5, v % 20, v] for v in range(300)}
    keys[7], keys[8], keys[9] = [-1, -1, -1], [3, None, 8], [None, None, None]
    pairs = [(rnd.randrange(310), rnd.randrange(310)) for _ in range(3000)]
    pairs += [(v, v + 20) for v in range(0, 260)] * 2
    h = spark.createDataFrame(list(keys.items()), "id bigint, key array<bigint>")
    h = explore.with_key_columns(h, 3)
    e = spark.createDataFrame(pairs, "src bigint, dst bigint")
    sinks.write_links(h, e, str(tmp_path / "links"))
    return h, e, str(tmp_path / "links")


@pytest.mark.parametrize("prefix", [[], [3], [3, 8], [3, 8, 28], [0], [-1], [4, 3], [99]])
def test_stored_links_equal_the_drill_over_all_edges(spark, stored_graph, prefix):
    h, e, path = stored_graph
    members = explore.drill_members(h, prefix)
    links = explore.drill_links(h, e, prefix).select("src", "dst")
    assert sorted(rows(explore.stored_links(spark, path, prefix))) == sorted(rows(links))
    adjacent = explore.stored_adjacent(spark, path, prefix)
    assert sorted(rows(adjacent)) == sorted(rows(explore.drill_adjacent(h, e, prefix)))
    if len(prefix) < 3:
        between = explore.stored_super_edges(spark, path, prefix)
        assert sorted(rows(between)) == sorted(rows(explore.super_edges(members, links)))
        inside = explore.stored_interior_edges(spark, path, prefix)
        assert sorted(rows(inside)) == sorted(rows(explore.interior_edges(members, links)))


def test_stored_links_of_nothing(spark, tmp_path):
    h = explore.with_key_columns(spark.createDataFrame([], "id bigint, key array<bigint>"), 2)
    sinks.write_links(h, spark.createDataFrame([(1, 2)], "src bigint, dst bigint"), str(tmp_path / "l"))
    assert explore.stored_links(spark, str(tmp_path / "l"), []).isEmpty()
    assert explore.stored_adjacent(spark, str(tmp_path / "l"), [1]).isEmpty()


def test_one_cluster_reads_few_files(spark, tmp_path):
    keys = spark.range(4000).select("id", F.array(F.col("id") % 10, F.col("id") % 100, F.col("id")).alias("key"))
    near = spark.range(40000).select((F.col("id") % 4000).alias("src"), ((F.col("id") * 100 + F.col("id")) % 4000).alias("dst"))
    path = str(tmp_path / "links")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_links(explore.with_key_columns(keys, 3), near, path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    drilled = explore.stored_links(spark, path, [3, 23])
    plan = drilled._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(in_0,3)" in plan and "EqualTo(in_1,23)" in plan and "Exchange" not in plan
    files = sorted((tmp_path / "links" / "links").glob("*.parquet"))

    def may_hold(file):
        meta = pq.ParquetFile(file).metadata
        column = [meta.schema.names.index(c) for c in ("in_0", "in_1")]
        for g in range(meta.num_row_groups):
            stats = [meta.row_group(g).column(c).statistics for c in column]
            if all(s.has_min_max and s.min <= v <= s.max for s, v in zip(stats, (3, 23))):
                return True
        return False

    # Its own stretch, and the files in which its parent's begins and ends.
    assert len(files) >= 12 and sum(map(may_hold, files)) <= 3
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        plan = explore.stored_adjacent(spark, path, [3, 23])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(depth,2)" in plan and "EqualTo(cluster,23)" in plan and "Exchange" not in plan


def test_graph_payload_sink(spark, tmp_path):
    people = spark.createDataFrame([(1, "a"), (2, "b"), (3, "alone")], "id bigint, name string")
    follows = spark.createDataFrame([(1, 2)], "src bigint, dst bigint")
    uses = spark.createDataFrame([(1, "t", 5), (1, "t", 5), (3, "t", 6)], "id bigint, hashtag string, time bigint")
    sinks.write_graph(people, follows, uses, str(tmp_path / "g"))
    got = {(r["kind"], r["value"]) for r in spark.read.text(str(tmp_path / "g")).collect()}
    assert got == {
        ("node", '{"id":1,"name":"a"}'),
        ("node", '{"id":2,"name":"b"}'),
        ("use", '{"id":1,"hashtag":"t","time":5,"uses":2}'),
        ("link", '{"source":1,"target":2}'),
    }
