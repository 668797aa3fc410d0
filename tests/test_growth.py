"""Layouts that must not grow faster than their tables, or fill one task."""

import datetime as dt
import random
import re

import graphs
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from strata.operators import iterate, paths, skew
from strata.plans import equivalence, features, model
from strata.session import save


def test_low_limits_do_not_start_a_task_for_every_few_rows(spark):
    edges = save(spark.range(3000).selectExpr("id AS src", "id % 7 AS dst"), "edges")
    low = skew.Limits(hot_min_rows=8, keep_rows=10, rows_per_partition=2)
    with skew.EdgeIndex(edges, toward="src", limits=low) as index:
        assert index.hot is not None
        assert index.table.rdd.getNumPartitions() <= low.tasks_per_core * spark.sparkContext.defaultParallelism
        reached = index.expand(spark.createDataFrame([(3,)], "id bigint"))
        assert sorted(r["nbr"] for r in reached.collect()) == list(range(3, 3000, 7))


def test_partitions_of_a_kept_table():
    low = skew.Limits(rows_per_partition=200)
    assert skew.partitions(1_000, 2, 12, low) == 5
    assert skew.partitions(12_000_000, 100, 12, low) == 100
    assert skew.partitions(12_000_000, 10, 12, low) == 48
    # Full partitions are as many as the rows fill, whatever the cores.
    assert skew.partitions(4_000_000_000, 100, 12, low) == 1000
    assert skew.partitions(4_000_000_000, 100, 12) == 1000


class _Fit:
    """A pipeline that only notes how many partitions it is given."""

    def __init__(self, pipeline):
        self.getStages = pipeline.getStages

    def fit(self, df):
        self.partitions = df.rdd.getNumPartitions()


def test_training_is_spread_by_the_size_of_its_arrays(spark):
    rows = save(spark.range(4000).selectExpr("id AS a", "1.0D AS label"), "training")
    cores = spark.sparkContext.defaultParallelism
    wide = _Fit(model.feature_pipeline(["a"], [], num_features=1 << 16))
    model.train(rows, wide)
    assert wide.partitions == max(cores, -(-4000 * (4 * (1 << 16) + 256) // (64 << 20)))
    narrow = _Fit(model.feature_pipeline(["a"], [], num_features=1 << 8))
    model.train(rows, narrow)
    assert narrow.partitions == cores


def test_training_on_ready_vectors_is_spread_by_their_size(spark):
    vector = array_to_vector(F.array_repeat(F.col("id").cast("double"), 20_000))
    rows = save(spark.range(9000).select(F.lit(1.0).alias("label"), vector.alias("features")), "training")
    wide = _Fit(model.vector_pipeline())
    model.train(rows, wide)
    assert wide.partitions == -(-9000 * (4 * 20_000 + 256) // (64 << 20)) > spark.sparkContext.defaultParallelism


def test_paths_are_not_moved_along_every_edge(spark, monkeypatch):
    # 0 and 1 are landmarks; 9 reaches 0 over 2 and 3 (least ids first) as well as over 4 and 5.
    pairs = [(9, 4), (4, 5), (5, 0), (9, 2), (2, 3), (2, 5), (3, 0), (0, 1), (1, 0), (7, 7)]
    edges = save(spark.createDataFrame(pairs, "src bigint, dst bigint"), "edges")
    moved, expand = set(), skew.EdgeIndex.expand

    def noted(self, frontier):
        moved.update(frontier.columns)
        return expand(self, frontier)

    monkeypatch.setattr(skew.EdgeIndex, "expand", noted)
    found = paths.landmark_paths(edges, spark.createDataFrame([(0,), (1,)], "id bigint"))
    got = {(r["id"], r["landmark"]): (r["hops"], list(r["path"])) for r in found.collect()}
    assert moved == {"id", "landmark"}
    assert got[9, 0] == (3, [2, 3, 0]) and got[9, 1] == (4, [2, 3, 0, 1]) and got[4, 0] == (2, [5, 0])
    assert got[0, 0] == (0, []) and got[1, 0] == (1, [0]) and len(got) == 14


def test_slots_are_unfolded_in_partitions_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(features, "_PARTITION_USES", 2, raising=False)
    begin, day = dt.datetime(2024, 1, 1), dt.timedelta(days=1)
    used = [(u, tag, begin + (u % 5) * day) for u in range(30) for tag in ("a", None)]
    uses = spark.createDataFrame(used, "id bigint, hashtag string, ts timestamp_ntz")
    edges = spark.createDataFrame([(1, 5), (99, 1)], "src bigint, dst bigint")
    profiles = spark.createDataFrame([(u,) for u in range(30)], "id bigint")
    df = features.tag_features(uses, edges, profiles, begin, begin + 8 * day)
    plan = df._jdf.queryExecution().executedPlan().toString()
    dealt = re.search(r"hashpartitioning\(id#\d+L, hashtag#\d+, 30\), REPARTITION_BY_NUM", plan)
    # A plan is printed from its end: the rows are unfolded after they were dealt.
    assert dealt and 0 <= plan.rfind("Generate inline") < dealt.start()
    got = {(r["hashtag"], r["cutoff"]): r["num_user_relations"] for r in df.where("id = 1").collect()}
    assert got == {(tag, begin + j * day): int(j in (2, 3)) for tag in ("a", None) for j in range(3, 9)}


def _star_pairs(copies):
    """``copies`` vertices of each of three kinds, told apart by the hubs they hang on."""
    kinds = [(-1, -2), (-1, -2, -3), (-2, -3)]
    return [(100 * k + 1000 * c, hub) for k, hubs in enumerate(kinds, 1) for c in range(copies) for hub in hubs]


def test_twin_elements_are_stored_once(spark):
    rows = {}
    for copies in (2, 8):
        edges = spark.createDataFrame(_star_pairs(copies), "src bigint, dst bigint")
        compared = equivalence._Compared.of(edges, None, "plain", True)
        rows[copies] = compared.tokens.count()
        held = {r["id"]: r["n"] for r in compared.tokens.groupBy("id").agg(F.sum("weight").alias("n")).collect()}
        assert held[-1] == 2 * copies and held[-2] == 3 * copies and held[-3] == 2 * copies
    # Three kinds of vertices and three hubs, however many vertices there are of a kind.
    assert rows[2] == rows[8] == 14


@pytest.mark.parametrize("mode, symmetric", [("plain", True), ("subset", True), ("plain", False)])
def test_weights_choose_like_single_elements(spark, monkeypatch, mode, symmetric):
    rng = random.Random(7)
    # Few hubs and many vertices, so that many are twins; some edges lead back.
    pairs = {(v, 100 + h) for v in range(40) for h in rng.sample(range(4), rng.randrange(1, 4))}
    pairs |= {(b, a) for a, b in sorted(pairs)[::9]} | {(101, 102), (102, 102)}
    edges = spark.createDataFrame(sorted(pairs), "src bigint, dst bigint")
    monkeypatch.setattr(equivalence, "_NODE", 2)
    got = equivalence.structural_fuzzy_schedule(edges, None, (1.8, 1.3, 1.0), mode, 3, symmetric)
    want = graphs.fuzzy_schedule(sorted(pairs), (1.8, 1.3, 1.0), 3, mode, symmetric)
    assert {r["id"]: tuple(r["key"]) for r in got.collect()} == {i: tuple(k) for i, k in want.items()}


def test_small_rounds_go_to_the_bucketed_table_many_at_a_time(spark, monkeypatch):
    first = spark.range(100).select("id", F.lit(0).cast("long").alias("landmark"))
    settles, settle = [], iterate.Rounds._settle

    def noted(self, rows):
        settles.append(rows.count())
        settle(self, rows)

    monkeypatch.setattr(iterate.Rounds, "_settle", noted)
    monkeypatch.setattr(iterate, "_LOOSE_ROUNDS", 3, raising=False)
    with iterate.Rounds(first, "few", ["id", "landmark"], by=["id"], limits=skew.Limits(settled_rows=50)) as rounds:
        for k in range(1, 11):
            rounds.add(spark.createDataFrame([(100 * k, 0), (100 * k, 1)], "id long, landmark long"))
            reached = spark.createDataFrame([(5, 0), (100 * k, 1), (100, 0), (7, 9)], "id long, landmark long")
            assert [tuple(r) for r in rounds.without_settled(reached).collect()] == [(7, 9)]
            assert rounds.settled().count() == 100 + 2 * k
            at = spark.createDataFrame([(5,), (100,), (100 * k,)], "id long")
            assert {tuple(r) for r in rounds.settled(at).collect()} == {(5, 0), (100, 0), (100, 1), (100 * k, 0), (100 * k, 1)}
    # Ten rounds of two rows: four at a time.
    assert settles == [100, 8, 8]
