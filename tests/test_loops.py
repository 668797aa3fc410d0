"""The loop primitives and the salting of hot keys."""

import uuid

import graphs
import pytest
from pyspark.sql import functions as F

from strata import session
from strata.operators import components, paths, skew
from strata.operators.iterate import iterate
from strata.plans import backbone, labels
from strata.session import purge, save, save_counted, shared_dir


@pytest.fixture
def small_limits(monkeypatch):
    """Limits so low that fixture graphs have hot keys and are kept partitioned."""
    small = skew.Limits(hot_min_rows=8, keep_rows=10, rows_per_partition=4)
    build = skew.EdgeIndex.__init__
    monkeypatch.setattr(skew.EdgeIndex, "__init__", lambda self, edges, toward, limits=None: build(self, edges, toward, small))
    return small


def test_save_counts_rows(spark):
    table, n = save_counted(spark.range(7).where("id > 2"), "t")
    assert n == 4 == table.count()
    assert save_counted(spark.range(7).where("id > 9"), "t")[1] == 0


def test_iterate_stops_and_raises(spark):
    def halve(state, _round):
        return state.select(F.floor(F.col("id") / 2).alias("id")).withColumn("active", F.col("id") > 0)

    state = spark.range(9).withColumn("active", F.lit(True))
    assert iterate(state, halve, 5).agg(F.max("id")).first()[0] == 0
    with pytest.raises(RuntimeError, match="converge"):
        iterate(state, halve, 2)


def test_hot_keys_are_few_and_split(spark, small_limits):
    rows = spark.createDataFrame([(0, i) for i in range(90)] + [(i, i) for i in range(1, 11)], "id int, nbr int")
    hot = skew.hot_keys(rows, "id", 100, 25, 8)
    assert [(r["id"], r["splits"]) for r in hot.collect()] == [(0, 12)]
    salted = skew.spread(rows, "id", "nbr", hot)
    assert salted.where("id = 0").select("salt").distinct().count() > 5
    assert salted.where("id > 0 AND salt > 0").isEmpty()
    once = spark.createDataFrame([(0,), (3,)], "id int")
    copies = {r["id"]: r["count"] for r in skew.replicate(once, "id", hot).groupBy("id").count().collect()}
    assert copies == {0: 12, 3: 1}
    assert skew.hot_keys(rows, "id", 100, 2, 8) is None
    assert skew.hot_keys(rows, "id", 5, 25, 8) is None


def test_kept_edges_are_not_shuffled_again(edges_of, spark, small_limits):
    edges = save(edges_of(graphs.random_edges(60, 200, 1, hub=0.5)), "edges")
    with skew.EdgeIndex(edges, toward="src") as index:
        assert index.hot is not None
        index.table.count()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            joined = index.expand(spark.range(60).select("id"))
            plan = joined._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange, of the frontier; the cached table's own plan starts at its scan.
    outside = plan.split("InMemoryRelation")[0]
    assert "InMemoryTableScan" in outside and outside.count("Exchange hashpartitioning") == 1
    assert "salt" in outside


@pytest.mark.parametrize("seed", range(2))
def test_hot_keys_change_no_result(edges_of, ids_of, small_limits, seed):
    edges = graphs.random_edges(60, 220, seed, hub=0.6)
    table = edges_of(edges)
    rows = paths.landmark_paths(save(table, "edges"), ids_of([0, 7])).collect()
    want = {(v, t): p for t in (0, 7) for v, p in graphs.shortest(edges, t).items()}
    assert {(r["id"], r["landmark"]): list(r["path"]) for r in rows} == want
    got = {r["id"]: list(r["key"]) for r in labels.seed_labels(table, levels=4, level_size=5).collect()}
    assert got == graphs.seed_labels(edges, 4, 5)
    got = {r["id"]: list(r["key"]) for r in backbone.keep_one(table, min_out_degree=3).collect()}
    assert got == graphs.keep_one(edges, 3, 5)


def test_forest_of_a_star_with_a_hub(spark):
    rows = [(0, i, 1) for i in range(1, 80)] + [(i, i + 1, 2) for i in range(1, 79)]
    got = components.spanning_forest(spark.createDataFrame(rows, "src bigint, dst bigint, weight int"))
    assert {tuple(r) for r in got.collect()} == graphs.kruskal(rows)


def test_shared_dir_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (named or spark.sparkContext.getCheckpointDir()).rstrip("/")


def test_purge_removes_the_tables(spark, monkeypatch):
    kept = save(spark.range(3), "kept")
    monkeypatch.setattr(session, "_run_root", lambda s: f"{shared_dir(s)}/purged-{uuid.uuid4().hex}")
    monkeypatch.setattr(session, "_run_root", lambda s, root=session._run_root(spark): root)
    gone = save(spark.range(3), "gone")
    purge(spark)
    with pytest.raises(Exception, match="(?i)exist|found"):
        spark.read.parquet(gone.inputFiles()[0])
    assert kept.count() == 3
