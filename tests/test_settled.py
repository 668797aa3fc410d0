"""Loops whose settled rows lie in a bucketed table: same results, and settled rows stay in place."""

import re

import graphs
import pytest
from pyspark.sql import functions as F

from strata.operators import iterate, paths, skew
from strata.plans import backbone, labels
from strata.session import save


@pytest.fixture
def indexed(monkeypatch):
    """Every loop keeps its settled keys bucketed from the first row on."""
    build, made = iterate.Rounds.__init__, []

    def start(self, first, name, keys, by=None, limits=None):
        build(self, first, name, keys, by, skew.Limits(settled_rows=0))
        made.append(self)

    monkeypatch.setattr(iterate.Rounds, "__init__", start)
    return made


@pytest.mark.parametrize("seed", range(2))
def test_same_results(edges_of, ids_of, indexed, seed):
    edges = graphs.random_edges(50, 150, seed, hub=0.4)
    table = edges_of(edges)
    rows = paths.landmark_paths(save(table, "edges"), ids_of([0, 7])).collect()
    want = {(v, t): p for t in (0, 7) for v, p in graphs.shortest(edges, t).items()}
    assert {(r["id"], r["landmark"]): list(r["path"]) for r in rows} == want
    got = {r["id"]: list(r["key"]) for r in labels.seed_labels(table, levels=4, level_size=5).collect()}
    assert got == graphs.seed_labels(edges, 4, 5)
    got = {r["id"]: list(r["key"]) for r in backbone.keep_one(table, min_out_degree=2).collect()}
    assert got == graphs.keep_one(edges, 2, 5)
    assert len(indexed) > 3 and all(not r.indexed for r in indexed)  # closed, and their tables forgotten


def test_a_long_path(edges_of, ids_of, indexed):
    edges = save(edges_of([(i, i + 1) for i in range(40)]), "edges")
    got = paths.landmark_pointers(edges, ids_of([40])).collect()
    assert {(r["id"], r["hops"]) for r in got} == {(i, 40 - i) for i in range(41)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_settled_rows_are_not_exchanged(spark, indexed):
    first = spark.range(500).select("id", (F.col("id") % 7).alias("landmark"))
    rounds = iterate.Rounds(first, "plan", ["id", "landmark"])
    rounds.add(spark.range(500, 900).select("id", (F.col("id") % 7).alias("landmark")))
    reached = spark.range(1000).groupBy("id", (F.col("id") % 5).alias("landmark")).agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        fresh = rounds.without_settled(reached)
        plan = _plan(fresh)
        # The one exchange is that of the aggregate over what the round reached.
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
        scan = re.search(r"FileScan parquet spark_catalog.*", plan).group(0)
        assert "Bucketed: true" in scan
        assert {r["id"] for r in fresh.collect()} == {i for i in range(1000) if i >= 900 or i % 7 != i % 5}
        # A round adds its own files and leaves the others as they are.
        before = set(rounds.settled().inputFiles())
        rounds.add(spark.range(2000, 2010).select("id", F.lit(1).cast("long").alias("landmark")))
        after = set(rounds.settled().inputFiles())
        assert before < after and rounds.settled().count() == 910
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        rounds.close()


def test_waves_look_up_only_ids_they_reached(spark, indexed):
    rows = spark.range(300).select("id", (F.col("id") % 3).alias("landmark"), F.lit(None).cast("long").alias("next"))
    rounds = iterate.Rounds(rows, "waves", ["id", "landmark"], by=["id"])
    of_landmark = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "landmark long, cluster long")
    reached = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (5, 2), (400, 2)], "id long, cluster long")
    with rounds:
        got = backbone._unvisited(reached, rounds, of_landmark).collect()
    # 0 and 1 have seen cluster 0, 5 cluster 2; 2 has seen cluster 2 only.
    assert sorted(tuple(r) for r in got) == [(2, 0), (400, 2)]
