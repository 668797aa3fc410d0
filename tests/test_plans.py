"""What the plans must not contain, and what must reach the scans."""

import pathlib
import re

import pytest

import __spark_entry__ as entry
from catalog import explore, feeds, relational

SF = "/root/testdata/sf0.001"
LAZY = [
    name
    for topic in (feeds, relational, explore)
    for name in topic.QUERIES
    if name not in ("edge_list", "libsvm_source", "stored_drill", "stored_links", "stored_adjacent", "stored_rollup")
]


# Windows over the names of one hash value, over top-k rows, or with a row limit before them.
WINDOWED = {"follow_graph", "resolve_edges", "follower_pages"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    for node in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas", "PythonUDF"):
        assert node not in plan
    assert name in WINDOWED or not re.search(r"\bWindow \[", plan)


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(entry.queries()["induced_subgraph"](spark, SF))
    assert "PushedFilters: [IsNotNull(c_nationkey), GreaterThanOrEqual(c_nationkey,0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    plan = plan_of(entry.queries()["tag_features"](spark, SF))
    scans = set(re.findall(r"ReadSchema: (struct<\S+>)", plan))
    assert "struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in scans
    assert not any("props" in s or "o_totalprice" in s for s in scans)


def test_aggregates_combine_before_the_shuffle(spark):
    for name in ("degrees", "latest_per_key", "tag_times", "super_edges", "rollup_levels"):
        assert "partial_" in plan_of(entry.queries()[name](spark, SF))


def test_every_query_has_columns_and_sql_keys_are_queries(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 80


def test_library_sources():
    root = pathlib.Path(entry.__file__).parent / "strata"
    text = "\n".join(p.read_text() for p in root.rglob("*.py") if p.parent.name != "llm")
    for word in ("localCheckpoint", ".collect(", "toPandas", "crossJoin", ".rdd", "udf("):
        assert word not in text
    assert text.count("F.broadcast(") == text.count("F.broadcast(hot)")
