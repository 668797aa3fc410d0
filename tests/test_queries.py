"""Every query against its SQL counterpart on the smallest tables."""

import pytest

import __spark_entry__ as entry
from catalog.check import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, name, SF) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["id", "hashtag", "cutoff"] and df.count() > 0
