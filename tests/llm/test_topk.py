"""Top-k search against every inner product, sorted."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strata.llm import topk


def brute(rows, k=5, scale=256, every=5):
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in fine]
    out = []
    for q, v in {(i, tuple(v)) for i, v in fine if i % every == 0}:
        scored = sorted(
            (-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i)
            for i, w in fine
            if i != q and len(v) == len(w)
        )
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def _got(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int")
    return sorted(map(tuple, topk.search(df.repartition(3), F.col("id") % 5 == 0, **how).collect()))


@pytest.mark.parametrize("block,bins", [(1024, 1024), (7, 4)])
def test_against_all_scores(spark, block, bins, monkeypatch):
    monkeypatch.setattr(topk, "BINS", bins)
    draw = random.Random(1)
    rows = [(i, [draw.gauss(0, 0.3) for _ in range(8)]) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(150, 190)]
    assert _got(spark, rows, block_size=block) == brute(rows)


def test_rows_of_any_kind(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 2.0]), (5, [0.0, 0.0]), (10, [-1.0, 0.5]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (4, [nan, 1.0]),
            (15, [inf, 1.0]), (20, [None, 1.0]), (None, [1.0, 1.0]), (25, [1.0]), (6, [2.0]), (30, [1.0, 2.0]), (30, [1.0, 2.0]),
            (-5, [0.001, -0.001])]
    assert _got(spark, rows) == brute(rows)
    assert _got(spark, rows, k=1) == brute(rows, k=1)
    assert _got(spark, []) == []
    assert _got(spark, [(0, [1.0])]) == []


def test_large_components(spark):
    rows = [(i, [1e6 * i + 0.25, -3e7 / (i + 1), float(i)]) for i in range(20)]
    assert _got(spark, rows) == brute(rows)
    rows = [(i, [1e15 * (i - 9), 1e3]) for i in range(20)]
    assert _got(spark, rows) == brute(rows)
