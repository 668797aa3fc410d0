"""The near-dedup stage drops near copies from a similarity of 0.8 on; op5 keeps its 0.85."""

import random

import pytest

import corpus_pipeline
from strata.llm import near
from test_near import brute, corpus


def _copies(groups, similar):
    """Texts of 49 words, each with a copy that shares 40 of their 50 shingles (0.8)."""
    draw = random.Random(groups)
    rows = []
    for _ in range(groups):
        base = [f"w{draw.randrange(10**6)}" for _ in range(49)]
        copy = list(base)
        copy[20 if similar else 4] = "other"
        if not similar:
            copy[30] = "other"
        rows += [" ".join(base), " ".join(copy)]
    return rows


def test_stage_threshold(spark):
    texts = _copies(20, True) + _copies(5, False) + [t for _, t in corpus(4, 20, 8, 160, 6)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "unused").collect())
    assert kept == sorted(d for d, _, c in brute(rows, percent=80) if c == d)
    assert kept != sorted(d for d, _, c in brute(rows) if c == d)


@pytest.mark.parametrize("limit", [2048, 12])
def test_against_all_pairs_at_80(spark, limit):
    rows = corpus(4, 40, 12, 160, 6) + [(10**6 + i, t) for i, t in enumerate(_copies(20, True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = near.near_duplicates(docs, percent=80, node_limit=limit).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str) == brute(rows, percent=80)


def test_bounds():
    assert near.bounds(85) == (0.92, 0.68, 0.55)
    for percent in range(55, 100, 5):
        sure, possible, nearby = near.bounds(percent)
        assert nearby < possible < percent / 100 < sure <= 1
