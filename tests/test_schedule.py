"""Fuzzy equivalence at falling thresholds against plain Python."""

import graphs
import pytest

from strata.plans import equivalence


def _keys(df):
    return {r["id"]: list(r["key"]) for r in df.collect()}


@pytest.mark.parametrize("mode, symmetric", [("plain", True), ("subset", True), ("plain", False)])
def test_schedule(edges_of, mode, symmetric):
    edges = graphs.random_edges(30, 90, 4, hub=0.4) + [(100 + k, n) for k in range(6) for n in range(k, k + 5)]
    thresholds = (2.0, 1.6, 1.2, 1.0)
    got = equivalence.structural_fuzzy_schedule(edges_of(edges), thresholds=thresholds, levels=3, mode=mode, symmetric=symmetric)
    want = graphs.fuzzy_schedule(edges, thresholds, 3, mode, symmetric)
    assert _keys(got) == want
    if mode == "plain" and symmetric:  # the graph on which keys are the work of more than one pass
        assert any(len(set(k)) > 2 for k in want.values())


def test_one_pass_is_the_plain_builder(edges_of):
    table = edges_of(graphs.random_edges(30, 90, 5))
    once = _keys(equivalence.structural_fuzzy_schedule(table, thresholds=(1.2,)))
    assert once == _keys(equivalence.structural_fuzzy(table, threshold=1.2))


def test_thresholds():
    assert equivalence.falling_thresholds(1.0, 5) == pytest.approx([2.0, 1.8, 1.6, 1.4, 1.2, 1.0])
    assert equivalence.falling_thresholds(2.0, 5) == [2.0]


def test_thresholds_must_fall(edges_of):
    with pytest.raises(ValueError, match="fall"):
        equivalence.structural_fuzzy_schedule(edges_of([(1, 2)]), thresholds=(1.0, 1.5))
