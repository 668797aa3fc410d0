"""The containment index against plain Python, and how much it compares."""

import random

import pytest

from strata.plans import equivalence


def _tables(spark, sets):
    """(candidates, tokens) of ``sets``: id -> set of (side, element)."""
    rows = [(i, side, nbr) for i, members in sets.items() for side, nbr in members]
    sizes = [(i, sum(s == 0 for s, _ in m), sum(s == 1 for s, _ in m)) for i, m in sets.items()]
    table = spark.createDataFrame(rows, "id bigint, side int, nbr bigint")
    sizes = spark.createDataFrame(sizes, "id bigint, n_out bigint, n_in bigint")
    return sizes.select("id"), equivalence._tokens(table, sizes)


def _community(n, elements, share, seed):
    """``n`` different sets in which every element is a hub, held by ``share`` of them."""
    rnd = random.Random(seed)
    found = {frozenset((rnd.randrange(2), e) for e in range(elements) if rnd.random() < share) for _ in range(n)}
    return dict(enumerate(sorted(found - {frozenset()}, key=sorted)))


def _covered(sets):
    return {i for i, s in sets.items() if any(s < t for t in sets.values())}


@pytest.mark.parametrize("node, depth", [(64, 16), (4, 16), (4, 2), (1, 3)])
def test_against_plain_python(spark, monkeypatch, node, depth):
    monkeypatch.setattr(equivalence, "_NODE", node)
    monkeypatch.setattr(equivalence, "_DEPTH", depth)
    sets = _community(160, 7, 0.5, 3)
    want = _covered(sets)
    assert 0 < len(want) < len(sets)
    got = equivalence.covered_sets(*_tables(spark, sets))
    assert sorted(r["id"] for r in got.collect()) == sorted(want)


def test_only_the_asked_sets(spark, monkeypatch):
    monkeypatch.setattr(equivalence, "_NODE", 2)
    sets = _community(120, 6, 0.5, 4)
    candidates, tokens = _tables(spark, sets)
    got = equivalence.covered_sets(candidates.where("id % 3 = 0"), tokens)
    assert {r["id"] for r in got.collect()} == {i for i in _covered(sets) if i % 3 == 0}
    assert equivalence.covered_sets(candidates.where("false"), tokens).isEmpty()


@pytest.mark.parametrize("n", [200, 400])
def test_hubs_are_not_compared_with_all_their_holders(spark, monkeypatch, n):
    node = 8
    monkeypatch.setattr(equivalence, "_NODE", node)
    sets = _community(n, 24, 0.6, 5)
    candidates, tokens = _tables(spark, sets)
    pairs, covered = equivalence.containment_pairs(candidates, tokens)
    holders = {}
    for s in sets.values():
        for e in s:
            holders[e] = holders.get(e, 0) + 1
    listed = 0
    for s in sets.values():
        rarest = min(s, key=lambda e: (holders[e], e))
        listed += sum(rarest in t and len(t) > len(s) for t in sets.values())
    # Growth is that of the sets asked; listing the larger holders grows with its square.
    assert pairs.count() <= node * len(sets)
    assert listed > n * n / 16 and covered.count() < len(sets)
