"""Hierarchy builders against the fixture graphs and plain-Python answers."""

import graphs
import pytest
from pyspark.sql import functions as F

from strata.operators import components, explore, graph, paths
from strata.plans import backbone, equivalence, labels


def keys(hierarchy):
    return {r["id"]: list(r["key"]) for r in hierarchy.collect()}


def test_landmark_paths_fixture(edges_of, ids_of):
    rows = paths.landmark_paths(edges_of(graphs.CHAIN), ids_of([20, 23])).collect()
    got = {(r["id"], r["landmark"]): list(r["path"]) for r in rows}
    assert got[27, 20] == [23, 22, 21, 20] and got[24, 23] == [20, 21, 22, 23] and got[20, 20] == []
    pointers = paths.landmark_pointers(edges_of(graphs.CHAIN), ids_of([20, 23]))
    # Whole means of the hops to 20 and 23: 1 for the chain, 2 for the leaves.
    assert paths.average_hops(pointers).first()[0] == pytest.approx((4 * 1 + 5 * 2) / 9)


@pytest.mark.parametrize("seed", range(3))
def test_landmark_paths_random(edges_of, ids_of, seed):
    edges = graphs.random_edges(40, 90, seed)
    rows = paths.landmark_paths(edges_of(edges), ids_of([1, 7])).collect()
    want = {
        (v, t): path for t in (1, 7) for v, path in graphs.shortest(edges, t).items()
    }
    assert {(r["id"], r["landmark"]): list(r["path"]) for r in rows} == want


def test_expanded_paths_match(edges_of, ids_of):
    edges = graphs.random_edges(40, 90, 5)
    pointers = paths.landmark_pointers(edges_of(edges), ids_of([1, 7]))
    pairs = pointers.select(F.col("id").alias("src"), "landmark", "hops")
    got = {}
    for r in paths.expand_paths(pointers, pairs).orderBy("pos").collect():
        got.setdefault((r["src"], r["landmark"]), []).append(r["node"])
    want = {
        (v, t): p for t in (1, 7) for v, p in graphs.shortest(edges, t).items() if p
    }
    assert got == want


def test_max_hops_raises_when_it_is_reached(edges_of, ids_of):
    edges = edges_of(graphs.CHAIN)
    assert paths.landmark_pointers(edges, ids_of([20]), max_hops=4).count() == 9
    with pytest.raises(RuntimeError, match="more than 2 hops"):
        paths.landmark_pointers(edges, ids_of([20]), max_hops=2)


def test_far_pairs_are_in_the_closure(edges_of, ids_of):
    ends = ids_of([0, 130])
    pointers = paths.landmark_pointers(edges_of([(i, i + 1) for i in range(130)]), ends)
    assert [tuple(r) for r in paths.closure(pointers, ends).collect()] == [(0, 130, 130)]


@pytest.mark.parametrize("m", [15, 40, 120])
def test_components_random(edges_of, ids_of, m):
    edges = graphs.random_edges(60, m, m)
    got = components.components(ids_of(range(60)), edges_of(edges)).collect()
    assert {r["id"]: r["component"] for r in got} == graphs.components(range(60), edges)


def test_components_of_a_long_chain(edges_of, ids_of):
    chain = [(i, i + 1) for i in range(100)]
    got = components.components(ids_of(range(102)), edges_of(chain)).collect()
    assert {r["id"]: r["component"] for r in got} == {**dict.fromkeys(range(101), 0), 101: 101}


@pytest.mark.parametrize("seed", range(3))
def test_spanning_forest_is_kruskals(spark, seed):
    pairs = graphs.random_edges(40, 25 + 40 * seed, seed)
    rows = [(a, b, (a * 7 + b * 3) % 5) for a, b in pairs]
    got = components.spanning_forest(spark.createDataFrame(rows, "src bigint, dst bigint, weight int"))
    assert {tuple(r) for r in got.collect()} == graphs.kruskal(rows)


def test_keep_one_fixture(edges_of):
    got = keys(backbone.keep_one(edges_of(graphs.CHAIN), min_out_degree=2))
    want = {v: [v] * 5 for v in (20, 21, 22, 23)}
    want.update({v: [20, v, v, v, v] for v in (24, 25, 26)})
    want.update({v: [23, v, v, v, v] for v in (27, 28)})
    assert got == want == graphs.keep_one(graphs.CHAIN, 2, 5)


@pytest.mark.parametrize("seed, m, k", [(1, 60, 2), (2, 90, 4), (3, 45, 1), (4, 70, 3), (5, 150, 7)])
def test_keep_one_random(edges_of, seed, m, k):
    edges = graphs.random_edges(40, m, seed)
    got = keys(backbone.keep_one(edges_of(edges), min_out_degree=k))
    assert got == graphs.keep_one(edges, k, 5)


def test_keep_one_without_important_vertices(edges_of):
    got = keys(backbone.keep_one(edges_of(graphs.CHAIN), min_out_degree=50))
    assert got == {v: [v] * 5 for v in range(20, 29)}


def test_keep_all_fixture(edges_of, ids_of):
    got = keys(backbone.keep_all(edges_of(graphs.CHAIN), important=ids_of([20, 23])))
    leaves = {**dict.fromkeys((24, 25, 26), 20), **dict.fromkeys((27, 28), 23)}
    assert got == {v: [top, v, v, v, v] for v, top in leaves.items()}


@pytest.mark.parametrize("seed", range(2))
def test_keep_all_random(edges_of, ids_of, seed):
    edges = graphs.random_edges(50, 100, seed)
    got = keys(backbone.keep_all(edges_of(edges), important=ids_of([2, 3, 11]), levels=3))
    assert got == graphs.keep_all(edges, [2, 3, 11], 3)


def test_degree_hierarchy_fixture(edges_of):
    got = keys(labels.degree_hierarchy(edges_of(graphs.FALLING), levels=4))
    assert got[8] == [1, 2, 6, 8] and got[9] == [1, 2, 9, 9] and got[3] == [1, 3, 3, 3] and got[1] == [1] * 4
    assert keys(labels.degree_hierarchy(edges_of(graphs.FALLING), levels=3))[8] == [2, 6, 8]


@pytest.mark.parametrize("levels", [1, 2, 5, 10])
def test_degree_hierarchy_random(edges_of, levels):
    edges = graphs.random_edges(60, 150, 3, hub=0.3)
    got = keys(labels.degree_hierarchy(edges_of(edges), levels=levels))
    assert got == graphs.degree_hierarchy(edges, levels)


def test_seed_labels_fixture(edges_of):
    shifted = [(a - 20, b - 20) for a, b in graphs.CHAIN]
    got = keys(labels.seed_labels(edges_of(shifted), levels=2, level_size=2))
    assert got == graphs.seed_labels(shifted, 2, 2) and got[8] == [1, 3]


def test_seed_labels_random(edges_of):
    edges = graphs.random_edges(60, 100, 9)
    got = keys(labels.seed_labels(edges_of(edges), levels=4, level_size=5))
    assert got == graphs.seed_labels(edges, 4, 5)


def test_structural_fixture(edges_of, ids_of):
    edges = edges_of(graphs.BLOWN_UP)
    h = equivalence.structural(edges, ids_of(range(1, 13)))
    got = keys(h)
    assert {v: k[0] for v, k in got.items()} == {v: c[0] for c in [*graphs.CLASSES, (12,)] for v in c}
    assert got[4] == [3, 4, 4, 4]
    members = explore.drill_members(h, [])
    sizes = {r["super"]: r["num_nodes"] for r in explore.supernode_sizes(members).collect()}
    assert sizes == {1: 2, 3: 3, 6: 1, 7: 3, 10: 2, 12: 1}
    links = explore.super_edges(members, edges)
    assert {(r["src"], r["dst"]): r["weight"] for r in links.collect()} == {
        (1, 3): 6, (3, 6): 3, (6, 7): 3, (6, 10): 2, (7, 6): 3,
    }
    assert explore.interior_edges(members, edges).isEmpty()
    degrees = {r["super"]: r["degree"] for r in explore.super_degrees(links).collect()}
    assert degrees == {1: 1, 3: 2, 6: 4, 7: 2, 10: 1}


def test_structural_random(edges_of):
    edges = graphs.random_edges(60, 50, 2)
    got = keys(equivalence.structural(edges_of(edges)))
    assert {v: k[0] for v, k in got.items()} == graphs.structural(edges)


def test_fingerprint_collisions_are_resolved(edges_of, monkeypatch):
    """With a fingerprint that says nothing in the first round, the result is the same."""
    real = F.xxhash64

    def useless_first(*columns):
        value = real(*columns)
        return F.when(F.lit(calls.pop(0)), F.lit(0).cast("bigint")).otherwise(value)

    calls = [True, True] + [False] * 100
    monkeypatch.setattr(equivalence.F, "xxhash64", useless_first)
    got = keys(equivalence.structural(edges_of(graphs.BLOWN_UP)))
    monkeypatch.undo()
    assert {v: k[0] for v, k in got.items()} == graphs.structural(graphs.BLOWN_UP)


@pytest.mark.parametrize("threshold", [2.0, 1.6, 1.0])
def test_fuzzy_fixture(edges_of, threshold):
    got = keys(equivalence.structural_fuzzy(edges_of(graphs.BLOWN_UP), threshold=threshold, symmetric=False))
    assert {v: k[0] for v, k in got.items()} == graphs.fuzzy(graphs.BLOWN_UP, threshold, symmetric=False)


def _near_copies(seed, vertices=60, groups=4):
    """Vertices of a few groups that share most neighbours, with hubs everybody has."""
    import random

    rng = random.Random(seed)
    edges = set()
    for v in range(vertices):
        common = range(1000 + 10 * (v % groups), 1008 + 10 * (v % groups))
        edges |= {(v, c) for c in common if rng.random() < 0.85}
        edges |= {(v, 2000), (v, 2001 + rng.randrange(vertices))}
        if rng.random() < 0.3:
            edges.add((rng.randrange(vertices), v))
    return sorted((a, b) for a, b in edges if a != b)


@pytest.mark.parametrize(
    "threshold, mode, symmetric, block",
    [(1.0, "plain", True, 64), (1.3, "plain", True, 1), (1.0, "plain", False, 2),
     (1.7, "plain", False, 64), (1.0, "subset", True, 1), (1.2, "subset", False, 64)],
)
def test_fuzzy_near_copies(edges_of, monkeypatch, threshold, mode, symmetric, block):
    monkeypatch.setattr(equivalence, "_FIRST_BLOCK", block)
    monkeypatch.setattr(equivalence, "_BLOCK_GROWTH", 3)
    edges = _near_copies(int(threshold * 10))
    got = keys(
        equivalence.structural_fuzzy(edges_of(edges), threshold=threshold, mode=mode, symmetric=symmetric)
    )
    want = graphs.fuzzy(edges, threshold, mode, symmetric)
    assert {v: k[0] for v, k in got.items()} == want
    assert any(a != b for a, b in want.items())


@pytest.mark.parametrize("seed", range(3))
def test_fuzzy_random(edges_of, seed):
    edges = graphs.random_edges(50, 70, seed, hub=0.4)
    for symmetric in (True, False):
        got = keys(equivalence.structural_fuzzy(edges_of(edges), threshold=1.0, symmetric=symmetric))
        assert {v: k[0] for v, k in got.items()} == graphs.fuzzy(edges, 1.0, "plain", symmetric)


def test_reruns_give_the_same_rows(edges_of):
    edges = edges_of(graphs.random_edges(50, 120, 8))
    assert keys(backbone.keep_all(edges, seed=3)) == keys(backbone.keep_all(edges, seed=3))


def test_rollup_properties(edges_of):
    """Edges are either between clusters or inside one; sizes add up to all vertices."""
    edges = edges_of(graphs.random_edges(50, 120, 8))
    h = backbone.keep_one(edges, min_out_degree=3)
    n, m = graph.endpoints(edges).count(), edges.count()
    for row in explore.rollup_levels(h, edges).groupBy("level").agg(F.sum("weight").alias("w")).collect():
        assert row["w"] == m
    for row in explore.rollup_members(h).groupBy("level").agg(F.sum("num_nodes").alias("n")).collect():
        assert row["n"] == n
    top = explore.drill_members(h, [])
    nodes = explore.supernodes(top, edges)
    between = explore.super_edges(top, edges).agg(F.sum("weight")).first()[0] or 0
    assert between + nodes.agg(F.sum("num_edges")).first()[0] == m
