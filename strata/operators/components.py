"""Connected components and minimum spanning forests by contraction.

Every round each cluster picks one neighbouring cluster, clusters that picked each other
merge, and the edges are rewritten to the merged ids. The number of clusters at least
halves per round, whatever the diameter of the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.iterate import iterate
from strata.session import save, save_counted

_MAX_ROUNDS = 100


def _jump(state: DataFrame) -> DataFrame:
    """Replace every parent by the parent's parent; ``active`` until that is a root."""
    above = state.select(
        F.col("id").alias("parent"), F.col("parent").alias("above"), F.col("active").alias("open")
    )
    return state.drop("active").join(above, "parent").select(
        "id", F.col("above").alias("parent"), F.col("open").alias("active")
    )


def _roots(picks: DataFrame) -> DataFrame:
    """(id, parent) with the parent a root, from a stored (id, pick).

    The picks' only cycles are pairs that picked each other; the smaller of such a pair is
    the root. Each round jumps twice, so it covers four times the depth of the last one.
    """
    back = picks.select(F.col("id").alias("pick"), F.col("pick").alias("back"))
    is_root = (F.col("back") == F.col("id")) & (F.col("id") < F.col("pick"))
    start = picks.join(back, "pick").select(
        "id",
        F.when(is_root, F.col("id")).otherwise(F.col("pick")).alias("parent"),
        (~is_root).alias("active"),
    )
    return iterate(start, lambda state, _round: _jump(_jump(state)), _MAX_ROUNDS, "roots")


def _relabel(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges (a, b, ...) between clusters after the merge; inner edges are dropped."""
    left = roots.select(F.col("id").alias("a"), F.col("parent").alias("ra"))
    right = roots.select(F.col("id").alias("b"), F.col("parent").alias("rb"))
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return (
        edges.join(left, "a")
        .join(right, "b")
        .where("ra <> rb")
        .select(F.col("ra").alias("a"), F.col("rb").alias("b"), *rest)
    )


def both_ways(edges: DataFrame, *payload: Column) -> DataFrame:
    """(a, b, payload): every edge in both directions."""
    ends = F.array(
        F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
        F.struct(F.col("dst").alias("a"), F.col("src").alias("b")),
    )
    return edges.select(F.inline(ends), *payload)


def contract(
    edges: DataFrame, ranked: bool = False
) -> tuple[list[DataFrame], list[DataFrame]]:
    """Merge everything that edges connect.

    ``edges`` (a, b) in both directions, without self edges. Returns (levels, chosen).
    Every level maps the clusters of one round to those of the next, (id, parent);
    :func:`labels` composes them. With ``ranked`` the edges carry a column ``rank`` that
    orders them totally, each cluster picks its least edge, and chosen holds the ranks
    of the minimum spanning forest, round by round. Both are empty if there is no edge.
    """
    levels, chosen = [], []
    current = edges
    for _ in range(_MAX_ROUNDS):
        if ranked:
            best = F.min(F.struct("rank", "b")).alias("best")
            picked = current.groupBy(F.col("a").alias("id")).agg(best)
            picked = picked.select("id", F.col("best.b").alias("pick"), "best.rank")
        else:
            picked = current.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("pick"))
        picks, n = save_counted(picked, "picks")
        if n == 0:
            break
        roots = _roots(picks.select("id", "pick"))
        levels.append(roots)
        merged = _relabel(current, roots)
        if ranked:
            chosen.append(picks.select("rank"))
            merged = merged.groupBy("a", "b").agg(F.min("rank").alias("rank"))
        else:
            merged = merged.distinct()
        current, n = save_counted(merged, "contracted")
        if n == 0:
            break
    return levels, chosen


def labels(levels: list[DataFrame]) -> DataFrame:
    """(id, root) for every end of an edge. Unranked, the root is the cluster's least id.

    Each level maps fewer clusters, so they are composed from the last one back.
    """
    composed = levels[-1].select("id", F.col("parent").alias("root"))
    for roots in reversed(levels[:-1]):
        up = composed.select(F.col("id").alias("parent"), F.col("root").alias("top"))
        composed = roots.join(up, "parent", "left").select(
            "id", F.coalesce("top", "parent").alias("root")
        )
    return composed


def chosen_ranks(chosen: list[DataFrame]) -> DataFrame:
    ranks = chosen[0]
    for more in chosen[1:]:
        ranks = ranks.unionByName(more)
    return ranks.distinct()


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id of the vertex's undirected component."""
    links = edges.where("src <> dst").select("src", "dst")
    levels, _ = contract(save(both_ways(links).distinct(), "links"))
    if not levels:
        return vertices.select("id", F.col("id").alias("component"))
    return vertices.select("id").join(labels(levels), "id", "left").select(
        "id", F.coalesce("root", "id").alias("component")
    )


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): the minimum spanning forest of the undirected graph.

    Opposite edges count as one, the lighter, on a tie the one of lesser src. Edges are
    compared by (weight, least end, greatest end), a total order, so the forest is unique.
    """
    one_way = (
        edges.where("src <> dst")
        .groupBy(F.least("src", "dst").alias("least"), F.greatest("src", "dst").alias("greatest"))
        .agg(F.min(F.struct("weight", "src")).alias("best"))
        .select(
            F.col("best.src").alias("src"),
            F.when(F.col("best.src") == F.col("least"), F.col("greatest"))
            .otherwise(F.col("least"))
            .alias("dst"),
            F.col("best.weight").alias("weight"),
        )
    )
    one_way = save(one_way, "one_way")
    rank = F.struct(
        F.col("weight"),
        F.least("src", "dst").alias("least"),
        F.greatest("src", "dst").alias("greatest"),
    )
    _, chosen = contract(both_ways(one_way, rank.alias("rank")), ranked=True)
    if not chosen:
        return one_way
    keys = ["least", "greatest"]
    return (
        one_way.withColumn("least", F.least("src", "dst"))
        .withColumn("greatest", F.greatest("src", "dst"))
        .join(chosen_ranks(chosen).select("rank.least", "rank.greatest"), keys, "left_semi")
        .select("src", "dst", "weight")
    )


def forest_weight(edges: DataFrame) -> DataFrame:
    """One row: number of edges and total weight of the minimum spanning forest."""
    return spanning_forest(edges).agg(
        F.count(F.lit(1)).alias("num_edges"),
        F.coalesce(F.sum("weight"), F.lit(0)).cast("bigint").alias("total_weight"),
    )


def within_components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges whose two ends carry the same component label."""
    src = labels.select(F.col("id").alias("src"), F.col("component").alias("cs"))
    dst = labels.select(F.col("id").alias("dst"), F.col("component").alias("cd"))
    return edges.join(src, "src").join(dst, "dst").where("cs = cd").select(*edges.columns)


def available_edges(edges: DataFrame, unavailable: DataFrame) -> DataFrame:
    """Edges that are not among ``unavailable`` (by src and dst)."""
    return edges.join(unavailable.select("src", "dst"), ["src", "dst"], "left_anti")
