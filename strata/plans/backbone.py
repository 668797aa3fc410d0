"""Backbone hierarchies: important vertices, the shortest paths between them, and everybody
else attached to the nearest point of that backbone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.keys import was_clustered
from strata.operators import graph, paths
from strata.operators.components import chosen_ranks, contract, labels
from strata.operators.explore import with_key_columns
from strata.operators.iterate import Rounds
from strata.operators.skew import LIMITS, EdgeIndex, Limits
from strata.session import save, save_counted


def _own_key(vertex_id, levels: int):
    return F.array_repeat(vertex_id, levels)


def attach(
    vertices: DataFrame, edges: DataFrame, backbone: DataFrame, levels: int = 5
) -> DataFrame:
    """Hierarchy in which each vertex hangs below the backbone vertex it reaches first.

    A vertex with an edge to an attached vertex joins it; the least such id wins. Its key
    is the start of its path from the backbone, padded with its own id. Backbone vertices
    and vertices that reach none keep their own id on every level.
    """
    start = backbone.select(
        "id", F.lit(0).alias("depth"), _own_key(F.col("id"), levels).alias("key")
    )
    with EdgeIndex(edges, toward="src") as index, Rounds(start, "attach", ["id"]) as rounds:
        while True:
            parent = F.struct("id", "depth", "key")
            reached = (
                index.expand(rounds.frontier)
                .groupBy(F.col("nbr").alias("child"))
                .agg(F.min(parent).alias("p"))
            )
            depth = F.col("p.depth") + 1
            own = F.slice(_own_key(F.col("child"), levels), F.lit(1), F.greatest(levels - depth, F.lit(0)))
            key = F.concat(F.slice("p.key", F.lit(1), F.least(depth, F.lit(levels))), own)
            attached = reached.select(F.col("child").alias("id"), depth.alias("depth"), key.alias("key"))
            if not rounds.add(rounds.without_settled(attached)):
                break
    keys = vertices.select("id").join(rounds.all().select("id", "key"), "id", "left")
    keys = keys.select("id", F.coalesce("key", _own_key(F.col("id"), levels)).alias("key"))
    return with_key_columns(keys, levels)


def _unvisited(reached: DataFrame, rounds: Rounds, of_landmark: DataFrame) -> DataFrame:
    """The rows (id, cluster, w) of a wave where no wave of the same cluster has been.

    Clusters merge, so a settled row's cluster is looked up by its landmark. Once settled rows
    are many, only those at the ids that the wave reached are: they lie bucketed by id.
    """
    if rounds.indexed:
        reached = save(reached, "reached")
        settled = rounds.settled(reached.select("id").distinct())
    else:
        settled = rounds.settled()
    visited = settled.join(of_landmark, "landmark").select("id", "cluster")
    return reached.join(visited, ["id", "cluster"], "left_anti")


def terminal_forest(
    edges: DataFrame, terminals: DataFrame, limits: Limits = LIMITS
) -> tuple[DataFrame, DataFrame]:
    """The minimum spanning forest of the closure between the terminals.

    Returns (forest (src, landmark, hops), pointers (id, landmark, next, hops)); the
    closure itself is never built. A wave starts at each terminal and walks the edges
    backwards, all by one hop per round; terminals that meet are linked with that number of
    hops and are one cluster from then on (Kruskal by hops). Of a cluster's waves only the
    first to reach a vertex goes on, the one of least terminal id among equals: every later
    path between the same two clusters is longer or ranks after it, so it cannot be in the
    forest. The loop ends when one cluster is left or no wave moves. The state is one row
    per vertex and cluster, and clusters vanish quickly, where the whole closure has one
    row per vertex and terminal.
    """
    first = terminals.select(
        "id", F.col("id").alias("landmark"), F.lit(None).cast("bigint").alias("next")
    )
    clusters, left = save_counted(
        terminals.select("id", F.col("id").alias("cluster")), "clusters"
    )
    forest = first.select(
        F.col("id").alias("src"), "landmark", F.lit(0).alias("hops")
    ).where(F.lit(False))
    waves = Rounds(first, "waves", ["id", "landmark"], by=["id"], limits=limits)
    with EdgeIndex(edges, toward="src", limits=limits) as index, waves as rounds:
        while left > 1:
            of_landmark = clusters.select(F.col("id").alias("landmark"), "cluster")
            reached = (
                index.expand(rounds.frontier.select("id", "landmark"))
                .groupBy(F.col("nbr").alias("id"), "landmark")
                .agg(F.min(F.col("id")).alias("next"))
                .join(of_landmark, "landmark")
                .groupBy("id", "cluster")
                .agg(F.min(F.struct("landmark", "next")).alias("w"))
            )
            wave = _unvisited(reached, rounds, of_landmark).select("id", "w.landmark", "w.next")
            if not rounds.add(wave):
                break
            linked, clusters = _link(rounds.frontier, clusters)
            if linked is None:
                continue
            forest = forest.unionByName(
                linked.select("src", "landmark", F.lit(rounds.round).alias("hops"))
            )
            left = clusters.select("cluster").distinct().count()
    return forest, rounds.all().withColumnRenamed("round", "hops")


def _link(wave: DataFrame, clusters: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Link the clusters that met in this round: (chosen (src, landmark), new clusters)."""
    at = clusters.select("id", F.col("cluster").alias("a"))
    of = clusters.select(F.col("id").alias("landmark"), F.col("cluster").alias("b"))
    rank = F.struct(
        F.least("id", "landmark").alias("least"),
        F.greatest("id", "landmark").alias("greatest"),
        F.col("id").alias("src"),
    )
    met = wave.join(at, "id").join(of, "landmark")
    # Both directions of a closure edge may have met; the one of lesser src is kept.
    ends = F.array(
        F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    )
    links = save(met.select(F.inline(ends), rank.alias("rank")), "met")
    levels, chosen = contract(links, ranked=True)
    if not levels:
        return None, clusters
    src = F.col("rank.src")
    other = F.when(src == F.col("rank.least"), F.col("rank.greatest")).otherwise(
        F.col("rank.least")
    )
    merged = clusters.join(labels(levels).withColumnRenamed("id", "cluster"), "cluster", "left").select(
        "id", F.coalesce("root", "cluster").alias("cluster")
    )
    ranks = chosen_ranks(chosen)
    return ranks.select(src.alias("src"), other.alias("landmark")), save(merged, "clusters")


def keep_one_backbone(edges: DataFrame, terminals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of the backbone along one spanning forest of the terminals."""
    forest, pointers = terminal_forest(edges, terminals)
    return paths.backbone(paths.expand_paths(pointers, forest), terminals)


def _stored(edges: DataFrame) -> DataFrame:
    return save(graph.distinct_edges(edges), "edges")


def keep_one(
    edges: DataFrame,
    vertices: DataFrame | None = None,
    min_out_degree: int = 5,
    levels: int = 5,
) -> DataFrame:
    """Hierarchy around a minimum spanning forest of the vertices of out-degree above
    ``min_out_degree``. Isolated and unreached vertices are their own cluster."""
    edges = _stored(edges)
    vertices = graph.endpoints(edges) if vertices is None else vertices
    important = graph.important(graph.degrees(edges), min_out_degree).select("id")
    terminals = save(important, "terminals")
    backbone, _ = keep_one_backbone(edges, terminals)
    return attach(vertices, edges, save(backbone, "backbone"), levels)


def pick_important(
    edges: DataFrame, vertices: DataFrame, seed: int = 0, max_hops: int | None = None
) -> DataFrame:
    """The vertices of keep_all: k is 100 over the average path length, at least 2; of all
    vertices whose total degree reaches the k-th largest, a random k (all if fewer).

    On a graph whose average path is at least one hop that is at most 100 landmarks,
    whatever its size. Without any path k is 100.
    """
    average = paths.avg_path_length(edges, vertices, 10, seed, max_hops).first()[0]
    k = max(2, int(100.0 / average)) if average else 100
    candidates = graph.top_degree(graph.attach_degrees(vertices, edges), k)
    return graph.sample_landmarks(candidates, k, seed)


def keep_all_backbone(
    edges: DataFrame, important: DataFrame, max_hops: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Backbone of all shortest paths between the important vertices."""
    pointers = paths.landmark_pointers(edges, important, max_hops)
    pairs = paths.closure(pointers, important)
    return paths.backbone(paths.expand_paths(pointers, pairs), important)


def keep_all(
    edges: DataFrame,
    vertices: DataFrame | None = None,
    seed: int = 0,
    levels: int = 5,
    important: DataFrame | None = None,
    max_hops: int | None = None,
) -> DataFrame:
    """Hierarchy around all shortest paths between the important vertices. Vertices with a
    uniform key (the backbone itself, and what no edge leads to it) are left out."""
    edges = _stored(edges)
    vertices = graph.endpoints(edges) if vertices is None else vertices
    if important is None:
        important = pick_important(edges, vertices, seed, max_hops)
    important = save(important.select("id"), "important")
    backbone, _ = keep_all_backbone(edges, important, max_hops)
    return attach(vertices, edges, save(backbone, "backbone"), levels).where(
        was_clustered(F.col("key"))
    )
