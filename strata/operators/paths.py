"""Shortest paths to landmarks, their expansion, and the average path length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.graph import sample_landmarks
from strata.operators.iterate import Rounds, Stages
from strata.operators.skew import LIMITS, EdgeIndex, Limits
from strata.session import save


def landmark_pointers(
    edges: DataFrame, landmarks: DataFrame, max_hops: int | None = None, limits: Limits = LIMITS
) -> DataFrame:
    """(id, landmark, next, hops): the directed distance from each vertex to each landmark
    it can reach, and the least neighbour one hop nearer.

    ``edges`` is a stored table of distinct (src, dst), ``landmarks`` has a column ``id``.
    A breadth-first wave walks the edges backwards; the state holds one narrow row per
    (vertex, landmark) and no path. A pair farther apart than ``max_hops`` raises: nothing is
    left out silently.
    """
    start = landmarks.select(
        "id", F.col("id").alias("landmark"), F.lit(None).cast("bigint").alias("next")
    )
    with EdgeIndex(edges, toward="src", limits=limits) as index, Rounds(start, "landmarks", ["id", "landmark"], limits=limits) as rounds:
        while True:
            reached = (
                index.expand(rounds.frontier.select("id", "landmark"))
                .groupBy(F.col("nbr").alias("id"), "landmark")
                .agg(F.min(F.col("id")).alias("next"))
            )
            if not rounds.add(rounds.without_settled(reached)):
                break
            _check_hops(rounds, max_hops)
    return rounds.all().withColumnRenamed("round", "hops")


def _check_hops(rounds: Rounds, max_hops: int | None) -> None:
    if max_hops is not None and rounds.round > max_hops:
        raise RuntimeError(f"there are paths of more than {max_hops} hops")


def expand_paths(pointers: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, landmark, pos, at, node): the steps of the paths of ``pairs``.

    ``pairs`` has (src, landmark, hops). Step ``pos`` goes from ``at`` to ``node``. All
    paths advance together, one join per hop; the last hop needs no lookup.
    """
    links = pointers.select(F.col("id").alias("at"), "landmark", F.col("next").alias("node"))

    def advance(steps: DataFrame) -> DataFrame:
        left = steps.where("hops > 1").join(links, ["at", "landmark"])
        last = steps.where("hops = 1").withColumn("node", F.col("landmark"))
        return left.unionByName(last).select("src", "landmark", "at", "node", "hops")

    first = pairs.where("hops > 0").select("src", "landmark", F.col("src").alias("at"), "hops")
    stored = Stages(advance(first), "paths")
    while True:
        ahead = stored.frontier.where("hops > 1").select(
            "src", "landmark", F.col("node").alias("at"), (F.col("hops") - 1).alias("hops")
        )
        if not stored.add(advance(ahead)):
            break
    return stored.all().select("src", "landmark", F.col("round").alias("pos"), "at", "node")


def landmark_paths(
    edges: DataFrame, landmarks: DataFrame, max_hops: int | None = None
) -> DataFrame:
    """(id, landmark, hops, path): like :func:`landmark_pointers` with whole paths.

    The path lists the vertices after ``id`` up to the landmark (empty for the landmark
    itself). Among equally short paths it is the lexicographically least: it starts with the
    least neighbour one hop nearer and goes on with that one's own path. So a wave chooses
    among ids, and a path is moved once, for the vertex that takes it over, and not along
    every edge. An array holds at most as many ids as the path has hops.
    """
    start = landmarks.select(
        "id", F.col("id").alias("landmark"), F.array().cast("array<bigint>").alias("path")
    )
    with EdgeIndex(edges, toward="src") as index, Rounds(start, "paths", ["id", "landmark"]) as rounds:
        while True:
            reached = (
                index.expand(rounds.frontier.select("id", "landmark"))
                .groupBy(F.col("nbr").alias("id"), "landmark")
                .agg(F.min(F.col("id")).alias("next"))
            )
            nearer = rounds.frontier.select(F.col("id").alias("next"), "landmark", F.col("path").alias("rest"))
            longer = F.concat(F.array("next"), F.col("rest")).alias("path")
            fresh = rounds.without_settled(reached).join(nearer, ["next", "landmark"])
            if not rounds.add(fresh.select("id", "landmark", longer)):
                break
            _check_hops(rounds, max_hops)
    return rounds.all().select("id", "landmark", F.col("round").alias("hops"), "path")


def average_hops(pointers: DataFrame) -> DataFrame:
    """One row: the mean over vertices of the whole-number mean of their landmark distances."""
    per_vertex = pointers.groupBy("id").agg(
        F.expr("sum(hops) div count(hops)").alias("mean_hops")
    )
    return per_vertex.agg(F.avg("mean_hops").alias("avg_path_length"))


def avg_path_length(
    edges: DataFrame,
    vertices: DataFrame,
    n: int = 10,
    seed: int = 0,
    max_hops: int | None = None,
) -> DataFrame:
    """The average path length estimated from ``n`` sampled landmarks."""
    landmarks = save(sample_landmarks(vertices, n, seed), "sampled")
    return average_hops(landmark_pointers(edges, landmarks, max_hops))


def closure(pointers: DataFrame, important: DataFrame) -> DataFrame:
    """(src, landmark, hops): the closure edges between important vertices, no self edges."""
    return (
        pointers.where("id <> landmark")
        .join(important.select("id"), "id", "left_semi")
        .select(F.col("id").alias("src"), "landmark", "hops")
    )


def backbone(steps: DataFrame, important: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of the backbone: the important vertices and all paths' steps."""
    edges = steps.select(F.col("at").alias("src"), F.col("node").alias("dst")).distinct()
    on_paths = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    vertices = important.select("id").unionByName(on_paths).distinct()
    return vertices, edges
