"""Hierarchies by degree hill-climbing and by seeded waves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.keys import UNASSIGNED, seed_slot, was_clustered
from strata.operators import graph
from strata.operators.explore import with_key_columns
from strata.operators.iterate import Rounds
from strata.operators.skew import EdgeIndex
from strata.session import save


def degree_parents(edges: DataFrame) -> DataFrame:
    """(id, parent): the in-neighbour of greatest out-degree, if greater than the vertex's
    own; the least id on a tie."""
    own = graph.degrees(edges).select("id", "out_degree")
    sender = own.select(F.col("id").alias("src"), F.col("out_degree").alias("src_degree"))
    best = F.max(F.struct(F.col("src_degree"), (-F.col("src")).alias("minus_src")))
    strongest = (
        edges.join(sender, "src").groupBy(F.col("dst").alias("id")).agg(best.alias("best"))
    )
    return (
        strongest.join(own, "id")
        .where("best.src_degree > out_degree")
        .select("id", (-F.col("best.minus_src")).alias("parent"))
    )


def degree_hierarchy(
    edges: DataFrame, vertices: DataFrame | None = None, levels: int = 10
) -> DataFrame:
    """Each vertex below its strongest in-neighbour, level by level.

    The key is the end of the chain root ... vertex, ``levels`` ids at most, padded with
    the vertex's own id. Chains are built by doubling: after round r a vertex knows its
    2^r nearest ancestors, so ten levels take four joins.
    """
    edges = save(graph.distinct_edges(edges), "edges")
    vertices = graph.endpoints(edges) if vertices is None else vertices
    parents = save(degree_parents(edges), "parents")
    chain = vertices.select("id").join(parents, "id", "left").select(
        "id",
        F.when(F.col("parent").isNull(), F.array().cast("array<bigint>"))
        .otherwise(F.array("parent"))
        .alias("above"),
    )
    known = 1
    while known < levels - 1:
        # Nearest ancestor first; the last known one is where the next stretch begins.
        head = F.get("above", F.lit(known - 1))
        stretch = chain.where(F.size("above") > 0).select(
            F.col("id").alias("head"), F.col("above").alias("more")
        )
        longer = F.concat("above", F.coalesce("more", F.array().cast("array<bigint>")))
        chain = (
            chain.withColumn("head", head)
            .join(stretch, "head", "left")
            .select("id", F.slice(longer, 1, levels - 1).alias("above"))
        )
        known *= 2
        if known in (4, 16, 64):  # two doublings per stored table
            chain = save(chain, "chain")
    near = F.slice("above", 1, levels - 1) if levels > 1 else F.array().cast("array<bigint>")
    line = F.concat(F.reverse(near), F.array("id"))
    padded = F.concat(line, F.array_repeat(F.col("id"), F.lit(levels) - F.size(line)))
    return with_key_columns(chain.select("id", padded.alias("key")), levels)


def seed_labels(
    edges: DataFrame,
    vertices: DataFrame | None = None,
    levels: int = 10,
    level_size: int = 100,
) -> DataFrame:
    """Each vertex carries, per level, the seed whose wave along the edges reaches it first.

    The seeds of level i are the ids from ``i * level_size`` on, ``level_size`` of them;
    of seeds that arrive together the least id wins. All levels run in one loop.
    Vertices with a uniform key are left out.
    """
    edges = save(graph.distinct_edges(edges), "edges")
    vertices = graph.endpoints(edges) if vertices is None else vertices
    seeds = vertices.select(
        "id",
        seed_slot(F.col("id"), levels, level_size).alias("level"),
        F.col("id").alias("seed"),
    ).where("level IS NOT NULL")
    with EdgeIndex(edges, toward="dst") as index, Rounds(seeds, "seeds", ["id", "level"]) as rounds:
        while True:
            reached = (
                index.expand(rounds.frontier)
                .groupBy(F.col("nbr").alias("id"), "level")
                .agg(F.min("seed").alias("seed"))
            )
            if not rounds.add(rounds.without_settled(reached)):
                break
    slots = [
        F.max(F.when(F.col("level") == i, F.col("seed"))).alias(f"slot_{i}") for i in range(levels)
    ]
    labelled = rounds.all().groupBy("id").agg(*slots)
    key = F.array(*[F.coalesce(f"slot_{i}", F.lit(UNASSIGNED)) for i in range(levels)])
    # A vertex that no wave reaches has only unassigned levels, a uniform key.
    keys = labelled.select("id", key.alias("key")).where(was_clustered(F.col("key")))
    return with_key_columns(keys, levels)
