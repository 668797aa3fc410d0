"""Drill-down and roll-up over a hierarchy ``(id, key, key_0, key_1, ...)``.

A prefix request becomes equality filters on the ``key_i`` columns, which a hierarchy
stored by ``sources.sinks.write_hierarchy`` answers from file statistics.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import save
from strata.sources.sinks import key_columns


def with_key_columns(keys: DataFrame, levels: int) -> DataFrame:
    """(id, key) plus one column per level."""
    cols = [F.get("key", F.lit(i)).alias(f"key_{i}") for i in range(levels)]
    return keys.select("id", "key", *cols)


def _under(hierarchy: DataFrame, prefix: Sequence[int]) -> DataFrame:
    for i, value in enumerate(prefix):
        hierarchy = hierarchy.where(F.col(f"key_{i}") == F.lit(value).cast("bigint"))
    return hierarchy


def drill_members(hierarchy: DataFrame, prefix: Sequence[int]) -> DataFrame:
    """(id, super): the vertices under ``prefix`` and the child cluster each one is in."""
    levels = len(key_columns(hierarchy))
    child = F.col(f"key_{len(prefix)}") if len(prefix) < levels else F.col("id")
    return _under(hierarchy, prefix).select("id", child.alias("super"))


def drill_links(hierarchy: DataFrame, edges: DataFrame, prefix: Sequence[int]) -> DataFrame:
    """Raw edges with both ends under ``prefix``."""
    return restrict_links(edges, drill_members(hierarchy, prefix))


def restrict_links(edges: DataFrame, members: DataFrame) -> DataFrame:
    src = members.select(F.col("id").alias("src"))
    dst = members.select(F.col("id").alias("dst"))
    return edges.select("src", "dst").join(src, "src", "left_semi").join(dst, "dst", "left_semi")


def drill_adjacent(hierarchy: DataFrame, edges: DataFrame, prefix: Sequence[int]) -> DataFrame:
    """(id): sibling clusters that an edge links to the cluster ``prefix``.

    Siblings share the prefix but for its last element. An edge inside the cluster yields
    the cluster itself. The top level has no siblings and gives no rows.
    """
    if not prefix:
        return hierarchy.select(F.col("key_0").alias("id")).where(F.lit(False))
    last = f"key_{len(prefix) - 1}"
    family = _under(hierarchy, prefix[:-1]).select("id", F.col(last).alias("cluster"))
    own = F.lit(prefix[-1]).cast("bigint")
    src = family.select(F.col("id").alias("src"), F.col("cluster").alias("cs"))
    dst = family.select(F.col("id").alias("dst"), F.col("cluster").alias("cd"))
    linked = edges.select("src", "dst").join(src, "src").join(dst, "dst")
    other = (
        F.when(F.col("cs") == own, F.col("cd")).when(F.col("cd") == own, F.col("cs")).alias("id")
    )
    return linked.select(other).where("id IS NOT NULL").distinct()


def _inside(stored: DataFrame, prefix: Sequence[int]) -> DataFrame:
    for i, value in enumerate(prefix):
        stored = stored.where(F.col(f"in_{i}") == F.lit(value).cast("bigint"))
    return stored


def _siblings(spark: SparkSession, path: str, parent: Sequence[int]) -> DataFrame:
    pairs = spark.read.parquet(f"{path}/pairs")
    return _inside(pairs.where(F.col("depth") == len(parent) + 1), parent)


def stored_links(spark: SparkSession, path: str, prefix: Sequence[int]) -> DataFrame:
    """:func:`drill_links` from what ``sources.sinks.write_links`` stored: one stretch of it."""
    return _inside(spark.read.parquet(f"{path}/links"), prefix).select("src", "dst")


def stored_adjacent(spark: SparkSession, path: str, prefix: Sequence[int]) -> DataFrame:
    """:func:`drill_adjacent` from stored pairs: the rows of one cluster, no edges."""
    if not prefix:
        return spark.read.parquet(f"{path}/pairs").select(F.col("cluster").alias("id")).where(F.lit(False))
    own = F.col("cluster") == F.lit(prefix[-1]).cast("bigint")
    return _siblings(spark, path, prefix[:-1]).where(own).select(F.col("other").alias("id"))


def stored_super_edges(spark: SparkSession, path: str, prefix: Sequence[int]) -> DataFrame:
    """:func:`super_edges` of the clusters directly below ``prefix``, from stored pairs."""
    apart = (F.col("cluster") != F.col("other")) & (F.col("cluster") != -1) & (F.col("other") != -1)
    return _siblings(spark, path, prefix).where(apart & (F.col("n_out") > 0)).select(
        F.col("cluster").alias("src"), F.col("other").alias("dst"), F.col("n_out").alias("weight")
    )


def stored_interior_edges(spark: SparkSession, path: str, prefix: Sequence[int]) -> DataFrame:
    """:func:`interior_edges` of the clusters directly below ``prefix``, from stored pairs."""
    within = (F.col("cluster") == F.col("other")) | (F.col("cluster") == -1) | (F.col("other") == -1)
    return (
        _siblings(spark, path, prefix)
        .where(within & (F.col("n_out") > 0))
        .groupBy(F.col("cluster").alias("super"))
        .agg(F.sum("n_out").alias("num_edges"))
    )


def _super_links(members: DataFrame, links: DataFrame) -> DataFrame:
    src = members.select(F.col("id").alias("src"), F.col("super").alias("ss"))
    dst = members.select(F.col("id").alias("dst"), F.col("super").alias("sd"))
    return links.select("src", "dst").join(src, "src").join(dst, "dst").select("ss", "sd")


def _inner():
    return (F.col("ss") == F.col("sd")) | (F.col("ss") == -1) | (F.col("sd") == -1)


def super_edges(members: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, weight): edges between different clusters, weighted by their number."""
    return (
        _super_links(members, links)
        .where(~_inner())
        .groupBy(F.col("ss").alias("src"), F.col("sd").alias("dst"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def interior_edges(members: DataFrame, links: DataFrame) -> DataFrame:
    """(super, num_edges): edges inside a cluster. Edges that touch the unassigned cluster
    ``-1`` count for their source."""
    return (
        _super_links(members, links)
        .where(_inner())
        .groupBy(F.col("ss").alias("super"))
        .agg(F.count(F.lit(1)).alias("num_edges"))
    )


def supernode_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("super").agg(F.count(F.lit(1)).alias("num_nodes"))


def supernodes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(super, num_nodes, num_edges) for every cluster."""
    return (
        supernode_sizes(members)
        .join(interior_edges(members, links), "super", "left")
        .select("super", "num_nodes", F.coalesce("num_edges", F.lit(0)).alias("num_edges"))
    )


def super_degrees(edges: DataFrame) -> DataFrame:
    """(super, degree): a link between clusters counts at both of its ends."""
    return (
        edges.select(F.explode(F.array("src", "dst")).alias("super"))
        .groupBy("super")
        .agg(F.count(F.lit(1)).alias("degree"))
    )


def histogram(
    stats: DataFrame, column: str, only: DataFrame | None = None
) -> DataFrame:
    """(``column``, num_supers): how many clusters have each value.

    ``only`` (column ``super``) restricts it to selected clusters. The clusters of one bar
    are ``stats`` filtered by the value (:func:`selected`), never a list in a row.
    """
    if only is not None:
        stats = stats.join(only.select("super").distinct(), "super", "left_semi")
    return stats.groupBy(column).agg(F.count(F.lit(1)).alias("num_supers"))


def degree_distribution(edges: DataFrame, only: DataFrame | None = None) -> DataFrame:
    return histogram(super_degrees(edges), "degree", only)


def interior_distribution(
    nodes: DataFrame, column: str, only: DataFrame | None = None
) -> DataFrame:
    """Histogram of ``num_nodes`` or ``num_edges`` of :func:`supernodes`."""
    return histogram(nodes, column, only)


def selected(
    stats: Mapping[str, DataFrame],
    selections: Mapping[str, Sequence[int]],
    deselected: Mapping[str, Sequence[int]] | None = None,
) -> DataFrame | None:
    """Clusters in any selected bar of any chart, without those in deselected bars.

    ``stats`` maps a chart's column to a frame (super, column). None if nothing is
    selected, which means no filter.
    """

    def members(chosen: Mapping[str, Sequence[int]]) -> DataFrame | None:
        parts = [
            stats[column].where(F.col(column).isin(list(values))).select("super")
            for column, values in chosen.items()
            if values
        ]
        if not parts:
            return None
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        return union.distinct()

    kept = members(selections)
    dropped = members(deselected or {})
    if kept is not None and dropped is not None:
        kept = kept.join(dropped, "super", "left_anti")
    return kept


def cross_filter(
    stats: Mapping[str, DataFrame], selections: Mapping[str, Sequence[int]], target: str
) -> DataFrame:
    """The ``target`` chart for the clusters selected in the other charts.

    With no cluster selected there is no filter.
    """
    others = {c: v for c, v in selections.items() if c != target}
    only = selected(stats, others)
    if only is not None:
        only = save(only, "selected")  # looked at twice
        only = None if only.isEmpty() else only
    return histogram(stats[target], target, only)


def _paths(hierarchy: DataFrame, end: str) -> DataFrame:
    return hierarchy.select(F.col("id").alias(end), F.col("key").alias(f"{end}_key"))


def rollup_levels(hierarchy: DataFrame, edges: DataFrame) -> DataFrame:
    """(level, src, dst, weight): super-edges of every level at once.

    A cluster is named by its key prefix ``a/b/c``; rows with equal ends are interior
    edges. Parallel edges between the same two whole keys are counted before the levels
    are unfolded.
    """
    levels = len(key_columns(hierarchy))
    keyed = (
        edges.select("src", "dst")
        .join(_paths(hierarchy, "src"), "src")
        .join(_paths(hierarchy, "dst"), "dst")
        .groupBy("src_key", "dst_key")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def prefix(key: str):
        return F.array_join(F.slice(key, F.lit(1), F.col("level") + 1), "/")

    return (
        keyed.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
        .groupBy("level", prefix("src_key").alias("src"), prefix("dst_key").alias("dst"))
        .agg(F.sum("n").alias("weight"))
    )


def rollup_members(hierarchy: DataFrame) -> DataFrame:
    """(level, super, num_nodes): cluster sizes of every level at once."""
    levels = len(key_columns(hierarchy))
    path = F.array_join(F.slice("key", F.lit(1), F.col("level") + 1), "/")
    return (
        hierarchy.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
        .groupBy("level", path.alias("super"))
        .agg(F.count(F.lit(1)).alias("num_nodes"))
    )
