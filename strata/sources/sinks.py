"""Batch sinks: hierarchies, predictions, model descriptions and graph payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import save

_SALTS = 8


def key_columns(hierarchy: DataFrame) -> list[str]:
    return [c for c in hierarchy.columns if c.startswith("key_")]


def write_hierarchy(hierarchy: DataFrame, path: str) -> None:
    """Store a hierarchy range-ordered by its key columns, id last.

    A drill-down filters on a prefix of those columns, so it reads only the files and
    row groups whose statistics cover the prefix. The id column keeps one huge cluster
    from falling into a single range.
    """
    keys = key_columns(hierarchy) + ["id"]
    hierarchy.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(
        "overwrite"
    ).parquet(path)


def _meeting(levels: int) -> list:
    """``in_0``, ``in_1``, ...: the clusters that hold both ends, null from where they part."""
    together, found = F.lit(True), []
    for i in range(levels):
        together = together & (F.col(f"src_{i}") == F.col(f"dst_{i}"))
        found.append(F.when(together, F.col(f"src_{i}")).alias(f"in_{i}"))
    return found


def _pairs(levels: int):
    """Of one link, an entry for every level on which its ends are siblings, both ways."""
    entries = []
    for depth in range(1, levels + 1):
        above = [
            (F.col(f"in_{i}") if i < depth - 1 else F.lit(None).cast("bigint")).alias(f"in_{i}")
            for i in range(levels - 1)
        ]
        a, b = F.col(f"src_{depth - 1}"), F.col(f"dst_{depth - 1}")

        def entry(cluster, other, n_out, n_in, wanted):
            fields = [
                F.lit(depth).alias("depth"),
                *above,
                cluster.alias("cluster"),
                other.alias("other"),
                n_out.cast("bigint").alias("n_out"),
                n_in.cast("bigint").alias("n_in"),
            ]
            siblings = F.col(f"in_{depth - 2}").isNotNull() if depth > 1 else F.lit(True)
            return F.when(siblings & wanted & a.isNotNull() & b.isNotNull(), F.struct(*fields))

        entries.append(entry(a, b, F.lit(1), (a == b).cast("int"), F.lit(True)))
        entries.append(entry(b, a, F.lit(0), F.lit(1), a != b))
    return F.filter(F.array(*entries), lambda e: e.isNotNull())


def write_links(hierarchy: DataFrame, edges: DataFrame, path: str) -> None:
    """Store the edges so that the links of one cluster are read without the others.

    ``links`` holds (src, dst) with the clusters that contain both ends (``in_0``, ``in_1``,
    ...), range-ordered by these: the edges inside a cluster are one stretch of it, at any
    level. ``pairs`` holds, for the siblings below every cluster, how many edges lead from
    one to the other and back, ordered by level, parent and cluster; a cluster's own entry
    counts the edges inside it. Edges with an end outside the hierarchy are left out.
    """
    levels = len(key_columns(hierarchy))

    def end(name: str) -> DataFrame:
        keys = [F.col(f"key_{i}").cast("bigint").alias(f"{name}_{i}") for i in range(levels)]
        return hierarchy.select(F.col("id").alias(name), *keys)

    placed = edges.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst")
    placed = save(placed.select("*", *_meeting(levels)), "placed")
    inside = [f"in_{i}" for i in range(levels)]
    # Both ends follow, so that the links of one huge cluster fill several ranges.
    order = [F.col(c).asc_nulls_first() for c in [*inside, "src", "dst"]]
    links = placed.select(*inside, "src", "dst")
    links.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/links")
    keys = ["depth", *inside[:-1], "cluster", "other"]
    pairs = save(
        placed.select(F.inline(_pairs(levels)))
        .groupBy(*keys)
        .agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in")),
        "pairs",
    )
    order = [F.col(c).asc_nulls_first() for c in keys]
    pairs.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/pairs")


def write_predictions(
    predictions: DataFrame, path: str, by: str = "tag", fmt: str = "parquet"
) -> None:
    """One directory per tag; vector and helper columns are dropped.

    Rows meet by tag and one of some salts, so a tag has few files and a hot tag several.
    """
    helpers = [
        name
        for name, dtype in predictions.dtypes
        if dtype == "vector" or name.endswith("_index")
    ]
    salt = F.pmod(F.xxhash64(*(c for c in predictions.columns if c not in helpers)), F.lit(_SALTS))
    placed = predictions.drop(*helpers).repartition(F.col(by), salt)
    placed.write.mode("overwrite").partitionBy(by).format(fmt).save(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A short text (a model description, a score) as a one-row text table."""
    spark.range(1).select(F.lit(text).alias("value")).write.mode("overwrite").text(path)


def graph_payload(
    vertices: DataFrame, edges: DataFrame, uses: DataFrame, predictions: DataFrame | None = None
) -> DataFrame:
    """The graph as bounded JSON records: ``node``, ``use``, ``link`` and ``prediction``.

    ``vertices`` has (id, name), ``uses`` (id, hashtag, time), ``predictions`` (id, hashtag,
    prediction). Vertices that no edge
    touches are left out, with their uses. A node's tag times are one record each, so
    a node with very many uses never becomes one huge row.
    """
    linked = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    nodes = vertices.join(linked, "id", "left_semi")
    node_rows = nodes.select(
        F.lit("node").alias("kind"),
        F.to_json(F.struct("id", "name")).alias("payload"),
    )
    use_rows = (
        uses.groupBy("id", "hashtag", "time")
        .agg(F.count(F.lit(1)).alias("uses"))
        .join(nodes.select("id"), "id", "left_semi")
        .select(
            F.lit("use").alias("kind"),
            F.to_json(F.struct("id", "hashtag", "time", "uses")).alias("payload"),
        )
    )
    link_rows = edges.select(
        F.lit("link").alias("kind"),
        F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"))).alias(
            "payload"
        ),
    )
    payload = node_rows.unionByName(use_rows).unionByName(link_rows)
    if predictions is None:
        return payload
    scored = predictions.select("id", "hashtag", "prediction").join(nodes.select("id"), "id", "left_semi")
    return payload.unionByName(
        scored.select(
            F.lit("prediction").alias("kind"),
            F.to_json(F.struct("id", "hashtag", "prediction")).alias("payload"),
        )
    )


def write_graph(
    vertices: DataFrame,
    edges: DataFrame,
    uses: DataFrame,
    path: str,
    predictions: DataFrame | None = None,
) -> None:
    graph_payload(vertices, edges, uses, predictions).write.mode("overwrite").partitionBy("kind").text(path)
