"""Graph construction and per-vertex operators.

Vertices are ``(id, ...)``, edges ``(src, dst, ...)`` with src the followed user and dst
the follower. Neighbour sets stay in long form, one row per neighbour: a vertex that a
third of all edges touch is then many small rows and never one array in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def name_id(name: Column) -> Column:
    """A 60-bit id from a name, the same in every run and in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def surrogate_ids(names: DataFrame, name: str = "screen_name") -> DataFrame:
    """(name, id) for every distinct name, no id twice.

    The id is a hash, so it needs no global numbering and does not change between runs.
    Of names that collide (a handful in billions) the first by order keeps the hash and the
    others are hashed anew with their rank; should one of these new ids be taken as well,
    the job fails rather than merge two users. A collision's ids depend on who else
    collides, so they can change when such a name is added. The window groups hold the
    names of one hash value, which is one row but for collisions.
    """
    distinct = names.select(name).where(F.col(name).isNotNull()).distinct()
    rank = F.row_number().over(Window.partitionBy("id").orderBy(name))
    return (
        distinct.withColumn("id", name_id(F.col(name)))
        .withColumn("_rank", rank)
        .withColumn(
            "id",
            F.when(F.col("_rank") == 1, F.col("id")).otherwise(
                name_id(F.concat_ws("#", F.col(name), F.col("_rank").cast("string")))
            ),
        )
        .withColumn("_again", F.count(F.lit(1)).over(Window.partitionBy("id")))
        .withColumn("id", F.when(F.col("_again") == 1, F.col("id")).otherwise(
            F.raise_error(F.concat(F.lit("two names share the id "), F.col("id").cast("string"))).cast("bigint")
        ))
        .select(name, "id")
    )


def resolve_edges(relations: DataFrame, ids: DataFrame, name: str = "screen_name") -> DataFrame:
    """Follow rows as id edges. Rows whose user or follower has no id vanish."""
    users = ids.select(F.col(name).alias("user"), F.col("id").alias("src"))
    followers = ids.select(F.col(name).alias("follower"), F.col("id").alias("dst"))
    return relations.join(users, "user").join(followers, "follower").select("src", "dst")


def follow_graph(
    relations: DataFrame, profiles: DataFrame, ids: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Vertices (profiles with ids) and distinct follow edges between known users. ``ids``
    (screen_name, id) come from a kept dictionary, or are made from the profiles."""
    ids = surrogate_ids(profiles) if ids is None else ids
    vertices = profiles.join(ids, "screen_name")
    return vertices, resolve_edges(relations.distinct(), ids)


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def with_defaults(vertices: DataFrame, edges: DataFrame, defaults: dict) -> DataFrame:
    """All vertices and all edge ends; ends without a vertex row get ``defaults``."""
    known = vertices.withColumn("_known", F.lit(True))
    joined = endpoints(edges).join(known, "id", "full")
    columns = [
        F.when(F.col("_known"), F.col(c)).otherwise(F.lit(defaults.get(c))).alias(c)
        for c in vertices.columns
        if c != "id"
    ]
    return joined.select("id", *columns)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree) from one pass and one shuffle."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    ends = F.array(
        F.struct(F.col("src").alias("id"), one.alias("o"), zero.alias("i")),
        F.struct(F.col("dst").alias("id"), zero.alias("o"), one.alias("i")),
    )
    return (
        edges.select(F.inline(ends))
        .groupBy("id")
        .agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
        .withColumn("degree", F.col("out_degree") + F.col("in_degree"))
    )


def attach_degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices with their degrees, 0 where no edge touches them."""
    names = ["out_degree", "in_degree", "degree"]
    return vertices.join(degrees(edges), "id", "left").fillna(0, names)


def important(vertices_with_degrees: DataFrame, min_out_degree: int) -> DataFrame:
    return vertices_with_degrees.where(F.col("out_degree") > min_out_degree)


def isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices that no edge touches."""
    return vertices.join(endpoints(edges), "id", "left_anti")


def neighbor_sets(edges: DataFrame) -> DataFrame:
    """(id, side, nbr): the out- and in-set of every vertex, one row per element."""
    sides = F.array(
        F.struct(F.col("src").alias("id"), F.lit("out").alias("side"), F.col("dst").alias("nbr")),
        F.struct(F.col("dst").alias("id"), F.lit("in").alias("side"), F.col("src").alias("nbr")),
    )
    return edges.select(F.inline(sides)).distinct()


def neighbor_attributes(
    vertices: DataFrame, edges: DataFrame, direction: str = "out"
) -> DataFrame:
    """(id, nbr, attributes of nbr): what a vertex sees of its out- or in-neighbours."""
    at, other = ("src", "dst") if direction == "out" else ("dst", "src")
    pairs = edges.select(F.col(at).alias("id"), F.col(other).alias("nbr"))
    return pairs.join(vertices.withColumnRenamed("id", "nbr"), "nbr")


def _prefixed(vertices: DataFrame, end: str) -> DataFrame:
    return vertices.select(
        F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in vertices.columns if c != "id"]
    )


def triplets(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the attributes of both ends (``src_*``, ``dst_*``)."""
    return edges.join(_prefixed(vertices, "src"), "src").join(_prefixed(vertices, "dst"), "dst")


def induced(
    vertices: DataFrame, edges: DataFrame, predicate: Column
) -> tuple[DataFrame, DataFrame]:
    """Vertices that match, and the edges with both ends among them."""
    kept = vertices.where(predicate)
    return kept, edges_within(edges, kept)


def edges_within(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return edges.join(vertices.select(F.col("id").alias("src")), "src", "left_semi").join(
        vertices.select(F.col("id").alias("dst")), "dst", "left_semi"
    )


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Each (src, dst) once."""
    return edges.select("src", "dst").distinct()


def without_self_edges(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def symmetrize(edges: DataFrame) -> DataFrame:
    """Edges and their reverses."""
    both = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    return edges.select(F.inline(both))


def sample_hash(vertex_id: Column, seed: int) -> Column:
    """A reproducible pseudo-random text per id; its first 15 hex digits are uniform."""
    return F.md5(F.concat_ws(":", vertex_id.cast("string"), F.lit(str(seed))))


def below_share(key: Column, fraction: float, seed: int) -> Column:
    """True for a share of the keys; 60 bits, so ten of 10^11 are a sample too."""
    bound = f"{int(min(max(fraction, 0.0), 1.0) * 2**60):015x}"
    if len(bound) > 15:
        return F.lit(True)
    return F.substring(sample_hash(key, seed), 1, 15) < bound


def hash_sample(vertices: DataFrame, fraction: float, seed: int) -> DataFrame:
    """A random sample that is the same on every run and after every retry."""
    if fraction >= 1:
        return vertices
    return vertices.where(below_share(F.col("id"), fraction, seed))


def sample_vertices(
    vertices: DataFrame, edges: DataFrame, size: int, seed: int
) -> tuple[DataFrame, DataFrame]:
    """About ``size`` random vertices and the edges among them."""
    total = vertices.count()
    kept = hash_sample(vertices, min(max(size, 0) / total, 1.0) if total else 0.0, seed)
    return kept, edges_within(edges, kept)


def sample_landmarks(vertices: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` vertices by least sample hash."""
    return vertices.select("id").orderBy(sample_hash(F.col("id"), seed), "id").limit(n)


def top_degree_threshold(vertices_with_degrees: DataFrame, k: int) -> DataFrame:
    """One row: the k-th largest total degree."""
    return (
        vertices_with_degrees.select("degree")
        .orderBy(F.desc("degree"))
        .limit(k)
        .agg(F.min("degree").alias("threshold"))
    )


def top_degree(vertices_with_degrees: DataFrame, k: int) -> DataFrame:
    """All vertices whose degree reaches the k-th largest (ties are kept)."""
    threshold = top_degree_threshold(vertices_with_degrees, k).first()["threshold"]
    return vertices_with_degrees.where(F.col("degree") >= F.lit(threshold))


def aggregate_messages(
    vertices: DataFrame,
    edges: DataFrame,
    aggs: Sequence[Column],
    to_src: Column | None = None,
    to_dst: Column | None = None,
) -> DataFrame:
    """Send ``msg`` along every edge and aggregate per receiving vertex.

    ``to_src`` and ``to_dst`` are expressions over a triplet; a NULL message is not sent.
    ``aggs`` aggregate the column ``msg``; they combine map-side, so a vertex that
    receives very many messages is cheap.
    """
    sent = []
    if to_src is not None:
        sent.append(F.struct(F.col("src").alias("id"), to_src.alias("msg")))
    if to_dst is not None:
        sent.append(F.struct(F.col("dst").alias("id"), to_dst.alias("msg")))
    return (
        triplets(vertices, edges)
        .select(F.inline(F.array(*sent)))
        .where(F.col("msg").isNotNull())
        .groupBy("id")
        .agg(*aggs)
    )
