"""Queries of drill-down and roll-up over the geo hierarchy and the follow graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from strata.operators import explore as X
from strata.session import new_path
from strata.sources.sinks import write_hierarchy, write_links

_REGION = 1
_NATION = 6


def _members(spark, sf):
    """Customers in the cluster of their nation."""
    return I.geo(spark, sf).select("id", F.col("key_1").alias("super"))


def _blocks(spark, sf):
    """Customers in clusters of ten consecutive ids."""
    return I.vertices(spark, sf).select("id", F.floor(F.col("id") / 10).alias("super"))


def drill_members(spark, sf):
    h = I.geo(spark, sf)
    requests = [[], [_REGION], [_REGION, _NATION]]
    parts = [X.drill_members(h, r).withColumn("depth", F.lit(len(r))) for r in requests]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def drill_links(spark, sf):
    return X.drill_links(I.geo(spark, sf), I.follow(spark, sf), [_REGION])


def drill_adjacent(spark, sf):
    h, e = I.geo(spark, sf), I.follow(spark, sf)
    region = X.drill_adjacent(h, e, [_REGION]).withColumn("depth", F.lit(1))
    return region.unionByName(X.drill_adjacent(h, e, [_REGION, _NATION]).withColumn("depth", F.lit(2)))


def stored_drill(spark, sf):
    """The hierarchy written in key order, read back and drilled into."""
    path = new_path(spark, "hierarchy")
    write_hierarchy(I.geo(spark, sf), path)
    return X.drill_members(spark.read.parquet(path), [_REGION, _NATION])


def _stored(spark, sf):
    path = new_path(spark, "stored-links")
    write_links(I.geo(spark, sf), I.follow(spark, sf), path)
    return path


def stored_links(spark, sf):
    """The links inside one nation, from edges stored by the clusters that hold both ends."""
    return X.stored_links(spark, _stored(spark, sf), [_REGION, _NATION])


def stored_adjacent(spark, sf):
    path = _stored(spark, sf)
    region = X.stored_adjacent(spark, path, [_REGION]).withColumn("depth", F.lit(1))
    nation = X.stored_adjacent(spark, path, [_REGION, _NATION]).withColumn("depth", F.lit(2))
    return region.unionByName(nation)


def stored_rollup(spark, sf):
    """Links between and inside the regions, and between and inside the nations of one."""
    path, parts = _stored(spark, sf), []
    for prefix in ([], [_REGION]):
        inside = X.stored_interior_edges(spark, path, prefix)
        own = inside.select(F.col("super").alias("src"), F.col("super").alias("dst"), F.col("num_edges").alias("weight"))
        found = X.stored_super_edges(spark, path, prefix).unionByName(own)
        parts.append(found.withColumn("depth", F.lit(len(prefix))))
    return parts[0].unionByName(parts[1])


def supernode_sizes(spark, sf):
    return X.supernode_sizes(_members(spark, sf))


def super_edges(spark, sf):
    return X.super_edges(_members(spark, sf), I.follow(spark, sf))


def interior_edges(spark, sf):
    """Interior edges where the customers of negative balance are unassigned."""
    members = I.profiles(spark, sf).join(_members(spark, sf), "id").select(
        "id", F.when(F.col("followers_count") < 0, F.lit(-1)).otherwise(F.col("super")).alias("super")
    )
    return X.interior_edges(members, I.follow(spark, sf))


def supernodes(spark, sf):
    return X.supernodes(_blocks(spark, sf), I.follow(spark, sf))


def degree_distribution(spark, sf):
    return X.degree_distribution(X.super_edges(_blocks(spark, sf), I.follow(spark, sf)))


def super_degrees(spark, sf):
    return X.super_degrees(X.super_edges(_blocks(spark, sf), I.follow(spark, sf)))


def interior_node_distribution(spark, sf):
    return X.interior_distribution(X.supernode_sizes(_members(spark, sf)), "num_nodes")


def interior_edge_distribution(spark, sf):
    nodes = X.supernodes(_blocks(spark, sf), I.follow(spark, sf))
    return X.interior_distribution(nodes, "num_edges")


def cross_filter(spark, sf):
    """Degrees of the clusters with no or one interior edge."""
    members, edges = _blocks(spark, sf), I.follow(spark, sf)
    nodes = X.supernodes(members, edges)
    stats = {
        "degree": X.super_degrees(X.super_edges(members, edges)),
        "num_nodes": nodes.select("super", "num_nodes"),
        "num_edges": nodes.select("super", "num_edges"),
    }
    return X.cross_filter(stats, {"num_edges": [0, 1], "num_nodes": [9]}, "degree")


def rollup_levels(spark, sf):
    return X.rollup_levels(I.geo(spark, sf), I.follow(spark, sf))


def rollup_members(spark, sf):
    return X.rollup_members(I.geo(spark, sf))


QUERIES = {
    "drill_members": drill_members,
    "drill_links": drill_links,
    "drill_adjacent": drill_adjacent,
    "stored_drill": stored_drill,
    "stored_links": stored_links,
    "stored_adjacent": stored_adjacent,
    "stored_rollup": stored_rollup,
    "supernode_sizes": supernode_sizes,
    "super_edges": super_edges,
    "interior_edges": interior_edges,
    "supernodes": supernodes,
    "degree_distribution": degree_distribution,
    "super_degrees": super_degrees,
    "interior_node_distribution": interior_node_distribution,
    "interior_edge_distribution": interior_edge_distribution,
    "cross_filter": cross_filter,
    "rollup_levels": rollup_levels,
    "rollup_members": rollup_members,
}

_SQL_ADJACENT = f"""WITH {I.SQL_FOLLOW}, {I.SQL_GEO}, t AS (
  SELECT a.key_0 AS s0, a.key_1 AS s1, b.key_0 AS d0, b.key_1 AS d1
  FROM follow JOIN geo a ON a.id = src JOIN geo b ON b.id = dst)
SELECT DISTINCT CASE WHEN s0 = {_REGION} THEN d0 ELSE s0 END AS id, 1 AS depth FROM t
WHERE s0 = {_REGION} OR d0 = {_REGION}
UNION ALL SELECT DISTINCT CASE WHEN s1 = {_NATION} THEN d1 ELSE s1 END, 2 FROM t
WHERE s0 = {_REGION} AND d0 = {_REGION} AND (s1 = {_NATION} OR d1 = {_NATION})"""
_SQL_GEO = f"{I.SQL_FOLLOW}, {I.SQL_GEO}, ends AS (SELECT a.key_1 AS ss, b.key_1 AS sd FROM follow JOIN geo a ON a.id = src JOIN geo b ON b.id = dst)"
_SQL_BLOCKS = f"""{I.SQL_FOLLOW},
ends AS (SELECT src // 10 AS ss, dst // 10 AS sd FROM follow),
supers AS (SELECT DISTINCT ss AS src, sd AS dst FROM ends WHERE ss <> sd),
degs AS (SELECT super, count(*) AS degree FROM (SELECT src AS super FROM supers UNION ALL SELECT dst FROM supers) GROUP BY 1),
inner_edges AS (SELECT ss AS super, count(*) AS n FROM ends WHERE ss = sd GROUP BY 1),
nodes AS (
  SELECT s.super, s.n AS num_nodes, coalesce(i.n, 0) AS num_edges
  FROM (SELECT c_custkey // 10 AS super, count(*) AS n FROM customer GROUP BY 1) s LEFT JOIN inner_edges i ON i.super = s.super)"""

ORACLES = {
    "drill_members": f"""WITH {I.SQL_GEO}
SELECT id, key_0 AS super, 0 AS depth FROM geo UNION ALL SELECT id, key_1, 1 FROM geo WHERE key_0 = {_REGION}
UNION ALL SELECT id, key_2, 2 FROM geo WHERE key_0 = {_REGION} AND key_1 = {_NATION}""",
    "drill_links": f"""WITH {I.SQL_FOLLOW}, {I.SQL_GEO}
SELECT src, dst FROM follow JOIN geo a ON a.id = src JOIN geo b ON b.id = dst
WHERE a.key_0 = {_REGION} AND b.key_0 = {_REGION}""",
    "drill_adjacent": _SQL_ADJACENT,
    "stored_adjacent": _SQL_ADJACENT,
    "stored_links": f"""WITH {I.SQL_FOLLOW}, {I.SQL_GEO}
SELECT src, dst FROM follow JOIN geo a ON a.id = src JOIN geo b ON b.id = dst
WHERE a.key_0 = {_REGION} AND b.key_0 = {_REGION} AND a.key_1 = {_NATION} AND b.key_1 = {_NATION}""",
    "stored_rollup": f"""WITH {I.SQL_FOLLOW}, {I.SQL_GEO}, t AS (
  SELECT a.key_0 AS s0, a.key_1 AS s1, b.key_0 AS d0, b.key_1 AS d1
  FROM follow JOIN geo a ON a.id = src JOIN geo b ON b.id = dst)
SELECT s0 AS src, d0 AS dst, count(*) AS weight, 0 AS depth FROM t GROUP BY s0, d0
UNION ALL SELECT s1, d1, count(*), 1 FROM t WHERE s0 = {_REGION} AND d0 = {_REGION} GROUP BY s1, d1""",
    "stored_drill": f"""WITH {I.SQL_GEO}
SELECT id, key_2 AS super FROM geo WHERE key_0 = {_REGION} AND key_1 = {_NATION}""",
    "supernode_sizes": f"WITH {I.SQL_GEO} SELECT key_1 AS super, count(*) AS num_nodes FROM geo GROUP BY 1",
    "super_edges": f"""WITH {_SQL_GEO}
SELECT ss AS src, sd AS dst, count(*) AS weight FROM ends WHERE ss <> sd GROUP BY 1, 2""",
    "interior_edges": f"""WITH {I.SQL_FOLLOW}, {I.SQL_GEO}, m AS (
  SELECT geo.id, CASE WHEN c_acctbal < 0 THEN -1 ELSE key_1 END AS super FROM geo JOIN customer ON c_custkey = geo.id)
SELECT a.super, count(*) AS num_edges FROM follow JOIN m a ON a.id = src JOIN m b ON b.id = dst
WHERE a.super = b.super OR a.super = -1 OR b.super = -1 GROUP BY 1""",
    "supernodes": f"WITH {_SQL_BLOCKS} SELECT super, num_nodes, num_edges FROM nodes",
    "degree_distribution": f"WITH {_SQL_BLOCKS} SELECT degree, count(*) AS num_supers FROM degs GROUP BY 1",
    "super_degrees": f"WITH {_SQL_BLOCKS} SELECT super, degree FROM degs",
    "interior_node_distribution": f"""WITH {I.SQL_GEO}
SELECT num_nodes, count(*) AS num_supers FROM (SELECT count(*) AS num_nodes FROM geo GROUP BY key_1) GROUP BY 1""",
    "interior_edge_distribution": f"""WITH {_SQL_BLOCKS}
SELECT num_edges, count(*) AS num_supers FROM nodes GROUP BY 1""",
    # Selected bars without any cluster filter nothing, like no selection at all.
    "cross_filter": f"""WITH {_SQL_BLOCKS},
selected AS (SELECT super FROM nodes WHERE num_edges IN (0, 1) OR num_nodes = 9)
SELECT degree, count(*) AS num_supers FROM degs
WHERE super IN (SELECT super FROM selected) OR (SELECT count(*) FROM selected) = 0 GROUP BY 1""",
    "rollup_levels": f"""WITH {I.SQL_FOLLOW}, {I.SQL_GEO}, p AS (
  SELECT id, CAST(key_0 AS VARCHAR) AS p0, key_0 || '/' || key_1 AS p1, key_0 || '/' || key_1 || '/' || key_2 AS p2 FROM geo),
t AS (SELECT a.p0 AS a0, a.p1 AS a1, a.p2 AS a2, b.p0 AS b0, b.p1 AS b1, b.p2 AS b2
  FROM follow JOIN p a ON a.id = src JOIN p b ON b.id = dst)
SELECT 0 AS level, a0 AS src, b0 AS dst, count(*) AS weight FROM t GROUP BY 1, 2, 3
UNION ALL SELECT 1, a1, b1, count(*) FROM t GROUP BY 1, 2, 3
UNION ALL SELECT 2, a2, b2, count(*) FROM t GROUP BY 1, 2, 3""",
    "rollup_members": f"""WITH {I.SQL_GEO}
SELECT 0 AS level, CAST(key_0 AS VARCHAR) AS super, count(*) AS num_nodes FROM geo GROUP BY 1, 2
UNION ALL SELECT 1, key_0 || '/' || key_1, count(*) FROM geo GROUP BY 1, 2
UNION ALL SELECT 2, key_0 || '/' || key_1 || '/' || key_2, count(*) FROM geo GROUP BY 1, 2""",
}
