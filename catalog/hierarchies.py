"""Queries of the graph loops and the hierarchy builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from strata.operators import components, graph, paths, skew
from strata.plans import backbone as B
from strata.plans import equivalence, labels
from strata.session import save

_LEVELS = 5


def _follow(spark, sf):
    return save(I.follow(spark, sf), "follow")


def _leaders(edges):
    """The ten vertices of greatest out-degree, the landmarks of these queries."""
    top = graph.degrees(edges).orderBy(F.desc("out_degree"), "id").limit(10)
    return save(top.select("id"), "leaders")


def _flat(hierarchy):
    return hierarchy.select("id", F.array_join("key", ",").alias("key"))


def landmark_hops(spark, sf):
    edges = _follow(spark, sf)
    return paths.landmark_pointers(edges, _leaders(edges))


def landmark_hops_salted(spark, sf):
    """Hops over a graph of hubs, with limits so low that the hubs are split and the edges
    kept as those of a huge graph are."""
    edges = save(graph.symmetrize(I.attribute_edges(spark, sf)).distinct(), "hubs")
    limits = skew.Limits(hot_min_rows=50, keep_rows=100, rows_per_partition=200)
    return paths.landmark_pointers(edges, _leaders(edges), limits=limits)


def landmark_paths(spark, sf):
    edges = _follow(spark, sf)
    return paths.landmark_paths(edges, _leaders(edges)).select(
        "id", "landmark", "hops", F.array_join("path", ",").alias("path")
    )


def avg_path_length(spark, sf):
    edges = _follow(spark, sf)
    return paths.avg_path_length(edges, graph.endpoints(edges), 10, seed=0).select(
        F.round("avg_path_length", 6).alias("avg_path_length")
    )


def connected_components(spark, sf):
    """Components of all customers under the follow links."""
    return components.components(I.vertices(spark, sf), I.follow(spark, sf))


def geo_components(spark, sf):
    edges = I.geo_edges(spark, sf)
    return components.components(graph.endpoints(edges), edges)


def spanning_forest(spark, sf):
    return components.spanning_forest(I.weighted_follow(spark, sf))


def spanning_forest_weight(spark, sf):
    return components.forest_weight(I.weighted_follow(spark, sf))


def backbone(spark, sf):
    """The steps of all shortest paths between the leaders."""
    edges = _follow(spark, sf)
    _, steps = B.keep_all_backbone(edges, _leaders(edges), max_hops=None)
    return steps


def backbone_keys(spark, sf):
    """Every customer attached to the leaders' backbone."""
    edges = _follow(spark, sf)
    points, _ = B.keep_all_backbone(edges, _leaders(edges), max_hops=None)
    return _flat(B.attach(I.vertices(spark, sf), edges, points, _LEVELS))


def keep_one(spark, sf):
    return _flat(B.keep_one(I.follow(spark, sf), I.vertices(spark, sf), 5, _LEVELS))


def keep_all(spark, sf):
    return _flat(B.keep_all(I.follow(spark, sf), seed=0, levels=_LEVELS))


def degree_hierarchy(spark, sf):
    return _flat(labels.degree_hierarchy(I.follow(spark, sf), levels=10))


def seed_labels(spark, sf):
    return _flat(labels.seed_labels(I.follow(spark, sf), levels=10, level_size=100))


def structural_equivalence(spark, sf):
    return _flat(equivalence.structural(I.geo_edges(spark, sf), levels=4))


def structural_attributes(spark, sf):
    return _flat(equivalence.structural(I.attribute_edges(spark, sf), levels=4))


def fuzzy_equivalence(spark, sf):
    return _flat(equivalence.structural_fuzzy(I.attribute_edges(spark, sf), threshold=1.4))


def fuzzy_pages(spark, sf):
    return _flat(equivalence.structural_fuzzy(I.page_edges(spark, sf), threshold=1.0))


def fuzzy_directed(spark, sf):
    return _flat(
        equivalence.structural_fuzzy(I.attribute_edges(spark, sf), threshold=1.6, symmetric=False)
    )


_SCHEDULE = (2.0, 1.7, 1.4, 1.1)


def fuzzy_schedule(spark, sf):
    return _flat(equivalence.structural_fuzzy_schedule(I.attribute_edges(spark, sf), thresholds=_SCHEDULE, levels=4))


def fuzzy_subset(spark, sf):
    return _flat(equivalence.structural_fuzzy(I.attribute_edges(spark, sf), threshold=1.2, mode="subset"))


QUERIES = {
    "landmark_hops": landmark_hops,
    "landmark_hops_salted": landmark_hops_salted,
    "landmark_paths": landmark_paths,
    "avg_path_length": avg_path_length,
    "connected_components": connected_components,
    "geo_components": geo_components,
    "spanning_forest": spanning_forest,
    "spanning_forest_weight": spanning_forest_weight,
    "backbone": backbone,
    "backbone_keys": backbone_keys,
    "keep_one": keep_one,
    "keep_all": keep_all,
    "degree_hierarchy": degree_hierarchy,
    "seed_labels": seed_labels,
    "structural_equivalence": structural_equivalence,
    "structural_attributes": structural_attributes,
    "fuzzy_equivalence": fuzzy_equivalence,
    "fuzzy_pages": fuzzy_pages,
    "fuzzy_directed": fuzzy_directed,
    "fuzzy_schedule": fuzzy_schedule,
    "fuzzy_subset": fuzzy_subset,
}


def _sql_distances(name: str, landmarks: str) -> str:
    """Breadth-first distances to ``landmarks`` and the least next vertex one hop nearer."""
    return f"""{name} (id, landmark, hops) USING KEY (id, landmark) AS (
  SELECT id, id, 0 FROM {landmarks}
  UNION
  SELECT DISTINCT e.src, w.landmark, w.hops + 1 FROM {name} w JOIN follow e ON e.dst = w.id
  LEFT JOIN recurring.{name} r ON r.id = e.src AND r.landmark = w.landmark WHERE r.id IS NULL),
{name}_next AS (
  SELECT w.id, w.landmark, w.hops, CASE WHEN w.hops > 0 THEN min(n.id) END AS next
  FROM {name} w LEFT JOIN follow e ON e.src = w.id
  LEFT JOIN {name} n ON n.id = e.dst AND n.landmark = w.landmark AND n.hops = w.hops - 1
  GROUP BY w.id, w.landmark, w.hops)"""


_SQL_LEADERS = """leaders AS (SELECT src AS id FROM follow GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)"""


def _sql_backbone(dist: str, points: str) -> str:
    """Steps of all paths between ``points`` and the vertices they touch."""
    return f"""steps (landmark, at_id, node) AS (
  SELECT landmark, id, next FROM {dist}_next WHERE hops > 0 AND id IN (SELECT id FROM {points})
  UNION
  SELECT s.landmark, n.id, n.next FROM steps s JOIN {dist}_next n ON n.id = s.node AND n.landmark = s.landmark
  WHERE n.hops > 0),
bone AS (SELECT id FROM {points} UNION SELECT at_id FROM steps UNION SELECT node FROM steps)"""


def _sql_attach(levels: int) -> str:
    return f"""att (id, depth) USING KEY (id) AS (
  SELECT id, 0 FROM bone
  UNION
  SELECT DISTINCT e.src, a.depth + 1 FROM att a JOIN follow e ON e.dst = a.id
  LEFT JOIN recurring.att r ON r.id = e.src WHERE r.id IS NULL),
parents AS (
  SELECT a.id, a.depth, min(p.id) AS parent FROM att a LEFT JOIN follow e ON e.src = a.id
  LEFT JOIN att p ON p.id = e.dst AND p.depth = a.depth - 1 GROUP BY 1, 2),
lines (id, line) AS (
  SELECT id, [id] FROM bone
  UNION ALL
  SELECT p.id, l.line || [p.id] FROM lines l JOIN parents p ON p.parent = l.id AND p.depth > 0),
keys AS (
  SELECT id, len(line) AS n, (line || list_transform(generate_series(1, {levels}), lambda i: id))[1:{levels}] AS key
  FROM lines)"""


def _sql_components(vertices: str, pairs: str, name: str = "cc") -> str:
    return f"""{name} (id, component) USING KEY (id) AS (
  SELECT id, id FROM {vertices}
  UNION
  SELECT x.t, min(c.component) FROM {name} c
  JOIN (SELECT src AS s, dst AS t FROM {pairs} UNION ALL SELECT dst, src FROM {pairs}) x ON x.s = c.id
  JOIN recurring.{name} r ON r.id = x.t WHERE c.component < r.component GROUP BY x.t)"""


_SQL_TWINS = """sets AS (
  SELECT id, list_sort(list(nbr) FILTER (side = 0)) AS o, list_sort(list(nbr) FILTER (side = 1)) AS i
  FROM (SELECT DISTINCT src AS id, 0 AS side, dst AS nbr FROM {edges} UNION ALL SELECT DISTINCT dst, 1, src FROM {edges})
  GROUP BY id),
reps AS (SELECT id, min(id) OVER (PARTITION BY o, i) AS rep FROM sets)"""


def _sql_structural(relation: str, edges: str) -> str:
    return f"""WITH {relation}, {_SQL_TWINS.format(edges=edges)}
SELECT id, concat_ws(',', rep, id, id, id) AS key FROM reps"""


def _sql_similar(relation: str, edges: str, symmetric: bool, subset: bool = False) -> str:
    """``alike`` (id, cand, size, total): uncovered candidates with their two-sided similarity."""
    both = f"UNION SELECT dst, src FROM {edges}" if symmetric else ""
    return f"""{relation},
e AS (SELECT DISTINCT src, dst FROM {edges} {both}),
tok AS (SELECT src AS id, 0 AS side, dst AS nbr FROM e UNION ALL SELECT dst, 1, src FROM e),
sizes AS (SELECT id, count(*) FILTER (side = 0) AS o, count(*) FILTER (side = 1) AS i FROM tok GROUP BY 1),
shared AS (
  SELECT a.id, b.id AS cand, count(*) FILTER (a.side = 0) AS bo, count(*) FILTER (a.side = 1) AS bi
  FROM tok a JOIN tok b ON b.side = a.side AND b.nbr = a.nbr AND b.id <> a.id GROUP BY 1, 2),
pairs AS (
  SELECT s.id, s.cand, x.o, x.i, y.o AS co, y.i AS ci, bo, bi
  FROM shared s JOIN sizes x ON x.id = s.id JOIN sizes y ON y.id = s.cand),
covered AS (
  SELECT DISTINCT id FROM pairs WHERE bo = o AND bi = i AND (co + ci > o + i OR (co + ci = o + i AND cand < id))),
alike AS (
  SELECT id, cand, co + ci AS size,
         (CASE WHEN o + co = 0 THEN 1.0::DOUBLE ELSE bo / (o + co - bo) END)
         + (CASE WHEN i + ci = 0 THEN 1.0::DOUBLE ELSE bi / (i + ci - bi) END) AS total
  FROM pairs WHERE cand NOT IN (SELECT id FROM covered) {"AND bo = o AND bi = i" if subset else ""})"""


def _sql_best(threshold: float) -> str:
    return f"""SELECT id, cand FROM alike WHERE total >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY size DESC, cand) = 1"""


def _sql_fuzzy(relation: str, edges: str, threshold: float, symmetric: bool, subset: bool = False) -> str:
    return f"""WITH {_sql_similar(relation, edges, symmetric, subset)},
best AS ({_sql_best(threshold)})
SELECT s.id, concat_ws(',', coalesce(cand, s.id), s.id) AS key FROM sizes s LEFT JOIN best ON best.id = s.id"""


def _sql_schedule(relation: str, edges: str, thresholds: tuple[float, ...], levels: int) -> str:
    passes = [f"keys_0 AS (SELECT id, [id for k in range({levels})] AS k FROM sizes)"]
    for n, threshold in enumerate(thresholds):
        passes.append(f"best_{n} AS ({_sql_best(threshold)})")
        passes.append(f"""keys_{n + 1} AS (
  SELECT id, CASE WHEN c IS NULL THEN k ELSE list_concat(c[1:used], k[used + 1:]) END AS k FROM (
    SELECT a.id, a.k, b.k AS c, 1 + len([1 for j in range(1, {levels}) if b.k[j] <> b.k[j + 1]]) AS used
    FROM keys_{n} a LEFT JOIN best_{n} USING (id) LEFT JOIN keys_{n} b ON b.id = cand))""")
    return f"""WITH {_sql_similar(relation, edges, True)}, {", ".join(passes)}
SELECT id, array_to_string(k, ',') AS key FROM keys_{len(thresholds)}"""


ORACLES = {
    "landmark_hops": f"""WITH RECURSIVE {I.SQL_FOLLOW}, {_SQL_LEADERS}, {_sql_distances("d", "leaders")}
SELECT id, landmark, next, hops FROM d_next""",
    "landmark_hops_salted": f"""WITH RECURSIVE {I.SQL_ATTRIBUTE_EDGES},
follow AS (SELECT src, dst FROM attribute_edges UNION SELECT dst, src FROM attribute_edges),
{_SQL_LEADERS}, {_sql_distances("d", "leaders")}
SELECT id, landmark, next, hops FROM d_next""",
    "landmark_paths": f"""WITH RECURSIVE {I.SQL_FOLLOW}, {_SQL_LEADERS}, {_sql_distances("d", "leaders")},
walk (id, landmark, hops, path) AS (
  SELECT id, landmark, hops, []::BIGINT[] FROM d_next WHERE hops = 0
  UNION ALL
  SELECT n.id, n.landmark, n.hops, [n.next] || w.path FROM walk w
  JOIN d_next n ON n.next = w.id AND n.landmark = w.landmark)
SELECT id, landmark, hops, array_to_string(path, ',') AS path FROM walk""",
    "avg_path_length": f"""WITH RECURSIVE {I.SQL_FOLLOW},
ids AS (SELECT src AS id FROM follow UNION SELECT dst FROM follow),
marks AS (SELECT id FROM ids ORDER BY md5(id || ':0'), id LIMIT 10), {_sql_distances("d", "marks")}
SELECT round(avg(m), 6) AS avg_path_length FROM (SELECT sum(hops) // count(*) AS m FROM d GROUP BY id)""",
    "connected_components": f"""WITH RECURSIVE {I.SQL_FOLLOW}, ids AS (SELECT c_custkey AS id FROM customer),
{_sql_components("ids", "follow")}
SELECT id, component FROM cc""",
    "geo_components": f"""WITH RECURSIVE {I.SQL_GEO_EDGES},
ids AS (SELECT src AS id FROM geo_edges UNION SELECT dst FROM geo_edges), {_sql_components("ids", "geo_edges")}
SELECT id, component FROM cc""",
    # Kruskal edge by edge; the labels of all points are one list.
    "spanning_forest": f"""WITH RECURSIVE {I.SQL_RAW_FOLLOW},
one_way AS (
  SELECT least(src, dst) AS a, greatest(src, dst) AS b, min((weight, src)) AS best FROM raw_follow GROUP BY 1, 2),
points AS (SELECT id, row_number() OVER (ORDER BY id) AS p FROM (SELECT a AS id FROM one_way UNION SELECT b FROM one_way)),
ranked AS (
  SELECT row_number() OVER (ORDER BY best[1], a, b) AS i, pa.p AS pa, pb.p AS pb, best[2] AS src,
    CASE WHEN best[2] = a THEN b ELSE a END AS dst, best[1] AS weight
  FROM one_way JOIN points pa ON pa.id = a JOIN points pb ON pb.id = b),
lists AS (SELECT list(pa ORDER BY i) AS pa, list(pb ORDER BY i) AS pb, count(*) AS n FROM ranked),
kruskal (one, i, label, chosen) USING KEY (one) AS (
  SELECT 1, CAST(0 AS BIGINT), (SELECT list(p ORDER BY p) FROM points), CAST([] AS BIGINT[])
  UNION
  SELECT 1, i + 1,
    CASE WHEN x = y THEN label ELSE [CASE WHEN l = y THEN x ELSE l END for l in label] END,
    CASE WHEN x = y THEN chosen ELSE list_append(chosen, i + 1) END
  FROM (SELECT i, label, chosen, label[pa[i + 1]] AS x, label[pb[i + 1]] AS y FROM kruskal, lists WHERE i < n))
SELECT src, dst, weight FROM ranked WHERE i IN (SELECT unnest(chosen) FROM kruskal)""",
    # Kruskal by weight class: a class adds as many edges as it removes components.
    "spanning_forest_weight": f"""WITH RECURSIVE {I.SQL_RAW_FOLLOW},
ids AS (SELECT src AS id FROM raw_follow UNION SELECT dst FROM raw_follow),
both_ways AS (SELECT src AS s, dst AS t, weight FROM raw_follow UNION SELECT dst, src, weight FROM raw_follow),
cc (w, id, component) USING KEY (w, id) AS (
  SELECT w, id, id FROM ids, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS w)
  UNION
  SELECT c.w, x.t, min(c.component) FROM cc c JOIN both_ways x ON x.s = c.id AND x.weight <= c.w
  JOIN recurring.cc r ON r.w = c.w AND r.id = x.t WHERE c.component < r.component GROUP BY c.w, x.t),
counts AS (SELECT w, count(DISTINCT component) AS n FROM cc GROUP BY 1)
SELECT (SELECT count(*) FROM ids) - (SELECT n FROM counts WHERE w = 5) AS num_edges,
  CAST(sum(n - (SELECT n FROM counts WHERE w = 5)) FILTER (w < 5) AS BIGINT) AS total_weight FROM counts""",
    "backbone": f"""WITH RECURSIVE {I.SQL_FOLLOW}, {_SQL_LEADERS}, {_sql_distances("d", "leaders")},
{_sql_backbone("d", "leaders")}
SELECT DISTINCT at_id AS src, node AS dst FROM steps""",
    "backbone_keys": f"""WITH RECURSIVE {I.SQL_FOLLOW}, {_SQL_LEADERS}, {_sql_distances("d", "leaders")},
{_sql_backbone("d", "leaders")}, {_sql_attach(_LEVELS)}
SELECT c_custkey AS id, coalesce(array_to_string(key, ','), concat_ws(',', c_custkey, c_custkey, c_custkey, c_custkey, c_custkey)) AS key
FROM customer LEFT JOIN keys ON id = c_custkey""",
    "keep_all": f"""WITH RECURSIVE {I.SQL_FOLLOW},
ids AS (SELECT src AS id FROM follow UNION SELECT dst FROM follow),
marks AS (SELECT id FROM ids ORDER BY md5(id || ':0'), id LIMIT 10), {_sql_distances("s", "marks")},
size AS (SELECT greatest(2, CAST(floor(100.0 / avg(m)) AS BIGINT)) AS k FROM (SELECT sum(hops) // count(*) AS m FROM s GROUP BY id)),
deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM follow UNION ALL SELECT dst FROM follow) GROUP BY 1),
ranked AS (SELECT degree, row_number() OVER (ORDER BY degree DESC) AS rn FROM deg),
strong AS (SELECT id FROM deg WHERE degree >= (SELECT min(degree) FROM ranked, size WHERE rn <= k)),
picked AS (SELECT id, row_number() OVER (ORDER BY md5(id || ':0'), id) AS rn FROM strong),
points AS (SELECT id FROM picked, size WHERE rn <= k), {_sql_distances("d", "points")},
{_sql_backbone("d", "points")}, {_sql_attach(_LEVELS)}
SELECT id, array_to_string(key, ',') AS key FROM keys WHERE n > 1""",
    "degree_hierarchy": f"""WITH RECURSIVE {I.SQL_FOLLOW},
ids AS (SELECT src AS id FROM follow UNION SELECT dst FROM follow),
deg AS (SELECT id, (SELECT count(*) FROM follow WHERE src = id) AS d FROM ids),
parents AS (
  SELECT dst AS id, src AS parent FROM follow JOIN deg a ON a.id = src JOIN deg b ON b.id = dst WHERE a.d > b.d
  QUALIFY row_number() OVER (PARTITION BY dst ORDER BY a.d DESC, src) = 1),
chain (id, line) AS (
  SELECT id, [id] FROM ids
  UNION ALL
  SELECT c.id, [p.parent] || c.line FROM chain c JOIN parents p ON p.id = c.line[1] WHERE len(c.line) < 10),
longest AS (SELECT id, line FROM chain QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(line) DESC) = 1)
SELECT id, array_to_string((line || list_transform(generate_series(1, 10), lambda i: id))[1:10], ',') AS key FROM longest""",
    "seed_labels": f"""WITH RECURSIVE {I.SQL_FOLLOW},
ids AS (SELECT src AS id FROM follow UNION SELECT dst FROM follow),
w (id, level, seed) USING KEY (id, level) AS (
  SELECT id, id // 100, id FROM ids WHERE id < 1000
  UNION
  SELECT e.dst, w.level, min(w.seed) FROM w JOIN follow e ON e.src = w.id
  LEFT JOIN recurring.w r ON r.id = e.dst AND r.level = w.level WHERE r.id IS NULL GROUP BY e.dst, w.level),
slots AS (
  SELECT id, list_transform(generate_series(0, 9), lambda l: coalesce(map_extract(m, l)[1], -1)) AS key
  FROM (SELECT id, map_from_entries(list((level, seed))) AS m FROM w GROUP BY 1))
SELECT id, array_to_string(key, ',') AS key FROM slots WHERE len(list_distinct(key)) > 1""",
    "structural_equivalence": _sql_structural(I.SQL_GEO_EDGES, "geo_edges"),
    "structural_attributes": _sql_structural(I.SQL_ATTRIBUTE_EDGES, "attribute_edges"),
    "fuzzy_equivalence": _sql_fuzzy(I.SQL_ATTRIBUTE_EDGES, "attribute_edges", 1.4, True),
    "fuzzy_pages": _sql_fuzzy(I.SQL_PAGE_EDGES, "page_edges", 1.0, True),
    "fuzzy_directed": _sql_fuzzy(I.SQL_ATTRIBUTE_EDGES, "attribute_edges", 1.6, False),
    "fuzzy_schedule": _sql_schedule(I.SQL_ATTRIBUTE_EDGES, "attribute_edges", _SCHEDULE, 4),
    "fuzzy_subset": _sql_fuzzy(I.SQL_ATTRIBUTE_EDGES, "attribute_edges", 1.2, True, True),
}
