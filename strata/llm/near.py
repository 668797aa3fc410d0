"""Near-duplicate documents by a chosen-path set similarity join.

Every document's set of word shingles gets a sketch of ``COORDINATES`` minwise tokens. A
tree starts with all documents; a node of more than ``node_limit`` documents branches: for
each coordinate that the node's own hash selects, a child for every value of the minwise
token there. The number of selected coordinates is 1 / threshold on average, so two
documents at the threshold meet in one child on average, as deep as the tree goes, while
those that share little part ways. Small nodes are compared exhaustively. ``trees``
independent trees bring the recall to the target.

What keeps groups of copies linear:

* documents of equal sets are linked to the least of them and only that one goes on;
* in a large node the sketches are compared with the node's pivot; those that are surely
  similar to it are linked to it and leave the tree, the pivot stays. Whatever can be
  similar to one that left is, by the triangle inequality, not far from the pivot either:
  these two kinds are compared with each other in blocks of the size of small nodes;
* small nodes emit no pairs, only their clusters of similar sketches (each cluster once,
  though many trees find it), and links are then confirmed on full sets within a cluster
  where they connect what is not connected yet.

Defined results: null, empty and blank texts have no set and no link; fewer than ``words``
words make one shingle; repeated rows are linked; rows without ``doc_id`` take no part and
stay on their own; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.hashing import lower_ascii, mix, window_hashes, word_hashes
from strata.llm.tables import every, map_batches, slices, texts_of
from strata.operators.components import components
from strata.session import save, save_counted

WORDS, PERCENT = 5, 85
COORDINATES, TREES, NODE_LIMIT = 128, 10, 2048
_SEEDS = np.random.default_rng(77).integers(0, 1 << 32, (2, COORDINATES), dtype=np.uint64).astype(np.uint32)
_FACTORS, _OFFSETS = _SEEDS[0] | np.uint32(1), _SEEDS[1]
_ROWS = 2048


def shingles(words: np.ndarray, width: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a document's shingles, from its words' hashes."""
    if 0 < len(words) < width:
        return window_hashes(words, len(words)) ^ np.uint64(len(words))
    return np.unique(window_hashes(words, width))


def minwise(found: np.ndarray) -> np.ndarray:
    """The 32-bit minwise token of a set at every coordinate."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), _ROWS):
        part = low[at : at + _ROWS, None] * _FACTORS
        part += _OFFSETS
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(least, part.min(axis=0), out=least)
    return least


def sketch(tokens: np.ndarray) -> np.ndarray:
    """One byte of every minwise token."""
    return (mix(tokens.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def roots(trees: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(tree, coordinate) of every child of every root: 100 / percent coordinates a tree on average."""
    draw = np.random.default_rng(trees)
    chosen = [
        (tree, at)
        for tree in range(trees)
        for at in draw.permutation(COORDINATES)[: 1 + (draw.random() < 100 / percent - 1)].tolist()
    ]
    return tuple(np.array(x, np.int64) for x in zip(*chosen))


def bounds(percent: int) -> tuple[float, float, float]:
    """(sure, possible, nearby): similarities of sketches at a threshold, to two digits.

    A sketch of 128 tokens is off by 3.2 points (one standard deviation) at 85 percent. Sure
    is 2.2 deviations above the threshold and possible 5.4 below it; nearby is twice the
    distance at the threshold, and 3.7 deviations for the sketches' error there.
    """

    def off(x: float) -> float:
        return (x * (1 - x) / COORDINATES) ** 0.5

    threshold = percent / 100
    twice = max(0.0, 2 * threshold - 1)
    return tuple(round(x, 2) for x in (threshold + 2.2 * off(threshold), threshold - 5.4 * off(threshold), twice - 3.7 * off(twice)))


def similarity(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sketches, corrected for bytes equal by chance."""
    equal = (others == one).mean(axis=-1)
    return (equal - 1 / 256) / (1 - 1 / 256)


def shingle_table(docs: DataFrame, width: int, percent: int, trees: int) -> DataFrame:
    """(doc_id, n_shingles, whole, sketch, nodes) of every set.

    ``whole`` is a 128-bit hash, ``nodes`` the children of the trees' roots that hold it.
    """
    tree, at = roots(trees, percent)
    salt = mix((tree * COORDINATES + at + 1).astype(np.uint64))

    def make(batch: pa.RecordBatch) -> dict:
        counts, wholes, sketches, nodes = [], [], [], []
        for words in word_hashes([lower_ascii(t) for t in texts_of(batch)]):
            found = shingles(words, width)
            counts.append(len(found))
            with np.errstate(over="ignore"):
                whole = np.array([mix(found).sum(), mix(found ^ np.uint64(0xA5A5A5A5)).sum()], np.uint64)
            wholes.append(whole.tobytes())
            tokens = minwise(found)
            sketches.append(sketch(tokens).tobytes() if len(found) else None)
            nodes.append(mix(tokens[at].astype(np.uint64) ^ salt).view(np.int64))
        return {
            "doc_id": batch.column("doc_id"),
            "n_shingles": pa.array(counts, pa.int64()),
            "whole": pa.array(wholes, pa.binary()),
            "sketch": pa.array(sketches, pa.binary()),
            "nodes": pa.array(nodes, pa.list_(pa.int64())),
        }

    schema = "doc_id long, n_shingles long, whole binary, sketch binary, nodes array<long>"
    return map_batches(docs, "text", schema, make)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles): the full sets, as the bytes of sorted 64-bit hashes."""

    def make(batch: pa.RecordBatch) -> dict:
        sets = [shingles(w, width).tobytes() for w in word_hashes([lower_ascii(t) for t in texts_of(batch)])]
        return {"doc_id": batch.column("doc_id"), "shingles": pa.array(sets, pa.binary())}

    return map_batches(docs, "text", "doc_id long, shingles binary", make)


def _children(node: Column, threshold: float) -> Column:
    """The coordinates that a node selects: 1 / threshold on average, at least one."""
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(COORDINATES))
    second = F.pmod(F.xxhash64(node, F.lit(2)), F.lit(COORDINATES))
    more = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(10_000)) < int(10_000 * (1 / threshold - 1))
    return F.when(more & (first != second), F.array(first, second)).otherwise(F.array(first))


def _branch(members: DataFrame, threshold: float) -> DataFrame:
    """(node, doc_id): every member once in each of its node's children."""
    return members.select(
        "node", "doc_id", "sketch", F.explode(_children(F.col("node"), threshold)).alias("at")
    ).select(F.xxhash64("node", "at", F.expr("substring(sketch, cast(at as int) + 1, 1)")).alias("node"), "doc_id")


def _pivots(large: DataFrame, limit: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links to pivots, members that stay, blocks of those that left and those near them)."""
    sure, _, nearby = bounds(percent)
    drawn = F.xxhash64("node", "doc_id")
    chosen = large.groupBy("node").agg(
        F.min_by(F.struct(F.col("doc_id").alias("pivot"), F.col("sketch").alias("model")), F.struct(drawn, "doc_id")).alias("p")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mine, model = (
                    np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES)
                    for c in ("sketch", "model")
                )
                alike = pa.array(similarity(model, mine), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("node", "doc_id", "pivot", "sketch")), alike],
                    ["node", "doc_id", "pivot", "sketch", "alike"],
                )

    seen = save(
        large.join(chosen, "node")
        .select("node", "doc_id", "sketch", "p.pivot", "p.model")
        .mapInArrow(compare, "node long, doc_id long, pivot long, sketch binary, alike double"),
        "pivots",
    )
    links = seen.where((F.col("alike") >= sure) & (F.col("doc_id") != F.col("pivot")))
    stay = seen.where((F.col("alike") < sure) | (F.col("doc_id") == F.col("pivot")))
    parts = seen.where("doc_id <> pivot").select(
        "node", "doc_id", "sketch", (F.col("alike") >= sure).alias("left"), (F.col("alike") >= nearby).alias("nearby")
    ).where("nearby")
    blocks = parts.groupBy("node").agg(
        F.ceil(F.count_if("left") / limit).alias("rows"), F.ceil(F.count_if(~F.col("left")) / limit).alias("columns")
    ).where("rows > 0 AND columns > 0")
    others = F.when(F.col("left"), F.col("columns")).otherwise(F.col("rows"))
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("left"), F.col("rows")).otherwise(F.col("columns")))
    grid = parts.join(blocks, "node").select(
        "node", "doc_id", "sketch", "left", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), others - 1)).alias("other")
    )
    row, column = (F.when(F.col("left"), F.col(a)).otherwise(F.col(b)) for a, b in (("own", "other"), ("other", "own")))
    grid = grid.select(F.xxhash64("node", row, column, F.lit("block")).alias("node"), "doc_id", "sketch")
    return links.select("doc_id", "pivot").distinct(), stay.select("node", "doc_id", "sketch"), grid


def _clusters(small: DataFrame, percent: int) -> DataFrame:
    """(cluster, doc_id): the groups of similar sketches within small nodes, each group once."""
    _, possible, _ = bounds(percent)

    def groups(batch: pa.RecordBatch) -> Iterator[list[int]]:
        for ids, raw in zip(batch.column("ids").to_pylist(), batch.column("sketches").to_pylist()):
            sketches = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, COORDINATES)
            label = np.arange(len(ids))
            for i in range(1, len(ids)):
                close = np.flatnonzero(similarity(sketches[i], sketches[:i]) >= possible)
                if len(close):
                    label[np.isin(label, np.append(label[close], i))] = label[close].min()
            for value in np.unique(label):
                members = np.flatnonzero(label == value)
                if len(members) > 1:
                    yield sorted(ids[m] for m in members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "sketches"):
            met = {tuple(g) for g in groups(batch)}
            yield pa.RecordBatch.from_arrays([pa.array([list(g) for g in met], pa.list_(pa.int64()))], ["ids"])

    nodes = (
        small.groupBy("node")
        .agg(F.collect_list(F.struct("doc_id", "sketch")).alias("members"))
        .where(F.size("members") > 1)
        .select(F.col("members.doc_id").alias("ids"), F.col("members.sketch").alias("sketches"))
    )
    found = nodes.mapInArrow(run, "ids array<long>").distinct()
    return found.select(F.xxhash64("ids").alias("cluster"), F.explode("ids").alias("doc_id"))


def _linked(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on the full sets."""
    small, large = sorted((len(one), len(other)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def _confirmed(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst): links between members of a cluster that connect what they can."""

    def links(ids: list[int], found: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """By size, each against all smaller ones within reach that it is not connected to;
        one pass over their shingles counts all intersections."""
        order = sorted(range(len(ids)), key=lambda i: (len(found[i]), ids[i]))
        sizes = np.array([len(found[i]) for i in order])
        known, local = np.unique(np.concatenate([found[i] for i in order]), return_inverse=True)
        ends = np.cumsum(sizes)
        begins, marked = ends - sizes, np.zeros(len(known), np.uint8)
        label = np.arange(len(ids))
        for k in range(1, len(ids)):
            first = int(np.searchsorted(100 * sizes, percent * sizes[k]))
            if (label[first:k] == label[k]).all():
                continue
            own = local[begins[k] : ends[k]]
            marked[own] = 1
            near = marked[local[begins[first] : begins[k]]]
            both = np.add.reduceat(near, begins[first:k] - begins[first], dtype=np.int64)
            marked[own] = 0
            for j in np.flatnonzero(100 * both >= percent * (sizes[first:k] + sizes[k] - both))[::-1] + first:
                if label[j] != label[k]:
                    label[label == label[k]] = label[j]
                    yield ids[order[j]], ids[order[k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, found = None, [], []

        def flush() -> pa.RecordBatch:
            got = list(links(ids, found))
            ends = [pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(ends, ["src", "dst"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("cluster", "doc_id", "shingles"))
            for cluster, doc, raw in zip(*columns):
                if cluster != current and ids:
                    yield flush()
                    ids, found = [], []
                current = cluster
                ids.append(doc)
                found.append(np.frombuffer(raw, np.uint64))
        if ids:
            yield flush()

    members = clusters.join(sets.hint("merge"), "doc_id").select("cluster", "doc_id", "shingles")
    return members.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(run, "src long, dst long")


def _star_confirmed(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst): the links to pivots that hold on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "mine"):
            raw = (batch.column(c).to_pylist() for c in ("mine", "model"))
            kept = [
                _linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(*raw)
            ]
            rows = batch.filter(pa.array(kept, pa.bool_()))
            yield pa.RecordBatch.from_arrays([rows.column("pivot"), rows.column("doc_id")], ["src", "dst"])

    models = sets.select(F.col("doc_id").alias("pivot"), F.col("shingles").alias("model"))
    both = stars.join(models, "pivot").join(sets.withColumnRenamed("shingles", "mine"), "doc_id")
    return both.select("doc_id", "pivot", "mine", "model").mapInArrow(run, "src long, dst long")


def links(docs: DataFrame, table: DataFrame, width: int, percent: int, node_limit: int) -> DataFrame:
    """(src, dst) links between documents that connect all near-duplicates found."""
    threshold = percent / 100
    known = table.where("doc_id IS NOT NULL AND sketch IS NOT NULL")
    groups = known.groupBy("whole", "n_shingles").agg(
        F.min(F.struct("doc_id", "sketch", "nodes")).alias("one"), F.count(F.lit(1)).alias("n")
    )
    groups = save(groups.select("whole", "n_shingles", "n", F.col("one.doc_id").alias("least"), "one.sketch", "one.nodes"), "sets")
    same = (
        known.select("doc_id", "whole", "n_shingles")
        .join(groups.where("n > 1").select("whole", "n_shingles", "least"), ["whole", "n_shingles"])
        .where("doc_id <> least")
        .select(F.col("least").alias("src"), F.col("doc_id").alias("dst"))
    )
    sketches = groups.select(F.col("least").alias("doc_id"), "sketch")
    level = groups.select(F.explode("nodes").alias("node"), F.col("least").alias("doc_id"))
    clusters, stars = [], []
    while True:
        # Most nodes hold one document; only members of the others get their sketches.
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        members = save(level.join(sizes.hint("merge"), "node"), "members")
        sketched = members.join(sketches.hint("merge"), "doc_id").select("node", "doc_id", "sketch", "members")
        clusters.append(save(_clusters(sketched.where(F.col("members") <= node_limit), percent), "clusters"))
        if members.where(F.col("members") > node_limit).isEmpty():
            break
        star, stay, grid = _pivots(sketched.where(F.col("members") > node_limit).drop("members"), node_limit, percent)
        stars.append(star)
        clusters.append(save(_clusters(grid, percent), "blocks"))
        level, left = save_counted(_branch(stay, threshold), "level")
        if not left:
            break
    found = clusters[0]
    for more in clusters[1:]:
        found = found.unionByName(more)
    found = save(found.distinct(), "all-clusters")
    wanted = found.select("doc_id")
    for star in stars:
        wanted = wanted.unionByName(star.select("doc_id")).unionByName(star.select(F.col("pivot").alias("doc_id")))
    # Joined by shuffle at every size; rows of one doc_id are one document.
    full = docs.join(wanted.distinct().hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    sets = save(shingle_sets(full, width), "shingles")
    out = same.unionByName(_confirmed(found, sets, percent))
    if stars:
        star = stars[0]
        for more in stars[1:]:
            star = star.unionByName(more)
        out = out.unionByName(_star_confirmed(star.distinct(), sets, percent))
    return save(out, "links")


def near_duplicates(
    docs: DataFrame,
    width: int = WORDS,
    percent: int = PERCENT,
    trees: int = TREES,
    node_limit: int = NODE_LIMIT,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    ``component_id`` is the least ``doc_id`` that links reach; that document is kept.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = save(shingle_table(rows, width, percent, trees), "shingled")
    edges = links(rows, table, width, percent, node_limit)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    labels = components(ends, edges).where("id <> component").select(F.col("id").alias("doc_id"), "component")
    return table.join(labels.hint("merge"), "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.col("component").isNull().alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, **how: int) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    gone = near_duplicates(docs, **how).where(~F.col("kept")).select(F.col("doc_id").alias("__strata_gone")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone["__strata_gone"], "left_anti").select(*every(docs))
