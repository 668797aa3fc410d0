"""Prefix trie of conversations, its subtree sums by the Euler-tour technique.

A node is a distinct sequence of first turns. Its id is a digest of the depth and of the sum
of position-tagged turn digests, so a conversation's node ids are prefix sums along its turns
and need no task that sees all of them in order; texts do not move once digested. The trie's
edges give a tour: every node has an arc that enters it and one that leaves it, and each arc
knows the next one from its node's first child or next sibling, or from the parent. The tour
is a linked list. It is ranked by pointer jumping that stops at sampled arcs, then the sampled
arcs, one in 32, are ranked in the same way, until a list is short enough for
the driver. At the arcs' positions, prefix sums of what enters give every subtree's total: the
sum up to a node's leaving arc less the sum before its entering arc.

Sums along an order never take one task: rows are dealt into stretches, each summed by itself,
and a stretch starts with the total of those before it.

Defined results: null roles and texts are empty; turns come in order of turn (null first),
then role, then text, and repeated rows are turns of their own; rows without a conversation id
take no part; a conversation without turns is a member of the root alone; an empty table has
no nodes; other columns take no part. Digests are SHA-256, in a node id 128 bits of MD5 over
eight exact sums: two nodes are taken for one with a chance of about 2^-128 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from strata.operators.skew import hot_keys, replicate, spread
from strata.session import save, save_counted

STRETCH, TOUR_STRETCH, RATE, SHORT, SEED = 1 << 12, 1 << 16, 32, 512, 11
_LANES = [f"lane{k}" for k in range(8)]
ROOT = hashlib.md5(b"root").hexdigest()


def ordered(rows: DataFrame, order: list[Column], group: str) -> DataFrame:
    """``rows`` with ``part`` and ``at``, rising in the given order, stored; and ``pos``, the place
    within the group from 1. The order starts with the group; a large group fills several parts."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "__tie")
    placed = ranged.sortWithinPartitions(*order, "__tie").drop("__tie")
    stored = save(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ordered")
    spans = stored.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    pos = F.col("at") - F.col("first") + F.col("before") + 1
    return stored.join(spans, [group, "part"]).withColumn("pos", pos).drop("first", "before")


def running_sums(rows: DataFrame, groups: list[str], place: str, values: list[str], stretch: int = STRETCH) -> DataFrame:
    """``rows`` with ``upto_<value>``: the sums over places up to the row's own, within its group.

    Places are distinct within a group. A stretch is a range of places.
    """
    cut = rows.withColumn("__stretch", F.floor(F.col(place) / stretch).cast("long"))
    totals = cut.groupBy(*groups, "__stretch").agg(*(F.sum(v).alias(v) for v in values))
    earlier = Window.partitionBy(*groups).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*groups, "__stretch", *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"__{v}") for v in values))
    inside = Window.partitionBy(*groups, "__stretch").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.select("*", *(F.sum(v).over(inside).alias(f"upto_{v}") for v in values))
    joined = summed.join(starts, [*groups, "__stretch"])
    return joined.select(*rows.columns, *((F.col(f"upto_{v}") + F.col(f"__{v}")).alias(f"upto_{v}") for v in values))


def digested(turns: DataFrame) -> DataFrame:
    """(conv_id, digest, chars, part, at, pos): every turn's SHA-256, code points and place from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    kept = plain.where("conv_id IS NOT NULL")
    # The digest is taken before rows move, so that of a text only what the order needs is compared.
    full = kept.select("conv_id", "turn", "role", "text", digest.alias("digest"), F.length("text").cast("long").alias("chars"))
    return ordered(full, order, "conv_id").drop("turn", "role", "text")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, chars) for turns (conv_id, depth, digest, chars), depths from 1."""
    tagged = F.sha2(F.concat(F.encode(F.col("depth").cast("string"), "UTF-8"), F.encode(F.lit(":"), "UTF-8"), "digest"), 256)
    lanes = [F.conv(F.substring("tag", 8 * k + 1, 8), 16, 10).cast("long").alias(_LANES[k]) for k in range(8)]
    laned = turns.select("conv_id", "depth", "chars", tagged.alias("tag")).select("conv_id", "depth", "chars", *lanes)
    summed = running_sums(laned, ["conv_id"], "depth", _LANES)
    node = F.md5(F.concat_ws(",", "depth", *(f"upto_{v}" for v in _LANES)))
    before = F.md5(F.concat_ws(",", F.col("depth") - 1, *(F.col(f"upto_{v}") - F.col(v) for v in _LANES)))
    parent = F.when(F.col("depth") == 1, F.lit(ROOT)).otherwise(before)
    return summed.select("conv_id", F.col("depth").cast("long").alias("depth"), node.alias("node"), parent.alias("parent"), "chars")


def list_rank(links: DataFrame, short: int = SHORT, rate: int = RATE, seed: int = SEED) -> DataFrame:
    """(arc, dist) for a linked list (arc, to, gap): the gaps from the arc to the end, its own included.

    ``to`` is null at the end. Arcs jump until they point to a sampled arc or the end; about
    one in ``rate`` is sampled. The sampled ones form a list of their own, ranked likewise.
    """
    state, n = save_counted(links.select("arc", "to", "gap"), "arcs")
    if n <= short:
        return _rank_short(state)
    sampled = lambda c: F.pmod(F.xxhash64(c, F.lit(seed), F.lit(n)), F.lit(rate)) == 0
    moving = F.col("to").isNotNull() & ~sampled(F.col("to"))
    while True:
        ahead = state.select(F.col("arc").alias("to"), F.col("to").alias("beyond"), F.col("gap").alias("more"))
        jumped = state.where(moving).join(ahead, "to").select("arc", F.col("beyond").alias("to"), (F.col("gap") + F.col("more")).alias("gap"))
        seen = Observation()
        both = state.where(~moving).select("arc", "to", "gap").unionByName(jumped)
        state = save(both.observe(seen, F.count_if(moving).alias("moving")), "jumped")
        if not seen.get["moving"]:
            break
    # Sampled arcs are 1 in rate of the list and every stop is one of them, or the end.
    ranks = list_rank(state.where(sampled(F.col("arc"))), short, rate, seed + 1)
    stops = ranks.select(F.col("arc").alias("to"), F.col("dist").alias("rest"))
    return state.join(stops, "to", "left").select("arc", (F.col("gap") + F.coalesce("rest", F.lit(0))).alias("dist"))


def _rank_short(links: DataFrame) -> DataFrame:
    """Rank a list of at most SHORT arcs on the driver."""
    rows = links.collect()
    before: dict[int | None, list] = {}
    for arc, to, gap in rows:
        before.setdefault(to, []).append((arc, gap))
    known = {arc for arc, _, _ in rows}
    ranked, open_ = [], [(arc, gap) for to, found in before.items() if to is None or to not in known for arc, gap in found]
    while open_:
        arc, dist = open_.pop()
        ranked.append((arc, dist))
        open_ += [(a, dist + gap) for a, gap in before.get(arc, [])]
    return links.sparkSession.createDataFrame(ranked, "arc long, dist long")


def tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(numbered nodes, arcs, number of nodes) of a tree of (node, parent), the root's parent null.

    Nodes get a number ``g`` in order of (parent, node): siblings follow each other. Arc 2 g
    enters node g, arc 2 g + 1 leaves it. Arcs are (arc, to), ``to`` null after the root's last.
    """
    sized = ordered(nodes.withColumn("__root", F.coalesce("parent", F.lit(""))), [F.col("__root"), F.col("node")], "__root")
    spans = sized.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = spans.select("part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    g = F.col("at") - F.col("first") + F.col("start")
    numbered, n = save_counted(
        sized.join(F.broadcast(starts), "part").select(*nodes.columns, g.alias("g"), F.col("pos").alias("born")), "numbered"
    )
    families = numbered.where("parent IS NOT NULL").groupBy("parent").agg(F.min("g").alias("eldest"), F.count(F.lit(1)).alias("n_children"))
    # One row per node with children: its number, and its children as a range of numbers.
    above = families.join(numbered.select(F.col("node").alias("parent"), F.col("g").alias("up")), "parent")
    above = save(above, "families")
    enter = F.col("g") * 2
    leave = enter + 1
    down = numbered.select("node", "g").join(above.select(F.col("parent").alias("node"), "eldest"), "node", "left")
    entering = down.select(enter.alias("arc"), F.coalesce(F.col("eldest") * 2, leave).alias("to"))
    # Leaving a child leads to the next number, leaving the last one to where its parent is left.
    last = F.col("eldest") + F.col("n_children") - 1
    leaving = numbered.where("parent IS NOT NULL").select("g").join(
        above.select(last.alias("g"), F.col("up")), "g", "left"
    ).select(leave.alias("arc"), F.coalesce(F.col("up") * 2 + 1, (F.col("g") + 1) * 2).alias("to"))
    root = numbered.where("parent IS NULL").select(leave.alias("arc"), F.lit(None).cast("long").alias("to"))
    kept = numbered.drop("born").join(above.select(F.col("parent").alias("node"), "n_children"), "node", "left")
    return kept.fillna(0, ["n_children"]), entering.unionByName(leaving).unionByName(root), n


def subtree_sums(nodes: DataFrame, values: dict[str, Column], **how) -> DataFrame:
    """``nodes`` with ``n_children`` and, for every name in ``values``, its sum over the node's subtree.

    ``nodes`` has ``node``, ``parent`` (null at the single root) and what the values read; they
    may read ``n_children`` too.
    """
    numbered, arcs, n = tour(nodes)
    numbered = save(numbered, "nodes")
    ranked = list_rank(arcs.withColumn("gap", F.lit(1).cast("long")), **how)
    weights = [f"w_{name}" for name in values]
    entering = numbered.select((F.col("g") * 2).alias("arc"), *(v.cast("long").alias(w) for w, v in zip(weights, values.values())))
    placed = ranked.select("arc", (F.lit(2 * n) - F.col("dist")).alias("place")).join(entering, "arc", "left").fillna(0, weights)
    # One stretch of the tour is one row of the sums before it.
    summed = running_sums(placed.withColumn("all", F.lit(0)), ["all"], "place", weights, TOUR_STRETCH)
    leaves = F.col("arc") % 2 == 1
    totals = summed.groupBy(F.floor(F.col("arc") / 2).cast("long").alias("g")).agg(
        *(
            F.sum(F.when(leaves, F.col(f"upto_{w}")).otherwise(F.col(w) - F.col(f"upto_{w}"))).alias(name)
            for name, w in zip(values, weights)
        )
    )
    return numbered.join(totals, "g").drop("g")


def trie(members: DataFrame, turns: DataFrame, **how) -> DataFrame:
    """(node, parent, depth, conv_id, n_convs, n_children, n_leaves, saved_tokens), one row per node.

    ``members`` has every conversation's ``conv_id`` once, those without turns too; ``turns`` is
    a stored table as :func:`prefixes` gives it.
    """
    found = turns.groupBy("node").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.first("chars").alias("chars"),
    )
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"),
        "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"),
    )
    values = {
        "n_leaves": (F.col("n_children") == 0).cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("chars"),
    }
    return subtree_sums(save(found.unionByName(root), "found"), values, **how).drop("chars")


def with_parent(nodes: DataFrame, column: str, name: str) -> DataFrame:
    """``nodes`` with the parent's ``column`` as ``name``; a parent of very many children is salted."""
    stored, rows = save_counted(nodes, "trie")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    above = stored.select(F.col("node").alias("parent"), F.col(column).alias(name))
    hot = hot_keys(stored.select("parent").where("parent IS NOT NULL"), "parent", rows, parts)
    if hot is None:
        return stored.join(above, "parent", "left")
    return spread(stored, "parent", "node", hot).join(replicate(above, "parent", hot), ["parent", "salt"], "left").drop("salt")


def list_digests(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): SHA-256 of every node's ids, ascending, joined by commas.

    A node's ids pass through one task one after the other, as the digest takes them; none is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for at, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if at != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = at, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    ordered_ = members.select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
    return ordered_.mapInArrow(run, "node string, ends_sha256 string")
