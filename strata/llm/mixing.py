"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source of ``n`` documents is dealt by hash into about sqrt(n) blocks of about sqrt(n)
documents. Its quota in words is met by whole passes over its blocks and one partial pass:
blocks in random order as long as they fit, then of the next block documents in random
order, the last of them if that comes nearer the quota. Documents are taken whole, so every
source comes within half a document of its target.

The blocks to be drawn are split among the output shards by a tree: a node with quotas per
source and a range of shards draws, from the multivariate hypergeometric distribution, how
many blocks of every source its left half gets; the right half gets the rest. A leaf's
quota is a run of its source's permuted draws, so shards never share a draw. The tree's top
is split on the driver, its branches in tasks. Within a shard documents are in random order.

Weights are 1, 2, 3 and again, over the sources in code point order, null last. Targets
share the total size by weight, but stop at ``most`` times a source's size; what is above
is shared anew. All draws follow from hashes of (doc_id, source, text), so reruns agree
however the table is split, and :func:`mix` decides for each row where it is read: a text
moves once, to its shard.

Defined results: null and blank texts have size 0 and nothing is taken; repeated rows and
rows without ``doc_id`` count each, but rows equal in id, source and text share one fate; an empty table gives an empty result; other columns are
kept by :func:`mix`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.tables import every, quoted
from strata.session import save, save_counted

WEIGHTS, MOST, SEED = (1, 2, 3), 3, 11
SHARD_WORDS = 1 << 22
MAX_SOURCES = 100_000
BROADCAST_ROWS = 1 << 20
_TOP = 64
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[Fraction]:
    """Shares of the total by weight, none above ``most`` times its size."""
    goal, open_ = [Fraction(0)] * len(sizes), set(range(len(sizes)))
    rest = Fraction(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        above = {i for i in open_ if rest * weights[i] / total > most * sizes[i]}
        for i in above or open_:
            goal[i] = Fraction(most * sizes[i]) if above else rest * weights[i] / total
        if not above:
            break
        rest -= sum(goal[i] for i in above)
        open_ -= above
    return goal


def _split(quotas: np.ndarray, share: Fraction, draw: np.random.Generator) -> np.ndarray:
    """Of every source, the blocks that go left: a uniform draw of a fixed number without replacement."""
    number, left, total = int(quotas.sum() * share), np.zeros_like(quotas), int(quotas.sum())
    for i, quota in enumerate(quotas.tolist()):
        rest = total - quota
        left[i] = draw.hypergeometric(quota, rest, number) if number and quota and rest else min(quota, number)
        number, total = number - int(left[i]), rest
    return left


def _halves(node: tuple[int, int, np.ndarray, np.ndarray], seed: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """The two children of a node (first shard, last shard + 1, quotas, first draws)."""
    low, high, quotas, firsts = node
    middle = (low + high) // 2
    left = _split(quotas, Fraction(middle - low, high - low), np.random.default_rng([seed, low, high]))
    return [(low, middle, left, firsts), (middle, high, quotas - left, firsts + left)]


def _leaves(spark, quotas: np.ndarray, shards: int, seed: int) -> DataFrame:
    """(shard, s, first, n): every shard's run of draws of every source."""
    nodes = [(0, shards, quotas, np.zeros_like(quotas))]
    while len(nodes) < min(_TOP, shards):
        nodes = [x for n in nodes for x in (_halves(n, seed) if n[1] - n[0] > 1 else [n])]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stack = [(row["low"], row["high"], np.array(row["quotas"]), np.array(row["firsts"]))]
                while stack:
                    node = stack.pop()
                    if node[1] - node[0] > 1:
                        stack += _halves(node, seed)
                        continue
                    s = np.flatnonzero(node[2])
                    columns = [np.full(len(s), node[0]), s, node[3][s], node[2][s]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "s", "first", "n"])

    rows = [(low, high, q.tolist(), f.tolist()) for low, high, q, f in nodes]
    top = spark.createDataFrame(rows, "low long, high long, quotas array<long>, firsts array<long>")
    return top.repartition(min(_TOP, shards)).mapInArrow(grow, "shard long, s long, first long, n long")


def _sources(sized: DataFrame) -> list[tuple[str | None, int, int]]:
    """(source, words, rows) in code point order, null last."""
    found = sized.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return sorted((tuple(r) for r in found), key=lambda r: (r[0] is None, r[0] or ""))


def _keyed(rows: DataFrame, seed: int) -> DataFrame:
    """Rows with ``key``, a hash of (doc_id, source, text), and ``source``."""
    return rows.withColumn("key", F.xxhash64("doc_id", "source", "text", F.lit(seed)))


def _joined(rows: DataFrame, small: DataFrame, n: int, on: list[str]) -> DataFrame:
    """Left join with a table of ``n`` rows, by broadcast if these are few."""
    return rows.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, on, "left")


class _Decision:
    """Which blocks are drawn how often and for which shards, from (key, source, size) rows, stored."""

    def __init__(self, sized: DataFrame, sources: list, shard_words: int, seed: int, weights: tuple[int, ...]):
        spark = sized.sparkSession
        goals = targets([n for _, n, _ in sources], [weights[i % len(weights)] for i in range(len(sources))])
        facts = []
        for s, ((source, words, rows), goal) in enumerate(zip(sources, goals)):
            quota = round(goal)
            passes, rest = divmod(quota, words) if words else (0, 0)
            facts.append((s, source, words, float(goal), passes, rest, max(1, math.isqrt(rows))))
        self.seed = seed
        self.facts = spark.createDataFrame(
            facts, "s long, name string, source_size long, target double, passes long, rest long, n_blocks long"
        )
        known = self.placed(sized)

        # Every pass draws the blocks in an order of its own; the last may end within a block.
        blocks = known.groupBy("s", "block").agg(
            F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest")
        )
        drawn = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("pass"))
        order = [F.col("pass"), F.xxhash64("s", "block", "pass", F.lit(seed)), F.col("block")]
        within = Window.partitionBy("s", "pass").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
        drawn = drawn.withColumn("before", F.coalesce(F.sum("words").over(within), F.lit(0)))
        drawn = drawn.where((F.col("words") > 0) & ((F.col("pass") < F.col("passes")) | (F.col("before") < F.col("rest"))))
        drawn = drawn.withColumn("draw", F.row_number().over(Window.partitionBy("s").orderBy(*order)) - 1)
        missing = F.when(F.col("pass") == F.col("passes"), F.col("rest") - F.col("before"))
        drawn = save(drawn.select("s", "block", "pass", "draw", F.when(missing < F.col("words"), missing).alias("missing")), "draws")

        quotas = np.zeros(len(sources), np.int64)
        for s, n in drawn.groupBy("s").count().collect():
            quotas[s] = n
        shards = max(1, math.ceil(sum(n for _, n, _ in sources) / shard_words))
        runs = _leaves(spark, quotas, shards, seed).select(
            "shard", "s", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("draw")
        )
        dealt = save(drawn.join(runs, ["s", "draw"]), "dealt")

        # The documents of the few blocks that are drawn in part, in random order, up to the words
        # missing; one that crosses the line is taken if half of it or more lies before it.
        part = known.join(dealt.where("missing IS NOT NULL").select("s", "block", "missing"), ["s", "block"])
        part = part.groupBy("s", "block", "key").agg(F.sum("size").alias("size"), F.first("missing").alias("missing"))
        window = Window.partitionBy("s").orderBy(F.xxhash64("key", F.lit(seed)), "key").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("size").over(window), F.lit(0))
        chosen = part.withColumn("before", before).where(2 * F.col("before") + F.col("size") <= 2 * F.col("missing"))
        self.chosen, self.n_chosen = save_counted(chosen.select("s", "block", "key", F.lit(True).alias("chosen")), "chosen")
        draws = F.collect_list(F.struct("pass", "shard", F.col("missing").isNull().alias("whole"))).alias("draws")
        self.blocks, self.n_blocks = save_counted(dealt.groupBy("s", "block").agg(draws), "drawn-blocks")

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows (key, source, ...) with their source's facts (one row per source, at most MAX_SOURCES) and their block."""
        known = rows.join(F.broadcast(self.facts), F.col("source").eqNullSafe(F.col("name"))).drop("name")
        return known.withColumn("block", F.pmod(F.xxhash64("key", F.lit(self.seed + 1)), "n_blocks"))

    def takes(self, rows: DataFrame) -> DataFrame:
        """Rows (key, source, size, ...) with ``takes``, (pass, shard, position, words) each; none of size 0."""
        drawn = _joined(self.placed(rows), self.blocks, self.n_blocks, ["s", "block"])
        told = _joined(drawn, self.chosen, self.n_chosen, ["s", "block", "key"])
        taken = F.filter("draws", lambda d: (d["whole"] | F.coalesce("chosen", F.lit(False))) & (F.col("size") > 0))
        takes = F.transform(
            F.coalesce(taken, F.expr("cast(array() as array<struct<pass:bigint,shard:bigint,whole:boolean>>)")),
            lambda d: F.struct(
                d["pass"].cast("int").alias("pass"),
                d["shard"].alias("shard"),
                F.xxhash64("key", d["pass"], F.lit(self.seed)).alias("position"),
                F.col("size").alias("words"),
            ),
        )
        return told.withColumn("takes", takes)


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    return save(_keyed(rows, seed).select("key", "doc_id", "source", size), "sized")


def plan(docs: DataFrame, shard_words: int = SHARD_WORDS, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, size, source_size, target, takes), one row per row of ``docs``.

    ``takes`` lists what the mix takes of it: (pass, shard, position, words).
    """
    sized = _sized(docs, seed)
    sources = _sources(sized)
    if not sources:
        return sized.select(
            "doc_id", "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"),
            F.expr("cast(array() as array<struct<pass:int,shard:bigint,position:bigint,words:bigint>>)").alias("takes"),
        )
    decided = _Decision(sized, sources, shard_words, seed, weights)
    return decided.takes(sized).select("doc_id", "size", "source_size", "target", "takes")


def mix(docs: DataFrame, shard_words: int = SHARD_WORDS, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mixed rows: columns of ``docs``, one row per take, shard by shard in random order."""
    sized = _sized(docs, seed)
    sources = _sources(sized)
    if not sources:
        return docs
    decided = _Decision(sized, sources, shard_words, seed, weights)
    rows = docs.select(F.struct(*every(docs)).alias("__strata_doc")).select(
        "__strata_doc",
        F.col("__strata_doc.doc_id").cast("long").alias("doc_id"),
        F.col("__strata_doc.source").alias("source"),
        F.col("__strata_doc.text").alias("text"),
    )
    # Whether there is a word at all is enough to know here.
    some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).cast("long").alias("size")
    told = decided.takes(_keyed(rows, seed).select("__strata_doc", "key", "source", some))
    taken = told.select("__strata_doc", F.explode("takes").alias("take"))
    ordered = taken.repartition("take.shard").sortWithinPartitions("take.shard", "take.position")
    return ordered.select(*(F.col(f"__strata_doc.{quoted(c)}") for c in docs.columns))
