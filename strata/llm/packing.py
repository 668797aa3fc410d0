"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

A document's tokens end with the separator. What is longer than a sequence is cut into
whole sequences and one shorter first piece; only pieces shorter than a sequence are left
to be packed. They are dealt by hash into problems of a few thousand pieces. A problem is
evolved on several islands, a few of them a task; between epochs each island's best solution
moves to the next island of its problem. A solution is a set of bins. Crossover puts the
best-filled bins of one parent into the other, drops the bins that hold a piece twice, and
places what was displaced by best fit; mutation empties the worst-filled bins and places
their pieces anew. A problem's size is fixed, so the work grows with the documents alone.

Defined results: null and empty texts are one separator; repeated rows, also those with
equal or no ``doc_id``, are packed each; an empty table gives an empty result; other
columns, whatever their names, take no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.tables import map_batches, row_number, texts_of
from strata.llm.tokens import VOCABULARY, encoder_of
from strata.session import save, save_counted

LENGTH, SEPARATOR = 1024, 2
PROBLEM = 2048
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 4, 4
# An island takes some 50 ms an epoch, a task of its own far more to start.
ISLANDS_A_TASK = 8

Bins = list[list[int]]


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter."""
    first = n % length
    head = [(0, first)] if first else []
    return head + [(at, length) for at in range(first, n, length)]


def pieces(
    docs: DataFrame, length: int = LENGTH, separator: int = SEPARATOR, vocabulary: str = VOCABULARY, with_ids: bool = False
) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32 [, ids]): every document's pieces."""

    def make(batch: pa.RecordBatch) -> dict:
        rows, ids_of = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()
        out: dict[str, list] = {n: [] for n in ("row", "doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for row, doc, ids in zip(rows, ids_of, encoder_of(vocabulary).encode(texts_of(batch)), strict=True):
            raw = np.append(ids, separator).astype("<u4")
            for k, (at, size) in enumerate(cut(len(raw), length)):
                part = raw[at : at + size]
                for name, value in zip(out, (row, doc, k, at, size, zlib.crc32(part.tobytes()))):
                    out[name].append(value)
                if with_ids:
                    out["ids"].append(part)
        kinds = {"row": pa.int64(), "doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64()}
        done = {n: pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items() if n != "ids"}
        return done | ({"ids": pa.array(out["ids"], pa.list_(pa.int32()))} if with_ids else {})

    rows = row_number(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "row")
    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_batches(rows, "text", schema + ", ids array<int>" * with_ids, make)


class Packer:
    """The steps of the genetic algorithm on one problem."""

    def __init__(self, sizes: np.ndarray, length: int, seed: list[int]):
        self.array, self.sizes, self.length = np.asarray(sizes, np.int64), sizes.tolist(), length
        self.draw = np.random.default_rng(seed)
        self.least = math.ceil(sum(self.sizes) / length)
        # Every piece's place among all, longest first.
        self.rank = np.argsort(np.argsort(-self.array, kind="stable")).tolist()

    def room(self, members: list[int]) -> int:
        return self.length - sum(self.sizes[i] for i in members)

    def rooms(self, bins: Bins) -> np.ndarray:
        """The room of every bin; no bin is empty."""
        if not bins:
            return np.zeros(0, np.int64)
        ends = np.cumsum(np.fromiter(map(len, bins), np.int64, len(bins)))
        members = np.fromiter(chain.from_iterable(bins), np.int64, ends[-1])
        return self.length - np.add.reduceat(self.array[members], np.append(0, ends[:-1]))

    def best_fit(self, bins: Bins, loose: list[int]) -> Bins:
        """Place loose pieces, longest first, each into the fullest bin that takes it."""
        # The bins of every room, and the rooms that have any as the bits of a number.
        by_room: list[list[int]] = [[] for _ in range(self.length + 1)]
        some = 0
        for k, room in enumerate(self.rooms(bins).tolist()):
            by_room[room].append(k)
            some |= 1 << room
        bins, sizes, length = [list(b) for b in bins], self.sizes, self.length
        for i in sorted(loose, key=self.rank.__getitem__):
            size = sizes[i]
            fitting = some >> size
            if not fitting:
                k, room = len(bins), length
                bins.append([i])
            else:
                room = size + (fitting & -fitting).bit_length() - 1
                k = by_room[room].pop()
                if not by_room[room]:
                    some ^= 1 << room
                bins[k].append(i)
            if room > size:
                by_room[room - size].append(k)
                some |= 1 << (room - size)
        return bins

    def fitness(self, bins: Bins) -> tuple[int, int]:
        """Fewer bins first; of as many, the more unequal fill, which leaves more to gain."""
        return -len(bins), int(((self.length - self.rooms(bins)) ** 2).sum())

    def _fullest_first(self, bins: Bins) -> Bins:
        return [bins[k] for k in np.argsort(self.rooms(bins), kind="stable").tolist()]

    def start(self) -> Bins:
        """A random part of the pieces placed first, the rest by best fit."""
        order = self.draw.permutation(len(self.sizes)).tolist()
        share = int(len(order) * self.draw.uniform(0, 0.3))
        return self.best_fit(self.best_fit([], order[:share]), order[share:])

    def crossover(self, mother: Bins, father: Bins) -> Bins:
        """Inject the father's well-filled bins whole, drop what they double, best-fit the rest."""
        good = self._fullest_first(father)[: max(1, len(father) // 2)]
        chosen = [b for b, taken in zip(good, (self.draw.random(len(good)) < 0.5).tolist()) if taken] or good[:1]
        taken = set(chain.from_iterable(chosen))
        whole = [b for b in mother if taken.isdisjoint(b)]
        placed = taken.union(*whole)
        return self.best_fit(chosen + whole, [i for i in range(len(self.sizes)) if i not in placed])

    def mutate(self, bins: Bins) -> Bins:
        """Empty the worst-filled bins and a few others, and place their pieces anew."""
        ranked = self._fullest_first(bins)
        worst = max(1, len(bins) // 50)
        odd = set(self.draw.integers(0, len(bins), max(1, len(bins) // 20)).tolist())
        odd.update(range(len(bins) - worst, len(bins)))
        return self.best_fit(
            [b for k, b in enumerate(ranked) if k not in odd], [i for k in odd for i in ranked[k]]
        )

    def evolve(self, population: list[Bins], generations: int) -> list[Bins]:
        """The fittest of parents and children, best first; ends early at the lower bound."""
        ranked = sorted([(self.fitness(b), b) for b in population], key=itemgetter(0), reverse=True)
        for _ in range(generations):
            if len(ranked[0][1]) <= self.least:
                break
            children = []
            for _ in ranked:
                a, b = self.draw.choice(len(ranked), 2)
                children.append(self.mutate(self.crossover(ranked[a][1], ranked[b][1])))
            size = len(ranked)
            ranked = sorted(ranked + [(self.fitness(b), b) for b in children], key=itemgetter(0), reverse=True)[:size]
        return [b for _, b in ranked]


def _flat(bins: Bins, n: int) -> np.ndarray:
    """The bin of every piece."""
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _bins(flat: np.ndarray) -> Bins:
    out: Bins = [[] for _ in range(int(flat.max()) + 1)]
    for i, k in enumerate(flat.tolist()):
        out[k].append(i)
    return out


_STATE = "problem long, island int, sizes array<int>, solutions array<array<int>>, arrivals array<array<int>>"


def _epoch(state: DataFrame, epoch: int, length: int, seed: int) -> DataFrame:
    """Evolve every island; the arrivals of the last epoch take the worst solutions' places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                sizes = np.array(row["sizes"])
                packer = Packer(sizes, length, [seed, epoch, row["problem"], row["island"]])
                old = [_bins(np.array(s)) for s in (row["solutions"] or [])] or [packer.best_fit([], list(range(len(sizes))))]
                if len(old[0]) > packer.least:
                    old += [packer.start() for _ in range(POPULATION - len(old))]
                come = [_bins(np.array(s)) for s in row["arrivals"] or []]
                population = packer.evolve(old[: POPULATION - len(come)] + come, GENERATIONS)
                row["solutions"] = [_flat(b, len(sizes)) for b in population]
                row["arrivals"] = []
                yield pa.RecordBatch.from_pylist([row], batch.schema)

    return state.mapInArrow(run, _STATE)


def _migrate(state: DataFrame, islands: int) -> DataFrame:
    """Send every island's best solution on to the next island of its problem."""
    elite = state.select(
        "problem", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("solutions", 1, 1).alias("come")
    )
    return state.drop("arrivals").join(elite, ["problem", "island"]).withColumnRenamed("come", "arrivals")


def solve(
    items: DataFrame, length: int = LENGTH, problem: int = PROBLEM, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 7
) -> DataFrame:
    """(item, sequence_id, offset) for items (item, size) shorter than ``length``.

    ``item`` is unique. Problems hold about ``problem`` items each, dealt by hash, so far
    fewer than the 2^20 sequences of which a problem's numbers have room.
    """
    stored, total = save_counted(items.select("item", "size"), "items")
    problems = max(1, math.ceil(total / problem))
    dealt = stored.withColumn("problem", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(problems)))
    groups = dealt.groupBy("problem").agg(F.sort_array(F.collect_list(F.struct("item", "size"))).alias("items"))
    groups = save(groups, "problems")
    state = groups.select(
        "problem",
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.col("items.size").cast("array<int>").alias("sizes"),
        F.lit(None).cast("array<array<int>>").alias("solutions"),
        F.lit(None).cast("array<array<int>>").alias("arrivals"),
    )
    for epoch in range(epochs):
        tasks = state.repartition(min(math.ceil(problems * islands / ISLANDS_A_TASK), 20_000), "problem", "island")
        state = save(_epoch(tasks, epoch, length, seed), f"islands-{epoch}")
        if epoch + 1 < epochs:
            state = _migrate(state, islands)
    bins = F.array_max(F.col("solutions")[0])
    best = state.groupBy("problem").agg(F.min_by(F.col("solutions")[0], F.struct(bins, "island")).alias("bins"))
    placed = groups.join(best, "problem").select(
        "problem", F.inline(F.arrays_zip(F.col("items.item").alias("item"), F.col("items.size").alias("size"), "bins"))
    )
    before = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "item", "size", (F.col("problem") * (1 << 20) + F.col("bins")).alias("sequence_id")
    ).select("item", "sequence_id", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("offset"))


def pack(
    docs: DataFrame,
    length: int = LENGTH,
    separator: int = SEPARATOR,
    vocabulary: str = VOCABULARY,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 [, ids], sequence_id, offset), one row per piece."""
    parts = save(pieces(docs, length, separator, vocabulary, with_ids), "pieces")
    short = solve(parts.where(F.col("length") < length).select(F.col("row").alias("item"), F.col("length").alias("size")), length)
    columns = [c for c in parts.columns if c != "row"]
    full = parts.where(F.col("length") == length).select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = parts.where(F.col("length") < length).join(short.withColumnRenamed("item", "row"), "row")
    return full.unionByName(rest.select(*full.columns))
