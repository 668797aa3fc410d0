"""Exact top-k search by distributed histogram selection.

Queries are answered in blocks of a fixed number of vectors. Every task scores the whole
block against its candidates and reports, for each query, a histogram of the scores within
the query's current interval; the sum of the histograms tells which bin holds the k-th
best score, and the next round divides that bin, until little more than k scores lie at or
above its lower end. A last round gives out just these scores.

Nothing that is sent grows with the number of candidates a task holds: of a histogram only
the bins from the task's own k-th best score up can matter, so at most k of them are sent,
and of a crowd of equal scores at the threshold a task gives out its k least ids. Scores are
integers, so intervals end at width one, and ties are broken by id, exactly.

Defined results: vectors that are null, empty or hold a null or non-finite component take
no part, nor do rows without an id; vectors of another length than the query's are no
candidates for it; equal rows of one id are one query but several candidates; a query never
finds rows of its own id; an empty table gives an empty result; other columns take no part.
A score beyond a long is given as the nearest long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.session import save, save_counted

K, SCALE = 5, 256
BLOCK, BINS, SLACK = 1024, 1024, 4
_ROWS = 2048
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


@dataclass
class Block:
    """A block of queries of one length, with the score interval in which each one's k-th best lies."""

    number: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    width: np.ndarray

    def bins_of(self) -> np.ndarray:
        """The width of every query's bins, a whole number."""
        return np.maximum(1, -(-self.width // BINS))


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector) of the rows that take part, components as doubles."""
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector")
    )
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))
    return rows.where(F.col("id").isNotNull() & (F.size("vector") > 0) & fine)


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), as doubles (exact)."""
    return np.floor(values * scale)


def scores_of(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact, as 64-bit integers."""
    if not len(candidates):
        return np.zeros((len(queries), 0), np.int64)
    bound = np.abs(queries).sum(axis=1).max() * np.abs(candidates).max()
    if bound < _EXACT:
        return (queries @ candidates.T).astype(np.int64)
    exact = np.frompyfunc(int, 1, 1)
    found = exact(queries) @ exact(candidates).T
    return np.clip(found, -_LONG - 1, _LONG).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], scale: float, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the candidates of the given length, some thousand at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            lists = part.column("vector")
            fits = np.asarray(lists.value_lengths()) == length
            if fits.any():
                rows = part.filter(pa.array(fits))
                flat = rows.column("vector").flatten().to_numpy(zero_copy_only=False)
                yield rows.column("id").to_numpy(), whole(flat.reshape(-1, length), scale)


def _scored(block: Block, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, whether the candidate has another id than the query)."""
    return scores_of(block.vectors, vectors), block.ids[:, None] != ids[None, :]


def _histograms(candidates: DataFrame, block: Block, k: int, scale: float) -> DataFrame:
    """(query, bin, n): scores by bin; scores above a query's interval count in bin BINS."""
    length, step = block.vectors.shape[1], block.bins_of()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(block.ids), BINS + 1), np.int64)
        for ids, vectors in _chunks(batches, scale, length):
            scores, others = _scored(block, ids, vectors)
            inside = others & (scores >= block.low[:, None])
            query, at = np.nonzero(inside)
            bins = np.minimum((scores[query, at] - block.low[query]) // step[query], BINS)
            total += np.bincount(query * (BINS + 1) + bins, minlength=total.size).reshape(total.shape)
        above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total
        query, bins = np.nonzero((total > 0) & (above < k))
        columns = [block.number[query], bins, total[query, bins]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "bin", "n"])

    return candidates.mapInArrow(count, "query long, bin long, n long")


def _winners(candidates: DataFrame, block: Block, k: int, scale: float) -> DataFrame:
    """(query, query_id, vec_id, score): of every task, the k best at or above the threshold."""
    length = block.vectors.shape[1]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def best(columns: list[np.ndarray]) -> list[np.ndarray]:
            query, ids, scores = columns
            order = np.lexsort((ids, -1 - scores, query))
            query, ids, scores = query[order], ids[order], scores[order]
            first = np.searchsorted(query, query)
            keep = np.arange(len(query)) - first < k
            return [query[keep], ids[keep], scores[keep]]

        for ids, vectors in _chunks(batches, scale, length):
            scores, others = _scored(block, ids, vectors)
            query, at = np.nonzero(others & (scores >= block.low[:, None]))
            held = best([np.append(a, b) for a, b in zip(held, (query, ids[at], scores[query, at]))])
        query, ids, scores = held
        columns = [block.number[query], block.ids[query], ids, scores]
        names = ["query", "query_id", "vec_id", "score"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return candidates.mapInArrow(find, "query long, query_id long, vec_id long, score long")


def _narrow(block: Block, found: list[tuple[int, int, int]], k: int) -> np.ndarray:
    """Move every query's interval to the bin of its k-th best; which queries are still wide."""
    total = np.zeros((len(block.ids), BINS + 1), np.int64)
    place = {n: i for i, n in enumerate(block.number.tolist())}
    for query, at, n in found:
        total[place[query], at] = n
    upto = np.cumsum(total[:, ::-1], axis=1)[:, ::-1]  # scores in a bin or above it
    enough = upto >= k
    step = block.bins_of()
    # The highest bin from which on there are k; the lowest if there are fewer than k at all.
    at = np.where(enough.any(axis=1), BINS - np.argmax(enough[:, ::-1], axis=1), 0)
    crowd = upto[np.arange(len(at)), at]
    done = (at == BINS) | (~enough.any(axis=1)) | (crowd <= SLACK * k) | (step == 1)
    block.low = block.low + np.minimum(at, BINS) * step
    block.width = np.where(done, 1, step)
    return ~done


def _answers(candidates: DataFrame, block: Block, largest: float, k: int, scale: float) -> DataFrame:
    """The winners among all candidates for one block."""
    reach = np.minimum(np.abs(block.vectors).sum(axis=1) * largest, float(1 << 62))
    reach = reach.astype(np.int64) + 1
    block.low, block.width = -reach, 2 * reach + 1
    if reach.max() >= 1 << 61:
        block.low = np.full_like(reach, -_LONG - 1)  # scores may end at the limits of a long
        return _winners(candidates, block, k, scale)
    wide = np.ones(len(block.ids), bool)
    while wide.any():
        part = Block(*(x[wide] for x in (block.number, block.ids, block.vectors, block.low, block.width)))
        counted = _histograms(candidates, part, k, scale).groupBy("query", "bin").agg(F.sum("n").alias("n"))
        still = _narrow(part, [tuple(r) for r in counted.collect()], k)
        block.low[wide], block.width[wide] = part.low, part.width
        wide[np.flatnonzero(wide)] = still
    return _winners(candidates, block, k, scale)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    scale: float = SCALE,
    block_size: int = BLOCK,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query.

    ``is_query`` is a condition on ``id``. The driver holds one block of queries at a time.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    numbered = rows.where(is_query).distinct().withColumn("length", F.size("vector"))
    stored, n = save_counted(numbered.withColumn("query", F.monotonically_increasing_id()), "queries")
    blocks = max(1, math.ceil(n / block_size))
    stored = save(
        stored.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))).repartition("block").sortWithinPartitions("block"),
        "query-blocks",
    )
    # No rounded component is larger than this.
    sizes = F.transform("vector", lambda x: F.abs(x * scale) + 1)
    largest = rows.agg(F.max(F.array_max(sizes))).first()[0] if n else None
    if largest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    answers = None
    for number in range(blocks):
        held = stored.where(F.col("block") == number).orderBy("query").collect()
        for length in sorted({r["length"] for r in held}):
            own = [r for r in held if r["length"] == length]
            vectors_ = whole(np.array([r["vector"] for r in own], np.float64), scale)
            zero = np.zeros(len(own), np.int64)
            block = Block(np.array([r["query"] for r in own]), np.array([r["id"] for r in own]), vectors_, zero, zero)
            part = save(_answers(rows, block, largest, k, scale), "answers")
            answers = part if answers is None else answers.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    ranked = answers.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
