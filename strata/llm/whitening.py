"""Embedding whitening by Chebyshev-filtered subspace iteration.

A vector's components c become whole numbers x = floor(scale * c). The fit list holds every
distinct x once; n is its length, S its sum by dimension, V its covariance (divisor n). V is
never built: a pass over the fit list gives V Q for a block Q of a few vectors, from the
centred rows (n x - S) / n. Every task sends one row of sums per dimension.

A round applies a Chebyshev polynomial in V to the block by its three-term recurrence, one
pass a degree. The polynomial is small on the unwanted part of the spectrum, from a lower
bound that a Lanczos recurrence finds in the passes of the first round up to the block's
least Ritz value, and grows fast above it. Then QR and Rayleigh-Ritz; converged leading
vectors are locked, and their directions are kept out of the block from then on. The last
two vectors of the block are drawn anew every round, so that a direction which the first
block lacked can still come in. Rounds go on until the residuals of the wanted vectors are
at rounding level; a block that stops gaining is doubled, at the dimension's size it is
exact.

The driver holds the block and the recurrence: a few numbers per dimension.

Defined results: rows whose vector is null or holds a null or non-finite entry are left out;
rows without an id stay, and so do repeated rows (which count once in the fit list). Empty
vectors have no components, so no rows. Vectors of different lengths are whitened apart, each
length by its own fit list. Components beyond the rank of V are not returned: a fit list of
one vector gives no rows, an empty table gives an empty result. Entries whose x is beyond a
long, and deviations beyond a long, are given as the nearest long. Other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.tables import slices
from strata.session import save_counted

K, SCALE, SEED = 4, 256, 13
GUARD, DEGREE, FRESH = 28, 10, 2
ROUNDING = 4e-15  # times the root of the dimension and the largest eigenvalue
GROWTH = 1e8  # what a round may multiply the largest unlocked direction by
_LONG = (1 << 63) - 1
_EXACT = 1 << 62


@dataclass
class Whitening:
    """n, S and trace of the fit list; leading eigenvalues and unit eigenvectors (columns)."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    passes: int
    identity_error: float = 0.0


def whole_numbers(rows: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(vec_id, x): the rows that take part, x = floor(scale * c) as longs."""
    vector = F.col(vector_column).cast("array<double>")
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != math.inf))
    x = F.transform(vector, lambda c: F.floor(c * scale))  # saturates at the limits of a long
    return rows.where(vector.isNotNull() & fine).select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x"))


def _centred(batch: pa.RecordBatch, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n x - S of a batch's rows, exact, and the same by n as doubles."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(sums))
    largest = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if n * largest + max(abs(s) for s in sums.tolist()) >= _EXACT:
        x, sums = x.astype(object), sums.astype(object)
    moved = x * n - sums
    return moved, (moved / n).astype(np.float64)


class Passes:
    """Passes over a fit list of vectors of one length."""

    def __init__(self, fit: DataFrame, length: int):
        self.fit, self.length, self.made = fit, length, 0
        self.n, self.sums, self.trace = 0, np.zeros(length, object), 0.0

    def _sum(self, width: int, f) -> np.ndarray:
        """Sum over the fit list of ``f(batch)``, an array with ``width`` columns."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in slices(batches, "x"):
                if batch.num_rows:
                    part = f(batch)
                    total = part if total is None else total + part
            if total is not None:
                i, j = np.indices(total.shape)
                columns = [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["i", "j", "y"])

        self.made += 1
        parts = self.fit.mapInArrow(run, "i int, j int, y double")
        found = parts.groupBy("i", "j").agg(F.sum("y").alias("y")).toArrow()
        at = [found.column(c).to_numpy() for c in ("i", "j", "y")]
        out = np.zeros((at[0].max() + 1 if len(at[0]) else 0, width))
        out[at[0], at[1]] = at[2]
        return out

    def measure(self) -> None:
        """n, S and the trace of V."""
        at = F.posexplode("x").alias("i", "c")
        whole = F.sum(F.col("c").cast("decimal(38,0)"))
        found = self.fit.select(at).groupBy("i").agg(F.count(F.lit(1)), whole).collect()
        for i, n, total in found:
            self.n, self.sums[i] = n, int(total)
        if max((abs(s) for s in self.sums.tolist()), default=0) < _EXACT:
            self.sums = self.sums.astype(np.int64)
        n, sums = self.n, self.sums
        self.trace = float(self._sum(1, lambda b: (_centred(b, n, sums)[1] ** 2).sum(axis=0)[:, None]).sum() / n)

    def times(self, block: np.ndarray) -> np.ndarray:
        """V times a block of columns."""
        n, sums = self.n, self.sums

        def f(batch: pa.RecordBatch) -> np.ndarray:
            centred = _centred(batch, n, sums)[1]
            return centred.T @ (centred @ block)

        return self._sum(block.shape[1], f) / n

    def identity_error(self, vectors: np.ndarray, values: np.ndarray) -> float:
        """Largest absolute entry of the whitened fit list's covariance minus the identity."""
        n, sums, k = self.n, self.sums, len(values)

        def f(batch: pa.RecordBatch) -> np.ndarray:
            white = _centred(batch, n, sums)[1] @ vectors / np.sqrt(values)
            return np.vstack([white.T @ white, white.sum(axis=0)])

        total = self._sum(k, f) / n
        mean = total[k]
        return float(np.abs(total[:k] - np.outer(mean, mean) - np.eye(k)).max())


class _Lanczos:
    """A Lanczos recurrence that rides along with the block's passes."""

    def __init__(self, start: np.ndarray):
        self.basis, self.alpha, self.beta = [start / np.linalg.norm(start)], [], []

    def step(self, product: np.ndarray) -> bool:
        self.alpha.append(float(self.basis[-1] @ product))
        rest = product
        for _ in range(2):
            for b in self.basis:
                rest = rest - b * (b @ rest)
        self.beta.append(float(np.linalg.norm(rest)))
        if self.beta[-1] <= 1e-12 * max(1.0, abs(self.alpha[0])):
            return False
        self.basis.append(rest / self.beta[-1])
        return True

    def lower(self) -> float:
        """A lower bound of the spectrum: the least Ritz value less its residual."""
        t = np.diag(self.alpha) + np.diag(self.beta[:-1], 1) + np.diag(self.beta[:-1], -1)
        values, vectors = np.linalg.eigh(t)
        return max(0.0, float(values[0] - abs(self.beta[-1] * vectors[-1, 0])))


def _orthonormal(block: np.ndarray, locked: np.ndarray) -> np.ndarray:
    for _ in range(2):
        block = np.linalg.qr(block - locked @ (locked.T @ block))[0]
    return block


def chebyshev(times, block: np.ndarray, product: np.ndarray, degree: int, low: float, cut: float, top: float) -> np.ndarray:
    """The block under the polynomial that is small on [low, cut] and one at ``top``; ``product`` is V block."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    first = half / (top - middle)
    scale, before, now = first, block, (product - middle * block) * (first / half)
    for _ in range(1, degree):
        following = 1 / (2 / first - scale)
        before, now = now, (times(now) - middle * now) * (2 * following / half) - scale * following * before
        scale = following
    return now


def leading(passes: Passes, k: int = K, seed: int = SEED) -> Whitening:
    """The ``k`` leading eigenpairs of V (as many as its rank, if lower)."""
    d, draw = passes.length, np.random.default_rng(seed)
    k = min(k, d)
    size = min(d, k + GUARD)
    locked, locked_values = np.zeros((d, 0)), []
    lanczos, low = _Lanczos(draw.standard_normal(d)), None
    growing = True

    def times(block: np.ndarray) -> np.ndarray:
        nonlocal growing
        if low is not None or not growing:
            return passes.times(block)
        both = passes.times(np.column_stack([block, lanczos.basis[-1]]))
        growing = lanczos.step(both[:, -1])
        return both[:, :-1]

    block = _orthonormal(draw.standard_normal((d, size)), locked)
    best, stalled, worst = math.inf, 0, 0.0
    tolerance = ROUNDING * math.sqrt(d)
    while True:
        product = times(block)
        values, turn = np.linalg.eigh((block.T @ product + product.T @ block) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        largest = max([*locked_values, float(values[0])])
        if largest <= 0 or largest <= d * np.finfo(float).eps * passes.trace:
            break
        rest = product - block * values
        rest -= locked @ (locked.T @ rest)
        residuals = np.linalg.norm(rest, axis=0) / largest
        exact = locked.shape[1] + block.shape[1] >= d
        done, worst = 0, float(residuals[: k - len(locked_values)].max())
        stalled = stalled + 1 if worst > best / 2 else 0
        best = min(best, worst)
        # A block that has stopped gaining just above rounding level is as good as doubles give.
        enough = 16 * tolerance if stalled >= 3 or exact else tolerance
        while len(locked_values) + done < k and residuals[done] <= enough:
            done += 1
        if done:
            locked = np.column_stack([locked, block[:, :done]])
            locked_values += values[:done].tolist()
            block, product, values = block[:, done:], product[:, done:], values[done:]
            best, stalled = math.inf, 0
        if len(locked_values) == k:
            break
        room = d - locked.shape[1]
        if exact:
            block = _orthonormal(draw.standard_normal((d, room)), locked)
            continue
        if stalled >= 6:
            size, best, stalled = min(d, 2 * size), math.inf, 0
        if low is None and len(lanczos.alpha) > 1 and (not growing or len(lanczos.alpha) > DEGREE):
            low = lanczos.lower()
        top, cut = float(values[0]), float(values[-1])
        bottom = min(low or 0.0, cut * (1 - 1e-6))
        if top > cut * (1 + 1e-12) and cut > 0:
            steep = math.acosh(max(1 + 1e-12, (2 * top - cut - bottom) / (cut - bottom)))
            degree = int(min(DEGREE, max(2, math.log(GROWTH) // steep)))
            block = chebyshev(times, block, product, degree, bottom, cut, top)
        fresh = draw.standard_normal((d, max(0, min(size, room) - block.shape[1])))
        if block.shape[1] + fresh.shape[1] > FRESH + k:
            block[:, -FRESH:] = draw.standard_normal((d, FRESH)) if fresh.shape[1] == 0 else block[:, -FRESH:]
        block = _orthonormal(np.column_stack([block / np.linalg.norm(block, axis=0), fresh]), locked)
    values = np.array(locked_values)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], locked[:, order]
    real = values > d * np.finfo(float).eps * max(passes.trace, 0.0)
    values, vectors = values[real], vectors[:, real]
    at = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[at, np.arange(len(values))])
    return Whitening(passes.n, passes.sums, passes.trace, values, vectors, worst, passes.made)


def fit(vectors: DataFrame, length: int, k: int = K) -> Whitening:
    """The whitening of stored (vec_id, x) rows of one length, fitted on their distinct vectors."""
    distinct, _ = save_counted(vectors.select("x").distinct(), "fit")
    passes = Passes(distinct, length)
    passes.measure()
    found = leading(passes, k)
    if len(found.values):
        found.identity_error = passes.identity_error(found.vectors, found.values)
    found.passes = passes.made
    return found


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """One row per row of ``vectors`` and component."""
    k = len(model.values)
    names = _SCHEMA.replace(",", "").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x"):
            if not batch.num_rows or not k:
                continue
            moved, centred = _centred(batch, model.n, model.sums)
            largest = max(abs(int(moved.max())), abs(int(moved.min())))
            whole = moved if largest**2 * moved.shape[1] < _EXACT else moved.astype(object)
            deviation = [min(_LONG, int(x)) for x in (whole * whole).sum(axis=1)]
            white = centred @ model.vectors / np.sqrt(model.values)
            rows, m = len(white), len(white) * k
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    pa.array(np.full(m, model.n), pa.int64()),
                    pa.array(np.repeat(np.array(deviation, np.int64), k), pa.int64()),
                    pa.array(white.ravel()),
                    pa.array(np.tile(model.values / model.trace, rows)),
                    pa.array(np.full(m, model.identity_error)),
                ],
                names,
            )

    return vectors.mapInArrow(run, _SCHEMA)


def whiten(
    rows: DataFrame, k: int = K, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), ``k`` components a row."""
    spark = rows.sparkSession
    taken, _ = save_counted(whole_numbers(rows, id_column, vector_column, scale), "whole")
    done = None
    for (length,) in taken.select(F.size("x").alias("length")).distinct().orderBy("length").collect():
        if length > 0:
            own = taken.where(F.size("x") == length)
            part = transform(own, fit(own, length, k))
            done = part if done is None else done.unionByName(part)
    return spark.createDataFrame([], _SCHEMA) if done is None else done
