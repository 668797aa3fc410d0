"""Whitening against numpy's eigenvectors of the whole covariance."""

import math

import numpy as np

from strata.llm import whitening


def _table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, `whitened.x` string")


def _expected(vectors, k=4):
    x = np.unique(np.floor(256 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64), axis=0)
    values, vectors_ = np.linalg.eigh(np.cov(x.T.astype(float), bias=True).reshape(x.shape[1], -1))
    return x, values[::-1][:k], vectors_[:, ::-1][:, :k]


def test_against_numpy(spark):
    draw = np.random.default_rng(1)
    for d, spread in ((48, np.linspace(3, 1, 48)), (6, [5, 3, 2, 1, 1, 1]), (3, [2, 1, 0.5]), (1, [1])):
        vectors = (draw.standard_normal((300, d)) * spread).tolist()
        rows = [(i, v, 0, "") for i, v in enumerate(vectors)]
        rows += [(1000, None, 0, ""), (1001, [None] * d, 0, ""), (1002, [math.nan] * d, 0, ""), (1003, [math.inf] * d, 0, "")]
        rows += [(2, vectors[2], 0, ""), (None, vectors[3], 0, "")] + [(5000 + i, vectors[4], 0, "") for i in range(150)]
        x, values, axes = _expected(vectors)
        k, n = min(4, d), len(x)
        got = whitening.whiten(_table(spark, rows)).collect()
        kept = [r for r in rows if r[0] not in (1000, 1001, 1002, 1003)]
        assert len(got) == len(kept) * k and {r.component for r in got} == set(range(1, k + 1))
        trace = ((x - x.mean(axis=0)) ** 2).sum() / n
        by_id = {(r.vec_id, r.component): r for r in got}
        signs = None
        for i, v, *_ in kept[:40] + kept[-3:]:
            xi = np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)
            white = (xi - x.sum(axis=0) / n) @ axes / np.sqrt(values)
            mine = np.array([by_id[i, c].whitened for c in range(1, k + 1)])
            signs = np.sign(white * mine) if signs is None else signs
            assert np.allclose(mine, signs * white, atol=1e-8)
            assert by_id[i, 1].deviation == int(((n * xi.astype(object) - x.sum(axis=0).astype(object)) ** 2).sum())
        for c in range(1, k + 1):
            assert abs(by_id[0, c].explained - values[c - 1] / trace) < 1e-10 and by_id[0, c].n == n
        assert got[0].identity_error < 1e-9


def test_a_flat_spectrum(spark):
    """Equal eigenvalues: any basis whitens."""
    rows = [(2 * i + s, [float(s * 2 - 1 if j == i else 0) for j in range(40)], 0, "") for i in range(40) for s in (0, 1)]
    got = whitening.whiten(_table(spark, rows)).collect()
    assert len(got) == 320 and got[0].identity_error < 1e-8


def test_rank_lengths_and_empty(spark):
    assert whitening.whiten(_table(spark, [])).collect() == []
    assert whitening.whiten(_table(spark, [(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, ""), (3, [], 0, "")])).collect() == []
    # Two vectors span one direction; the longer vectors are whitened apart.
    rows = [(1, [0.0, 0.0], 0, ""), (2, [1.0, 1.0], 0, ""), (3, [0.0, 0.0, 0.0], 0, ""), (4, [0.0, 2.0, 0.0], 0, "")]
    got = whitening.whiten(_table(spark, rows)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in got) == [
        (1, 1, 2, 2 * 256**2), (2, 1, 2, 2 * 256**2), (3, 1, 2, 512**2), (4, 1, 2, 512**2)
    ]
    assert all(abs(abs(r.whitened) - 1) < 1e-9 and abs(r.explained - 1) < 1e-9 for r in got)


def test_entries_beyond_a_long(spark):
    table = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(table).collect()
    assert {r.deviation for r in got} == {(1 << 63) - 1} and len(got) == 2


def test_chebyshev_grows_only_the_wanted_part():
    values = np.array([10.0, 4.0, 1.0, 0.5, 0.0])
    times = lambda b: values[:, None] * b
    start = np.ones((5, 1))
    got = whitening.chebyshev(times, start, times(start), 6, 0.0, 1.0, 10.0)[:, 0]
    t = np.polynomial.chebyshev.Chebyshev([0] * 6 + [1])
    assert np.allclose(got, t(2 * values - 1) / t(19.0))
