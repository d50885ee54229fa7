"""Whitening against numpy's eigenvectors of the whole covariance."""

import math

import numpy as np
import pytest

from auctionstream.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component int"


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, v, 1, "x", 7) for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def brute(vectors):
    """Per vector: x, deviation and whitened coordinates up to their signs; then explained."""
    xs = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(xs))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in xs]
    centred = np.array([[float((n * a - s)) / n for a, s in zip(x, sums)] for x in fit])
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:16], turn[:, ::-1][:, :16]
    own = np.array([[float(n * a - s) / n for a, s in zip(x, sums)] for x in xs])
    return n, deviation, own @ turn / np.sqrt(values), values / np.square(centred).sum() * n


def compare(rows, vectors, ids):
    n, deviation, coordinates, explained = brute(vectors)
    found = {(r.vec_id, r.component): r for r in rows}
    assert len(found) == len(rows) == len(vectors) * coordinates.shape[1]
    got = np.array([[found[i, k + 1].whitened for k in range(coordinates.shape[1])] for i in ids])
    sign = np.sign((got * coordinates).sum(axis=0))
    assert np.abs(got - coordinates * sign).max() < 1e-6
    for place, i in enumerate(ids):
        row = found[i, 1]
        assert (row.n, row.deviation) == (n, deviation[place]) and row.identity_error <= 1e-4
    for k, share in enumerate(explained):
        assert abs(found[ids[0], k + 1].explained / share - 1) < 1e-9


@pytest.mark.parametrize("dimensions, n", [(5, 40), (24, 200), (40, 300)])
def test_whiten_is_that_of_the_whole_covariance(spark, dimensions, n):
    rng = np.random.default_rng(dimensions)
    vectors = (rng.standard_normal((n, dimensions)) * np.linspace(3, 0.5, dimensions)).astype(np.float32).tolist()
    vectors += vectors[:1] * 50  # a group of copies counts once in the fit
    rows = whitening.whiten(table(spark, vectors)).collect()
    compare(rows, vectors, list(range(len(vectors))))


def test_query_on_the_whole_table(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    compare(queries.op13_whitening(spark, folder).collect(), [r.embedding for r in rows], [r.vec_id for r in rows])


def test_clustered_spectrum_grows_the_block(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((600, 48)) * 3).astype(np.float32).tolist()
    fit = whitening.stage(whitening.on_lattice(table(spark, vectors)).select("x").distinct(), "test-vectors")
    model = whitening.train(fit, degree=2)
    x = np.array([r.x for r in fit.collect()], float)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.abs(model.eigenvalues / values[:16] - 1).max() < 1e-10 and model.residual < 1e-10


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 0.5], [1.0, 2.0, 0.5], [0.0, -1.0, 3.0], [5.0, 4.0, -2.0], [2.5, 0.0, 1.0]]
    odd = [None, [1.0, None, 2.0], [nan, 1.0, 2.0], [1.0, inf, 2.0], [], [1.0], [-inf, 0.0, 0.0]]
    rows = whitening.whiten(table(spark, good + odd)).collect()
    assert {r.vec_id for r in rows} == {0, 1, 2, 3, 4} and {r.n for r in rows} == {4}
    compare(rows, good, list(range(5)))
    assert whitening.whiten(table(spark, odd[:4])).collect() == []
    assert whitening.whiten(table(spark, good).limit(0)).collect() == []
    assert whitening.whiten(table(spark, good[:2])).collect() == []  # no variance
    flat = [[float(i), 1.0, 2.0] for i in range(6)]  # one direction only
    assert {r.component for r in whitening.whiten(table(spark, flat)).collect()} == {1}
    unnamed = table(spark, good).selectExpr("CAST(NULL AS bigint) AS vec_id", "embedding")
    assert {r.vec_id for r in whitening.whiten(unnamed).collect()} == {None}


def test_large_values_stay_exact(spark):
    vectors = [[1e15, 0.0], [-1e15, 1.0], [0.0, 3.0e38]]
    rows = whitening.whiten(table(spark, vectors)).collect()
    assert {r.n for r in rows} == {3} and all(r.deviation is None for r in rows)
    x = np.array([[2**31, 7], [5, -9]], np.int64)
    exact = [sum((3 * int(a) - s) ** 2 for a, s in zip(row, (10, 20))) for row in x]
    assert whitening._deviations(x, 3, (10, 20)) == [None if v >= 2**63 else v for v in exact]
