import numpy as np
import pytest
from helpers import empty

from cadenza.llm import catalog, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """x, n, S and the covariance's eigenvalues (falling) and vectors, by numpy alone."""
    x = np.floor(256 * np.array([list(r) for r in rows], np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    return x, len(fit), fit.sum(axis=0), values[::-1], vectors[:, ::-1]


def test_whitening_of_sf_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, n, s, values, vectors = plain([r.embedding for r in rows])
    got = {(r.vec_id, r.component): r for r in catalog.QUERIES["op12_whitening"](spark, sf_dir).collect()}
    assert len(got) == 4 * len(rows)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    for k in range(4):
        expected = (x - s / n) @ vectors[:, k] / np.sqrt(values[k])
        mine = np.array([got[r.vec_id, k + 1].whitened for r in rows])
        assert min(np.abs(mine - expected).max(), np.abs(mine + expected).max()) < 1e-9
        assert np.isclose(got[rows[0].vec_id, k + 1].explained, values[k] / values.sum(), rtol=1e-10)
    assert [got[r.vec_id, 1].deviation for r in rows] == deviation.tolist()
    assert {r.n for r in got.values()} == {n} and {r.identity_error for r in got.values()}.pop() < 1e-9


@pytest.mark.parametrize("size", [1, 2, 7, 20])
def test_jacobi(size):
    rng = np.random.default_rng(size)
    a = rng.normal(size=(size, size))
    a = a @ a.T
    values, vectors = whitening.jacobi(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1]) and np.allclose(vectors.T @ vectors, np.eye(size))
    assert np.allclose(vectors * values @ vectors.T, a)


def test_small_eigenvalues_are_accurate():
    """A graded matrix, whose eigenvalues span 24 decimal orders: those of its 2 x 2 blocks, to double precision."""
    from fractions import Fraction

    a = np.zeros((6, 6))
    for i, scale in enumerate((1.0, 1e-12, 1e-24)):
        a[2 * i : 2 * i + 2, 2 * i : 2 * i + 2] = scale * np.array([[2.0, 1.0], [1.0, 2.0]])
    values, _ = whitening.jacobi(a)
    assert np.allclose(values / np.array([3, 1, 3e-12, 1e-12, 3e-24, 1e-24]), 1, rtol=1e-14)
    d = np.diag([1e8, 1.0, 1e-8])
    m = np.array([[2.0, 0.5, 0.25], [0.5, 2.0, 0.5], [0.25, 0.5, 2.0]])
    least = whitening.jacobi(d @ m @ d)[0][-1]  # its product with the others is the determinant, exactly
    f = [[Fraction(float(x)) for x in row] for row in m]
    det = sum(f[0][i] * (f[1][(i + 1) % 3] * f[2][(i + 2) % 3] - f[1][(i + 2) % 3] * f[2][(i + 1) % 3]) for i in range(3))
    minor = f[0][0] * f[1][1] - f[0][1] * f[1][0]
    assert np.isclose(least, float(det / minor) * 1e-16, rtol=1e-10)


def test_odd_vectors(spark):
    good = [[0.1, -0.2, 0.3], [1.0, 0.5, -0.5], [0.25, 0.25, 0.9], [-1.0, 0.0, 0.1], [0.3, -0.9, 0.2]]
    rows = [(i, v, 0) for i, v in enumerate(good)] + [(0, good[0], 0)] * 20
    rows += [(90, None, 0), (91, [0.1, None, 0.2], 0), (92, [0.1, float("nan"), 0.2], 0), (93, [float("inf"), 0.0, 0.0], 0), (None, good[1], 1), (94, [0.5], 0), (95, [0.5, 0.0, 0.0], 1), (96, [], 0)]
    table = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as x", "2 as n", "3 as component")
    out = whitening.whiten(table).collect()
    x, n, s, values, vectors = plain([*good, [0.5, 0, 0], [0, 0, 0]])
    assert len(out) == 3 * (5 + 20 + 4) and {r.n for r in out} == {7} == {n}
    by = {(r.vec_id, r.component): r for r in out}
    assert by[94, 1][2:] == by[95, 1][2:] and by[None, 2][2:] == by[1, 2][2:]
    assert [by[i, 1].deviation for i in range(5)] == ((n * x - s) ** 2).sum(axis=1)[:5].tolist()
    assert np.allclose([abs(by[0, k + 1].whitened) for k in range(3)], np.abs((x[0] - s / n) @ vectors / np.sqrt(values)))
    assert out[0].identity_error < 1e-9


def test_without_variance(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5], 0)] * 3, VECTORS)).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, 0.0, 0.0)}
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0, -float(i)], 0) for i in range(5)], VECTORS)).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1}
    assert whitening.whiten(empty(spark, VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [], 0)], VECTORS)).count() == 0


def test_large_entries_are_exact(spark):
    rows = [(1, [1e30, 0.0], 0), (2, [-1e30, 1.0], 0), (3, [2.0**40, 2.0], 0)]
    out = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).where("component = 1").collect()}
    assert all(r.deviation is None for r in out.values()) and len(out) == 3
    x = np.array([[1 << 53, 0], [-(1 << 53), 256], [256 << 40, 512]], object)
    assert whitening.deviations(np.array([[5, -3]]), 2, (1 << 31, 0)).to_pylist() == [(10 - (1 << 31)) ** 2 + 36]
    fit = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>")
    assert whitening.sums(fit) == (3, [int(c) for c in x.sum(axis=0)])
