import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import whitening

ROWS = "vec_id long, embedding array<double>, label int"


def plain(x):
    """Distinct integer vectors, eigenvalues falling, eigenvectors as columns."""
    fit = np.unique(x, axis=0)
    centred = fit - fit.sum(axis=0) / len(fit)
    values, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    return fit, values[::-1], axes[:, ::-1]


def check(rows, x, k=4):
    fit, values, axes = plain(x)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    assert len(rows) == k * len(x)
    for component in range(1, k + 1):
        mine = sorted((r for r in rows if r.component == component), key=lambda r: r.vec_id)
        want = (x - fit.sum(axis=0) / n) @ axes[:, component - 1] / np.sqrt(values[component - 1])
        got = np.array([r.whitened for r in mine])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
        assert mine[0].explained == pytest.approx(values[component - 1] / values.sum(), rel=1e-9)
        for r, row in zip(mine, x):
            assert r.n == n and r.deviation == sum((n * int(a) - s) ** 2 for a, s in zip(row, sums))
    assert {r.identity_error for r in rows}.pop() < 1e-9


@pytest.mark.parametrize("shape,seed", [((400, 16), 1), ((60, 64), 2), ((1000, 5), 3)])
def test_against_eigenvectors(spark, shape, seed):
    rng = np.random.default_rng(seed)
    x = np.floor(256 * rng.normal(size=shape) * np.linspace(1, 3, shape[1])).astype(np.int64)
    x[1::7] = x[0]  # repeats count once
    rows = [(i, [float(c) / 256 for c in v], 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    check(whitening.whiten(df).collect(), x)


def test_equal_eigenvalues(spark):
    # A cross: three equal eigenvalues, found only by going on from new directions.
    x = np.vstack([s * 256 * np.diag([2, 2, 2, 1, 1, 1]) for s in (1, -1)])
    rows = [(i, [float(c) / 256 for c in v], 0) for i, v in enumerate(x)]
    got = whitening.whiten(spark.createDataFrame(rows, ROWS), components=6).collect()
    assert len(got) == 72
    share = {r.component: r.explained for r in got}
    assert [share[c] for c in range(1, 7)] == pytest.approx([4 / 15] * 3 + [1 / 15] * 3)
    assert got[0].identity_error < 1e-12


def test_bidiagonal_vectors_stay_orthogonal(spark):
    rng = np.random.default_rng(8)
    # Deviations over ten orders of magnitude.
    x = np.floor(rng.normal(size=(500, 24)) * np.logspace(0, 9, 24)).astype(np.int64)
    fit = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>")
    matrix = whitening.Matrix(whitening._packed(fit, 24).cache(), 24, 500, [int(s) for s in x.sum(axis=0)])
    right, s = whitening.bidiagonalise(matrix)
    assert np.abs(right.T @ right - np.eye(24)).max() < 1e-12
    assert s == pytest.approx(np.linalg.svd(x - x.mean(axis=0))[1], rel=1e-6)


def test_more_dimensions_than_steps(spark):
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(size=(300, 40)) * np.logspace(1, -1, 40)).astype(np.int64)
    fit = spark.createDataFrame([(v.tolist(),) for v in np.unique(x, axis=0)], "x array<long>")
    n = len(np.unique(x, axis=0))
    sums = [int(s) for s in np.unique(x, axis=0).sum(axis=0)]
    matrix = whitening.Matrix(whitening._packed(fit, 40).cache(), 40, n, sums)
    right, s = whitening.bidiagonalise(matrix, 4, steps=8)
    _, values, axes = plain(x)
    assert right.shape[1] < 40
    assert s[:4] ** 2 / n == pytest.approx(values[:4], rel=1e-9)
    assert np.abs(np.abs((right[:, :4] * axes[:, :4]).sum(axis=0)) - 1).max() < 1e-9


def test_unusable_rows_few_directions_and_names(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0), (2, [2.0, 4.0], 0), (None, [3.0, 6.0], 0), (5, None, 0),
            (6, [None, 1.0], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [], 0), (10, [1.0], 0)]
    df = spark.createDataFrame(rows, ROWS)
    extra = df.withColumns({c: F.lit("x") for c in ("id", "x", "v", "n", "component", "d")})
    for table in (df, extra):
        got = whitening.whiten(table).collect()
        assert sorted(str(r.vec_id) for r in got) == ["1", "2", "2", "None"]
        assert {(r.component, r.n) for r in got} == {(1, 3)} and got[0].explained == pytest.approx(1)
    equal = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], ROWS)
    for empty in (equal, spark.createDataFrame([], ROWS), spark.createDataFrame([(1, [], 0)], ROWS)):
        none = whitening.whiten(empty)
        assert none.columns == df.select("vec_id").columns + [
            "component", "n", "deviation", "whitened", "explained", "identity_error"] and not none.count()


def test_a_deviation_beyond_a_long_is_null(spark):
    rows = [(1, [1e12, 0.0], 0), (2, [-1e12, 1.0], 0), (3, [0.0, 0.5], 0)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, ROWS)).collect()
           if r.component == 1}
    assert got == {1: None, 2: None, 3: 0}
