"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of their centred matrix.

Components become integers, ``floor(256 * x)``; the fit sees each distinct vector once and
is centred by exact sums. One pass over the rows per step makes both distributed products:
``u = X v - b u'`` and ``X' u``. The left vectors are as long as the table; none is stored.
Each is ``X w`` for a short ``w``, so a pass makes those it needs again from its own rows,
and full reorthogonalisation on the left needs only their products with the new vector,
which come from the same pass. The right vectors are reorthogonalised on the driver. The
singular vectors of the small bidiagonal matrix give the components, its singular values
the deviations along them.

All steps are made, as many as there are dimensions up to ``STEPS``, because equal
eigenvalues show up only when the space is exhausted; a step without a remainder goes on
from a new direction. Beyond ``STEPS`` it stops as soon as the components wanted have a
remainder of rounding size.

The rows of the fit are written once, packed into binary blocks; a pass sends one short
vector per task to the driver, added up in the order of the tasks.

Edge cases: vectors that are null or hold null or non-finite entries are dropped; of the
others only those of the most common length take part (of the shorter on a tie); empty
vectors and an empty table give no rows. Only components along which the fit varies exist:
k distinct vectors have at most k - 1, and a table of equal vectors gives no rows. A
deviation beyond a long is null. A null id is kept, repeated rows count once in the fit
and are all returned; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.scale import materialise
from .impact import quantised, whole

COMPONENTS = 4
SCALE = 256
STEPS = 256
PACK_ROWS = 4096
# A direction with less than this share of the largest deviation is rounding.
ROUNDING = 1e-12


def _packed(fit: DataFrame, d: int) -> DataFrame:
    """Rows of the fit as binary blocks of little-endian longs."""
    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, PACK_ROWS):
                x = batch.column(0).slice(a, PACK_ROWS).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.astype("<i8").tobytes()], pa.binary())], names=["rows"])
    return fit.mapInArrow(pack, "rows binary")


class Matrix:
    """The centred fit: products with it are passes over the packed rows."""

    def __init__(self, packed: DataFrame, d: int, n: int, sums: list[int]):
        self.packed, self.d, self.n, self.sums = packed, d, n, sums
        # The quotient of the exact sums, correctly rounded.
        self.mean = np.array([s / n for s in sums])

    def over_rows(self, f, width: int) -> np.ndarray:
        """Sum over all blocks of ``f(block of centred rows)``, an array of ``width`` doubles."""
        d, mean = self.d, self.mean

        def work(batches):
            total = np.zeros(width)
            for batch in batches:
                for rows in batch.column(0):
                    x = np.frombuffer(rows.as_py(), "<i8").reshape(-1, d)
                    total = total + f(x - mean)
            from pyspark import TaskContext
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()),
                 pa.array([total.tolist()], pa.list_(pa.float64()))], names=["task", "total"])

        parts = self.packed.mapInArrow(work, "task int, total array<double>").collect()
        return sum((np.array(p["total"]) for p in sorted(parts, key=lambda p: p["task"])),
                   np.zeros(width))

    def step(self, v: np.ndarray, beta: float, before: np.ndarray, left: np.ndarray):
        """``u = X v - beta X before``: its ``X'u``, products with ``X left`` and square."""
        d = self.d
        w = v - beta * before

        def block(x):
            u = x @ w
            return np.concatenate([x.T @ u, (x @ left).T @ u, [u @ u]])

        out = self.over_rows(block, d + left.shape[1] + 1)
        return out[:d], out[d:-1], out[-1]


def bidiagonalise(matrix: Matrix, wanted: int = COMPONENTS, steps: int = STEPS):
    """Right singular vectors (columns) and singular values, the largest first."""
    d = matrix.d
    random = np.random.default_rng(2027)
    right = np.zeros((d, 0))  # v
    left = np.zeros((d, 0))  # w with u = X w
    images = np.zeros((d, 0))  # X'u
    alphas, betas = [], []

    def fresh(v):
        for _ in range(2):
            v = v - right @ (right.T @ v)
        return v

    v, beta, before = random.normal(size=d), 0.0, np.zeros(d)
    v /= np.linalg.norm(v)
    largest = 0.0
    while True:
        image, overlap, square = matrix.step(v, beta, before, left)
        w = v - beta * before - left @ overlap
        image = image - images @ overlap
        alpha = float(np.sqrt(max(square - overlap @ overlap, 0.0)))
        largest = max(largest, alpha)
        right = np.column_stack([right, v])
        if alpha <= ROUNDING * largest or not alpha:
            alpha = 0.0
            w, image = np.zeros(d), np.zeros(d)
        else:
            w, image = w / alpha, image / alpha
        alphas.append(alpha)
        left = np.column_stack([left, w])
        images = np.column_stack([images, image])
        if right.shape[1] == d:
            break
        rest = fresh(image - alpha * v)
        beta = float(np.linalg.norm(rest))
        if beta <= ROUNDING * max(largest, beta) or not alpha:
            # This part of the space is exhausted: go on from a new direction.
            rest, beta = fresh(random.normal(size=d)), 0.0
        elif len(alphas) >= steps:
            p = np.linalg.svd(_bidiagonal(alphas, betas))[0][:, :wanted]
            if (beta * np.abs(p[-1]) <= ROUNDING * largest).all():
                break
        v, before = fresh(rest / np.linalg.norm(rest)), w
        v /= np.linalg.norm(v)
        betas.append(beta)
    _, s, inner = np.linalg.svd(_bidiagonal(alphas, betas))
    return right @ inner.T, s


def _bidiagonal(alphas, betas) -> np.ndarray:
    return np.diag(alphas) + np.diag(betas[:len(alphas) - 1], 1)


def whiten(df: DataFrame, components: int = COMPONENTS, key: str = "vec_id",
           vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """A row for each usable vector and component; see the module for what they hold."""
    shape = (f"{key} {df.schema[key].dataType.simpleString()}, component int, n long, deviation long, "
             "whitened double, explained double, identity_error double")
    found = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(whole(F.col("v"))).select(
        "id", quantised(F.col("v"), scale).alias("x"))
    rows = materialise(found.filter(F.size("x") > 0), "whitening_rows")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return df.sparkSession.createDataFrame([], shape)
    d = common["d"]
    rows = rows.filter(F.size("x") == d)
    fit = materialise(rows.select("x").distinct(), "whitening_fit")
    # Sums as decimals: exact whatever the number of rows.
    total = fit.agg(F.count("*").alias("n"), *[
        F.sum(F.col("x")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(d)]).first()
    n, sums = total["n"], [int(total[f"s{i}"]) for i in range(d)]
    packed = materialise(_packed(fit, d), "whitening_packed")
    matrix = Matrix(packed, d, n, sums)
    axes, s = bidiagonalise(matrix, components)
    spread = matrix.over_rows(lambda x: np.array([(x * x).sum()]), 1)[0]
    keep = min(components, int((s > ROUNDING * s[0]).sum())) if s[0] > 0 else 0
    if not keep:
        return df.sparkSession.createDataFrame([], shape)
    axes, values = axes[:, :keep], s[:keep] ** 2 / n
    # The sign of a component is free; the largest entry is made positive, so reruns agree.
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(keep)])
    to_white = axes / np.sqrt(values)
    middle = matrix.over_rows(lambda x: (x @ to_white).sum(axis=0), keep) / n

    def outer(x):
        y = x @ to_white - middle
        return (y.T @ y).reshape(-1)

    covariance = matrix.over_rows(outer, keep * keep).reshape(keep, keep) / n
    error = float(np.abs(covariance - np.eye(keep)).max())
    explained, mean = values / (spread / n), matrix.mean
    far = np.array(sums, object)

    def deviations(x):
        reach = float(np.abs(x.astype(np.float64)).max(initial=0)) * n + max(map(abs, sums))
        if reach * reach * d < 2.0 ** 62:
            gap = x * n - far.astype(np.int64)
            return (gap * gap).sum(axis=1).tolist()
        exact = [sum((n * a - b) ** 2 for a, b in zip(row, sums)) for row in x.tolist()]
        return [e if e < 2 ** 63 else None for e in exact]

    def work(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)
            white = (x - mean) @ to_white
            m = len(x)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(m), keep))),
                pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), m)),
                pa.array(np.full(m * keep, n, np.int64)),
                pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), keep))),
                pa.array(white.reshape(-1)), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * keep, error))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(work, shape)
