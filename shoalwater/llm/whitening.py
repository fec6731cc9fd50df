"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

What grows with the rows runs on the cluster: distinct vectors, their exact sums, the scatter of centred
vectors (a matrix a task, added up in two levels) and the projection of every row. What reaches the driver is one matrix
of the vectors' dimension, which ``MAX_DIM`` bounds. There the matrix is factored as L L' with pivots and
the columns of L are rotated in pairs until they are orthogonal: their squared norms are the eigenvalues, and
the columns over their norms, with the pivots undone, the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pin, table

#: Fixed values of the integer form: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components returned, at most; the dimension that the driver's factorisation is meant for.
COMPONENTS, MAX_DIM = 16, 4096
#: Groups in which the tasks' matrices are added up first.
FANS = 32


# ------------------------------------------------------------------ the factorisation


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with A = L L', rows in A's order: columns by falling pivots, as many as A's numerical rank."""
    a = np.array(a, np.float64)
    d = len(a)
    factor, left, todo = np.zeros((d, d)), a.diagonal().copy(), np.arange(d)
    least = max(left.max(initial=0.0), 0.0) * d * np.finfo(np.float64).eps
    for k in range(d):
        p = todo[np.argmax(left[todo])]
        if left[p] <= least:
            return factor[:, :k]
        column = a[:, p] - factor[:, :k] @ factor[p, :k]
        column[np.setdiff1d(np.arange(d), todo)] = 0.0
        factor[:, k] = column / np.sqrt(left[p])
        factor[p, k] = np.sqrt(left[p])
        left -= factor[:, k] ** 2
        todo = todo[todo != p]
    return factor


def rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of n columns as n - 1 rounds (n even) of disjoint pairs: the circle method of tournaments."""
    ring = np.arange(n + n % 2)
    for _ in range(len(ring) - 1):
        a, b = ring[: len(ring) // 2], ring[::-1][: len(ring) // 2]
        real = (a < n) & (b < n)
        yield a[real], b[real]
        ring = np.concatenate((ring[:1], ring[-1:], ring[1:-1]))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of ``factor @ factor.T``.

    Each round rotates disjoint pairs of columns so that each pair becomes orthogonal; sweeps end when no
    pair's cosine is above rounding.
    """
    g = np.array(factor, np.float64)
    least = np.finfo(np.float64).eps * max(1, len(g)) ** 0.5
    for _ in range(sweeps):
        turned = False
        for a, b in rounds(g.shape[1]):
            x, y = g[:, a], g[:, b]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            open_ = np.abs(xy) > least * np.sqrt(xx * yy)
            if not open_.any():
                continue
            turned, a, b, x, y = True, a[open_], b[open_], x[:, open_], y[:, open_]
            zeta = (yy[open_] - xx[open_]) / (2 * xy[open_])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            g[:, a], g[:, b] = c * (x - t * y), c * (t * x + y)
        if not turned:
            break
    norms = np.sqrt((g * g).sum(0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, g[:, order] / norms[order]


# ------------------------------------------------------------------ sums over the cluster


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the integer form of each whole and finite vector of the commonest length."""
    v = F.col("embedding").cast("array<double>")
    good = F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select("vec_id", v.alias("v")).where(good)
    whole = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return rows.select("vec_id", whole.alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of a list column as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _sums(fit: DataFrame, value, kind: str) -> np.ndarray:
    """Sum over the rows of ``value(x matrix)``, by dimension: exact where ``kind`` is long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = value(_matrix(b.column(0))).sum(0)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "s"])

    rows = fit.mapInArrow(run, f"i long, s {kind}").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return np.array([r["s"] for r in rows])


def _scatter(fit: DataFrame, value, centre: np.ndarray) -> np.ndarray:
    """Sum over the rows of the outer products of ``value(x matrix) - centre``, centred before multiplying.

    A task adds up its own rows; the tasks' matrices, row by row, in ``FANS`` groups and then those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, fan = np.zeros((len(centre), len(centre))), 0
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                z = value(_matrix(b.column(0).slice(at, 4096))) - centre
                total += z.T @ z
            fan = b.column(1)[0].as_py() if b.num_rows else fan
        n = len(centre)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, fan, np.int64)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "fan", "row"])

    def add(rows: DataFrame, *keys: str) -> DataFrame:
        kinds = ", ".join(f"{k} long" for k in keys)
        return rows.groupBy(*keys).applyInPandas(lambda g: g.iloc[:1][list(keys)].assign(row=[np.sum(np.stack(list(g["row"])), axis=0)]), f"{kinds}, row array<double>")

    tasks = fit.select("x", (F.spark_partition_id() % FANS).cast("long").alias("fan")).mapInArrow(run, "i long, fan long, row array<double>")
    got = add(add(tasks, "i", "fan"), "i").orderBy("i").collect()
    return np.array([r["row"] for r in got]).reshape(len(centre), len(centre))


# ------------------------------------------------------------------ the operator


def _whole_squares(n: int, x: np.ndarray, total: list[int]) -> list:
    """Sum over dimensions of (n x - S)^2 for each row, exact; None where it does not fit a long."""
    limit = max(abs(int(v)) for v in (x.min(initial=0), x.max(initial=0), 1)) * n + max(abs(v) for v in total)
    if limit < 2**62 and (far := n * x - np.array(total, np.int64)).size and x.shape[1] * int(max(-int(far.min()), int(far.max()))) ** 2 < 2**63:
        return (far * far).sum(1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total)) for row in x]
    return [v if v < 2**63 else None for v in exact]


class Whitening:
    """The fit: n, S, mean, components (columns) and eigenvalues, the trace, and the identity error."""

    def __init__(self, rows: DataFrame, components: int = COMPONENTS):
        """``rows``: x. The fit list is each distinct x once; copies are combined before the shuffle."""
        fit = pin(rows.select("x").distinct(), "fit")
        self.n = fit.count()
        if not self.n:
            return
        self.total = [int(s) for s in _sums(fit, lambda x: x, "long")]
        d = len(self.total)
        if d > MAX_DIM:
            raise ValueError(f"vectors of {d} entries: the driver factors matrices of up to {MAX_DIM}")
        self.mean = np.array([s / self.n for s in self.total])
        v = _scatter(fit, lambda x: x.astype(np.float64), self.mean) / self.n
        self.trace = float(np.trace(v))
        values, vectors = one_sided_jacobi(pivoted_cholesky(v))
        self.values, self.components = values[:components], vectors[:, :components]
        mean, weights = self.mean, self.components / np.sqrt(self.values)
        self.project = lambda x: (x - mean) @ weights
        self.identity_error = 0.0
        if len(self.values):
            centre = _sums(fit, self.project, "double") / self.n
            self.identity_error = float(np.abs(_scatter(fit, self.project, centre) / self.n - np.eye(len(centre))).max())

    def apply(self, rows: DataFrame) -> DataFrame:
        """vec_id, component, n, deviation, whitened, explained, identity_error for every row of ``rows`` (vec_id, x)."""
        kind = f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        if not self.n or not len(self.values):
            return rows.sparkSession.createDataFrame([], kind)
        n, total, project, error = self.n, self.total, self.project, self.identity_error
        k, explained = len(self.values), self.values / self.trace

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    m, x = part.num_rows, _matrix(part.column(1))
                    ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                    far = pa.array(_whole_squares(n, x, total), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                    columns = [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), far, project(x).ravel(), np.tile(explained, m), np.full(m * k, error)]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[f.split()[0] for f in kind.split(", ")])

        return rows.select("vec_id", "x").mapInArrow(run, kind)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold null or non-finite entries are dropped, and so are those of
    another length than the commonest (of equally common ones, the longest). Rows stay apart, whatever
    repeats: equal vectors, ids or whole rows; null ids are kept. The fit counts each distinct vector once.
    Equal eigenvalues keep the order in which the factor gives them. Directions
    without spread have no component, so there may be fewer than ``components``, none at all for
    one distinct vector, and no rows then, as for an empty table. ``deviation`` is null where it does not fit a long.
    Entries are meant below 2**50 / 64. Columns other than vec_id and embedding are not read.
    """
    rows = clean(vectors)
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        sizes = {"d": 0}
    rows = rows.where(F.size("x") == sizes["d"])
    return Whitening(rows, components).apply(rows)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
