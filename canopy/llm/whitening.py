"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X are held in blocks of a written table.  From a start vector v the steps alternate
u = Xv - beta u', alpha = |u| and v = X'u - alpha v', beta = |v|, each made orthogonal to all its
predecessors, so that X V = U B with B upper bidiagonal.  A left vector has an entry per row and is
never gathered or stored: each is X w for a direction w of the vectors' dimension, so a task computes its
rows' entries from the rows.  One pass over the blocks gives |u|, its products with all earlier left
vectors and X'u; where the products show lost orthogonality, the corrected direction is passed once more.
The steps go on until V spans all dimensions (a vanishing beta restarts from a fresh orthogonal
vector), so repeated and zero eigenvalues are found as well.  B's singular values give the deviations,
and V times its right vectors the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Entries a block holds at most (or one row).
BLOCK = 1 << 18
#: Share of the largest singular value below which one is zero, and share of a left vector's length above which
#: its products with the earlier ones call for another pass over the rows.
ZERO, LOST = 1e-12, 1e-9

_BLOCKS = "ids array<long>, n long, d int, x binary"


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, vectors = batch.column("vec_id"), batch.column("vector")
        d = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
        x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.int64)
        at = 0
        while at < len(d):  # rows of one length, so that a block is a matrix
            end = at + max(1, BLOCK // max(1, int(d[at])))
            other = np.flatnonzero(d[at:end] != d[at])
            end = min(at + int(other[0]) if len(other) else end, len(d))
            lo, hi = int(d[:at].sum()), int(d[:end].sum())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, end - at], pa.int32()), ids.slice(at, end - at)),
                 pa.array([end - at], pa.int64()), pa.array([int(d[at])], pa.int32()), pa.array([x[lo:hi].tobytes()])],
                ["ids", "n", "d", "x"])
            at = end


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, rows of longs) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, d, raw = batch.column("ids")[i].values, batch.column("d")[i].as_py(), batch.column("x")[i].as_buffer()
            yield ids, np.frombuffer(raw, np.int64).reshape(len(ids), d)


class Rows:
    """The centred rows of a table of vectors, in blocks."""

    def __init__(self, vectors: DataFrame, id_col: str, vector_col: str):
        valid = F.col(vector_col).isNotNull() & F.forall(
            F.col(vector_col).cast("array<double>"), lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
        x = F.transform(F.col(vector_col).cast("array<double>"), lambda c: F.floor(SCALE * c).cast("long") + SHIFT)
        base = vectors.where(valid).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("vector"))
        self.blocks = stored(base.mapInArrow(_block_batches, _BLOCKS), "vectors")
        told = self.blocks.agg(F.sum("n").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).first()
        self.n, self.d = told.n or 0, told.high or 0
        if told.low != told.high:
            raise ValueError(f"vectors of {told.low} and of {told.high} entries")
        self.sums = np.zeros(self.d, np.int64)
        if self.n and self.d:
            found = self._added(_sum_batches, "long")
            self.sums = np.array([found[i] for i in range(self.d)], np.int64)
            most = found[self.d]  # sum of the tasks' largest entries: a bound of the largest
            if 2 * most * self.n >= 1 << 63:
                raise ValueError("the vectors' entries are too large for exact sums")

    def _added(self, run, kind: str) -> dict[int, float]:
        rows = self.blocks.select("ids", "d", "x").mapInArrow(run, f"i int, s {kind}").groupBy("i").agg(
            F.sum("s").alias("s")).collect()
        return {r.i: r.s for r in rows}

    def centred_sums(self, of, size: int) -> np.ndarray:
        """The sum over blocks of ``of(centred rows)``, a vector of ``size`` doubles; added in the JVM."""
        n, sums = self.n, self.sums

        def run(batches):
            total = np.zeros(size)
            for _, x in _rows(batches):
                total += of(_centre(x, n, sums))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "s"])

        found = self._added(run, "double")
        return np.array([found.get(i, 0.0) for i in range(size)])


def _centre(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n  # the difference is exact


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, most = None, 0
    for _, x in _rows(batches):
        total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
        most = max(most, int(np.abs(x).max()))
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1, dtype=np.int32)),
                                          pa.array(np.append(total, most))], ["i", "s"])


def bidiagonalise(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): V's columns are the right vectors, B is upper bidiagonal, X V = U B.

    The driver holds vectors of the dimension, never an entry per row."""
    d = rows.d
    rng = np.random.default_rng(12)
    V, W, XtU = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    alphas, betas, scale = [], [], 0.0

    def fresh() -> np.ndarray:
        v = rng.standard_normal(d)
        for _ in range(3):
            v -= V @ (V.T @ v)
            v /= np.linalg.norm(v)
        return v

    def left(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(|Xw|, U'Xw, X'Xw) in one pass."""
        k = W.shape[1]

        def of(x: np.ndarray) -> np.ndarray:
            y = x @ w
            return np.concatenate([[y @ y], (x @ W).T @ y, x.T @ y])

        s = rows.centred_sums(of, 1 + k + d)
        return float(np.sqrt(s[0])), s[1:1 + k], s[1 + k:]

    v, beta = fresh(), 0.0
    while True:
        V = np.column_stack([V, v])
        w = v - beta * W[:, -1] if beta else v
        alpha, products, xtu = left(w)
        again = 0
        while W.shape[1] and alpha > ZERO * scale and np.abs(products).max() > LOST * alpha and again < 3:
            w = w - W @ products
            alpha, products, xtu = left(w)
            again += 1
        if W.shape[1]:  # what is left is below LOST, so its square is lost in alpha's last digit
            w, xtu = w - W @ products, xtu - XtU @ products
        scale = max(scale, alpha)
        if alpha > ZERO * scale:
            w, xtu = w / alpha, xtu / alpha
        else:  # X v lies in the span of the earlier left vectors
            alpha, w, xtu = 0.0, np.zeros(d), np.zeros(d)
        W, XtU = np.column_stack([W, w]), np.column_stack([XtU, xtu])
        alphas.append(alpha)
        if V.shape[1] == d:
            break
        right = xtu - alpha * v
        for _ in range(2):
            right -= V @ (V.T @ right)
        beta = float(np.linalg.norm(right))
        scale = max(scale, beta)
        if beta > ZERO * scale:
            v = right / beta
        else:
            v, beta = fresh(), 0.0
        betas.append(beta)
    return V, np.diag(alphas) + np.diag(betas, 1)


def components_of(rows: Rows, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(unit eigenvectors as columns, eigenvalues falling, trace) of the rows' covariance: those of positive
    variance, ``most`` at most.  The larger of a component's extreme entries is positive."""
    if not rows.n or not rows.d:
        return np.zeros((rows.d, 0)), np.zeros(0), 0.0
    V, B = bidiagonalise(rows)
    _, s, right = np.linalg.svd(B)
    e = s * s / rows.n
    vectors = V @ right.T
    keep = min(most, int((s > ZERO * s[0]).sum()) if s[0] > 0 else 0)
    vectors = vectors[:, :keep]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(keep)])
    return vectors, e[:keep], float(e.sum())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """Per row with a whole vector and per component: vec_id, component, n, deviation, whitened, explained,
    identity_error.

    An entry c becomes x = floor(64 c) + 1000000.  Rows whose vector is null or has null or non-finite
    entries are dropped; null and repeated ids and repeated vectors count and are returned as they come.
    Only components of positive variance are returned (at most ``components``): none of an empty table,
    of equal rows or of vectors without entries.  A deviation that a long can't hold is null.  Vectors
    of different lengths and entries too large for exact sums are errors.  Other columns are not read.
    A task holds a block of rows; the driver holds matrices of the dimension."""
    rows = Rows(vectors, id_col, vector_col)
    directions, e, trace = components_of(rows, components)
    k, n, sums = len(e), rows.n, rows.sums
    to = directions / np.sqrt(e)
    error = 0.0
    if k:
        mean = rows.centred_sums(lambda x: (x @ to).sum(axis=0), k) / n

        def moments(x: np.ndarray) -> np.ndarray:
            w = x @ to - mean
            return (w.T @ w).ravel()

        error = float(np.abs(rows.centred_sums(moments, k * k).reshape(k, k) / n - np.eye(k)).max())
    share = e / trace if k else e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _rows(batches) if k else ():
            m = len(x)
            off = n * x - sums
            near = (off.astype(np.float64) ** 2).sum(axis=1)
            deviation = pa.array((off * off).sum(axis=1), mask=near >= 2.0**63)
            one = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(one)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, n)), deviation.take(pa.array(one)), pa.array((_centre(x, n, sums) @ to).ravel()),
                 pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.blocks.select("ids", "d", "x").mapInArrow(
        run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
