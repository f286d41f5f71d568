"""Whitening of embeddings by the cyclic Jacobi method.

1. One pass sums the integer entries x = floor(1024 c) + 100000 of each dimension, exactly.
2. A second pass sums the centred scatter, (x - S/n)(x - S/n)', task by task; Spark adds the tasks' sums by position.
3. The driver turns the covariance by symmetric Jacobi rotations, sweep after sweep over all pairs, until every
   off-diagonal entry is negligible beside its two diagonal entries. This test is relative, so that small eigenvalues are
   as accurate as large ones. The matrix has the size of a vector squared, whatever the number of rows, and MOST_DIMS bounds it.
4. The columns, sorted and scaled, are broadcast; a third pass sums the whitened covariance, a fourth gives the rows.

Defined cases: rows whose vector is null, or holds null or non-finite entries, are dropped; so are empty vectors, and
vectors of another length than most have (of equally common lengths the greatest counts). Entries beyond 2**52 count as that.
Components without variance (a single vector, or fewer dimensions than asked for) have no rows; equal eigenvalues keep
the order in which the rotations leave them. A deviation beyond a long is null. Repeated rows count and are returned
each; an empty table gives no rows; a null id is kept; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import written

MOST_DIMS = 4_096
SCALE, OFFSET = 1_024, 100_000
_EPS = np.finfo(float).eps
#: Entries of vectors that are worked on at once.
_BLOCK = 1 << 19


def integers(c: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(c, -(2.0**52), 2.0**52) * SCALE).astype(np.int64) + OFFSET


def _blocks(vectors: pa.Array):
    """(length, numbers of rows, their entries as integers) of vectors whose entries are all finite."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    values = vectors.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    sound = (lengths > 0) & (bad[ends] == bad[starts])
    for length in np.unique(lengths[sound]):
        rows = np.flatnonzero(sound & (lengths == length))
        step = max(1, _BLOCK // int(length))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            yield int(length), some, integers(values[starts[some][:, None] + np.arange(length)])


def _sums(vectors: DataFrame) -> DataFrame:
    """length, i, n, high, low: for vectors of a length, the sum of their i-th entries is high * 2**32 + low."""

    def run(batches):
        told: dict[int, list] = {}
        for batch in batches:
            for length, rows, x in _blocks(batch.column(0)):
                old = told.setdefault(length, [0, np.zeros(length, np.int64), np.zeros(length, np.int64)])
                old[0] += len(rows)
                old[1] += (x >> 32).sum(axis=0)
                old[2] += (x & 0xFFFFFFFF).sum(axis=0)
        for length, (n, high, low) in told.items():
            columns = [np.full(length, length), np.arange(length), np.full(length, n), high, low]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["length", "i", "n", "high", "low"])

    rows = vectors.mapInArrow(run, "length long, i long, n long, high long, low long")
    return rows.groupBy("length", "i").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low")))


def _products(vectors: DataFrame, length: int, factors) -> DataFrame:
    """i, j, v: sums over all vectors of the products of two columns of factors(entries), i <= j."""

    def run(batches):
        total = None
        for batch in batches:
            for d, _, x in _blocks(batch.column(0)):
                if d == length:
                    y = factors(x)
                    total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(total[i, j])], ["i", "j", "v"])

    return vectors.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def _matrix(products: DataFrame, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for r in products.collect():  # size**2 / 2 numbers
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def jacobi(symmetric: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the largest entry of each (the first of equals) is positive."""
    a, d = symmetric.astype(float).copy(), len(symmetric)
    vectors, none = np.eye(d), np.trace(symmetric) * _EPS**2
    for _ in range(most_sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if abs(off) <= _EPS * np.sqrt(abs(a[p, p] * a[q, q])) + none:
                    continue
                turned = True
                ratio = (a[q, q] - a[p, p]) / (2 * off)
                t = (1.0 if ratio >= 0 else -1.0) / (abs(ratio) + np.hypot(ratio, 1.0))
                c = 1 / np.hypot(t, 1.0)
                turn = np.array([[c, -t * c], [t * c, c]])
                pair = [p, q]
                app, aqq = a[p, p] - t * off, a[q, q] + t * off
                a[pair] = turn @ a[pair]
                a[:, pair] = a[pair].T
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
                vectors[:, pair] = vectors[:, pair] @ turn.T
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    vectors = vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(d)]
    return np.diag(a)[order], vectors * np.where(largest < 0, -1.0, 1.0)


class Centre:
    """S/n of each dimension as whole and rest, so that x - S/n loses nothing."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.whole = n, np.array([s // n for s in sums], np.int64)
        self.over = np.array([s % n for s in sums], np.int64)
        self.rest = self.over / n

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sums over dimensions of (n x - S)**2, exact."""
        off = x - self.whole
        if x.shape[1] * (self.n * (int(np.abs(off).max()) + 1)) ** 2 < 2**63:
            return ((self.n * off - self.over) ** 2).sum(axis=1).tolist()
        whole = ((self.n * off.astype(object) - self.over.astype(object)) ** 2).sum(axis=1)
        return [v if v < 2**63 else None for v in whole]


def whitened(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark, id_type = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, only = vectors.select(id_col, vector_col), vectors.select(vector_col)
    sums = written(_sums(only), "whitening-sums")
    most = sums.where("i = 0").orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    if not most:
        return spark.createDataFrame([], schema)
    length, n = most[0].length, most[0].n
    if length > MOST_DIMS:
        raise ValueError(f"vectors have {length} dimensions, over {MOST_DIMS}: the driver holds a square matrix of them")
    total = {r.i: (r.high << 32) + r.low for r in sums.where(F.col("length") == length).collect()}  # a row per dimension
    centre = Centre(n, [total[i] for i in range(length)])

    covariance = _matrix(_products(only, length, centre), length) / n
    values, directions = jacobi(covariance)
    k = int((values[:components] > length * _EPS * max(values[0], 0)).sum())
    if not k:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((centre, directions[:, :k] / np.sqrt(values[:k])))

    def with_ones(x):
        mid, turn = shared.value
        return np.column_stack([mid(x) @ turn, np.ones(len(x))])

    after = _matrix(_products(only, length, with_ones), k + 1) / n
    mean = after[:k, k]
    error = float(np.abs(after[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())
    explained = values[:k] / np.trace(covariance)

    def run(batches):
        mid, turn = shared.value
        names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            for d, some, x in _blocks(batch.column(1)):
                if d == length:
                    m = len(some)
                    each = np.repeat(np.arange(m), k)
                    columns = [
                        batch.column(0).take(pa.array(some[each])), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                        pa.array(mid.deviations(x), pa.int64()).take(pa.array(each)), pa.array((mid(x) @ turn).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)
