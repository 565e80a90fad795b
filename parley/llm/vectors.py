"""Columns of vectors as numpy matrices, and moments that are merged over partitions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(rows: DataFrame, name: str) -> int:
    """The length that most vectors have, the greater of equally frequent ones; 0 if there are none. Rows with vectors of another
    length don't belong to the table."""
    size = F.size(name)
    found = rows.where(F.col(name).isNotNull() & (size > 0)).groupBy(size.alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found["size"] if found else 0


def matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the rows that hold d finite entries, and these vectors as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.flatnonzero(np.asarray(pc.equal(pc.list_value_length(column), d).fill_null(False)))
    if not d or not len(at):
        return at[:0], np.zeros((0, d))
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(len(at), d)  # a null entry is not a number here
    good = np.isfinite(values).all(axis=1)
    return at[good], values[good]


class Moments:
    """Count, mean and centred second moments of vectors, and the exact sums of whole-number ones."""

    def __init__(self, d: int):
        self.n, self.mean, self.m2, self.sums = 0, np.zeros(d), np.zeros((d, d)), [0] * d

    def add(self, x: np.ndarray) -> None:
        """Welford's rank-one update with one vector."""
        self.n += 1
        off = x - self.mean
        self.mean += off / self.n
        self.m2 += off[:, None] * (off * ((self.n - 1) / self.n))

    def add_all(self, rows: np.ndarray, exact: np.ndarray | None = None) -> None:
        """Each of rows by a rank-one update; exact: the same rows as whole numbers of less than 2**53."""
        for x in rows:
            self.add(x)
        if exact is not None:
            for k in range(0, len(exact), 512):  # 512 of them don't leave 64 bits
                self.sums = [a + b for a, b in zip(self.sums, exact[k : k + 512].sum(axis=0).tolist(), strict=True)]

    def merge(self, other: Moments) -> None:
        """The parallel update: the moments of both sets of vectors."""
        if not other.n:
            return
        n, off = self.n + other.n, other.mean - self.mean
        self.mean += off * (other.n / n)
        self.m2 += other.m2 + off[:, None] * (off * (self.n * other.n / n))
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def covariance(self) -> np.ndarray:
        return (self.m2 + self.m2.T) / (2 * max(self.n, 1))

    SCHEMA = "cell int, n long, mean binary, m2 binary, sums array<decimal(38,0)>"
    ARROW = pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("mean", pa.binary()), ("m2", pa.binary()), ("sums", pa.list_(pa.decimal128(38)))])

    def row(self, cell: int) -> pa.RecordBatch:
        sums = pa.array([[Decimal(s) for s in self.sums]], self.ARROW.field("sums").type)
        columns = [pa.array([cell], pa.int32()), pa.array([self.n]), pa.array([self.mean.tobytes()]), pa.array([self.m2.tobytes()]), sums]
        return pa.RecordBatch.from_arrays(columns, schema=self.ARROW)

    @classmethod
    def of(cls, d: int, row: dict) -> Moments:
        out = cls(d)
        out.n, out.mean = row["n"], np.frombuffer(row["mean"]).copy()
        out.m2, out.sums = np.frombuffer(row["m2"]).reshape(d, d).copy(), [int(s) for s in row["sums"]]
        return out


def moments(rows: DataFrame, d: int, read) -> Moments:
    """The moments of what `read` makes of the Arrow batches of rows: vectors, and the same as whole numbers or None.

    Each partition sends one state of d * d doubles. Their number is that of the partitions, so they are merged in two steps, first
    in about as many tasks as its root: no task meets all of them, and the driver gets one.
    """
    cells = max(1, math.isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments(d)
        for batch in batches:
            own.add_all(*read(batch))
        if own.n:
            yield own.row(TaskContext.get().partitionId() % cells)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments(d)
        for batch in batches:
            for k in range(batch.num_rows):
                own.merge(Moments.of(d, batch.slice(k, 1).to_pylist()[0]))
        if own.n:
            yield own.row(0)

    states = rows.mapInArrow(gather, Moments.SCHEMA).repartition(cells, "cell").mapInArrow(merge, Moments.SCHEMA)
    found = states.repartition(1).mapInArrow(merge, Moments.SCHEMA).first()
    return Moments.of(d, found.asDict()) if found else Moments(d)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and orthogonal Q with a = Q T Q', by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if not length:
            continue
        alpha = -math.copysign(length, v[0])
        v[0] -= alpha
        v /= np.linalg.norm(v)
        a[k + 1 :, k], a[k, k + 1 :] = 0.0, 0.0
        a[k + 1, k] = a[k, k + 1] = alpha
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (v[:, None] * w + w[:, None] * v)
        q[:, k + 1 :] -= 2 * (q[:, k + 1 :] @ v)[:, None] * v
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, by the symmetric QR iteration with Wilkinson's shift.

    The largest entry of each vector, the first of equal ones, is positive.
    """
    d, e, q = tridiagonal(a)
    tiny, hi = np.finfo(float).eps, len(d) - 1
    while hi > 0:
        small = np.abs(e[:hi]) <= tiny * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0.0
        if small[hi - 1]:
            hi -= 1
            continue
        zeros = np.flatnonzero(small)
        lo = int(zeros[-1]) + 1 if len(zeros) else 0
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + math.copysign(math.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):  # the bulge is chased down the diagonal by plane rotations
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            a_k, b_k, a_next = d[k], e[k], d[k + 1]
            d[k] = c * c * a_k + 2 * c * s * b_k + s * s * a_next
            d[k + 1] = s * s * a_k - 2 * c * s * b_k + c * c * a_next
            e[k] = c * s * (a_next - a_k) + (c * c - s * s) * b_k
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            left, right = q[:, k].copy(), q[:, k + 1]
            q[:, k] = c * left + s * right
            q[:, k + 1] = c * right - s * left
    order = np.argsort(-d, kind="stable")
    d, q = d[order], q[:, order]
    if len(d):
        q *= np.where(q[np.abs(q).argmax(axis=0), np.arange(len(d))] < 0, -1.0, 1.0)
    return d, q
