"""Whitening of embeddings: moments by Welford's updates, components by the symmetric QR iteration.

Each entry c of a vector becomes the whole number x = floor(scale * c) + shift. The fit list holds each distinct x vector once,
so copies weigh nothing; Spark's distinct drops them before the shuffle as well as after it, and a vector that a third of all
rows share is one row of each task.

Moments. In each partition of the fit list vectors update count, mean and centred second moments one by one; the states of
the partitions are merged by the parallel update in two steps. They are taken of x - shift, as numbers around 10**6 would cost six
digits; a covariance does not change by that. The sums S are whole numbers of any size. The driver gets one state, of the size of
the covariance, and solves that by Householder reflections and shifted QR steps.

The rows are then projected where they are, with one small matrix. The covariance of the whitened fit list is measured in the
same way as that of x, and its distance from the identity comes with each row.

Defined results: rows whose vector is null, or holds a null or non-finite entry, are left out, and so are rows of another length than
most, and vectors with an entry for which |scale * c| is 2**53 or more, which has no exact x. A component whose eigenvalue is
below rounding (d * 2**-52 of the largest) carries no information and is not returned, so equal vectors, or a single one, give no rows.
A deviation above 2**63 - 1 is null. Repeated rows each come back, ids may be null or repeated, other columns are ignored, an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import discard, stored, table
from parley.llm.vectors import Moments, dimension, matrix, moments, symmetric_eigen

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_MOST = 1 << 63


def _whole(column: pa.Array, d: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of usable rows, and floor(scale * c) of their entries."""
    at, values = matrix(column, d)
    with np.errstate(over="ignore"):
        y = np.floor(values * scale)
    fits = (np.abs(y) < 2.0**53).all(axis=1)
    return at[fits], y[fits].astype(np.int64)


def fit_list(rows: DataFrame, d: int, scale: float = SCALE) -> DataFrame:
    """embedding -> y: each distinct vector of floor(scale * c), as bytes of 64-bit numbers."""

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, y = _whole(batch.column(0), d, scale)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in y], pa.binary())], names=["y"])

    return rows.select("embedding").mapInArrow(bytes_of, "y binary").distinct()


def _rows_of(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(batch.num_rows, d)


class Whitening:
    """The fitted model: everything that a task needs to whiten a vector."""

    def __init__(self, fitted: Moments, components: int = COMPONENTS):
        self.n, self.sums = fitted.n, fitted.sums
        self.d = len(fitted.mean)
        values, vectors = symmetric_eigen(fitted.covariance())
        held = values > self.d * np.finfo(float).eps * values.max(initial=0.0)
        self.k = min(components, int(held.sum()))
        self.explained = values[: self.k] / np.trace(fitted.covariance()) if self.k else np.zeros(0)
        self.project = vectors[:, : self.k] / np.sqrt(values[: self.k])
        self.identity_error = 0.0

    def off(self, y: np.ndarray) -> np.ndarray:
        """n * x - S of each entry, exact: as 64-bit numbers where they fit, else as Python's."""
        most = max([1, int(np.abs(y).max(initial=0)), *(abs(s) // max(self.n, 1) + 1 for s in self.sums)])
        kind = np.int64 if 4 * most * self.n < _MOST else object
        return self.n * y.astype(kind) - np.array(self.sums, kind)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (self.off(y) / self.n).astype(float) @ self.project

    def deviations(self, y: np.ndarray) -> list[int | None]:
        off = self.off(y)
        if off.dtype != object and float(np.abs(off).max(initial=0)) ** 2 * self.d < 2.0**62:
            return (off * off).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in off]
        return [v if v < _MOST else None for v in exact]


def fit(rows: DataFrame, scale: float = SCALE, components: int = COMPONENTS) -> Whitening:
    """The model of the column `embedding`."""
    d = dimension(rows, "embedding")
    distinct = stored(fit_list(rows, d, scale), "fit-list")

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        y = _rows_of(batch, d)
        return y.astype(float), y

    model = Whitening(moments(distinct, d, read), components)
    if model.k:
        again = moments(distinct, model.k, lambda batch: (model.whitened(_rows_of(batch, d)), None))
        model.identity_error = float(np.abs(again.covariance() - np.eye(model.k)).max())
    discard(distinct)
    return model


def apply(rows: DataFrame, model: Whitening, scale: float = SCALE) -> DataFrame:
    """vec_id, embedding -> the rows of OUT, one for each component. No row moves."""

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.k
        for batch in batches:
            at, y = _whole(batch.column(1), model.d, scale)
            if not len(at) or not k:
                continue
            repeat = pa.array(np.repeat(at, k))
            columns = [
                batch.column(0).take(repeat),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                pa.array(np.full(len(at) * k, model.n)),
                pa.array(model.deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                pa.array(model.whitened(y).ravel()),
                pa.array(np.tile(model.explained, len(at))),
                pa.array(np.full(len(at) * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(whiten, OUT)


def whiten(rows: DataFrame, scale: float = SCALE, components: int = COMPONENTS) -> DataFrame:
    """Every usable row of rows (vec_id, embedding) by each of its components."""
    return apply(rows, fit(rows, scale, components), scale)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
