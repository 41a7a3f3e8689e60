"""Embedding whitening: covariances by Welford's rank-one updates, merged over partitions, and a symmetric QR.

Moments run through the rows of a partition one by one and never hold more than one state; the states of
partitions meet in a tree of bounded groups by the parallel formula.  The covariance of the whole, dims by
dims, is reduced to a tridiagonal matrix and diagonalised by implicit QR steps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions.lineage import cut
from trackloom.llm.frames import fresh
from trackloom.llm.vectors import floored, sound
from trackloom.llm.workers import mapped

#: Integers are held within this: exact as doubles.
MOST = 1 << 53
#: Bytes of states that meet in one task.
MERGED = 32 << 20
LOW = 26

STATE = "node bigint, n bigint, mean array<double>, m2 array<double>, high array<bigint>, low array<bigint>"
STATE_ARROW = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("m2", pa.list_(pa.float64())),
                         ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])


class Moments:
    """Count, mean and centred products of vectors, and exact sums of integers in two halves."""

    def __init__(self, dims: int) -> None:
        self.n, self.mean, self.m2 = 0, np.zeros(dims), np.zeros((dims, dims))
        self.high, self.low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)

    def add(self, rows: np.ndarray) -> None:
        """Rank-one updates, a row at a time."""
        product = np.empty_like(self.m2)
        for row in rows:
            self.n += 1
            off = row - self.mean
            self.mean += off / self.n
            np.multiply.outer(off, off * ((self.n - 1) / self.n), out=product)
            self.m2 += product

    def count(self, x: np.ndarray) -> None:
        self.high += (x >> LOW).sum(0)
        self.low += (x & (1 << LOW) - 1).sum(0)

    def merge(self, other: Moments) -> None:
        if not other.n:
            return
        n = self.n + other.n
        off = other.mean - self.mean
        self.mean = self.mean + off * (other.n / n)
        self.m2 = self.m2 + other.m2 + np.multiply.outer(off, off) * (self.n * (other.n / n))
        self.n, self.high, self.low = n, self.high + other.high, self.low + other.low

    def sums(self) -> list[int]:
        return [(h << LOW) + low for h, low in zip(self.high.tolist(), self.low.tolist())]

    def written(self, node: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"node": node, "n": self.n, "mean": self.mean.tolist(), "m2": self.m2.ravel().tolist(),
                                            "high": self.high.tolist(), "low": self.low.tolist()}], STATE_ARROW)

    @classmethod
    def read(cls, row: dict) -> Moments:
        dims = len(row["mean"])
        out = cls(dims)
        out.n, out.mean, out.m2 = row["n"], np.array(row["mean"]), np.array(row["m2"]).reshape(dims, dims)
        out.high, out.low = np.array(row["high"], np.int64), np.array(row["low"], np.int64)
        return out


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """Integer vectors from their bytes (see distinct), as int64."""
    rows = column.to_pylist()
    out = np.empty((len(rows), dims), np.int64)
    for k, value in enumerate(rows):
        out[k] = np.frombuffer(value, f"<i{len(value) // dims}")
    return out


def distinct(kept: DataFrame, vector: str, dims: int, scale: int) -> DataFrame:
    """Each distinct vector of floor(scale * c) once, as bytes x: the narrowest of 2, 4 and 8 bytes a component
    that holds them all, so that equal vectors have equal bytes.  Repeats are dropped before the shuffle too."""
    def run(batches):
        for batch in batches:
            x = floored(batch.column(0), dims, scale, MOST)
            largest = np.abs(x).max(axis=1, initial=0)
            out = [None] * len(x)
            for width, below in ((8, 1 << 62), (4, 1 << 31), (2, 1 << 15)):
                for k in np.flatnonzero(largest < below).tolist():
                    out[k] = x[k].astype(f"<i{width}").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["x"])

    return mapped(kept.select(vector), run, "x binary").distinct()


def moments(vectors: DataFrame, dims: int, project=None, size: int | None = None) -> Moments:
    """Moments of the vectors (bytes x), or of project(them), rows by size, in one pass and a tree of merges."""
    size = size or dims

    def run(batches):
        own = Moments(size)
        for batch in batches:
            x = unpacked(batch.column(0), dims)
            own.add(x.astype(np.float64) if project is None else project(x))
            if project is None:
                own.count(x)
        if own.n:
            yield own.written(TaskContext.get().partitionId())

    def merged(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["node"])
        own = Moments.read(rows[0])
        for row in rows[1:]:
            own.merge(Moments.read(row))
        return pa.Table.from_batches([own.written(rows[0]["node"] // fan)])

    fan = max(2, MERGED // (8 * size * (size + 3)))
    states = cut(mapped(vectors, run, STATE))
    most = states.agg(F.max("node")).first()[0]
    while most:
        group = F.expr(f"node div {fan}")
        states, most = cut(states.groupBy(group).applyInArrow(merged, STATE)), most // fan
    row = states.first()
    return Moments.read(row.asDict()) if row else Moments(size)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, side diagonal and rows of q with q a qT tridiagonal, by reflections."""
    a, q = a.copy(), np.eye(len(a))
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        v[0] += math.copysign(float(np.linalg.norm(v)), v[0])
        square = float(v @ v)
        if square > 0:
            for m in (a, a.T, q):
                m[k + 1:] -= np.outer(v * (2 / square), v @ m[k + 1:])
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(a: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as rows.

    Implicit QR steps with the shift of the last two rows; a side element that is lost beside its diagonal
    neighbours becomes 0 and splits the matrix.  The largest entry of each eigenvector is positive.
    """
    d, e, q = tridiagonal(np.asarray(a, np.float64))
    tiny = np.finfo(float).eps
    high, budget = len(d) - 1, steps * max(1, len(d))
    while high > 0 and budget:
        small = np.abs(e[:high]) <= tiny * (np.abs(d[:high]) + np.abs(d[1:high + 1]))
        e[:high][small] = 0
        if e[high - 1] == 0:
            high -= 1
            continue
        zeros = np.flatnonzero(e[:high] == 0)
        low, budget = int(zeros[-1]) + 1 if len(zeros) else 0, budget - 1
        half, side = (d[high - 1] - d[high]) / 2, e[high - 1]
        x, z = d[low] - (d[high] - side * side / (half + math.copysign(math.hypot(half, side), half))), e[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            p, b, t = d[k], e[k], d[k + 1]
            d[k], d[k + 1] = c * c * p + 2 * c * s * b + s * s * t, s * s * p - 2 * c * s * b + c * c * t
            e[k] = c * s * (t - p) + (c * c - s * s) * b
            if k + 1 < high:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k:k + 2] = np.array([[c, s], [-s, c]]) @ q[k:k + 2]
    if high > 0:
        raise ArithmeticError("the eigenvalues did not converge")
    order = np.argsort(-d, kind="stable")
    d, q = d[order], q[order]
    largest = q[np.arange(len(q)), np.abs(q).argmax(1)]
    return d, q * np.where(largest < 0, -1.0, 1.0)[:, None]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None where a long does not hold it."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if x.shape[1] * most * most < 1 << 62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """A row for each row of df whose vector counts (see sound) and each component up to components: vec_id,
    component int, n long, deviation long, whitened double, explained double, identity_error double.

    x = floor(scale * c), held within 2^53.  The fit list holds each distinct x once, so that repeated rows do not
    weigh twice; they are returned each.  Fewer dimensions have fewer components.  A component without variance
    (a rank below it, or one vector only) has a null whitened value; where all vectors are equal, explained is
    null too, and identity_error is taken over the components with variance.  Of equal eigenvalues any basis is
    right.  A null id stays null.
    """
    schema = T.StructType([T.StructField("vec_id", df.schema[vec_id].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
                           T.StructField("identity_error", T.DoubleType())])
    kept, dims = sound(df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")), "vector")
    if not dims:
        return df.sparkSession.createDataFrame([], schema)
    vectors = cut(distinct(kept, "vector", dims, scale))
    fit = moments(vectors, dims)
    n, sums = fit.n, fit.sums()
    values, basis = symmetric_qr(fit.m2 / n)
    k = min(components, dims)
    trace = float(np.trace(fit.m2 / n))
    some = values[:k] > dims * np.finfo(float).eps * max(values[0], 0.0)
    with np.errstate(divide="ignore"):
        turn = np.where(some, basis[:k].T / np.sqrt(np.where(some, values[:k], 1.0)), 0.0)
    centre = np.array([s / n for s in sums])
    explained = [float(v) / trace if trace > 0 else None for v in values[:k]]
    after = moments(vectors, dims, lambda x: (x - centre) @ turn, k)
    rest = np.abs(after.m2 / n - np.eye(k))[np.ix_(some, some)]
    error = float(rest.max(initial=0.0))

    def run(batches):
        for batch in batches:
            x = floored(batch.column(1), dims, scale, MOST)
            white = (x - centre) @ turn
            rows = len(x)
            number = np.tile(np.arange(k), rows)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(number + 1, pa.int32()), pa.array(np.full(rows * k, n)),
                pa.array([v for v in deviations(x, n, sums) for _ in range(k)], pa.int64()),
                pa.array(white.ravel(), mask=~some[number]), pa.array(explained * rows, pa.float64()), pa.array(np.full(rows * k, error))], names=schema.names)

    return mapped(kept, run, schema)
