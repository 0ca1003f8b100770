"""Embedding whitening: a covariance in two passes, and a projection on its first components.

Entries become whole numbers, floor(scale * c) + offset.  The *fit list* is each distinct vector of them once.

* First pass: exact integer sums of each dimension, as Python integers; the mean is a whole part and a fraction, both exact.
* Second pass: vectors minus the mean, their outer products summed by NumPy's matrix product a block of rows at a time;
  tasks' sums meet by treeAggregate, as those of the first pass do, so the driver never holds one matrix for each task.
* LAPACK's symmetric eigh gives components; those vectors (dimensions x components numbers) are broadcast, and each row is
  projected where it is.
* Third pass: the covariance of the whitened fit list is measured against the identity.

`deviation` is exact: sums of squares of n * x - S as integers, by int64 where a bound shows that they fit, by Python
integers elsewhere.

Cases: rows whose vector is null, or holds null or non-finite entries, are dropped, and so are empty vectors.  Entries are
clipped to LARGEST in absolute value after scaling.  Where vectors differ in length, the length with the most distinct
vectors counts (of several, the longest) and rows of other lengths are dropped.  Components whose eigenvalue is zero (up to
rounding) have null `whitened`; `explained` is null if all are.  `deviation` is null where it is beyond a long.  Equal rows
have equal results; a null id is an id like any other.  Empty tables give empty results.  Further columns are handed on in
`row`, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import cut

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Scaled entries beyond this are clipped, so that they and their sums of squares stay numbers.
LARGEST = 1 << 40
#: Bytes of a block of vectors as doubles.
BLOCK_BYTES = 4 << 20
#: Eigenvalues under this share of the largest (a multiple of what rounding leaves) count as zero.
ZERO = 1e-12


def whole_numbers(vectors: pa.Array, scale: int = SCALE, offset: int = OFFSET) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of an array of lists: indices of the rows that remain, and the whole numbers of each."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)  # null entries are NaN
    ends = np.cumsum(lengths)
    bad = np.append(0, np.cumsum(~np.isfinite(values)))
    keep = np.flatnonzero((lengths > 0) & (bad[ends] == bad[ends - lengths]))
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.clip(np.floor(values * scale), -LARGEST, LARGEST)
    x = np.where(np.isfinite(x), x, 0).astype(np.int64) + offset
    return keep, [x[ends[i] - lengths[i] : ends[i]] for i in keep]


def _packed(x: np.ndarray) -> bytes:
    """The same bytes for the same numbers, half as many where all fit in 32 bits; the first byte tells."""
    return b"\x04" + x.astype("<i4").tobytes() if x.min() >= -(1 << 31) and x.max() < 1 << 31 else b"\x08" + x.astype("<i8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4" if data[0] == 4 else "<i8", offset=1).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    """Vectors as rows of int64, at most BLOCK_BYTES at a time."""
    most = max(1, BLOCK_BYTES // (8 * dim))
    for batch in batches:
        column = batch.column("x")
        for at in range(0, len(column), most):
            yield np.stack([_unpacked(b) for b in column.slice(at, most).to_pylist()])


def _sum_rows(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    total, n = [0] * dim, 0
    for x in _blocks(batches, dim):
        total, n = [a + int(b) for a, b in zip(total, x.sum(axis=0), strict=True)], n + len(x)  # a block's sums fit: its rows are few
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(v) for v in total]], pa.list_(pa.string()))], names=["n", "total"])


@dataclass
class Whitening:
    n: int
    whole: np.ndarray  # int64: floor of the mean
    rest: np.ndarray  # int64 or object: n * mean - n * whole, from 0 to n - 1
    values: np.ndarray  # eigenvalues, the largest first
    vectors: np.ndarray  # eigenvectors as columns
    trace: float
    identity_error: float | None = None

    @property
    def dim(self) -> int:
        return len(self.whole)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.whole, self.rest)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components, NaN for those without variance."""
        out = self.centred(x) @ self.vectors
        some = self.values > ZERO * max(self.trace, 0.0)
        out[:, some] /= np.sqrt(self.values[some])
        out[:, ~some] = np.nan
        return out

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; None beyond a long."""
        y = x - self.whole
        most = (int(np.abs(y).max(initial=0)) + 1) * self.n
        if most * most * self.dim < 1 << 63:
            d = y * self.n - self.rest
            return (d * d).sum(axis=1).tolist()
        sums = [sum((a * self.n - b) ** 2 for a, b in zip(row, rest, strict=True)) for rest in [[int(r) for r in self.rest]] for row in y.tolist()]
        return [s if s < 1 << 63 else None for s in sums]


def centred(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x minus the mean: the difference to its whole part is exact, so only the fraction is rounded."""
    return (x - whole).astype(np.float64) - (rest / n).astype(np.float64)


def _outer(batches: Iterator[pa.RecordBatch], rows) -> Iterator[pa.RecordBatch]:
    """One row: the sum of the outer products of what `rows` makes of the blocks of vectors."""
    total = None
    for y in rows(batches):
        total = y.T @ y if total is None else total + y.T @ y
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])


def _added(df: DataFrame, size: int) -> np.ndarray:
    """Sum of the matrices of df (m), by a tree of tasks."""
    add = lambda a, b: a + b
    return df.rdd.treeAggregate(np.zeros((size, size)), lambda a, r: a + np.frombuffer(r.m, np.float64).reshape(size, size), add, 2)


def _plus(a: tuple[int, list[int]], b: tuple[int, list[int]]) -> tuple[int, list[int]]:
    return a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)]


def remaining(df: DataFrame, vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(row, dim, x): rows of df whose vector is whole and finite; x holds its whole numbers."""
    others = [F.col(f"`{c}`") for c in df.columns if c != vector_col]
    packed = df.select(F.struct(*(others or [F.lit(0).alias("none")])).alias("row"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    schema = T.StructType([packed.schema["row"], *T.StructType.fromDDL("dim int, x binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keep, x = whole_numbers(part.column("v"), scale, offset)
                yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(keep)), pa.array([len(v) for v in x], pa.int32()), pa.array([_packed(v) for v in x], pa.binary())], names=schema.names)

    return packed.mapInArrow(run, schema)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learns from the distinct vectors of rows (dim, x); None if there are none.  What comes to the driver is the sums
    and one matrix."""
    listed = cut(rows.select("dim", "x").distinct())
    most = listed.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if most is None:
        return None
    dim = most.dim
    listed = listed.where(F.col("dim") == dim).select("x")
    sums = listed.mapInArrow(lambda b: _sum_rows(b, dim), "n long, total array<string>")
    n, total = sums.rdd.treeAggregate((0, [0] * dim), lambda a, r: _plus(a, (r.n, [int(t) for t in r.total])), _plus, 2)
    whole = np.array([s // n for s in total], np.int64)
    rest = np.array([s % n for s in total], np.int64)
    share = listed.mapInArrow(lambda b: _outer(b, lambda bs: (centred(x, n, whole, rest) for x in _blocks(bs, dim))), "m binary")
    v = _added(share, dim) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    few = min(components, dim)
    model = Whitening(n, whole, rest, values[::-1][:few].copy(), np.ascontiguousarray(vectors[:, ::-1][:, :few]), float(np.trace(v)))
    some = np.flatnonzero(~np.isnan(model.whitened(whole[None, :])[0]))
    if len(some):
        shared = listed.sparkSession.sparkContext.broadcast(model)
        measured = listed.mapInArrow(lambda b: _outer(b, lambda bs: (shared.value.whitened(x)[:, some] for x in _blocks(bs, dim))), "m binary")
        model.identity_error = float(np.abs(_added(measured, len(some)) / n - np.eye(len(some))).max())
    return model


def project(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """(row, deviation, whitened) of rows (row, dim, x) of the model's length; whitened has a number for each component."""
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("deviation long, whitened array<double>").fields])
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        most = max(1, BLOCK_BYTES // (8 * m.dim))
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                x = np.stack([_unpacked(b) for b in part.column("x").to_pylist()])
                w = m.whitened(x)
                flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(m.deviations(x), pa.int64()), lists], names=schema.names)

    return rows.where(F.col("dim") == model.dim).mapInArrow(run, schema)


def op13(spark, sf_dir: str) -> DataFrame:
    """Whole `embeddings`."""
    rows = remaining(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    model = fit(rows)
    made = project(rows, model)
    shares = [float(v) / model.trace if model.trace > 0 else None for v in model.values] if model else [None]
    explained = F.array(*(F.lit(s).cast("double") for s in shares))
    n, error = (model.n, model.identity_error) if model else (0, None)
    return made.select("row.vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, "at").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
