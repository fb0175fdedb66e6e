"""Whitening of embeddings by an exact integer scatter matrix.

Components become whole numbers, and the covariance is built of those alone: a shift (some vector of the list) is subtracted, each task
accumulates sums and cross-products of its vectors, which are added up exactly whatever their size, and n * X'X - S S' is formed
in integers. Only then does it become floating point, correctly rounded, and is decomposed by eigh. So neither the number of vectors nor their distance from
zero costs precision. Cross-products are matrix products of digits so small that doubles hold every sum.

The fit list has each distinct vector once. A vector is whitened from the integers n * x - S. What a task and the driver hold grows with the
square of the vectors' length (at most MAX_DIMENSIONS), not with their number.

Defined cases: null vectors and those with null or non-finite entries are dropped; entries beyond a long's range become the nearest
long; vectors of another length than the most frequent one among the distinct (of equals the shortest) are dropped; rows with a null or
repeated id are whitened each; directions of no more variance than 1e-11 of the largest are no components, so a list of
equal vectors has none; deviations beyond a long are the largest long; an empty table gives one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.llm.common import materialise, table
from volspark.llm.exact import exact_sums, nearest_longs, opened, rows_of, schema_of, total

MAX_DIMENSIONS = 8192
LEAST_SHARE = 1e-11
#: Digits of cross-products: 2^13 rows of two 20-bit digits stay under 2^53.
_DIGIT, _ROWS = 20, 1 << 13


def lattice_points(vector: Column, scale: int = 64, offset: int = 1_000_000) -> Column:
    """floor(scale * c) + offset of each entry; null where an entry is null or not finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    most = F.lit((1 << 63) - 1 - offset)
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda c: F.least(F.floor(c.cast("double") * scale), most) + F.lit(offset).cast("long")))


def _shifted(x: pa.Array, shift: np.ndarray) -> np.ndarray:
    """rows x dimensions less the shift, as int64, or as Python integers where that could overflow."""
    m = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
    if m.size and max(abs(int(m.max())), abs(int(m.min())), *(abs(int(s)) for s in shift)) >= 1 << 61:
        return m.astype(object) - shift.astype(object)
    return m - shift


def _digits(y: np.ndarray) -> list[np.ndarray]:
    """float64 digits of base 2^20, lowest first, the last one signed."""
    out = []
    while y.size and max(int(y.max()), -int(y.min())) >= 1 << _DIGIT:
        out.append((y & ((1 << _DIGIT) - 1)).astype(np.float64))
        y = y >> _DIGIT
    return [*out, y.astype(np.float64)]


class Scatter:
    """Sums and cross-products of whole numbers."""

    def __init__(self, dimensions: int):
        self.n, self.sums = 0, np.zeros(dimensions, object)
        self.cross: dict[int, np.ndarray] = {}  # by power of the digits' base
        self.late: dict[int, np.ndarray] = {}
        self.blocks = 0

    def add(self, y: np.ndarray) -> None:
        for a in range(0, len(y), _ROWS):
            part = _digits(y[a : a + _ROWS])
            self.n += len(part[0])
            for i, p in enumerate(part):
                self.sums += p.sum(axis=0).astype(np.int64).astype(object) << (_DIGIT * i)
                for j, q in enumerate(part):
                    product = (p.T @ q).astype(np.int64)
                    self.cross[i + j] = self.cross[i + j] + product if i + j in self.cross else product
            self.blocks += 1
            if self.blocks % 128 == 0:  # before 64-bit sums of products under 2^53 (four at most of one power) can overflow
                self._fold()

    def _fold(self) -> None:
        for k, m in self.cross.items():
            self.late[k] = self.late[k] + m.astype(object) if k in self.late else m.astype(object)
        self.cross = {}

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Row -1 has n and the sums, row i the cross-products of i and what follows."""
        self._fold()
        if self.n:
            yield rows_of({"i": [-1]}, [np.array([self.n, *self.sums], object)])
            for i in range(len(self.sums)):
                yield rows_of({"i": [i]}, [sum(m[i, i:] << (_DIGIT * k) for k, m in self.late.items())])


class Whitener:
    """Of a fit list: n, the shift, sums (of shifted vectors), the components' matrix and eigenvalues, and the trace."""

    def __init__(self, n: int, shift: np.ndarray, sums: list[int], covariance: np.ndarray, components: int):
        self.n, self.shift, self.sums = n, shift, np.array(sums, object)
        e, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-e, kind="stable")[:components]
        order = order[e[order] > LEAST_SHARE * max(e.max(initial=0.0), 0.0)]
        self.values, self.trace = e[order], float(np.trace(covariance))
        self.to = vectors[:, order] / np.sqrt(self.values)

    def __call__(self, x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Deviations and whitened vectors."""
        y = _shifted(x, self.shift)
        most = self.n * max(int(y.max()), -int(y.min())) + max(map(abs, self.sums)) if y.size else 0
        y = self.n * (y if most < 1 << 62 else y.astype(object)) - (self.sums.astype(np.int64) if most < 1 << 62 else self.sums)
        squares = y * y if most * most * max(1, y.shape[1]) < 1 << 63 else y.astype(object) * y.astype(object)
        centred = y.astype(np.float64) / self.n if y.dtype != object else np.array([[v / self.n for v in row] for row in y], np.float64)
        return nearest_longs(squares.sum(axis=1)), centred @ self.to


def fit(points: DataFrame, components: int = 16) -> tuple[Whitener | None, DataFrame]:
    """points: distinct x. The whitener of those of the most frequent length, and these."""
    size = points.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").where("d > 0").head()
    if size is None:
        return None, points
    d = size["d"]
    if d > MAX_DIMENSIONS:
        raise ValueError(f"a covariance of more than {MAX_DIMENSIONS} dimensions is not held in one place")
    own = points.where(F.size("x") == d)
    shift = np.array(own.select("x").head()["x"], np.int64)

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Scatter(d)
        for b in batches:
            held.add(_shifted(b.column(0), shift))
        yield from held.rows()

    n, sums, covariance = 0, [], np.zeros((d, d))
    rows = materialise(exact_sums(own.select("x").mapInArrow(accumulate, schema_of(["i"])), ["i"]), "scatter")
    n, *sums = total(opened(rows.where("i < 0").head()["sums"], rows.where("i < 0").head()["limbs"]))
    for r in rows.where("i >= 0").toLocalIterator():
        i = r["i"]
        for j, c in enumerate(total(opened(r["sums"], r["limbs"])), start=i):
            covariance[i, j] = covariance[j, i] = (n * c - sums[i] * sums[j]) / (n * n)  # of integers, correctly rounded
    return Whitener(n, shift, sums, covariance, components), own


def identity_error(points: DataFrame, whitener: Whitener) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    k = len(whitener.values)
    shared = points.sparkSession.sparkContext.broadcast(whitener)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k, k))
        for b in batches:
            z = shared.value(b.column(0))[1]
            held += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(held.ravel())], names=["at", "c"])

    found = points.select("x").mapInArrow(products, "at int, c double").groupBy("at").agg(F.sum("c").alias("c")).collect()  # k * k rows
    return float(max(abs(r["c"] / whitener.n - (r["at"] % (k + 1) == 0)) for r in found))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    base = vectors.select(F.col(id_col).alias(id_col), lattice_points(F.col(vector_col), scale, offset).alias("x")).where(F.col("x").isNotNull())
    whitener, points = fit(materialise(base.select("x").distinct(), "points"), components)
    if whitener is None or not len(whitener.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error, k = identity_error(points, whitener), len(whitener.values)
    shared = vectors.sparkSession.sparkContext.broadcast(whitener)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            deviation, z = w(b.column(1))
            row = np.repeat(np.arange(b.num_rows), k)
            columns = [b.column(0).take(pa.array(row)), np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows), np.full(len(row), w.n), deviation[row], z.ravel(), np.tile(w.values / w.trace, b.num_rows), np.full(len(row), error)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return base.where(F.size("x") == len(whitener.shift)).mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
