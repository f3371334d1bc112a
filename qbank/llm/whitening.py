"""Whitening of embeddings: covariances from exact variances of dimensions and of their pair sums, and their eigenvectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import cut, small_batches

#: An entry c counts as the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries of this size and more count as not finite: sums of their squares have no place in a decimal of 38 digits.
LARGEST = 2.0**30
#: Rows that are centred and squared at once, and rows that Arrow hands over at once: vectors of thousands of entries are large.
ROWS, PER_BATCH = 1024, 2048


@dataclass(frozen=True)
class Whitening:
    """What a fit holds: vectors taken, sums and centre of each dimension, covariance, and the components by falling eigenvalue.

    components has a row for each component; values are their eigenvalues, explained their shares of the trace.
    """

    n: int
    sums: list[int]
    centre: np.ndarray
    covariance: np.ndarray
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    @property
    def dimensions(self) -> int:
        return len(self.sums)


def usable(column: str) -> str:
    """SQL condition: not null and not empty, and every entry a finite number."""
    return f"size({column}) > 0 AND forall({column}, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < {LARGEST!r}D)"


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    """The whole numbers of a batch's vectors, some rows at a time; neighbouring rows of equal length together."""
    col = batch.column(column)
    sizes, flat = col.value_lengths().to_numpy(zero_copy_only=False), col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(SCALE * flat).astype(np.int64) + SHIFT
    begins = np.concatenate([[0], np.cumsum(sizes)])
    rows = np.concatenate([[0], np.flatnonzero(np.diff(sizes)) + 1, [len(sizes)]]) if len(sizes) else np.array([0])
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        for f in range(a, b, ROWS):
            e = min(b, f + ROWS)
            yield x[begins[f] : begins[e]].reshape(e - f, -1)


def _sums(vectors: DataFrame, column: str) -> DataFrame:
    """Rows (size, i, n, total): for each length of vectors how many there are and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for x in _matrices(b, column):
                n, s = held.get(x.shape[1], (0, np.zeros(x.shape[1], dtype=object)))
                held[x.shape[1]] = (n + len(x), s + x.sum(axis=0).astype(object))
        for d, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))],
                names=["size", "i", "n", "total"],
            )

    return vectors.select(column).mapInArrow(run, "size int, i int, n long, total decimal(38,0)").groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _squares(vectors: DataFrame, column: str, centre: np.ndarray) -> DataFrame:
    """Rows (i, j, total), i <= j: the exact sum of squares of centred dimension i, and for i < j of the sum of i and j."""
    d = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(d - i, dtype=object) for i in range(d)]
        for b in batches:
            for x in _matrices(b, column):
                y = np.ascontiguousarray((x - centre).T)
                if 4 * int(np.abs(y).max()) ** 2 * len(x) >= 1 << 62:
                    y = y.astype(object)
                for i in range(d):
                    z = y[i:] + y[i]
                    z[0] = y[i]
                    totals[i] += (z * z).sum(axis=1).astype(object)
        for i, t in enumerate(totals):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * (d - i), pa.int32()), pa.array(range(i, d), pa.int32()), pa.array([Decimal(int(v)) for v in t], pa.decimal128(38, 0))], names=["i", "j", "total"]
            )

    return vectors.select(column).mapInArrow(run, "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total"))


def _fitted(vectors: DataFrame, column: str) -> DataFrame:
    small_batches(vectors.sparkSession, PER_BATCH)
    return vectors.where(usable(column))


def fit(vectors: DataFrame, column: str = "embedding", components: int = 8) -> Whitening | None:
    """The whitening of all usable vectors; null if there is none.

    Entries become whole numbers; they are centred by the whole part of the mean, and the rest of the mean is taken off exactly
    when n * sum of squares - square of the sum is formed. Two passes: sums, then squares of every dimension and of every sum of
    two. The covariance of i and j is half of what the variance of their sum has over their own two variances; all of this is in
    whole numbers and rounded once. What comes to the driver is one number for each pair of dimensions, whatever the rows.

    Vectors that are null, empty or hold null or non-finite entries (or some of 2**30 and more) take no part. Where lengths
    differ, the commonest counts (the greater on ties). Components without variance cannot be whitened and are left out, so there
    may be fewer than asked for; the sign of each is such that its largest entry is positive.
    """
    rows = _fitted(vectors, column)
    sums = cut(_sums(rows, column))
    first = sums.where("i = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if first is None:
        return None
    n, d = first["n"], first["size"]
    s = [int(r["total"]) for r in sums.where(F.col("size") == d).orderBy("i").collect()]
    centre = np.array([t // n for t in s], dtype=np.int64)
    rest = [t - n * int(c) for t, c in zip(s, centre, strict=True)]  # sums of the centred numbers
    squares = {(r["i"], r["j"]): int(r["total"]) for r in _squares(rows.where(F.size(column) == d), column, centre).collect()}
    own = [n * squares[i, i] - rest[i] ** 2 for i in range(d)]
    cov = np.empty((d, d))
    for i in range(d):
        cov[i, i] = own[i] / n**2
        for j in range(i + 1, d):
            pair = n * squares[i, j] - (rest[i] + rest[j]) ** 2
            cov[i, j] = cov[j, i] = (pair - own[i] - own[j]) / (2 * n**2)
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs.T[::-1]
    kept = int((values[:components] > d * np.finfo(float).eps * max(values[0], 0)).sum())
    values, vecs = values[:kept], vecs[:kept]
    signs = np.sign(vecs[np.arange(kept), np.abs(vecs).argmax(axis=1)]) if kept else np.ones(0)
    return Whitening(n, s, centre, cov, values, vecs * signs[:, None], values / np.trace(cov) if kept else values)


def transform(vectors: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """The usable vectors with whitened (array<double>, a number for each component) and deviation (decimal: the exact sum over
    dimensions of (n * x - sum)**2) in place of column. Other columns pass through; those named like the new ones are replaced."""
    n, d, centre = model.n, model.dimensions, model.centre
    rest = np.array([t - n * int(c) for t, c in zip(model.sums, centre, strict=True)], dtype=object)
    shift = np.array([int(r) / n for r in rest])
    scaled = model.components.T / np.sqrt(model.values)
    width = scaled.shape[1]
    rows = _fitted(vectors, column).where(F.size(column) == d)
    gone = {column.lower(), "whitened", "deviation"}
    kept = [f for f in rows.schema.fields if f.name.lower() not in gone]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *T._parse_datatype_string("whitened array<double>, deviation decimal(38,0)").fields])
    kinds = {f.name: f.type for f in to_arrow_schema(schema)}
    least = int(np.abs(rest.astype(float)).max()) + 1 if d else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            white, deviation = [], []
            for x in _matrices(b, column):
                y = x - centre
                white.append((y - shift) @ scaled)
                small = (n * int(np.abs(y).max()) + least) ** 2 * d < 1 << 62
                z = n * (y if small else y.astype(object)) - (rest.astype(np.int64) if small else rest)
                deviation += [Decimal(int(v)) for v in (z * z).sum(axis=1)]
            flat = np.concatenate(white).ravel() if white else np.empty(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width) if width else np.zeros(b.num_rows + 1), pa.int32()), pa.array(flat, pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), lists.cast(kinds["whitened"]), pa.array(deviation, type=kinds["deviation"])], names=[*names, "whitened", "deviation"]
            )

    return rows.mapInArrow(run, schema)


def identity_error(whitened: DataFrame, width: int) -> float:
    """The largest absolute entry of the covariance of whitened's numbers (divisor n, centred) minus the identity."""
    at = lambda i: F.col("whitened")[i]
    pairs = [F.abs(F.covar_pop(at(i), at(j)) - (1.0 if i == j else 0.0)) for i in range(width) for j in range(i, width)]
    return whitened.agg(F.greatest(*pairs, F.lit(0.0)).alias("e")).first()["e"]


def whiten(vectors: DataFrame, column: str = "embedding", components: int = 8) -> DataFrame:
    """One row for each usable vector and component: the vector's other columns, component (from 1), n, deviation, whitened,
    explained, identity_error. No rows where no vector is usable or nothing varies. The whitened numbers are written to the shared
    folder, so the error is that of the very numbers returned."""
    own = [c for c in vectors.columns if c.lower() not in {column.lower(), "component", "n", "deviation", "whitened", "explained", "identity_error"}]
    model = fit(vectors.select(column), column, components)
    width = len(model.values) if model else 0
    if not width:
        empty = vectors.select(*own).limit(0)
        return empty.selectExpr("*", "1 AS component", "0L AS n", "cast(0 AS decimal(38,0)) AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    done = cut(transform(vectors.select(*own, column), model, column))
    error = identity_error(done, width)
    shares = F.array(*[F.lit(float(v)) for v in model.explained])
    long = done.select(*own, "deviation", F.posexplode("whitened").alias("_place", "_value"))
    return long.select(
        *own, (F.col("_place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("_value").alias("whitened"),
        F.get(shares, F.col("_place")).alias("explained"), F.lit(error).alias("identity_error"),
    )
