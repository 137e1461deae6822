"""Whitening of embeddings from an exact scatter matrix in residue numbers.

Integer vectors x, a one appended, are multiplied modulo several primes: in
blocks so small that a product of doubles is exact.  Each task gives its
residues, Spark adds them up, and Chinese remaindering of the sums gives the
exact scatter, the exact sums S and the number of vectors n.  The covariance
(n G - S S') / n^2 is rounded once, entry by entry, and goes to ``eigh`` in
doubles; no accuracy is lost to means that are large against the spread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Residues are below 2^20, so up to 2^13 products of two add up exactly in a double.
PRIME_LIMIT = 1 << 20
BLOCK = 4096
#: Groups in which the executors add up what tasks give.
PARTS = 64
_MOMENTS = "part int, n double, mean array<double>, m2 array<double>"


def integers(col: str, scale: int, shift: int) -> Column:
    """floor(scale c) + shift of every component, c as double."""
    return F.transform(F.col(col), lambda c: F.floor(F.lit(scale) * c.cast("double")) + F.lit(shift))


def matrix(column: pa.Array, dim: int, fill: int = 0) -> np.ndarray:
    """Rows of integer lists as int64; short rows end in ``fill``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(column), dim), fill, np.int64)
    start = np.cumsum(lengths) - lengths
    out[np.repeat(np.arange(len(column)), lengths), np.arange(lengths.sum()) - np.repeat(start, lengths)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def primes_for(bound: int) -> list[int]:
    """The largest primes under the limit, as many as tell all integers of [-bound, bound] apart."""
    out, product, p = [], 1, PRIME_LIMIT - 1
    while product <= 2 * bound:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            out, product = [*out, p], product * p
        p -= 2
    return out


def remainders(x: np.ndarray, primes: list[int]) -> dict[int, np.ndarray]:
    """x'x modulo each prime."""
    out = {}
    for p in primes:
        total = np.zeros((x.shape[1], x.shape[1]), np.int64)
        for at in range(0, len(x), BLOCK):
            r = np.mod(x[at : at + BLOCK], p).astype(np.float64)
            total = (total + (r.T @ r).astype(np.int64)) % p
        out[p] = total
    return out


def from_remainders(sums: dict[int, np.ndarray]) -> np.ndarray:
    """The integers of least size with these remainders, as Python integers."""
    value, product = 0, 1
    for p, r in sums.items():
        own = r.astype(object) % p
        value, product = value + product * ((own - value) * pow(product, -1, p) % p), product * p
    return np.where(value > product // 2, value - product, value)


@dataclass
class Whitening:
    """n, the sums of each dimension, the number subtracted before all else, and the components: rows of unit length, falling eigenvalues."""

    n: int
    sums: list[int]
    centre: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else self.values

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        y = x - self.centre
        rest = np.array([s - self.n * int(c) for s, c in zip(self.sums, self.centre, strict=True)], object)  # 0 to n - 1
        if self.n * (int(np.abs(y).max(initial=0)) + 1) < 1 << 62:
            return self.n * y - rest.astype(np.int64)
        return self.n * y.astype(object) - rest

    def rows(self, x: np.ndarray) -> np.ndarray:
        """The whitened components of each row."""
        return (self.deviations(x) / self.n).astype(np.float64) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    @staticmethod
    def squares(d: np.ndarray) -> list[int]:
        """The sum of squares of each row, exact."""
        if d.dtype != object and d.shape[1] * int(np.abs(d).max(initial=0)) ** 2 >= 1 << 63:
            d = d.astype(object)
        return (d * d).sum(axis=1).tolist()


def exact_scatter(vectors: DataFrame, column: str, n: int, dim: int, most: int, fill: int) -> np.ndarray:
    """Sum of (x, 1)(x, 1)' over all rows as Python integers; components are at most ``most`` in size, short rows end in ``fill``."""
    primes = primes_for(n * max(1, most) ** 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {p: np.zeros((dim + 1, dim + 1), np.int64) for p in primes}
        for b in batches:
            x = np.hstack([matrix(b.column(0), dim, fill), np.ones((b.num_rows, 1), np.int64)])
            total = {p: (total[p] + r) % p for p, r in remainders(x, primes).items()}
        for p, t in total.items():
            i, j = np.triu_indices(dim + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), p)), pa.array(i), pa.array(j), pa.array(t[i, j])], ["prime", "i", "j", "r"])

    parts = vectors.select(column).mapInArrow(run, "prime long, i long, j long, r long")
    got = parts.groupBy("prime", "i", "j").agg(F.sum("r").alias("r")).toPandas()  # as many rows as the triangles of the primes have entries
    sums = {}
    for p in primes:
        own, table = got[got["prime"] == p], np.zeros((dim + 1, dim + 1), np.int64)
        table[own["i"], own["j"]] = table[own["j"], own["i"]] = own["r"]
        sums[p] = table
    return from_remainders(sums)


def components_of(scatter: np.ndarray, components: int) -> Whitening:
    """Eigenvectors of the covariance; those without variance, to double precision, are left out."""
    dim = len(scatter) - 1
    n, s = int(scatter[dim, dim]), scatter[dim, :dim].tolist()
    v = np.array([[(n * scatter[i, j] - s[i] * s[j]) / (n * n) for j in range(dim)] for i in range(dim)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors.T[::-1]
    there = values > dim * np.finfo(float).eps * max(values[0], 0)
    values, vectors = values[there][:components], vectors[there][:components]
    largest = np.abs(vectors).argmax(axis=1)
    vectors = vectors * np.where(np.take_along_axis(vectors, largest[:, None], axis=1) < 0, -1.0, 1.0)
    return Whitening(n, s, np.array([t // n for t in s], np.int64), vectors, values, float(np.trace(v)))


def merged(a: tuple, b: tuple) -> tuple:
    """Number, mean and centred second moments of two sets of rows together."""
    n, gap = a[0] + b[0], b[1] - a[1]
    if not n:
        return a
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def identity_error(vectors: DataFrame, column: str, model: Whitening, fill: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    dim, k = len(model.sums), len(model.values)
    zero = (0.0, np.zeros(k), np.zeros((k, k)))

    def row(part: int, m: tuple) -> pd.DataFrame:
        return pd.DataFrame({"part": [part], "n": [m[0]], "mean": [m[1]], "m2": [m[2].ravel()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = zero
        for b in batches:
            w = model.rows(matrix(b.column(0), dim, fill))
            mean = w.mean(axis=0) if len(w) else np.zeros(k)
            total = merged(total, (float(len(w)), mean, (w - mean).T @ (w - mean)))
        context = TaskContext.get()
        yield pa.RecordBatch.from_pandas(row(context.partitionId() % PARTS if context else 0, total), schema=pa.schema([("part", pa.int32()), ("n", pa.float64()), ("mean", pa.list_(pa.float64())), ("m2", pa.list_(pa.float64()))]), preserve_index=False)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = zero
        for n, mean, m2 in zip(pdf["n"], pdf["mean"], pdf["m2"], strict=True):
            total = merged(total, (n, np.asarray(mean), np.asarray(m2).reshape(k, k)))
        return row(0, total)

    parts = vectors.select(column).mapInArrow(run, _MOMENTS).groupBy("part").applyInPandas(add, _MOMENTS).toPandas()  # PARTS rows at most
    total = add(parts)
    return float(np.abs(total["m2"].iloc[0].reshape(k, k) / total["n"].iloc[0] - np.eye(k)).max(initial=0))


def whiten(vectors: DataFrame, components: int = 32, fill: int = 0) -> DataFrame:
    """vec_id, n, deviation, whitened, explained, identity_error; a row for each row of ``vectors``.

    ``vectors``: vec_id and vector (array<long>, no nulls in it); other columns
    are not read.  All rows are fitted on and all are returned, also those with
    null or repeated ids and repeated vectors; rows with a null vector are
    dropped.  Short vectors count as ending in ``fill``.  ``whitened`` and
    ``explained`` (arrays of doubles) have an entry for each of the up to
    ``components`` components of largest variance; those without variance, to
    double precision, are no components, so equal vectors give empty arrays.
    ``deviation`` (decimal) is the exact sum of squares of n x - S.  The driver
    holds matrices of the size of the covariance.  The rows are read four times
    and nothing is written.  An empty table gives no rows.
    """
    vectors = vectors.where("vector is not null").select("vec_id", "vector")
    schema = "vec_id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim"), F.max(F.array_max("vector")).alias("high"), F.min(F.array_min("vector")).alias("low")).first()
    if not size["n"] or not size["dim"]:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, most = size["dim"], max(abs(size["high"]), abs(size["low"]), abs(fill))
    scatter = exact_scatter(vectors, "vector", size["n"], dim, most, fill)
    if scatter[dim, dim] != size["n"]:
        raise RuntimeError("the vectors changed while they were read")
    model = components_of(scatter, components)
    error = identity_error(vectors, "vector", model, fill)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * k, pa.int32()), pa.array(np.ascontiguousarray(a).ravel(), pa.float64()))
        for whole in batches:
            for b in (whole.slice(at, BLOCK) for at in range(0, whole.num_rows, BLOCK)):
                x = matrix(b.column("vector"), dim, fill)
                square = pa.array([Decimal(v) for v in model.squares(model.deviations(x))], pa.decimal128(38, 0))
                rows = len(x)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), pa.array([model.n] * rows, pa.int64()), square, lists(model.rows(x)), lists(np.tile(model.explained, (rows, 1))), pa.array([error] * rows, pa.float64())],
                    ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(run, schema)
