"""Whitening of embeddings by merged moments.

Each partition computes its rows' count, mean and scatter about that mean; two such moments are merged by Chan's formula, in a
tree over the executors. The covariance's eigenvectors, a d x d matter, are found on the driver. A second pass projects all rows
and takes the moments of the result, whose covariance has to be the identity.

Entries are made integers first, so that sums over rows are exact however they are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entry c becomes the integer floor(SCALE * c) + SHIFT, the floor held within +-LIMIT.
SCALE, SHIFT, LIMIT = 64, 1_000_000, 1 << 40
COMPONENTS = 32
#: Eigenvalues up to this share of the largest, for each dimension, are noise: their components are left out.
NOISE = 1e-14


def usable(vector: Column) -> Column:
    """True for vectors that aren't null and hold neither null nor non-finite entries."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _padded(a: np.ndarray, d: int) -> np.ndarray:
    return np.pad(a, [(0, d - s) for s in a.shape])


@dataclass
class Moments:
    """Of n rows: sums (exact for integers), mean, and scatter (the sum of products of the rows less the mean). Rows of fewer
    dimensions than others count as padded with zeros."""

    n: int
    sums: list
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        n, d = rows.shape
        if not n:
            return cls(0, [0] * d, np.zeros(d), np.zeros((d, d)))
        if rows.dtype.kind == "i":
            sums = rows.sum(axis=0).tolist() if n * int(np.abs(rows).max(initial=0)) < 1 << 62 else [sum(c) for c in rows.T.tolist()]
            mean = np.array([s / n for s in sums], float)
        else:
            mean = rows.mean(axis=0)
            sums = (mean * n).tolist()
        centred = rows - mean
        return cls(n, sums, mean, centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        """Chan's formula: the scatters, and what lies between the two means."""
        if not self.n or not other.n:
            return self if self.n else other
        d = max(len(self.sums), len(other.sums))
        n = self.n + other.n
        pad = lambda s: s + [0] * (d - len(s))
        sums = [a + b for a, b in zip(pad(self.sums), pad(other.sums), strict=True)]
        between = _padded(other.mean, d) - _padded(self.mean, d)
        scatter = _padded(self.scatter, d) + _padded(other.scatter, d) + np.outer(between, between) * (self.n * other.n / n)
        return Moments(n, sums, np.array([s / n for s in sums], float), scatter)


@dataclass(frozen=True)
class Whitening:
    """What apply() needs. sums are of the integers without SHIFT; components are rows, by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float


def _integers(column: pa.Array, d: int | None = None) -> np.ndarray:
    """A row for each vector: floor(SCALE * c); as wide as the longest, or d."""
    column = column.cast(pa.large_list(pa.float64()))
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    value = column.flatten().to_numpy(zero_copy_only=False)
    d = int(size.max(initial=0)) if d is None else d
    with np.errstate(over="ignore"):
        made = np.clip(np.floor(SCALE * value), -LIMIT, LIMIT).astype(np.int64)
    if (size == d).all():
        return made.reshape(len(size), d)
    out = np.zeros((len(size), d), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(made)) - np.repeat(np.cumsum(size) - size, size)] = made
    return out


def moments(vectors: DataFrame, rows_of) -> Moments:
    """The moments of all rows: rows_of makes an array of a batch's `v` column. Partitions meet in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Moments.of(np.zeros((0, 0)))
        for batch in batches:
            out = out.merged(Moments.of(rows_of(batch.column("v"))))
        d = len(out.sums)
        flat = [pa.array([x], t) for x, t in ((out.n, pa.int64()), ([str(s) for s in out.sums], pa.list_(pa.string())), (out.mean.tobytes(), pa.binary()), (out.scatter.tobytes(), pa.binary()), (d, pa.int32()))]
        yield pa.RecordBatch.from_arrays(flat, names=["n", "sums", "mean", "scatter", "d"])

    exact = vectors.select("v").mapInArrow(run, "n long, sums array<string>, mean binary, scatter binary, d int")
    parts = exact.rdd.map(lambda r: Moments(r.n, [float(s) if "." in s or "e" in s or "n" in s else int(s) for s in r.sums], np.frombuffer(r.mean), np.frombuffer(r.scatter).reshape(r.d, r.d)))
    return parts.treeReduce(Moments.merged) if parts.getNumPartitions() else Moments.of(np.zeros((0, 0)))


def _kept(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    kept = vectors.where(usable(F.col(f"`{vector_column}`")))
    return kept.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v"))


def _whitened(x: np.ndarray, n: int, sums: tuple, values: np.ndarray, components: np.ndarray) -> np.ndarray:
    return (x - np.array([s / n for s in sums])) @ (components / np.sqrt(values)[:, None]).T


def fit(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors; None if there is none.

    Components are unit eigenvectors of the covariance (divisor n) by falling eigenvalue, their largest entry positive. There are
    as many as asked for, or as the covariance's rank if that is less: constant or repeated dimensions have none, nor has a single
    vector. explained is an eigenvalue's share of the trace. Vectors shorter than the longest count as padded with zeros.
    """
    rows = _kept(vectors, id_column, vector_column)
    found = moments(rows, _integers)
    if not found.n:
        return None
    d = len(found.sums)
    value, vector = np.linalg.eigh(found.scatter / found.n)
    value, vector = value[::-1], vector.T[::-1]
    keep = np.flatnonzero(value > NOISE * d * value.max(initial=0))[:components] if d else np.zeros(0, int)
    value, vector, trace = value[keep], vector[keep], float(np.trace(found.scatter)) / found.n
    vector = vector * np.sign(np.take_along_axis(vector, np.abs(vector).argmax(axis=1)[:, None], 1)) if len(keep) else vector
    n, sums = found.n, tuple(found.sums)
    error = 0.0
    if len(keep):
        check = moments(rows, lambda v: _whitened(_integers(v, d), n, sums, value, vector))
        error = float(np.abs(check.scatter / check.n - np.eye(len(keep))).max())
    return Whitening(n, sums, value, vector, value / trace if len(keep) else value, error)


def deviations(x: np.ndarray, n: int, sums: tuple) -> list[int | None]:
    """The sum over dimensions of (n * x - S)**2 for each row, exact; None where it doesn't fit into 64 bits."""
    bound = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if bound * bound * max(1, x.shape[1]) < 1 << 63:
        far = n * x - np.array(sums, np.int64)
        return (far * far).sum(axis=1).tolist()
    exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def apply(vectors: DataFrame, model: Whitening, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, deviation (see deviations()) and whitened (an array, an entry for each component) of each usable vector."""
    d, n, sums, values, components = len(model.sums), model.n, model.sums, model.values, model.components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch.column("v"), d)
            w = _whitened(x, n, sums, values, components) if len(values) else np.zeros((len(x), 0))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviations(x, n, sums), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], names=["vec_id", "deviation", "whitened"])

    return _kept(vectors, id_column, vector_column).mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """A row for each usable vector and component, from 1: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are left out; null ids, ties and repeated rows are rows like others.
    Entries beyond LIMIT / SCALE count as that. Without usable vectors, or where all are equal, there are no rows. Other columns
    are ignored.
    """
    model = fit(vectors, components, id_column, vector_column)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = apply(vectors, model, id_column, vector_column).select("vec_id", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    share = F.get(F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>"), F.col("pos"))
    return rows.select("vec_id", (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
