"""Embedding whitening by polarisation.

cov(a, b) = (var(a + b) - var(a) - var(b)) / 2, so the variance of every
dimension and of every sum of two dimensions gives the whole covariance. All
these variances are exact: entries are whole numbers, centred on the whole
part of their mean before they are squared, their squares add up without
rounding, and the rest of the mean is taken off in whole numbers too. Each
task sends one number for each pair of dimensions, so what is shuffled and
what the driver assembles for ``eigh`` grows with the dimensions only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import stored

#: Entries are counted in steps of 1 / SCALE.
SCALE = 256
#: Sums travel as two numbers, the lower one of so many bits.
LIMB = 62


@dataclass(frozen=True)
class Whitening:
    """Number and sums of the vectors fitted on, eigenvalues, and components over the root of their eigenvalue as columns."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    trace: float
    matrix: np.ndarray
    identity_error: float


def rounded(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x, the whole steps of each entry, of the rows whose vector has neither null nor non-finite entries."""
    value = F.col(vector).cast("array<double>")
    sound = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(value.isNotNull() & sound).select(
        F.col(vec_id).alias("vec_id"), F.transform(value, lambda c: F.floor(c * SCALE)).alias("x"))


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows; a shorter one ends in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def _whole(a: np.ndarray, limit: int) -> np.ndarray:
    """The same numbers, without a bound on their size if any reaches ``limit``."""
    return a.astype(object) if a.size and max(-int(a.min()), int(a.max())) >= limit else a


def _sums(a: np.ndarray) -> np.ndarray:
    """Exact sums of the columns, as Python's whole numbers."""
    if a.dtype == object:
        return a.sum(axis=0)
    return (a >> 32).sum(axis=0).astype(object) * 2**32 + (a & 0xFFFFFFFF).sum(axis=0).astype(object)


def _add_up(fit: DataFrame, width: int, dims: int, each: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Exact sums over all vectors of the ``width`` whole numbers that ``each`` gives for a block of them."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                total = total + each(_rows(batch.column("x").slice(at, 2048), dims))
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()),
                                          "high": pa.array([int(t) >> LIMB for t in total], pa.decimal128(38, 0)),
                                          "low": pa.array([int(t) & (2**LIMB - 1) for t in total], pa.decimal128(38, 0))})

    parts = fit.mapInArrow(add, "i int, high decimal(38,0), low decimal(38,0)").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    out = [0] * width
    for r in parts.collect():
        out[r.i] = (int(r.high) << LIMB) + int(r.low)
    return out


def _covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of x with divisor n, each entry rounded once."""
    dims = len(sums)
    middle = np.array([s // n for s in sums], object)
    rest = [s - n * int(m) for s, m in zip(sums, middle, strict=True)]

    def squares(x: np.ndarray) -> np.ndarray:
        small = all(abs(int(m)) < 2**61 for m in middle)
        u = _whole(_whole(x, 2**61) - (middle.astype(np.int64) if small else middle), 2**30)
        out = [_sums(u * u)]
        for i in range(dims - 1):
            both = u[:, i : i + 1] + u[:, i + 1 :]
            out.append(_sums(both * both))
        return np.concatenate(out)

    found = _add_up(fit, dims * (dims + 1) // 2, dims, squares)
    single = [n * found[i] - rest[i] ** 2 for i in range(dims)]
    out, at = np.empty((dims, dims)), dims
    for i in range(dims):
        out[i, i] = Fraction(single[i], n * n)
        for j in range(i + 1, dims):
            out[i, j] = out[j, i] = Fraction(n * found[at] - (rest[i] + rest[j]) ** 2 - single[i] - single[j], 2 * n * n)
            at += 1
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact."""
    s = np.array(sums, object)
    if x.size and n * max(-int(x.min()), int(x.max())) < 2**61 and max(map(abs, sums)) < 2**61:
        return x * n - s.astype(np.int64)
    return x.astype(object) * n - s


def _identity_error(fit: DataFrame, n: int, sums: list[int], matrix: np.ndarray) -> float:
    dims, k = matrix.shape

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                w = (_centred(_rows(batch.column("x").slice(at, 2048), dims), n, sums) / n).astype(np.float64) @ matrix
                first += w.sum(axis=0)
                second += w.T @ w
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(k + k * k), pa.int32()), "v": np.concatenate([first, second.ravel()])})

    rows = fit.mapInArrow(moments, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    v = np.array([r.v for r in rows]) / n
    return float(np.abs(v[k:].reshape(k, k) - np.outer(v[:k], v[:k]) - np.eye(k)).max())


def fit(rows: DataFrame, components: int = 4) -> Whitening | None:
    """Whitening fitted on each distinct x of ``rounded`` rows once; None if there is nothing to fit."""
    dims = rows.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return None
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    lists = stored(rows.select(padded.alias("x")).distinct(), "vectors")
    n = lists.count()
    sums = _add_up(lists, dims, dims, lambda x: _sums(_whole(x, 2**61)))
    covariance = _covariance(lists, n, sums)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int(min(components, (values > max(values[0], 0) * dims * np.finfo(float).eps).sum()))
    if not k:
        return None
    matrix = vectors[:, :k] / np.sqrt(values[:k])
    return Whitening(n, sums, values[:k].copy(), float(np.trace(covariance)), matrix, _identity_error(lists, n, sums, matrix))


def whiten(vectors: DataFrame, components: int = 4, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each sound vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries have no rows; others are kept whatever their id, repeated
    rows and null ids too. A vector shorter than the longest counts as ending in zeros. Equal vectors are fitted once.
    Directions without variance are no components, so a table that is empty, has one distinct vector or only empty ones
    gives no rows. A deviation beyond a long is null. Other columns are not looked at.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rounded(vectors, vec_id, vector)
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims, k = model.matrix.shape
    explained = model.eigenvalues / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                centred = _centred(_rows(part.column("x"), dims), model.n, model.sums)
                whole = _whole(centred, int((2**62 / dims) ** 0.5))
                deviation = [v if v < 2**63 else None for v in (whole * whole).sum(axis=1).tolist()]
                scores = (centred / model.n).astype(np.float64) @ model.matrix
                each = np.repeat(np.arange(len(scores)), k)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column("vec_id").cast(pa.int64()).take(pa.array(each)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(scores))),
                    "n": pa.array(np.full(len(each), model.n, np.int64)),
                    "deviation": pa.array(deviation, pa.int64()).take(pa.array(each)),
                    "whitened": scores.ravel(),
                    "explained": np.tile(explained, len(scores)),
                    "identity_error": np.full(len(each), model.identity_error)})

    return rows.mapInArrow(project, schema)
