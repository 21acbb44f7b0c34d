"""Embedding whitening: distributed centred covariance, eigenvectors of the small matrix, projection broadcast to the rows.

Three passes over the vectors: exact integer sums, centred second moments, projection. All are narrow; between them only partial sums
travel, one set of at most d x d numbers for each task, added up by Spark by matrix entry. The driver sees one d x d matrix, whatever
the number of rows; the projection that the tasks get is as small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spectral import leading_components

#: An entry c counts as the integer floor(64 * c) + 1000000.
STEPS, LIFT = 64, 1_000_000

COMPONENTS = 32
#: An eigenvalue counts as zero below this share of the largest one for each dimension.
LEAST_SHARE = 1e-14
_ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """The fit: rows, exact sums, eigenvalues, unit components as rows, explained shares and the measured error of the whitened covariance."""

    rows: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None


def usable(embedding: Column) -> Column:
    """Neither null nor empty, and without null or non-finite entries."""
    return F.coalesce((F.size(embedding) > 0) & F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batch with their vectors as whole numbers; beyond the range of a long, its ends."""
    for begin in range(0, batch.num_rows, _ROWS):
        part = batch.slice(begin, _ROWS)
        entries = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        entries = entries.reshape(part.num_rows, -1)
        with np.errstate(over="ignore"):
            steps = np.floor(STEPS * entries)
        near = np.clip(steps, -(2.0**62), 2.0**62).astype(np.int64) + LIFT
        yield part, np.where(steps >= 2.0**62, np.iinfo(np.int64).max, np.where(steps <= -(2.0**62), np.iinfo(np.int64).min, near))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, and for each dimension the sums of the upper and lower 32 bits: exact, and far from the ends of a long."""
    n, total = 0, None
    for batch in batches:
        for _, x in _steps(batch):
            part = np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
            n, total = n + len(x), part if total is None else total + part
    if n:
        d = total.shape[1]
        yield pa.RecordBatch.from_pydict({"dimension": np.arange(d, dtype=np.int32), "high": total[0], "low": total[1], "n": np.full(d, n)})


def _centre(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The mean of each dimension as the nearest whole number and what is left of it."""
    whole = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(whole, np.int64), np.array([(s - n * m) / n for s, m in zip(sums, whole)])


def _centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """``x`` less the mean; whole numbers first, so that nothing is lost to the size of the mean."""
    if np.abs(x).max(initial=0) < 1 << 52 and np.abs(whole).max(initial=0) < 1 << 52:
        return (x - whole).astype(np.float64) - rest
    return (x.astype(object) - whole.astype(object)).astype(np.float64) - rest


def _moments(n: int, sums: tuple[int, ...], projection: np.ndarray | None):
    whole, rest = _centre(n, sums)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _steps(batch):
                y = _centred(x, whole, rest)
                y = y if projection is None else y @ projection
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            a, b = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"a": a.astype(np.int32), "b": b.astype(np.int32), "product": total[a, b]})
    return moments


def _covariance(vectors: DataFrame, n: int, sums: tuple[int, ...], projection: np.ndarray | None = None) -> np.ndarray:
    """The covariance, divisor n, of the centred vectors or of their projections."""
    partial = vectors.mapInArrow(_moments(n, sums, projection), "a int, b int, product double")
    size = len(sums) if projection is None else projection.shape[1]
    out = np.zeros((size, size))
    for r in partial.groupBy("a", "b").agg(F.sum("product").alias("product")).collect():
        out[r.a, r.b] = out[r.b, r.a] = r["product"] / n
    return out


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all rows of ``vectors`` (column ``embedding``: usable vectors of one length); None without rows."""
    totals = vectors.mapInArrow(_sums, "dimension int, high long, low long, n long").groupBy("dimension").agg(
        F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"), F.sum("n").alias("n")).orderBy("dimension").collect()
    if not totals:
        return None
    n, sums = int(totals[0].n), tuple((int(r.high) << 32) + int(r.low) for r in totals)
    covariance = _covariance(vectors, n, sums)
    values, found = leading_components(covariance, min(components, len(sums)))
    good = values > LEAST_SHARE * len(sums) * max(values[0], 0.0)
    values, found = values[good], found[good]
    error = None
    if len(values):
        error = float(np.abs(_covariance(vectors, n, sums, found.T / np.sqrt(values)) - np.eye(len(values))).max())
    return Whitening(n, sums, values, found, values / np.trace(covariance), error)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...], whole: np.ndarray) -> list[int | None]:
    """The sums of (n * x - S)^2, exact; null where one does not fit a long."""
    apart = [s - n * int(m) for s, m in zip(sums, whole)]
    if np.abs(x).max(initial=0) < 1 << 62 and np.abs(whole).max(initial=0) < 1 << 62:
        gap = x - whole
        most = n * int(np.abs(gap).max(initial=0)) + max(map(abs, apart))
        if most * most * len(sums) < 1 << 63:
            return ((n * gap - np.array(apart, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def _project(fit: Whitening):
    whole, rest = _centre(fit.rows, fit.sums)
    k = len(fit.values)
    projection = fit.components.T / np.sqrt(fit.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _steps(batch):
                rows = len(x)
                again = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column("vec_id").take(again), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows), "n": np.full(rows * k, fit.rows),
                    "deviation": pa.array(_deviations(x, fit.rows, fit.sums, whole), pa.int64()).take(again),
                    "whitened": (_centred(x, whole, rest) @ projection).ravel(), "explained": np.tile(fit.explained, rows),
                    "identity_error": np.full(rows * k, fit.identity_error)})
    return project


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable_vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, embedding`` (array<double>) of the usable rows; of vectors of several lengths, those of the commonest (ties: the longest)."""
    vectors = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("embedding")).where(usable(F.col("embedding")))
    lengths = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return vectors.where(F.size("embedding") == lengths[0].d) if lengths else vectors


def whiten(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable row and component.

    Rows whose vector is null or empty or holds null or non-finite entries go. An entry c becomes the whole number x = floor(64 * c) + 1000000;
    all remaining rows are the fit list: n rows, sums S. ``deviation`` is the sum of (n * x - S)^2 over the dimensions, exact (null where it
    does not fit a long). ``whitened`` is x - S / n along the component, a unit eigenvector of the covariance (divisor n), over the root
    of its eigenvalue; components are numbered from 1 by falling eigenvalue, at most ``components`` of them. ``explained`` is the eigenvalue's
    share of the trace, ``identity_error`` the largest absolute entry of the whitened rows' covariance less the identity, measured over all rows.

    Directions without variance (equal rows, a single row, constant dimensions) are no components, so a table of equal vectors gives no
    rows. Null ids and repeated rows are rows like others. Vectors of another length than the commonest share no covariance
    with the rest and go. Entries beyond the range of a long count as its ends. Other columns of the table don't matter.
    """
    vectors = usable_vectors(table, id_column, vector_column)
    fit = fit_whitening(vectors, components)
    if fit is None or not len(fit.values):
        return table.sparkSession.createDataFrame([], SCHEMA)
    return vectors.mapInArrow(_project(fit), SCHEMA)
