"""Whitening of embeddings by mixed-precision refinement (operator 12).

1. One pass adds up the whole-number forms floor(64 c) of all components, exactly. (The constant that a caller adds to them
   cancels in everything below, so it is left out and no digits are lost to it.)
2. A second pass centres every vector at the exact mean, then multiplies: each task keeps its count, mean and centred
   products, and a tree of merges makes the covariance.
3. Its eigenvectors in float32 are the start of Ogita-Aishima refinement in extended precision: each round corrects all
   vectors at once by a few matrix products, from the residuals of orthogonality and of the diagonal form. Eigenvalues closer
   than the residuals allow to tell apart are a cluster; the small problem of the cluster's own plane, shifted by
   its mean eigenvalue, is solved apart, after which the next rounds see the gaps.
4. A third pass whitens all vectors and merges the covariance of the result, whose distance to the identity is reported
   with each row by the fourth.

The driver holds a mean, a covariance and the components per vector length; nothing there grows with the rows.

Rows whose vector is null, empty, or holds null or non-finite entries, or entries of 2^53 / 64 and more (which have no exact
whole-number form), take no part. Vectors of different lengths are fitted apart. A null id is passed on; repeated rows count
and are returned each; ties of eigenvalues give some orthonormal basis of their plane. Components without variance cannot be
whitened and are left out, so n = 1 gives no rows. A deviation that does not fit a long is null. Other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cautela.llm.common import Scratch
from cautela.llm.vector_blocks import matrix, usable

SCALE, LARGEST = 64, 2.0**53
COMPONENTS, ROUNDS, FAN_IN = 32, 16, 16
#: Share of the largest eigenvalue below which one counts as zero.
RANK = 1e-13
#: Vectors centred or whitened at once.
ROWS = 2048
WIDE = np.longdouble
PARTS = "dim int, n long, mean binary, products binary"
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Moments:
    """Count, mean and centred products of rows, which merge without loss."""

    def __init__(self, dim: int):
        self.n, self.mean, self.products = 0, np.zeros(dim, WIDE), np.zeros((dim, dim), WIDE)

    def add(self, rows: np.ndarray) -> None:
        mean = rows.mean(axis=0)
        centred = rows - mean
        self.merge(len(rows), mean.astype(WIDE), (centred.T @ centred).astype(WIDE))

    def merge(self, n: int, mean: np.ndarray, products: np.ndarray) -> None:
        if n:
            total, apart = self.n + n, mean - self.mean
            self.products += products + np.outer(apart, apart) * (WIDE(self.n) * n / total)
            self.mean += apart * (WIDE(n) / total)
            self.n = total

    def covariance(self) -> np.ndarray:
        return self.products / self.n


def _packed(values: np.ndarray) -> bytes:
    """Extended numbers as pairs of doubles."""
    high = values.astype(np.float64)
    return np.stack([high, (values - high).astype(np.float64)]).tobytes()


def _unpacked(raw: bytes, *shape: int) -> np.ndarray:
    high, low = np.frombuffer(raw, np.float64).reshape(2, *shape)
    return high.astype(WIDE) + low


def _parts(found: dict[int, Moments]) -> Iterator[pa.RecordBatch]:
    for key, m in found.items():
        columns = [pa.array([key], pa.int32()), pa.array([m.n], pa.int64())]
        columns += [pa.array([_packed(x)], pa.binary()) for x in (m.mean, m.products)]
        yield pa.RecordBatch.from_arrays(columns, ["dim", "n", "mean", "products"])


def merged(parts: DataFrame, lengths: int, scratch: Scratch, width: Callable[[int], int]) -> dict[int, Moments]:
    """Moments per vector length from the tasks' parts, ``FAN_IN`` of them at a time; ``width`` gives their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for batch in batches:
            for row in batch.to_pylist():
                size = width(row["dim"])
                into = found.setdefault(row["dim"], Moments(size))
                into.merge(row["n"], _unpacked(row["mean"], size), _unpacked(row["products"], size, size))
        yield from _parts(found)

    saved = scratch.save(parts)
    count = saved.count()
    while count > lengths:
        saved = scratch.save(saved.repartition(-(-count // FAN_IN)).mapInArrow(run, PARTS))
        count = saved.count()
    found = {}
    for row in saved.collect():  # one row per vector length
        size = width(row.dim)
        found[row.dim] = into = Moments(size)
        into.merge(row.n, _unpacked(row["mean"], size), _unpacked(row.products, size, size))
    return found


@dataclass
class Centre:
    """Exact mean of whole-number vectors: ``floor`` + ``rest`` / n, all Python integers."""

    n: int
    floor: list[int]
    rest: list[int]

    def shifted(self, whole: np.ndarray) -> np.ndarray:
        return whole - np.array(self.floor, np.int64)

    def centred(self, whole: np.ndarray) -> np.ndarray:
        return self.shifted(whole) - np.array([r / self.n for r in self.rest])

    def deviations(self, whole: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2; None beyond a long."""
        shifted = self.shifted(whole)
        reach = self.n * (int(np.abs(shifted).max(initial=0)) + 1)
        if reach * reach * whole.shape[1] < 1 << 63:
            apart = self.n * shifted - np.array(self.rest, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        sums = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest, strict=True)) for row in shifted.tolist()]
        return [x if x < 1 << 63 else None for x in sums]


@dataclass
class Components:
    """Unit vectors as columns, their variances, and the share of each in the trace."""

    vectors: np.ndarray
    variances: np.ndarray
    shares: np.ndarray

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred @ self.vectors) / np.sqrt(self.variances)


def clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Positions of values that neighbours no more than ``apart`` away chain together, two at least."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > apart) + 1
    return [group for group in np.split(order, cuts) if len(group) > 1]


def refined(symmetric: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of a symmetric matrix in extended precision, from rough eigenvectors."""
    a, x, one = symmetric.astype(WIDE), vectors.astype(WIDE), np.eye(len(symmetric), dtype=WIDE)
    norm, last = np.sqrt((a * a).sum()), np.inf
    for _ in range(ROUNDS):
        skew = one - x.T @ x
        form = x.T @ (a @ x)
        form = (form + form.T) / 2  # rounding must not tilt the correction of close values
        values = np.diag(form) / (1 - np.diag(skew))
        residual = form - np.diag(values)
        apart = 2 * (np.sqrt((residual * residual).sum()) + norm * np.sqrt((skew * skew).sum()))
        if apart <= 64 * np.finfo(WIDE).eps * norm or apart > last / 1.5 and apart <= 1e-15 * norm:
            break
        last, gap = apart, values[None, :] - values[:, None]
        near = np.abs(gap) <= apart
        correction = np.where(near, skew / 2, (form + values[None, :] * skew) / np.where(near, 1, gap))
        x = x + x @ correction
        for group in clusters(values, apart):
            plane, middle = x[:, group], values[group].mean()
            small = plane.T @ (a @ plane - middle * plane)
            small = (small + small.T) / 2
            size = np.abs(small).max()
            if size > 0:
                x[:, group] = plane @ np.linalg.eigh((small / size).astype(np.float64))[1].astype(WIDE)
    for _ in range(2):  # what sub-solves left of skewness lies within their planes
        x = x + x @ (one - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def components(covariance: np.ndarray, most: int) -> Components:
    """The ``most`` strongest components with variance, the largest entry of each vector positive."""
    trace, size = np.trace(covariance), np.abs(covariance).max()
    if size == 0:
        return Components(np.empty((len(covariance), 0)), np.empty(0), np.empty(0))
    rough = np.linalg.eigh((covariance / size).astype(np.float32))[1]
    values, vectors = refined(covariance / size, rough)
    kept = np.flatnonzero(values > RANK * values[0])[:most]
    vectors = vectors[:, kept]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(kept))])
    values = values[kept] * size
    return Components(vectors.astype(np.float64), values.astype(np.float64), (values / trace).astype(np.float64))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole-number vectors of one length."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            lengths = part.column("vec").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                at = pa.array(np.flatnonzero(lengths == dim))
                vectors = matrix(part.column("vec").take(at), dim)
                yield part.column("id").take(at), np.floor(SCALE * vectors).astype(np.int64)


def _centres(rows: DataFrame) -> dict[int, Centre]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        totals: dict[int, list[int]] = {}
        for ids, whole in _whole(batches):
            dim = whole.shape[1]
            safe = int(np.abs(whole).max(initial=0)) * len(ids) < 1 << 62
            sums = whole.sum(axis=0).tolist() if safe else whole.astype(object).sum(axis=0).tolist()
            counts[dim] = counts.get(dim, 0) + len(ids)
            totals[dim] = [a + b for a, b in zip(totals[dim], sums, strict=True)] if dim in totals else sums
        for dim, sums in totals.items():
            columns = [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([counts[dim]] * dim, pa.int64())]
            # A decimal holds any sum of longs exactly.
            columns.append(pa.array(sums, pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays(columns, ["dim", "place", "n", "total"])

    sums = rows.select("id", "vec").mapInArrow(run, "dim int, place int, n long, total decimal(38,0)")
    found: dict[int, Centre] = {}
    for row in sums.groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim", "place").collect():
        floor, rest = divmod(int(row.total), row.n)
        one = found.setdefault(row.dim, Centre(row.n, [], []))
        one.floor.append(floor)
        one.rest.append(rest)
    return found


def whiten(df: DataFrame, k: int = COMPONENTS, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per vector and component (see ``RESULT``)."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "whitening")
    large = lambda x: F.abs(x.cast("double")) >= LARGEST / SCALE
    named = df.select(df[row_id].cast("long").alias("id"), df[vector].alias("vec"))
    named = named.filter(usable(F.col("vec")) & ~F.exists("vec", large)).select("id", F.col("vec").cast("array<double>").alias("vec"))
    centres = spark.sparkContext.broadcast(_centres(named))  # a mean per vector length

    def covariance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for _, whole in _whole(batches):
            dim = whole.shape[1]
            found.setdefault(dim, Moments(dim)).add(centres.value[dim].centred(whole))
        yield from _parts(found)

    lengths = len(centres.value)
    fitted = merged(named.mapInArrow(covariance, PARTS), lengths, scratch, lambda dim: dim)
    model = {dim: components(m.covariance(), k) for dim, m in fitted.items()}
    model = {dim: c for dim, c in model.items() if len(c.variances)}
    basis = spark.sparkContext.broadcast(model)  # k vectors per vector length

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for _, whole in _whole(batches):
            dim = whole.shape[1]
            if dim in basis.value:
                rows = basis.value[dim].whitened(centres.value[dim].centred(whole))
                found.setdefault(dim, Moments(rows.shape[1])).add(rows)
        yield from _parts(found)

    widths = {dim: len(c.variances) for dim, c in model.items()}
    checked = merged(named.mapInArrow(second, PARTS), len(model), scratch, widths.__getitem__)
    errors = {dim: float(np.abs(m.covariance() - np.eye(widths[dim])).max()) for dim, m in checked.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, whole in _whole(batches):
            dim = whole.shape[1]
            if dim not in basis.value:
                continue
            centre, basis_, width = centres.value[dim], basis.value[dim], widths[dim]
            rows = basis_.whitened(centre.centred(whole))
            each = np.repeat(np.arange(len(ids)), width)
            size = len(each)
            columns = [
                ids.take(pa.array(each)),
                pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(ids))),
                pa.array(np.full(size, centre.n, np.int64)),
                pa.array(centre.deviations(whole), pa.int64()).take(pa.array(each)),
                pa.array(rows.ravel()),
                pa.array(np.tile(basis_.shares, len(ids))),
                pa.array(np.full(size, errors[dim])),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            )

    return named.mapInArrow(run, RESULT)
