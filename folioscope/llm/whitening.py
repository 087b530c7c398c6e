"""Whitening of vectors by the eigenvectors of their covariance, found with cyclic Jacobi rotations.

Entries become whole numbers, floor(256 * c). Each distinct vector counts once in the fit: sums are exact, and every vector is
centred with them (n * x - S, exact too) before products are summed on the executors. The driver gets the sums and the
covariance, whose size depends on the number of dimensions alone, rotates the covariance until nothing is left off its
diagonal, and sends the whitening matrix to the tasks. Jacobi rotations keep the relative accuracy of small eigenvalues,
which the whitening divides by. A last pass over the fit measures the whitened covariance.

Vectors travel as packed integers of 1, 2, 4 or 8 bytes, the fewest that all entries of a vector fit in, so equal vectors are
equal bytes; copies are merged before the shuffle.

Defined results: rows without vector, or with a null, non-finite or empty one, or with an entry that leaves the range of a long, take no part;
nor do vectors that are not of the most frequent length (the greatest of several). Repeated rows and null ids are whitened
alike. Components whose eigenvalue is zero up to rounding have null as whitened value, and are left out of ``identity_error``; with a total
variance of zero, ``explained`` and ``identity_error`` are null. ``deviation`` is null where it leaves the range of a long. An
empty table gives an empty one; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE = 256.0
COMPONENTS = 4
#: Rows of a centred block.
BLOCK = 4096
_WIDTHS = ("<i1", "<i2", "<i4", "<i8")


def packed(x: np.ndarray) -> list[bytes]:
    """Each row of whole numbers in the fewest bytes an entry; the number of entries comes first, so lengths stay apart."""
    least, most = (x.min(1), x.max(1)) if x.shape[1] else (np.zeros(len(x)), np.zeros(len(x)))
    head = np.int32(x.shape[1]).tobytes()
    out: list[bytes] = [b""] * len(x)
    todo = np.ones(len(x), bool)
    for kind in _WIDTHS:
        info = np.iinfo(kind)
        fits = todo & (least >= info.min) & (most <= info.max)
        block = x[fits].astype(kind)
        for i, row in zip(np.flatnonzero(fits).tolist(), block, strict=True):
            out[i] = head + row.tobytes()
        todo &= ~fits
    return out


def unpacked(blobs: list) -> np.ndarray:
    """Rows of one length as 64-bit integers."""
    size = int(np.frombuffer(blobs[0], "<i4", 1)[0])
    out = np.empty((len(blobs), size), np.int64)
    for i, blob in enumerate(blobs):
        out[i] = np.frombuffer(blob, f"<i{(len(blob) - 4) // size}", size, 4)
    return out


def whole_numbers(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, size, x of the rows that take part."""

    def run(stream):
        for batch in stream:
            lists = batch.column("v").cast(pa.list_(pa.float64()))
            start, stop = lists.offsets[:-1].to_numpy(), lists.offsets[1:].to_numpy()
            values = lists.values
            flat = values.to_numpy(zero_copy_only=False)  # nulls become nan
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(SCALE * flat) + 0.0
            bad = np.concatenate([[0], np.cumsum(~(np.isfinite(flat) & (x >= -(2.0**63)) & (x < 2.0**63)))])
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            size = stop - start
            good = valid & (size > 0) & (bad[stop] == bad[start])
            for n in np.unique(size[good]).tolist():
                at = np.flatnonzero(good & (size == n))
                block = x[start[at][:, None] + np.arange(n)].astype(np.int64)
                yield pa.record_batch({"vec_id": batch.column("id").take(pa.array(at)).cast(pa.int64()), "size": pa.array(np.full(len(at), n, np.int32)), "x": pa.array(packed(block), pa.binary())})

    given = rows.select(F.col(vec_id).alias("id"), F.col(vector).alias("v")).filter(F.col("v").isNotNull())
    return given.mapInArrow(run, "vec_id long, size int, x binary")


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S: 64-bit integers where they fit, else Python's."""
    most = n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, sums))
    if most < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(y: np.ndarray) -> list[int | None]:
    """Exact sum of squares of each row; null where it is no long."""
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 2**63:
        return (y * y).sum(1).tolist()
    sums = [sum(v * v for v in row) for row in y.tolist()]
    return [s if s < 2**63 else None for s in sums]


def rotations(a: np.ndarray, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix, by cyclic Jacobi rotations.

    A sweep visits every pair of dimensions; it ends when no element off the diagonal counts against the two on it. A
    vector's sign makes its largest entry positive.
    """
    a, v = a.astype(float).copy(), np.eye(len(a))
    tiny = np.finfo(float).tiny
    for _ in range(most):
        turned = False
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                off = a[p, q]
                if abs(off) <= tiny or abs(off) <= 1e-17 * np.sqrt(abs(a[p, p])) * np.sqrt(abs(a[q, q])):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                for m in (a, v):
                    left, right = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = c * left - s * right, s * left + c * right
                upper, lower = a[p].copy(), a[q].copy()
                a[p], a[q] = c * upper - s * lower, s * upper + c * lower
                a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    e = np.diag(a)
    order = np.argsort(-e, kind="stable")
    e, v = e[order], v[:, order]
    v = v / np.sqrt((v * v).sum(0))
    return e, v * np.where(v[np.abs(v).argmax(0), np.arange(len(e))] < 0, -1.0, 1.0)


@dataclass
class Whitening:
    """n distinct vectors with sums S; eigenvalues and eigenvectors of their covariance; how many eigenvalues are above zero."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    rank: int
    explained: list[float | None]
    identity_error: float | None = None

    def __call__(self, y: np.ndarray, components: int) -> np.ndarray:
        """Whitened values of centred vectors (n * x - S), for the first components; nan beyond the rank."""
        k = min(components, self.rank)
        out = np.full((len(y), components), np.nan)
        out[:, :k] = (y.astype(float) / self.n) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))
        return out


def _summed_products(fit: DataFrame, n: int, sums: list[int], size: int, project) -> np.ndarray:
    """Sum over the fit of the outer product of ``project(n * x - S)`` with itself: a partial matrix per task, of which the
    upper triangle is summed by place; the driver gets one number for each place."""

    def run(stream):
        total = np.zeros((size, size))
        for batch in stream:
            for i in range(0, batch.num_rows, BLOCK):
                w = project(centred(unpacked(batch.column("x").slice(i, BLOCK).to_pylist()), n, sums))
                total += w.T @ w
        at = np.triu_indices(size)
        yield pa.record_batch({"i": pa.array(at[0].astype(np.int32)), "j": pa.array(at[1].astype(np.int32)), "v": pa.array(total[at])})

    out = np.zeros((size, size))
    for r in fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def fit(vectors: DataFrame) -> Whitening | None:
    """From ``whole_numbers``; None where no row takes part."""
    sizes = vectors.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not sizes:
        return None
    size = sizes[0]["size"]
    distinct = written(vectors.filter(F.col("size") == size).select("x").distinct(), "whitening-fit")

    def totals(stream):
        n, total = 0, [0] * size
        for batch in stream:
            for i in range(0, batch.num_rows, BLOCK):
                x = unpacked(batch.column("x").slice(i, BLOCK).to_pylist())
                n += len(x)
                exact = np.abs(x).max(initial=0) < 2**48  # else a block's sums might leave 64 bits
                total = [a + int(b) for a, b in zip(total, x.sum(0) if exact else x.astype(object).sum(0), strict=True)]
        yield pa.record_batch({"i": pa.array(range(-1, size), pa.int32()), "v": pa.array([str(v) for v in (n, *total)])})

    # sums of tasks are decimals, exact to 38 digits
    found = distinct.mapInArrow(totals, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    by_place = {r.i: int(r.v) for r in found}
    n, sums = by_place[-1], [by_place[i] for i in range(size)]
    covariance = _summed_products(distinct, n, sums, size, lambda y: y.astype(float) / n) / n
    e, v = rotations(covariance)
    rank = int((e > max(e[0], 0.0) * size * np.finfo(float).eps).sum())
    total = float(np.trace(covariance))
    model = Whitening(n, sums, e, v, rank, [float(x) / total if total > 0 else None for x in e])
    if rank:
        whitened = _summed_products(distinct, n, sums, rank, lambda y: model(y, rank)) / n
        model.identity_error = float(np.abs(whitened - np.eye(rank)).max())
    return model


def whiten(vectors: DataFrame, model: Whitening | None, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of ``whole_numbers`` rows of the model's size."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k = min(components, len(model.values))
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(stream):
        model = shared.value
        for batch in stream:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                rows = part.num_rows
                y = centred(unpacked(part.column("x").to_pylist()), model.n, model.sums)
                w = model(y, k).ravel()
                each = lambda values, kind: pa.array(np.repeat(np.array(values, object), k).tolist(), kind)  # noqa: B023, E731
                yield pa.record_batch({
                    "vec_id": part.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), "n": pa.array(np.full(rows * k, model.n)),
                    "deviation": each(squares(y), pa.int64()), "whitened": pa.array(w, mask=np.isnan(w)), "explained": pa.array(model.explained[:k] * rows, pa.float64()), "identity_error": pa.array([model.identity_error] * (rows * k), pa.float64()),
                })

    return vectors.filter(F.col("size") == len(model.values)).select("vec_id", "x").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: all ``embeddings``, the first four components."""
    vectors = whole_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return whiten(vectors, fit(vectors))
