"""Embedding whitening: principal components by matrix-free block subspace iteration over Spark passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: Columns of a block beyond the components sought, blocks that are kept for Rayleigh-Ritz, and passes at most.
EXTRA, KEPT, PASSES = 8, 4, 300
#: A residual of this share of the largest eigenvalue is small; one of FLOOR is where STALE passes didn't lower it by a tenth
#: (the sums' rounding). Eigenvalues below RANK of the largest count as none.
CERTAIN, FLOOR, STALE, RANK = 2e-14, 1e-11, 6, 1e-11
#: A component's steps per unit, and what is added to them; components beyond LARGEST count as LARGEST.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0**55


@dataclass
class Fit:
    """Of the distinct vectors of a dimension: their number, the floor of each mean with what is left of the sum, and components
    (columns, by falling eigenvalue)."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float = 0.0
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the integer part is subtracted first, so nothing is lost to the size of x."""
        return (x - self.base) - np.array([r / self.n for r in self.rest.tolist()])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S) squared of each row, exactly; null beyond a long."""
        off = x - self.base
        if self.n * (int(np.abs(off).max(initial=0)) + 1) * max(1, x.shape[1]) ** 0.5 < 2**31:
            return ((self.n * off - self.rest.astype(np.int64)) ** 2).sum(1).tolist()
        exact = ((self.n * off.astype(object) - self.rest) ** 2).sum(1).tolist() if x.shape[1] else [0] * len(x)
        return [e if e < 2**63 else None for e in exact]


def steps(values: Column) -> Column:
    """The vector as whole numbers: floor(SCALE c) + SHIFT for each component c."""
    return F.transform(values, lambda c: F.floor(F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST)) * SCALE) + SHIFT)


def matrices(batches: Iterator[pa.RecordBatch], at: int, rows: int = 2000) -> Iterator[np.ndarray]:
    """The vectors of column `at`, which have one dimension, as matrices of so many rows at most."""
    for batch in small(batches, rows):
        if batch.num_rows:
            yield batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def summed(x: DataFrame, shape: tuple[int, ...], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of part(rows), an array of the given shape: each task sums its own, Spark adds those up cell by
    cell, and the driver gets one number for each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for m in matrices(batches, 0):
            total += part(m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["cell", "value"])

    out = np.zeros(int(np.prod(shape)))
    for r in x.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r.cell] = r.value
    return out.reshape(shape)


def sums(x: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each of their d places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, [0] * d, [0] * d
        for m in matrices(batches, 0):
            # both halves' sums of a few thousand rows fit
            low = [a + b for a, b in zip(low, (m & 0xFFFFFFFF).sum(0).tolist(), strict=True)]
            high = [a + b for a, b in zip(high, (m >> 32).sum(0).tolist(), strict=True)]
            n += len(m)
        total = [Decimal((h << 32) + v) for v, h in zip(low, high, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total, pa.decimal128(38, 0)), pa.array([n] * d, pa.int64())], ["place", "total", "n"])

    rows = x.mapInArrow(run, "place int, total decimal(38,0), n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    totals = {r.place: int(r.total) for r in rows}
    return (rows[0].n if rows else 0), [totals[i] for i in range(d)]


def orthonormal(block: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of block have beyond the space of kept (orthonormal columns)."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    for _ in range(2):  # once more, for what rounding leaves
        block = block - kept @ (kept.T @ block)
        q, r = np.linalg.qr(block)
        block = q[:, np.abs(np.diag(r)) > 1e-10]
    return block[:, : len(block) - kept.shape[1]]


def components(multiply: Callable[[np.ndarray], np.ndarray], d: int, top: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The `top` largest eigenvalues of a covariance of d places, falling, and their unit vectors, from multiply(Q), which is the covariance times Q.

    Each round multiplies one block, orthonormalised (QR) against the blocks that are kept, and takes Rayleigh-Ritz values
    and vectors of all that is kept; the next block is the image of the leading ones. When KEPT blocks are held, they are
    replaced by their leading Ritz vectors. Once the residuals are small, the vectors themselves are multiplied: their own
    residuals, as small but for rounding, certify every component, or rounds go on.
    """
    width = min(d, top + EXTRA)
    rng = np.random.default_rng(seed)
    kept, images = np.zeros((d, 0)), np.zeros((d, 0))
    block, least, stale, checked = orthonormal(rng.normal(size=(d, width)), kept), np.inf, 0, False
    for _ in range(PASSES):
        image = multiply(block)
        if checked:  # block holds the Ritz vectors: what is kept starts anew from them
            kept, images = np.zeros((d, 0)), np.zeros((d, 0))
        kept, images = np.hstack([kept, block]), np.hstack([images, image])
        h = kept.T @ images
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, moved = kept @ turn, images @ turn
        residual = np.linalg.norm(moved[:, :top] - ritz[:, :top] * values[:top], axis=0).max(initial=0)
        goal = max(values[0], 0) if len(values) else 0.0
        if checked and residual <= 4 * max(CERTAIN * goal, least):
            order = ritz[:, :top] / np.linalg.norm(ritz[:, :top], axis=0)
            return values[:top], order * np.where(order[np.abs(order).argmax(0), range(order.shape[1])] < 0, -1.0, 1.0)
        least, stale = (residual, 0) if checked or residual < 0.9 * least else (least, stale + 1)
        done = residual <= CERTAIN * goal or residual <= FLOOR * goal and stale >= STALE
        following = orthonormal(moved[:, :width], kept)
        if kept.shape[1] < d and not following.shape[1]:
            following = orthonormal(rng.normal(size=(d, width)), kept)
        checked = bool(done or not following.shape[1])
        if checked:
            block = np.linalg.qr(ritz[:, :width])[0]
            continue
        if kept.shape[1] + following.shape[1] > KEPT * width:
            kept, images = ritz[:, : 2 * width], moved[:, : 2 * width]
            following = orthonormal(moved[:, :width] - kept @ (kept.T @ moved[:, :width]), kept)
        block = following
    raise ArithmeticError(f"after {PASSES} passes a residual is {residual / goal:.3g} of the largest eigenvalue")


def fit(x: DataFrame, d: int, top: int) -> Fit:
    """Components of the rows of x, distinct vectors of d whole numbers. Every pass reads them once, centres them and sums."""
    n, totals = sums(x, d)
    base = np.array([t // n for t in totals], np.int64)
    own = Fit(n, base, np.array([t - n * int(b) for t, b in zip(totals, base, strict=True)], object), np.zeros((d, 0)), np.zeros(0))
    own.trace = float(summed(x, (1,), lambda m: (own.centred(m) ** 2).sum()[None])[0]) / n
    if own.trace == 0:
        return own

    def multiply(q: np.ndarray) -> np.ndarray:
        def part(m: np.ndarray) -> np.ndarray:
            c = own.centred(m)
            return c.T @ (c @ q)

        return summed(x, q.shape, part) / n

    values, vectors = components(multiply, d, min(top, d))
    some = (values > RANK * values[0]) & (np.arange(len(values)) < n - 1)
    own.values, own.vectors = values[some], vectors[:, some]
    k = int(some.sum())

    def moments(m: np.ndarray) -> np.ndarray:
        w = own.whitened(m)
        return np.vstack([w.T @ w, w.sum(0)[None]])

    both = summed(x, (k + 1, k), moments) / n
    own.identity_error = float(np.abs(both[:k] - np.outer(both[k], both[k]) - np.eye(k)).max(initial=0))
    return own


def whiten(vectors: DataFrame, top: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row and component, up to `top`: the row's vector, whitened by the components of all distinct vectors.

    A vector's components c become whole numbers floor(64 c) + 1000000. Every covariance is over the distinct ones (divisor n, their number), about their mean, which
    is subtracted exactly. Result: id, component (from 1, by falling eigenvalue e), n, deviation (the sum of (n x - S) squared
    over places, exactly, null if it is no long), whitened (the centred vector on the unit component, over the root of e),
    explained (e over the trace) and identity_error (how far the whitened vectors' covariance is from the identity).

    Rows whose vector is null, or holds null or non-finite entries, are dropped; rows without ids, and repeated ones, stay
    rows of their own. Vectors of one dimension are whitened together, apart from those of others. There are as many components as the
    vectors vary in (so none for one distinct vector, nor for empty ones, whose rows have no result). Components beyond 2 ** 55
    count as that. An empty table gives an empty result. Other columns are not carried. The driver holds a few blocks of the
    dimension times `top`, never the covariance.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)) & (F.size("v") > 0)).select("id", steps(F.col("v")).alias("x"))
    distinct = written(rows.select("x").distinct(), "whitening")
    fits = {d: fit(distinct.where(F.size("x") == d), d, top) for d in sorted(r.d for r in distinct.select(F.size("x").alias("d")).distinct().collect())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2000):
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                own, some = fits[d], batch.filter(pa.array(sizes == d))
                x, k = next(matrices(iter([some]), 1)), len(own.values)
                at = pa.array(np.repeat(np.arange(len(x)), k))
                explained = own.values / own.trace if k else own.values
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(at),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, own.n)),
                        pa.array(own.deviations(x), pa.int64()).take(at),
                        pa.array(own.whitened(x).ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(x) * k, own.identity_error)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
