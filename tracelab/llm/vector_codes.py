"""Vector code compression: codebooks of the parts of a vector, assigned by exponion search in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import sized, small, written

#: Parts of a vector, entries of a part's codebook, rounds that move the entries, and steps per unit of a component.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that a task looks at together.
ROWS = 1000


def widths(d: int) -> np.ndarray:
    """Places of each part: equal ones, or the first longer by one where PARTS doesn't divide d."""
    return np.array([d // PARTS + (p < d % PARTS) for p in range(PARTS)])


def cut(x: np.ndarray) -> np.ndarray:
    """Vectors (rows x d) as rows x parts x places; shorter parts end in zeros, which lie in no distance."""
    own = widths(x.shape[1])
    out = np.zeros((len(x), PARTS, max(1, own.max())), x.dtype)
    ends = np.cumsum(own)
    for p, w in enumerate(own.tolist()):
        out[:, p, :w] = x[:, ends[p] - w : ends[p]]
    return out


def fits(*arrays: np.ndarray) -> bool:
    """Whether four times a squared distance between any of these surely fits into 64 bits."""
    most = max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)
    return 16 * most * most * arrays[0].shape[-1] < 2**62


@dataclass
class Books:
    """A codebook for each part (parts x entries x places), and of every entry the squared distances to all entries of its
    part, ascending, with those entries."""

    entries: np.ndarray

    def __post_init__(self) -> None:
        own = self.entries if fits(self.entries) else self.entries.astype(object)
        far = ((own[:, :, None] - own[:, None]) ** 2).sum(3)
        self.order = np.argsort(far, axis=2, kind="stable")
        self.far = np.take_along_axis(far, self.order, axis=2)

    def assign(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part of each vector, the lowest of several, and its squared distance.

        x is rows x parts x places, start an entry of each part. An entry j that is as near to x as the starting entry a has
        |j - a| <= 2 |x - a|; so the entries around a are scanned in order of distance until their square exceeds four times
        that of x to a. All of it is exact: Python's integers take over where 64 bits might not do.
        """
        exact = fits(x, self.entries)
        x = x.reshape(-1, x.shape[2])
        x, entries = (x, self.entries) if exact else (x.astype(object), self.entries.astype(object))
        part, at = np.tile(np.arange(PARTS), len(x) // PARTS), start.ravel().astype(np.int64)
        best, code = ((x - entries[part, at]) ** 2).sum(1), at.copy()
        limit, left = 4 * best, np.arange(len(x))
        for t in range(self.order.shape[2]):
            left = left[(self.far[part[left], at[left], t] <= limit[left]).astype(bool)]
            if not len(left):
                break
            j = self.order[part[left], at[left], t]
            d = ((x[left] - entries[part[left], j]) ** 2).sum(1)
            better = ((d < best[left]) | (d == best[left]) & (j < code[left])).astype(bool)
            best[left[better]], code[left[better]] = d[better], j[better]
        return code.reshape(start.shape).astype(np.uint8), best.reshape(start.shape)


def vectors_of(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with vectors of one dimension: the dimension, the rows, the vectors cut into parts."""
    for batch in small(batches, ROWS):
        sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(sizes).tolist():
            some = batch.filter(pa.array(sizes == d))
            yield d, some, cut(some.column(column).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, d))


def codes_of(some: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(some.column("codes").to_pylist()), np.uint8).reshape(-1, PARTS)


def assigned(rows: DataFrame, books: dict[int, Books]) -> DataFrame:
    """rows with the codes of the nearest entries, found from the codes they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, some, x in vectors_of(batches):
            codes, _ = books[d].assign(x, codes_of(some))
            at = some.schema.get_field_index("codes")
            yield some.set_column(at, "codes", pa.array([c.tobytes() for c in codes], pa.binary()))

    return rows.mapInArrow(run, rows.schema)


def moved(rows: DataFrame, books: dict[int, Books]) -> dict[int, Books]:
    """Each entry replaced by the floor of its parts' mean, in every place; entries without parts stay. A task adds up its own
    parts, Spark adds those sums up; the driver gets one sum for each place of each entry."""
    shapes = {d: b.entries.shape for d, b in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for d, some, x in vectors_of(batches):
            codes, (_, k, w) = codes_of(some), shapes[d]
            if d not in sums:
                sums[d], counts[d] = np.zeros((PARTS * k, w), object), np.zeros(PARTS * k, np.int64)
            at = (codes + np.arange(PARTS) * k).ravel()
            counts[d] += np.bincount(at, minlength=PARTS * k)
            flat = x.reshape(-1, w)
            batch = np.zeros((PARTS * k, w), np.int64 if fits(flat) else object)
            np.add.at(batch, at, flat)
            sums[d] = sums[d] + batch
        for d, n in counts.items():
            used = np.flatnonzero(n)
            w = shapes[d][2]
            cells = (used[:, None] * w + np.arange(w)).ravel()
            total = [Decimal(int(v)) for v in sums[d][used].ravel().tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cells), d, np.int32)), pa.array(cells.astype(np.int32)), pa.array(total, pa.decimal128(38, 0)), pa.array(np.repeat(n[used], w))], ["d", "cell", "total", "n"]
            )

    cells = rows.mapInArrow(run, "d int, cell int, total decimal(38,0), n long").groupBy("d", "cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    entries = {d: b.entries.copy() for d, b in books.items()}
    for r in cells.collect():
        entries[r.d].reshape(-1)[r.cell] = int(r.total) // r.n
    return {d: Books(e) for d, e in entries.items()}


def digest(books: Books, d: int) -> str:
    """SHA-256 of the entries' decimal components by part, entry and place, comma-joined."""
    own = widths(d)
    numbers = [str(v) for p in range(PARTS) for e in books.entries[p, :, : own[p]].tolist() for v in e]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: id, code (an entry of each part, two hexadecimal digits each), error (the squared distance to those entries),
    label_error (errors summed over equal labels, nulls together) and codebooks_sha256 (see digest).

    A component c becomes floor(256 c). Each part's codebook starts as that part of the ENTRIES smallest ids' vectors, in
    ascending order (null ids last, equal ids by their vectors); fewer rows make fewer entries. In each of ROUNDS rounds every
    part goes to its nearest entry and every entry to the floor of its parts' mean; then parts are assigned again. The codes
    of a round are written with the vectors, and the next search begins at them.

    Rows whose vector is null, or holds null or non-finite components, or one whose whole number is no long, are dropped;
    repeated rows and rows without ids are rows of their own. Vectors of one dimension have codebooks of their own; where
    PARTS doesn't divide it, the first parts are longer by one, and a part without places has entry 0. An error beyond a long, and the
    sum of its label, are null. An empty table gives an empty result. Other columns are not carried. What is sent to tasks
    are ENTRIES vectors for each dimension.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | ~(F.abs(c) < 2.0**62 / SCALE))
    rows = rows.where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    rows = rows.select("id", "label", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"), F.lit(bytes(PARTS)).alias("codes"))
    order = Window.partitionBy(F.size("x")).orderBy(F.asc_nulls_last("id"), "x")
    first = rows.select("id", "x").withColumn("place", F.row_number().over(order)).where(F.col("place") <= ENTRIES)
    starts: dict[int, list[Any]] = {}
    for r in first.orderBy("place").collect():  # ENTRIES rows for each dimension
        starts.setdefault(len(r.x), []).append(r.x)
    books = {d: Books(np.ascontiguousarray(cut(np.array(v, np.int64).reshape(len(v), d)).transpose(1, 0, 2))) for d, v in starts.items()}
    for i in range(ROUNDS):
        rows = written(assigned(rows, books), f"codes-{i}")
        books = moved(rows, books)
    digests = {d: digest(b, d) for d, b in books.items()}

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, some, x in vectors_of(batches):
            codes, error = books[d].assign(x, codes_of(some))
            total = [e if e < 2**63 else None for e in map(int, error.astype(object).sum(1).tolist())]
            own = [some.column("id"), some.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string())]
            yield pa.RecordBatch.from_arrays([*own, pa.array(total, pa.int64()), pa.array([digests[d]] * len(x), pa.string())], ["id", "label", "code", "error", "digest"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]
    out = written(rows.mapInArrow(final, f"id {kinds[0]}, label {kinds[1]}, code string, error long, digest string"), "codes")
    whole = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long"))
    labels = written(out.groupBy(F.col("label").alias("of")).agg(whole.alias("label_error")), "code-labels")
    joined = out.join(sized(labels), F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.col("digest").alias("codebooks_sha256"))
