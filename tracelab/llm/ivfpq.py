"""Nearest neighbours: inverted file of coarse centroids, product-quantised residuals, exact reranking, and bounds that prove it whole."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fitted, written

#: Vectors of a dimension that centroids and codebooks are fitted on (those that hash lowest), and rounds of k-means.
SAMPLE, ROUNDS = 16_384, 8
#: Coarse centroids are the root of the number of vectors, within these bounds; parts of a vector, centroids of a part.
CELLS, PARTS, CODES = (16, 1024), 16, 256
#: Numbers of the sample whose vectors give each query a floor under its nearest ones' scores.
KEPT = 2**20
#: Candidates that a block reranks first for a query, rows of a block, and queries that are compared with it together.
RERANK, BLOCK, ASKED = 60, 4096, 256
#: What rounding may add to a bound, as a share of the norms' product.
SLACK = 1e-9
FOUND = "query_id long, query_row long, vec_id long, score double"


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm; fewer distinct rows than k give as many centroids."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        a = nearest(x, c)
        n = np.bincount(a, minlength=k)
        sums = np.stack([np.bincount(a, x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1) if len(x) else np.zeros(0, np.int64)


def slack(q: np.ndarray, norms: np.ndarray | float) -> np.ndarray:
    """What rounding may make of inner products of the queries with vectors of such norms."""
    own = np.sqrt((q * q).sum(1))
    return SLACK * (own * norms if np.ndim(norms) == 0 else own[:, None] * norms)


def floors_of(q: np.ndarray, sample: np.ndarray, top: int) -> np.ndarray:
    """Per query a score that its `top` nearest reach: the one that so many of the sample and itself reach (-inf: too few)."""
    if len(sample) <= top:
        return np.full(len(q), -np.inf)
    return np.partition(q @ sample.T, len(sample) - 1 - top, axis=1)[:, -1 - top] - slack(q, np.sqrt((sample**2).sum(1).max()))


@dataclass
class Index:
    """Coarse centroids and a codebook for each part."""

    cells: np.ndarray
    books: list[np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell and codes of each vector, its distance to the cell's centroid and to what its codes stand for."""
        cell = nearest(x, self.cells)
        residual = x - self.cells[cell]
        parts = np.array_split(residual, len(self.books), axis=1)
        codes = [nearest(part, book) for part, book in zip(parts, self.books, strict=True)]
        lost = np.concatenate([part - book[c] for part, book, c in zip(parts, self.books, codes, strict=True)], axis=1)
        return cell, np.stack(codes, axis=1).astype(np.uint8), np.sqrt((residual**2).sum(1)), np.sqrt((lost**2).sum(1))

    def probed(self, q: np.ndarray, radii: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """Which cells each query probes: those that may hold a vector that reaches its floor, by their radii (-1: empty)."""
        norms = np.sqrt((q * q).sum(1))[:, None]
        most = q @ self.cells.T + norms * radii + slack(q, np.sqrt((self.cells**2).sum(1)) + np.abs(radii))
        return (most >= floors[:, None]) & (radii >= 0)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Asymmetric tables: for each part, the inner products of the queries' parts with the part's codebook."""
        return [part @ book.T for part, book in zip(np.array_split(q, len(self.books), axis=1), self.books, strict=True)]


def fit(rows: Iterable[tuple[list[float]]], cells: int, seed: int = 11) -> tuple[Index, np.ndarray]:
    """Centroids and codebooks of a sample, and some of its vectors."""
    rng = np.random.default_rng(seed)
    sample = np.array([v for (v,) in rows], np.float64)
    coarse = kmeans(sample, cells, rng)
    residual = sample - coarse[nearest(sample, coarse)]
    books = [kmeans(part, CODES, rng) for part in np.array_split(residual, min(PARTS, sample.shape[1]), axis=1)]
    return Index(coarse, books), sample[: max(1, KEPT // sample.shape[1])]


class Block:
    """The stored vectors of a block, sorted by cell and id: equal ones count as one candidate."""

    def __init__(self, index: Index, rows: pa.Table, radii: np.ndarray, top: int):
        self.index, self.radii, self.top = index, radii, top
        cells, self.rows, self.ids = (rows.column(c).to_numpy() for c in ("cell", "row", "id"))
        raw = rows.column("v").to_pylist()
        _, first, of = np.unique(np.array(raw, dtype=np.dtype((np.void, len(raw[0])))), return_index=True, return_inverse=True)
        order = np.argsort(first)
        self.members = np.argsort(np.argsort(order)[of], kind="stable")
        self.sizes = np.bincount(of)[order]
        self.begins = np.cumsum(self.sizes) - self.sizes
        first = first[order]
        self.vectors = np.frombuffer(b"".join(raw[i] for i in first.tolist()), np.float64).reshape(len(first), -1)
        codes = rows.column("codes").to_pylist()
        self.codes = np.frombuffer(b"".join(codes[i] for i in first.tolist()), np.uint8).reshape(len(first), -1)
        self.lost = rows.column("lost").to_numpy()[first]
        self.norms = np.sqrt((self.vectors**2).sum(1))
        cells = cells[first]
        begins = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]).tolist()
        self.runs = list(zip(cells[begins].tolist(), begins, [*begins[1:], len(cells)], strict=True))

    def candidates(self, q: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """Per query the exact inner products of the block's vectors that may be among its `top` nearest (others: -inf).

        The vectors of probed cells that are nearest by the tables are reranked first. Their scores raise the query's floor; a
        vector can only reach it if its estimate and the query's norm times what its codes lose do. Those that can are
        compared with the query itself, so nothing that is near enough is missed, whatever the sample was.
        """
        index, count = self.index, len(self.vectors)
        probed = index.probed(q, self.radii, floors)
        tables, near = index.tables(q), np.full((len(q), count), -np.inf)
        for cell, a, b in self.runs:
            asked = np.flatnonzero(probed[:, cell])
            if len(asked):
                own = np.repeat((q[asked] @ index.cells[cell])[:, None], b - a, axis=1)
                for m, table in enumerate(tables):
                    own += table[asked][:, self.codes[a:b, m]]
                near[asked, a:b] = own
        keep = min(RERANK, count)
        best = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
        some = (q[:, None, :] * self.vectors[best]).sum(2)
        some[np.take_along_axis(near, best, axis=1) == -np.inf] = -np.inf
        error = slack(q, self.norms)
        if keep > self.top:
            # one of these may be the query itself
            floors = np.maximum(floors, np.partition(some, keep - 1 - self.top, axis=1)[:, keep - 1 - self.top] - error.max(axis=1))
        near += np.sqrt((q * q).sum(1))[:, None] * self.lost + error
        reach = near >= floors[:, None]
        reach &= near > -np.inf
        exact = np.full(near.shape, -np.inf)
        own = np.flatnonzero(reach.any(axis=0))
        close = reach[:, own] & (q @ self.vectors[own].T + error[:, own] >= floors[:, None])
        at, place = np.nonzero(close)
        for i in range(0, len(at), 50_000):
            k, v = at[i : i + 50_000], own[place[i : i + 50_000]]
            exact[k, v] = (q[k] * self.vectors[v]).sum(1)
        return exact

    def answer(self, asked: pa.RecordBatch) -> pa.RecordBatch:
        """The block's `top` nearest of each query, as far as they may be among all vectors' nearest."""
        top = self.top
        q = np.frombuffer(b"".join(asked.column("v").to_pylist()), np.float64).reshape(asked.num_rows, -1)
        exact = self.candidates(q, asked.column("floor").to_numpy())
        last = max(0, exact.shape[1] - 1 - top)
        least = np.partition(exact, last, axis=1)[:, last]
        queries, found, scores = [], [], []
        for k, row in enumerate(asked.column("row").to_pylist()):
            pairs = []
            # equal scores: all of them, the smaller ids are told below
            for c in np.flatnonzero((exact[k] >= least[k]) & (exact[k] > -np.inf)).tolist():
                members = self.members[self.begins[c] : self.begins[c] + min(self.sizes[c], top + 1)]
                pairs += [(-exact[k, c], self.ids[j], j) for j in members.tolist() if self.rows[j] != row]
            pairs = sorted(pairs)[:top]
            queries += [k] * len(pairs)
            found += [j for *_, j in pairs]
            scores += [-s for s, *_ in pairs]
        own = asked.select(["id", "row"]).take(pa.array(queries, pa.int64()))
        return pa.RecordBatch.from_arrays([*own.columns, pa.array(self.ids[found]), pa.array(scores, pa.float64())], ["query_id", "query_row", "vec_id", "score"])


def search(vectors: DataFrame, top: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by `every`: its `top` nearest other rows by inner product.

    Result: query_id, rank (from 1), vec_id, score (the inner product of the original vectors in double precision), nearest
    first, ties to the smaller id, and query_row, a number of the asking row. Every vector is in the index, and all that are
    near enough are found: a query probes every cell that may hold a vector as near as its `top` nearest of the sample, by
    the cell's radius, and in a block compares all that may be by what their codes lose. A sample that is unlike the rest
    costs time, not neighbours. Cells are stored in blocks of about BLOCK rows: small cells share
    a block, one that holds a third of all vectors has many. A stored vector moves once; a query moves once to each block
    that has a cell that it probes, and queries stream past the block, so a task holds one block and one batch. In a block,
    equal vectors count as one candidate, which then stands for its smallest ids.

    Null vectors, vectors with null or non-finite components, zero and empty vectors and null ids take no part. Rows of one
    id are rows of their own, as queries (told apart by query_row) and as candidates. A vector is compared with those of its
    dimension, which have an index of their own. With fewer candidates than `top`, all of them are returned. An empty table gives an empty result. Other columns are not carried.
    """
    values = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & values.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(values, lambda x: x != 0))
    found = vectors.sparkSession.createDataFrame([], FOUND)
    for r in rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():  # one row for each dimension
        found = found.unionByName(neighbours(rows.where(F.size("v") == r["d"]), r["d"], r["count"], top, every))
    rank = F.row_number().over(Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score", "query_row")


def neighbours(rows: DataFrame, dim: int, count: int, top: int, every: int) -> DataFrame:
    """Columns of FOUND: the nearest of each query in each block; rows (id, v) have `count` vectors of dimension dim."""
    sample = rows.orderBy(F.xxhash64("id", "v"), "id", "v").limit(SAMPLE).select("v")
    cells = min(CELLS[1], max(CELLS[0], 2 ** round(np.log2(count) / 2)))
    index, some_vectors = fitted(sample, lambda own: fit(own, cells))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(2).flatten()).reshape(-1, dim)
                cell, codes, far, lost = index.encode(x)
                own = [pa.array(cell.astype(np.int32)), pa.array(far), pa.array(lost), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], ["row", "id", "cell", "far", "lost", "codes", "v"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "v")
    stored = written(numbered.mapInArrow(encode, "row long, id long, cell int, far double, lost double, codes binary, v binary"), "ivf-index")
    radii = np.full(len(index.cells), -1.0)
    sizes = np.zeros(len(index.cells), np.int64)
    for r in stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # one row for each cell
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["far"]
    # large cells have blocks of their own, small ones fill blocks in turn
    blocks = np.maximum(1, -(-sizes // BLOCK))
    first, at, held = np.zeros(len(sizes), np.int64), -1, BLOCK
    for c, n in enumerate(sizes.tolist()):
        if n > BLOCK or held + n > BLOCK:
            first[c], held = at + 1, n if n <= BLOCK else BLOCK
            at += int(blocks[c])
        else:
            first[c], held = at, held + n

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ASKED):
                some = batch.slice(i, ASKED)
                q = np.frombuffer(b"".join(some.column(2).to_pylist()), np.float64).reshape(-1, dim)
                floors = floors_of(q, some_vectors, top)
                own = [np.unique(gathered(first[c], blocks[c])) for c in index.probed(q, radii, floors)]
                take = pa.array(np.repeat(np.arange(len(q)), [len(x) for x in own]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), *(c.take(take) for c in (*some.columns, pa.array(floors)))], ["block", "row", "id", "v", "floor"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            at, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (asks[1:] != asks[:-1])][: len(at)]).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
                if at[a] != now:
                    now, held, block = at[a], [], None
                if not asks[a]:
                    held.append(batch.slice(a, b - a))
                elif held:
                    block = block or Block(index, pa.Table.from_batches(held), radii, top)
                    for i in range(a, b, ASKED):
                        yield block.answer(batch.slice(i, min(ASKED, b - i)))

    array = lambda xs: F.lit([int(x) for x in xs])
    of = lambda xs: F.element_at(array(xs), F.col("cell") + 1).cast("long")
    left = stored.withColumn("block", of(first) + F.pmod(F.xxhash64("row"), of(blocks))).withColumns({"asks": F.lit(0), "floor": F.lit(None).cast("double")})
    right = stored.where(F.col("id") % every == 0).select("row", "id", "v").mapInArrow(probe, "block long, row long, id long, v binary, floor double")
    right = right.withColumns({"asks": F.lit(1), "cell": F.lit(-1), "lost": F.lit(None).cast("double"), "codes": F.lit(None).cast("binary")})
    columns = ["block", "asks", "cell", "id", "row", "lost", "floor", "codes", "v"]
    both = left.select(columns).unionByName(right.select(columns)).repartition("block").sortWithinPartitions("block", "asks", "cell", "id", "row")
    return both.mapInArrow(compare, FOUND)


def gathered(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges of n numbers from each first, one after another."""
    ends = np.cumsum(n)
    return np.repeat(first - ends + n, n) + np.arange(ends[-1])
