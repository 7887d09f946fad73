"""Approximate nearest neighbours by score-aware quantisation.

Product quantisation with 16 centroids for each subspace (four bits a code). Codes and centroids minimise an
anisotropic loss: the residual's part parallel to the vector, which moves inner products with near
queries most, weighs ETA times its orthogonal part. A search scans the codes with one table lookup for
each pair of codes and measures the BEST of every block of rows
on the original vectors. Then it measures all other rows that may belong to the k nearest: those whose
approximate score, plus the query's norm times the norm of the row's residual, reaches the k-th best. So
the codes only spare work, and how much depends on the vectors: few rows are spared where residuals are long.

Euclidean distance becomes an inner product: |q - x|^2 = |q|^2 - 2 (q.x - |x|^2 / 2), with |x|^2 kept exactly.

The index is a table of blocks of ROWS vectors with their codes; queries are blocks of QUERIES vectors. Each
block of queries meets each block of the index once, in one join of the two tables; no query passes
through the driver. A task keeps the k nearest so far of a few blocks of queries. The work is queries times rows.

The codebook is fitted on a bounded sample (SAMPLE vectors, by hash of the id); every vector is indexed.
The index has the length that most usable vectors have (of equally common ones, the smallest), counted over all rows.
Vectors that are null, zero, of another length, or that hold null or
non-finite components take no part, nor do rows with a null id. Of rows that repeat an id, each is a
candidate, and one is a query. Ties go to the smaller id. Other columns are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _store

SAMPLE, ROUNDS = 8192, 6
#: The inner product, as a share of the norms' product, above which queries count as near.
NEAR = 0.2
#: Vectors of a block, and how many of them are measured first for each query.
ROWS, BEST = 4096, 48
#: The share of a batch's (query, row) pairs to measure from which one product of matrices is quicker.
MANY = 0.02
#: Queries of a block, and blocks of queries that a task keeps at once.
QUERIES, OPEN = 1024, 16


class Codebook:
    """Centroids, (subspaces, 16, width), and the weight of the parallel residual."""

    def __init__(self, centroids: np.ndarray, dim: int, eta: float):
        self.centroids, self.dim, self.eta = centroids, dim, eta

    @classmethod
    def fit(cls, sample: np.ndarray, width: int = 2, near: float = NEAR, rounds: int = ROUNDS) -> Codebook:
        n, dim = sample.shape
        parts = -(-dim // width)
        parts += parts % 2  # codes go in pairs
        x = np.zeros((n, parts * width))
        x[:, :dim] = sample
        x = x.reshape(n, parts, width)
        start = np.argsort(np.linalg.norm(x, axis=2), axis=0)  # spread over lengths and, by index, over the sample
        pick = np.linspace(0, n - 1, 16).astype(int)
        centroids = np.stack([x[start[pick, m], m] for m in range(parts)])
        book = cls(centroids, dim, max(1.0, (dim - 1) * near**2 / (1 - near**2)))
        eye = np.eye(width)
        for _ in range(rounds):
            codes = book.codes(sample)
            unit = x / np.maximum(np.linalg.norm(x.reshape(n, -1), axis=1), 1e-12)[:, None, None]
            chosen = book.centroids[np.arange(parts)[None, :], codes]
            along = ((x - chosen) * unit).sum(axis=2)
            total = along.sum(axis=1)
            for m in range(parts):
                rest = total - along[:, m]
                for k in range(16):
                    own = np.flatnonzero(codes[:, m] == k)
                    if len(own):
                        u, v = unit[own, m], x[own, m]
                        a = len(own) * eye + (book.eta - 1) * u.T @ u
                        b = v.sum(axis=0) + (book.eta - 1) * ((rest[own] + (v * u).sum(axis=1))[:, None] * u).sum(axis=0)
                        book.centroids[m, k] = np.linalg.solve(a, b)
                    else:
                        book.centroids[m, k] = x[(7 * k + m) % n, m]
                along[:, m] = ((x[:, m] - book.centroids[m, codes[:, m]]) * unit[:, m]).sum(axis=1)
                total = rest + along[:, m]
        return book

    def _parts(self, vectors: np.ndarray) -> np.ndarray:
        parts, _, width = self.centroids.shape
        x = np.zeros((len(vectors), parts * width))
        x[:, : self.dim] = vectors
        return x.reshape(len(vectors), parts, width)

    def codes(self, vectors: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Four-bit codes, (rows, subspaces), by coordinate descent on the anisotropic loss."""
        x = self._parts(vectors)
        n, parts, _ = x.shape
        unit = x / np.maximum(np.linalg.norm(x.reshape(n, -1), axis=1), 1e-12)[:, None, None]
        codes = np.empty((n, parts), np.int64)
        along = np.empty((n, parts))
        for sweep in range(sweeps + 1):
            total = along.sum(axis=1) if sweep else None
            for m in range(parts):
                gap = x[:, m, None, :] - self.centroids[m][None]
                loss = (gap**2).sum(axis=2)
                part = (gap * unit[:, m, None, :]).sum(axis=2)
                if sweep:
                    rest = total - along[:, m]
                    loss = loss + (self.eta - 1) * (rest[:, None] + part) ** 2
                codes[:, m] = loss.argmin(axis=1)
                along[:, m] = part[np.arange(n), codes[:, m]]
                if sweep:
                    total = rest + along[:, m]
        return codes

    def packed(self, vectors: np.ndarray) -> np.ndarray:
        """Codes, two to a byte."""
        c = self.codes(vectors)
        return (c[:, ::2] * 16 + c[:, 1::2]).astype(np.uint8)

    def residuals(self, vectors: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Norms of what the codes leave of each vector."""
        codes = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)
        gap = self._parts(vectors) - self.centroids[np.arange(codes.shape[1])[None, :], codes]
        return np.sqrt((gap**2).sum(axis=(1, 2)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(bytes of a code, queries, 256): what each byte of a code adds to the inner product."""
        q = self._parts(queries)
        t = np.einsum("qmw,mkw->mqk", q, self.centroids).astype(np.float32)
        return t[::2, :, :, None].repeat(16, 3).reshape(len(t) // 2, len(q), 256) + np.tile(t[1::2], (1, 1, 16))


def usable(vector: str, dim: int | None = None) -> Column:
    c = F.col(vector)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)
    return F.coalesce(fine & (F.size(c) == dim) if dim else fine, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _pack(encoded: Codebook | None, size: int, dim: int):
    """Blocks of at most `size` rows of (vec_id, vector): ids, vectors and, with a codebook, codes and residuals as flat bytes."""

    def block(ids: list[np.ndarray], vectors: list[np.ndarray]) -> pa.RecordBatch:
        i, x = np.concatenate(ids), np.concatenate(vectors)
        order = np.argsort(i, kind="stable")
        i, x = i[order], x[order]
        parts = {"block": pa.array([int(i[0])]), "ids": i.tobytes(), "vectors": x.tobytes()}
        if encoded is not None:
            packed = encoded.packed(x)
            parts |= {"codes": packed.tobytes(), "residuals": encoded.residuals(x, packed).tobytes()}
        return pa.RecordBatch.from_arrays([v if n == "block" else pa.array([v], pa.binary()) for n, v in parts.items()], list(parts))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        held = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - held)
                at += part.num_rows
                held += part.num_rows
                ids.append(part.column(0).to_numpy())
                vectors.append(_matrix(part.column(1), dim))
                if held == size:
                    yield block(ids, vectors)
                    ids, vectors, held = [], [], 0
        if held:
            yield block(ids, vectors)

    return pack


class _Best:
    """The k nearest so far of a block of queries."""

    def __init__(self, book: Codebook, ids: np.ndarray, queries: np.ndarray, k: int):
        self.book, self.ids, self.queries, self.k = book, ids, queries, k
        self.tables = book.tables(queries)
        self.distance, self.near = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.squares = (queries**2).sum(axis=1)
        self.norms = np.sqrt(self.squares)

    def measure(self, q: int, near: np.ndarray, own: np.ndarray, x: np.ndarray) -> None:
        near = near[own[near] != self.ids[q]]
        d = np.sqrt(((x[near] - self.queries[q]) ** 2).sum(axis=1))
        d, i = np.concatenate((self.distance[q], d)), np.concatenate((self.near[q], own[near]))
        if len(d) > 4 * self.k:  # only what may be among the k nearest, ties included, is sorted
            few = np.flatnonzero(d <= np.partition(d, self.k - 1)[self.k - 1])
            d, i = d[few], i[few]
        keep = np.lexsort((i, d))[: self.k]
        self.distance[q], self.near[q] = d[keep], i[keep]

    def meet(self, own: np.ndarray, x: np.ndarray, codes: np.ndarray, residual: np.ndarray, best: int) -> None:
        """Looks at one block of the index."""
        ids, tables = self.ids, self.tables
        square = (x**2).sum(axis=1)
        score = np.repeat((-square / 2).astype(np.float32)[None], len(ids), axis=0)
        for j, table in enumerate(tables):
            score += table[:, codes[:, j]]
        score[ids[:, None] == own[None]] = -np.inf
        take = min(best, len(own))
        left = np.ones(score.shape, bool)
        for q in range(len(ids)):
            near = np.argpartition(-score[q], take - 1)[:take]
            self.measure(q, near, own, x)
            left[q, near] = False
        if take == len(own):
            return
        # Scores are sums in single precision; the slack covers their rounding.
        slack = 1.2e-7 * (len(tables) + 4)
        length = np.sqrt(square)
        for q in range(len(ids)):
            bound = score[q] + self.norms[q] * residual + slack * (self.norms[q] * (length + residual) + square)
            left[q] &= ~(bound < (self.squares[q] - self.distance[q, -1] ** 2) / 2)
        products = self.queries @ x.T if left.mean() > MANY else None
        for q in np.flatnonzero(left.any(axis=1)):
            near = np.flatnonzero(left[q])
            if products is not None:
                about = self.squares[q] + square[near] - 2 * products[q, near]
                near = near[~(about > self.distance[q, -1] ** 2 + 1e-9 * (self.squares[q] + square[near]))]
            self.measure(q, near, own, x)

    def rows(self) -> pa.RecordBatch:
        q, place = np.nonzero(np.isfinite(self.distance))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.near[q, place]), pa.array(self.distance[q, place])], ["query_id", "vec_id", "score"])


def _search(book: Codebook, k: int, best: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, _Best] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda name, row=row, batch=batch: batch.column(batch.schema.get_field_index(name))[row].as_py()
                asked = value("q_block")
                now = open_blocks.pop(asked, None)
                if now is None:
                    ids = np.frombuffer(value("q_ids"), np.int64)
                    now = _Best(book, ids, np.frombuffer(value("q_vectors"), np.float64).reshape(len(ids), -1), k)
                    if len(open_blocks) >= OPEN:  # the one that was met longest ago; should it come again, it starts anew
                        yield open_blocks.pop(next(iter(open_blocks))).rows()
                open_blocks[asked] = now
                own = np.frombuffer(value("ids"), np.int64)
                now.meet(own, np.frombuffer(value("vectors"), np.float64).reshape(len(own), -1), np.frombuffer(value("codes"), np.uint8).reshape(len(own), -1), np.frombuffer(value("residuals"), np.float64), best)
        for now in open_blocks.values():
            yield now.rows()

    return search


class Index:
    """Every usable vector of a table with its codes, in the shared folder."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE):
        spark = self.spark = vectors.sparkSession
        _store.arrow(spark)
        self.book, self.dim = None, None
        fine = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable("vector"))
        common = fine.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
        if common:
            dim = self.dim = common["dim"]
            self.plain = fine.where(F.size("vector") == dim)
            self.book = Codebook.fit(np.array([r[0] for r in self.plain.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").select("vector").limit(sample).collect()]))
            self.table = _store.cut(self.plain.mapInArrow(_pack(self.book, ROWS, dim), "block long, ids binary, vectors binary, codes binary, residuals binary"), "ann-index")

    def search(self, queries: DataFrame | None = None, every: int = 100, k: int = 10, block: int = QUERIES, best: int = BEST) -> DataFrame:
        """query_id, rank, vec_id and score (Euclidean distance) of the k nearest to each query but itself. Queries are the rows of the index whose id `every` divides, or `queries` (vec_id, vector)."""
        schema = "query_id long, vec_id long, score double"
        if self.book is None:
            out = self.spark.createDataFrame([], schema)
        else:
            asked = self.plain.where(F.col("vec_id") % every == 0) if queries is None else queries.select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>")).where(F.col("vec_id").isNotNull() & usable("vector", self.dim))
            asked = asked.dropDuplicates(["vec_id"])
            packed = asked.repartition(max(1, -(-asked.count() // block))).mapInArrow(_pack(None, block, self.dim), "block long, ids binary, vectors binary")
            asked = _store.cut(packed.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "ann-queries")
            # Blocks of the stated queries against blocks of all rows: Spark broadcasts the queries if they are small, else goes through pairs of partitions.
            out = self.table.crossJoin(asked).mapInArrow(_search(self.book, k, best), schema)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return out.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
