"""Approximate nearest neighbours by cosine (operator 3).

Vectors are scaled to length one, so the inner product is the cosine. A product quantiser with 16 centres
for each subspace (four bits) is trained with a score-aware loss: the residual's part along the vector, which
changes its inner products with near queries, weighs eta times as much as the rest. Codebooks come from a
sample of at most SAMPLE vectors (those with the least hash of their id); every vector is coded, by the same loss.
What the code leaves of a vector gets four-bit codes in turn (`levels` of them in all), by the plain loss.
A search scans the first codes with one table for each two subspaces, takes at least the best `rerank` of each block of
candidates, and ranks those by exact cosines of the original vectors, in double precision. As queries have length one,
a scan score is off by at most the length of the row's residual, which is stored with its code: every other candidate
whose score plus that bound reaches the k-th exact cosine stays open. The next level's tables add their share to the scores of
open rows, with a smaller bound, and so on; rows that the last level leaves open are ranked exactly, so no row of the true k is lost.

The query set meets all rows in blocks of both, so a task holds one block of queries and one of candidates;
blocks are cut by hash of the id, so equal vectors are spread evenly. Ties of exact cosines go to the smaller id.
Originals travel with their codes, once for each block of queries: in a group of near copies no code tells rows apart, and
sending every open (query, row) to its original would grow with the square of the group.

Defined results: vectors null, empty, zero or holding null or non-finite components take no part, nor do rows
without id or of another length than most. A query has fewer than k rows if there are fewer candidates. Repeated
ids: a row never finds its own id; repeated candidates each count. Extra columns are ignored. Empty tables: empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm import common as C

SAMPLE = 8192
CENTRES = 16
CANDIDATES, QUERIES = 8192, 8192
PIECE = 1024
FOUND = "query_id long, vec_id long, score double"


class Quantiser:
    """Codebooks of each level (subspaces, 16, components); vectors are padded with zeros to an even number of whole subspaces."""

    def __init__(self, sample: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 8, sweeps: int = 2, levels: int = 2):
        dim = sample.shape[1]
        self.dim, self.width = dim, width
        self.parts = 2 * max(1, math.ceil(dim / (2 * width)))
        self.eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
        self.sweeps = sweeps
        x = self._split(sample)
        rng = np.random.default_rng(0)
        picked = rng.choice(len(x), (self.parts, CENTRES))
        self.books = np.stack([x[picked[m], m] for m in range(self.parts)]) + rng.normal(0, 1e-4, (self.parts, CENTRES, width))
        for _ in range(rounds):
            self._update(x, self._first(x))
        self.finer: list[np.ndarray] = []
        for _ in range(levels - 1):
            self.finer.append(self._centres(self._left(x, self.codes(sample)), rng, rounds))

    def _split(self, v: np.ndarray) -> np.ndarray:
        v = np.asarray(v, np.float64)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        return np.pad(v, ((0, 0), (0, self.parts * self.width - self.dim))).reshape(len(v), self.parts, self.width)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """(vectors, levels, subspaces): the first level's codes by the score-aware loss, the others' by plain nearness to what is left."""
        x = self._split(vectors)
        out = [self._first(x)]
        left = x - self._at(self.books, out[0])
        for books in self.finer:
            out.append(self._plain(left, books))
            left = left - self._at(books, out[-1])
        return np.stack(out, 1)

    def _at(self, books: np.ndarray, code: np.ndarray) -> np.ndarray:
        return books[np.arange(self.parts), code]

    def _plain(self, x: np.ndarray, books: np.ndarray) -> np.ndarray:
        return ((books**2).sum(2)[None] - 2 * np.einsum("nmd,mkd->nmk", x, books)).argmin(2).astype(np.uint8)

    def _left(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return x - sum(self._at(books, codes[:, i]) for i, books in enumerate([self.books, *self.finer][: codes.shape[1]]))

    def _centres(self, left: np.ndarray, rng: np.random.Generator, rounds: int) -> np.ndarray:
        """Centres of residuals, each the mean of those nearest to it."""
        picked = rng.choice(len(left), (self.parts, CENTRES))
        books = np.stack([left[picked[m], m] for m in range(self.parts)]) + rng.normal(0, 1e-5, (self.parts, CENTRES, self.width))
        for _ in range(rounds):
            code = self._plain(left, books)
            for m in range(self.parts):
                n = np.bincount(code[:, m], minlength=CENTRES)
                for d in range(self.width):
                    total = np.bincount(code[:, m], left[:, m, d], CENTRES)
                    books[m, n > 0, d] = total[n > 0] / n[n > 0]
        return books

    def _first(self, x: np.ndarray) -> np.ndarray:
        """Codes by coordinate descent on |r|^2 + (eta - 1) (r . x)^2, r = x - quantised x, from the plainly nearest centres."""
        along = np.einsum("nmd,mkd->nmk", x, self.books)  # centre . x
        plain = (self.books**2).sum(2)[None] - 2 * along  # |x_m - centre|^2 without |x_m|^2
        code = plain.argmin(2)
        inner = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0]
        total = inner.sum(1)
        for _ in range(self.sweeps):
            for m in range(self.parts):
                rest = 1.0 - (total - inner[:, m])
                best = (plain[:, m] + (self.eta - 1) * (rest[:, None] - along[:, m]) ** 2).argmin(1)
                new = along[np.arange(len(x)), m, best]
                total += new - inner[:, m]
                code[:, m], inner[:, m] = best, new
        return code.astype(np.uint8)

    def errors(self, vectors: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(vectors, levels): by how much a score of a query of length one can be off once so many levels are added, the residual's
        length and the rounding of the tables' sums."""
        x, out = self._split(vectors), []
        for level in range(1, codes.shape[1] + 1):
            left = self._left(x, codes[:, :level])
            length = np.sqrt((left * left).sum((1, 2)))
            out.append(length + level * (self.parts + 4) * 2.0**-23 * (1 + length))
        return np.stack(out, 1)

    def _update(self, x: np.ndarray, code: np.ndarray) -> None:
        """The best centres for given codes, one subspace after the other (least squares of the same loss)."""
        rows = np.arange(self.parts)
        inner = (self.books[rows, code] * x).sum(2)
        total = inner.sum(1)
        for m in range(self.parts):
            rest = 1.0 - (total - inner[:, m])
            for k in range(CENTRES):
                own = code[:, m] == k
                if own.any():
                    v = x[own, m]
                    left = own.sum() * np.eye(self.width) + (self.eta - 1) * v.T @ v
                    right = v.sum(0) + (self.eta - 1) * (rest[own, None] * v).sum(0)
                    self.books[m, k] = np.linalg.solve(left, right)
            new = (self.books[m][code[:, m]] * x[:, m]).sum(1)
            total += new - inner[:, m]
            inner[:, m] = new

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each level (pairs of subspaces, queries, 256): the share of each pair of codes in the inner product."""
        x, out = self._split(queries), []
        for books in [self.books, *self.finer]:
            one = np.einsum("nmd,mkd->mnk", x, books).astype(np.float32)
            out.append((one[1::2, :, :, None] + one[0::2, :, None, :]).reshape(self.parts // 2, len(queries), 256))
        return out


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    return codes[..., 0::2] | (codes[..., 1::2] << 4)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _encode(quantiser):
    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column(1))
                codes = quantiser.value.codes(vectors)
                blob = pa.array([c.tobytes() for c in packed(codes)], pa.binary())
                errors = pa.array([e.tobytes() for e in quantiser.value.errors(vectors, codes)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blob, errors], ["vec_id", "vec", "code", "errors"])

    return encode


def _search(quantiser, k: int, rerank: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(key, candidates, queries):
        if not candidates.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids, vectors = np.asarray(candidates.column("vec_id")), _matrix(candidates.column("vec")).astype(np.float64)
        blob = lambda name, kind: np.frombuffer(b"".join(candidates.column(name).to_pylist()), kind)
        errors = np.ascontiguousarray(blob("errors", np.float64).reshape(len(ids), -1).T)
        codes = np.ascontiguousarray(blob("code", np.uint8).reshape(len(ids), len(errors), -1).transpose(1, 2, 0))
        lengths = np.sqrt((vectors * vectors).sum(1))
        query_ids, wanted = np.asarray(queries.column("query_id")), _matrix(queries.column("query")).astype(np.float64)
        exact = lambda rows, q: (vectors[rows] * q).sum(1) / (lengths[rows] * np.sqrt((q * q).sum()))
        kth = lambda score: np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf
        out = []
        for first in range(0, len(query_ids), 128):
            tables = quantiser.value.tables(wanted[first : first + 128])
            scan = np.zeros((tables[0].shape[1], len(ids)), np.float32)
            for table, code in zip(tables[0], codes[0], strict=True):
                scan += table[:, code]
            for i, near in enumerate(scan, first):
                near[ids == query_ids[i]] = -np.inf
                n = min(max(rerank, k), len(near))
                best = np.argpartition(near, len(near) - n)[len(near) - n :]
                best = best[np.isfinite(near[best])]
                score = exact(best, wanted[i])
                least = kth(score)
                reach = near + errors[0]
                reach[best] = -np.inf
                rest = np.flatnonzero((reach >= least) & np.isfinite(reach))
                guess, reach = near[rest], reach[rest]
                for level in range(1, len(codes)):
                    for table, code in zip(tables[level], codes[level], strict=True):
                        guess += table[i - first, code[rest]]
                    reach = guess + errors[level, rest]
                    still = reach >= least
                    rest, guess, reach = rest[still], guess[still], reach[still]
                order = np.argsort(-reach)
                rest, reach = rest[order], reach[order]
                for at in range(0, len(rest), PIECE):
                    if reach[at] < least:
                        break
                    piece = rest[at : at + PIECE]
                    best, score = np.append(best, piece), np.append(score, exact(piece, wanted[i]))
                    least = kth(score)
                top = np.lexsort((ids[best], -score))[:k]
                out.append((np.full(len(top), query_ids[i]), ids[best][top], score[top]))
        return pa.table([np.concatenate([x[j] for x in out]) for j in range(3)], schema=schema)

    return search


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, rerank: int = 100, **options) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query holds its k nearest among all other rows."""
    spark = vectors.sparkSession
    t = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), is_query.alias("is_query"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("vec", lambda x: x != 0)
    t = t.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    dims = t.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("n_queries")).orderBy(F.col("n").desc(), "dim").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    t = t.filter(F.size("vec") == dims["dim"])
    sample = t.select("vec", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    quantiser = spark.sparkContext.broadcast(Quantiser(np.array([r[0] for r in sample], np.float64), **options))  # levels x 16 centres per component
    n_blocks, n_queries = math.ceil(dims["n"] / CANDIDATES), max(1, math.ceil(dims["n_queries"] / QUERIES))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = dict(t.dtypes)["vec"]
    coded = t.select("vec_id", "vec").mapInArrow(_encode(quantiser), f"vec_id long, vec {kind}, code binary, errors binary")
    coded = coded.withColumn("block", block(n_blocks)).select("*", others(n_queries).alias("queries"))
    queries = t.filter("is_query").withColumn("queries", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(n_queries)).cast("int"))
    queries = queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query"), "queries", others(n_blocks).alias("block"))
    found = coded.groupBy("block", "queries").cogroup(queries.groupBy("block", "queries")).applyInArrow(_search(quantiser, k, rerank), FOUND)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    return nearest(C.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
