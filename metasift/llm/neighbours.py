"""Exact nearest neighbours by a block matrix join over int8 tiles.

Query vectors are taken in chunks of bounded size; each chunk meets every tile of candidates once. Both sides are rounded to
int8 with one scale a vector. The tile product gives the distances of the rounded vectors, and by the triangle inequality
the true distance lies within the two rounding errors of it. A pair whose lower bound is above the k-th smallest upper
bound of its query can't be among its k nearest; all others are recomputed from the original components and kept in heaps,
which are merged over tasks at the end.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metasift.llm.common import fresh_path

QUERY_CHUNK = 2048
TILE = 2048
#: Products of int8 components are added exactly in float32 up to this many; wider vectors use float64.
EXACT_IN_FLOAT32 = 1024
#: Pairs recomputed at a time.
REFINED = 1 << 16


def usable(vector: Column) -> Column:
    """Not null, not all zero, no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


class Rounded:
    """Vectors with their int8 form, scale and rounding error."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.scale = np.abs(vectors).max(axis=1) / 127
        self.scale[self.scale == 0] = np.finfo(float).tiny
        whole = np.rint(vectors / self.scale[:, None])
        self.int8 = np.clip(whole, -127, 127).astype(np.int8)
        near = self.int8 * self.scale[:, None]
        with np.errstate(over="ignore", invalid="ignore"):
            self.error = np.linalg.norm(vectors - near, axis=1)
        # infinite where a square is too large: such bounds say nothing, and what they belong to is recomputed
        self.squared = np.einsum("ij,ij->i", near, near)

    def bounds(self, other: Rounded) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the distances between all of these and all of the other."""
        kind = np.float32 if self.int8.shape[1] <= EXACT_IN_FLOAT32 else np.float64
        product = (self.int8.astype(kind) @ other.int8.astype(kind).T).astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            product *= self.scale[:, None] * other.scale[None, :]
            near = np.sqrt(np.maximum(self.squared[:, None] + other.squared[None, :] - 2 * product, 0))
            # the square root magnifies what float64 loses where two vectors are nearly the same
            slack = self.error[:, None] + other.error[None, :] + 1e-7 * np.sqrt(self.squared[:, None] + other.squared[None, :])
            lower, upper = near - slack, near + slack
        unknown = ~np.isfinite(upper)
        lower[unknown], upper[unknown] = -np.inf, np.inf
        return lower, upper


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, components added one after another in double precision; infinite where a square is too large for it."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for j in range(a.shape[1]):
            gap = a[:, j] - b[:, j]
            total += gap * gap
    return np.sqrt(total)


class Heaps:
    """The k nearest found so far of each query, and a bound beyond which no candidate matters."""

    def __init__(self, queries: Rounded, k: int):
        self.queries, self.k = queries, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
        self.bound = np.full(len(queries.ids), np.inf)

    def meet(self, tile: Rounded) -> None:
        lower, upper = self.queries.bounds(tile)
        own = self.queries.ids[:, None] == tile.ids[None, :]
        lower[own] = upper[own] = np.inf
        if tile.ids.size >= self.k:
            self.bound = np.minimum(self.bound, np.partition(upper, self.k - 1, axis=1)[:, self.k - 1])
        q, c = np.nonzero((lower <= self.bound[:, None]) & ~own)
        for at in range(0, len(q), REFINED):
            qs, cs = q[at : at + REFINED], c[at : at + REFINED]
            exact = distances(self.queries.vectors[qs], tile.vectors[cs])
            for i, d, v in zip(qs.tolist(), exact.tolist(), tile.ids[cs].tolist(), strict=True):
                heap, item = self.heaps[i], (-d, -v)
                if len(heap) < self.k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        for i in np.unique(q):
            if len(self.heaps[i]) == self.k:
                self.bound[i] = min(self.bound[i], -self.heaps[i][0][0])


def matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and float64 rows, by dimension."""
    lengths = vectors.value_lengths().to_numpy()
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lengths)
    numbers = ids.to_numpy()
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield numbers[rows], flat[(ends[rows] - size)[:, None] + np.arange(size)]


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", query_chunk: int = QUERY_CHUNK) -> DataFrame:
    """query_id, rank (from 1), the id and the exact Euclidean distance (``score``) of each query's ``k`` nearest rows.

    Ties go to the smaller id; distances beyond double precision are infinite and tie; a query with fewer candidates gets them all. A row is no candidate of a query with the same
    id. Rows with a null id, and vectors that are null, zero or hold a null or non-finite component, take no part; vectors of
    different lengths never meet. Other columns are ignored; an empty table gives an empty one. Where the queries need more
    than one chunk, each chunk's finds are written to the shared folder before the next chunk is taken, so one chunk is held at a time.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    asked = rows.where("asked").select("id", "vector")
    chunks = max(1, -(-asked.count() // query_chunk))
    if chunks == 1:
        merged, _ = _pass(rows, asked, k)
    else:
        merged = _chunk_by_chunk(rows, asked, chunks, k)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score")


def _chunk_by_chunk(rows: DataFrame, asked: DataFrame, chunks: int, k: int) -> DataFrame:
    """All finds, from the shared folder. Queries are written by chunk first, so a pass reads its own alone."""
    spark = rows.sparkSession
    queries, finds = fresh_path(spark, "queries"), fresh_path(spark, "nearest")
    asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).write.partitionBy("chunk").parquet(queries)
    written = spark.read.parquet(queries)
    for n in range(chunks):
        found, sent = _pass(rows, written.where(F.col("chunk") == n).select("id", "vector"), k)
        found.write.mode("append").parquet(finds)
        sent.destroy()
    return spark.read.parquet(finds)


def _pass(rows: DataFrame, asked: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    """One chunk of queries (about ``query_chunk`` vectors, broadcast) against all rows; and the broadcast."""
    table = asked.toArrow().combine_chunks()
    known = [Rounded(*part) for part in matrices(table["id"].combine_chunks(), table["vector"].combine_chunks())] if table.num_rows else []
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = {part.vectors.shape[1]: Heaps(part, k) for part in sent.value}
        for batch in stream:
            for at in range(0, batch.num_rows, TILE):
                tile = batch.slice(at, TILE)
                for ids, matrix in matrices(tile.column(0), tile.column(1)):
                    if matrix.shape[1] in heaps:
                        heaps[matrix.shape[1]].meet(Rounded(ids, matrix))
        for found in heaps.values():
            kept = [(int(q), -v, -d) for q, heap in zip(found.queries.ids, found.heaps, strict=True) for d, v in heap]
            if kept:
                q, v, d = zip(*kept, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float64())], ["query_id", "vec_id", "score"])

    return rows.select("id", "vector").mapInArrow(search, "query_id long, vec_id long, score double"), sent


NEAREST_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
          FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
