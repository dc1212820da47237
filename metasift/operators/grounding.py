"""Citations of a text against the corpus: do they exist, and does the source carry the claim?"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metasift.functions import text as T
from metasift.functions import vectors as V
from metasift.operators.ordered import settled

THRESHOLD = 0.12


def cited(narratives: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos, cited_id, claim: each cited id once, in order, with the text around its first place."""
    found = narratives.select(id_col, F.col(text_col).alias("narrative"), F.posexplode(T.citations(F.col(text_col))).alias("pos", "cited_id"))
    return found.select(id_col, "pos", "cited_id", T.claim_context(F.col("narrative"), F.col("cited_id")).alias("claim"))


def verify(claims: DataFrame, corpus: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """exists_in_corpus, similarity and grounded of each claim. ``corpus``: record_id, source (null where no text is known).

    A citation outside the corpus isn't grounded; one whose source has no text is taken as grounded.
    """
    known = V.with_vector(corpus.select(F.col("record_id").alias("cited_id"), F.lit(True).alias("known"), "source"), "source", "source_vector")
    known = known.withColumn("silent", F.coalesce(F.length("source"), F.lit(0)) == 0).drop("source")
    # both sides meet as vectors, never as texts
    rows = V.with_vector(claims, "claim", "claim_vector").drop("claim").join(known, "cited_id", "left")
    scored = rows.withColumn("similarity", V.sparse_dot(F.col("claim_vector"), F.col("source_vector")))
    exists = F.coalesce("known", F.lit(False))
    grounded = exists & (F.coalesce("silent", F.lit(True)) | (F.col("similarity") >= threshold))
    return scored.select(id_col, "pos", "cited_id", exists.alias("exists_in_corpus"), "similarity", grounded.alias("grounded"))


def flagged(exists: Column, grounded: Column) -> Column:
    return ~exists | ~grounded


def reports(checks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per text: checks, flagged checks and whether any is."""
    bad = flagged(F.col("exists_in_corpus"), F.col("grounded"))
    return checks.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(bad).alias("n_flagged"), F.bool_or(bad).alias("hallucination_flagged"), F.array_sort(F.collect_list(F.when(bad, F.col("pos")))).alias("flagged_positions"))


#: Query vectors that meet all rows at a time, and rows in one product with them.
QUERY_CHUNK, TILE = 2048, 2048
#: Similarities that agree to this many places are equal.
PLACES = 12


def most_similar(queries: DataFrame, vectors: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", seq_col: str = "vec_id", query_chunk: int = QUERY_CHUNK) -> DataFrame:
    """query_id, rank, id, similarity: the ``k`` most similar vectors of each query, earlier ones first among equals.

    Queries, any number, are taken in chunks of about ``query_chunk``; each chunk is broadcast and meets all vectors in
    tiles, and a task keeps the ``k`` best of each query. With several chunks each one's finds are settled in the shared
    folder. Vectors of other lengths, null ones and those with null components take no part; a zero vector's similarity is 0.
    """
    whole = lambda v: v.isNotNull() & F.forall(v, lambda x: x.isNotNull())
    rows = vectors.where(whole(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(seq_col).cast("long").alias("seq"), F.col(vector_col).cast("array<double>").alias("vector"))
    asked = queries.where(whole(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    chunks = max(1, -(-asked.count() // query_chunk))
    found = None
    for n in range(chunks):
        # a chunk's vectors are few by its size
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == n).toArrow().combine_chunks()
        best = _best(rows, part, k)
        best = settled(best) if chunks > 1 else best
        found = best if found is None else found.unionAll(best)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", PLACES)), "seq")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "similarity")


def _by_length(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, ids and unit vectors, by number of components."""
    sizes, flat = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        matrix = flat[(ends[at] - size)[:, None] + np.arange(size)]
        norms = np.linalg.norm(matrix, axis=1)
        yield at, ids.to_numpy()[at], matrix / np.where(norms > 0, norms, 1)[:, None]


def _best(rows: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """The ``k`` best rows of each query and task: query_id, id, seq, similarity."""
    known = {unit.shape[1]: (ids, unit) for _, ids, unit in _by_length(asked["id"].combine_chunks(), asked["vector"].combine_chunks())} if asked.num_rows else {}
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # query, similarity, seq and id of what is kept so far, by number of components
        kept: dict[int, list[np.ndarray]] = {}
        for tile in (batch.slice(at, TILE) for batch in stream for at in range(0, batch.num_rows, TILE)):
            seqs = tile.column(1).to_numpy()
            for at, ids, unit in _by_length(tile.column(0), tile.column(2)):
                size = unit.shape[1]
                if size not in sent.value:
                    continue
                similar = sent.value[size][1] @ unit.T
                least = np.partition(similar, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(similar), -np.inf)
                q, c = np.nonzero(similar >= least[:, None] - 10.0**-PLACES)
                new = [q, similar[q, c], seqs[at][c], ids[c]]
                held = [np.concatenate(pair) for pair in zip(kept[size], new, strict=True)] if size in kept else new
                order = np.lexsort((held[2], -np.round(held[1], PLACES), held[0]))
                query = held[0][order]
                first = np.searchsorted(query, query)
                order = order[np.arange(len(query)) - first < k]
                kept[size] = [column[order] for column in held]
        for size, (q, similarity, seq, ids) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[size][0][q]), pa.array(ids), pa.array(seq), pa.array(similarity)], ["query_id", "id", "seq", "similarity"])

    return rows.mapInArrow(search, "query_id long, id long, seq long, similarity double")


def upsert(vectors: DataFrame, id_col: str = "doc_id", seq_col: str = "seq") -> DataFrame:
    """The last row of each id."""
    others = [c for c in vectors.columns if c != id_col]
    return vectors.groupBy(id_col).agg(F.max_by(F.struct(*others), seq_col).alias("last")).select(id_col, "last.*")
