"""Hard negatives by bit-sliced integer products.

Components become whole numbers, and a tile of candidates is cut into the bit-planes of their two's complement. Planes are
multiplied with the anchors from the most significant one down. After each plane a score is known but for what the lower
planes can still add, between their ones under all negative and all positive components of the anchor: an interval that
shrinks by half a plane. A pair whose interval can't reach the scores that still count is dropped, a candidate or an anchor
without pairs leaves the tile, and the few pairs left at the end are exact, since whole numbers are added without error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metasift.llm.common import fresh_path, settle

#: Anchors that one pass over all rows works for: they're broadcast, a few hundred bytes each.
ANCHOR_CHUNK = 16384
#: Anchors and candidates whose pairs are held as a table at a time.
BLOCK, TILE = 512, 1024
#: Below this share of pairs left they're followed one by one.
FEW = 1 / 16
PAIRS_AT_A_TIME = 1 << 16
#: Components are below this: products of up to 32 768 such components fit a long.
LIMIT = 1 << 24
UNBOUNDED = 1 << 62


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, null where the vector can't take part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LIMIT))
    return F.when(usable & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def planes_of(matrix: np.ndarray) -> int:
    """Bits of the two's complement that holds all components."""
    return 1 + max(int(matrix.max(initial=0)).bit_length(), int(-1 - matrix.min(initial=-1)).bit_length())


class Anchors:
    """A block of anchors with what is known of each: components, label, id and the scores that count."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray):
        self.keys, self.ids, self.labels = keys, ids, labels
        # sums of products with single bits stay whole in float32 up to 2 ** 24
        exact = np.abs(matrix.astype(np.int64)).sum(axis=1).max(initial=0) < 1 << 24
        self.matrix = matrix.astype(np.float32 if exact else np.float64)
        self.below = np.minimum(matrix, 0).sum(axis=1, dtype=np.int64)
        self.above = np.maximum(matrix, 0).sum(axis=1, dtype=np.int64)

    def survivors(self, tile: np.ndarray, allowed: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, candidate and exact score of the ``allowed`` pairs that score from ``least`` to ``most``, which are given for each anchor."""
        a, c = np.flatnonzero(allowed.any(axis=1)), np.flatnonzero(allowed.any(axis=0))
        planes = planes_of(tile[c])
        alive, known = allowed[np.ix_(a, c)], np.zeros((len(a), len(c)), np.int64)
        p = planes - 1
        while p >= 0 and alive.size and np.count_nonzero(alive) > FEW * alive.size:
            bits = ((tile[c] >> p) & 1).astype(self.matrix.dtype)
            product = (self.matrix[a] @ bits.T).astype(np.int64)
            known += product * (-(1 << p) if p == planes - 1 else 1 << p)
            open_ = (1 << p) - 1
            alive &= (known + (open_ * self.above[a])[:, None] >= least[a][:, None]) & (known + (open_ * self.below[a])[:, None] <= most[a][:, None])
            rows, columns = alive.any(axis=1), alive.any(axis=0)
            if 2 * np.count_nonzero(rows) < len(rows) or 2 * np.count_nonzero(columns) < len(columns):
                known, alive, a, c = known[np.ix_(rows, columns)], alive[np.ix_(rows, columns)], a[rows], c[columns]
            p -= 1
        i, j = np.nonzero(alive)
        found = []
        for at in range(0, len(i), PAIRS_AT_A_TIME):
            found.append(self._follow(tile, a[i[at : at + PAIRS_AT_A_TIME]], c[j[at : at + PAIRS_AT_A_TIME]], known[i[at : at + PAIRS_AT_A_TIME], j[at : at + PAIRS_AT_A_TIME]], p, p == planes - 1, least, most))
        return tuple(np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def _follow(self, tile: np.ndarray, a: np.ndarray, c: np.ndarray, known: np.ndarray, p: int, signed: bool, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The planes from ``p`` down for single pairs. ``signed``: the first of them is that of the sign."""
        for plane in range(p, -1, -1):
            bits = ((tile[c] >> plane) & 1).astype(self.matrix.dtype)
            known = known + np.einsum("ij,ij->i", self.matrix[a], bits).astype(np.int64) * (-(1 << plane) if signed and plane == p else 1 << plane)
            open_ = (1 << plane) - 1
            left = (known + open_ * self.above[a] >= least[a]) & (known + open_ * self.below[a] <= most[a])
            a, c, known = a[left], c[left], known[left]
        return a, c, known


class Best:
    """The ``k`` best of each slot so far: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.slots, self.k = slots, k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(slots, -UNBOUNDED, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores equal to the k-th so far may still come in before it, by their ids."""
        if not len(slot):
            return
        slot, score, ids = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, slot))
        sorted_ = slot[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
        order, place = order[place < self.k], place[place < self.k]
        self.slot, self.score, self.id = slot[order], score[order], ids[order]
        full = place == self.k - 1
        self.least[self.slot[full]] = self.score[full]


def tiles(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and components of rows (id, label, vector) with vectors of one length."""
    for at in range(0, batch.num_rows, TILE):
        piece = batch.slice(at, TILE)
        for rows, matrix in by_length(piece.column(2)):
            yield piece.column(0).to_numpy()[rows], piece.column(1).to_numpy()[rows], matrix


def by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths, flat = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy()
    ends = np.cumsum(lengths)
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield rows, flat[(ends[rows] - size)[:, None] + np.arange(size)]


def blocks(asked: pa.Table) -> list[tuple[np.ndarray, Anchors]]:
    """Anchors (key, id, label, vector) in blocks of one length: their places in ``asked``, and themselves."""
    key, ids, label = (asked[name].to_numpy() for name in ("key", "id", "label"))
    found = []
    for rows, matrix in by_length(asked["vector"].combine_chunks()):
        for at in range(0, len(rows), BLOCK):
            own = rows[at : at + BLOCK]
            found.append((own, Anchors(key[own], ids[own], label[own], matrix[at : at + BLOCK])))
    return found


FOUND = "key long, slot int, id long, score long"


def _results(key: np.ndarray, slot: np.ndarray, best: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(slot.astype(np.int32)), pa.array(best.id), pa.array(best.score)], ["key", "slot", "id", "score"])


def search_positives(rows: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """Each task's ``k`` best rows of the anchor's own label."""
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(anchors, Best(len(anchors.keys), k)) for _, anchors in blocks(sent.value)]
        for batch in stream:
            for ids, labels, matrix in tiles(batch):
                for anchors, best in known:
                    if anchors.matrix.shape[1] == matrix.shape[1]:
                        allowed = (anchors.labels[:, None] == labels) & (anchors.ids[:, None] != ids)
                        a, c, score = anchors.survivors(matrix, allowed, best.least, np.full(len(anchors.keys), UNBOUNDED))
                        best.add(a, score, ids[c])
        for anchors, best in known:
            yield _results(anchors.keys[best.slot], np.zeros(len(best.slot)), best)

    return rows.mapInArrow(search, FOUND)


def search_negatives(rows: DataFrame, asked: pa.Table, slots: int, k: int, least: np.ndarray, most: np.ndarray) -> DataFrame:
    """Each task's ``k`` best rows of other labels for each anchor and slot, among scores from ``least`` to ``most`` ([anchor, slot])."""
    sent = rows.sparkSession.sparkContext.broadcast((asked, least, most))

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, low, high = sent.value
        known = [(anchors, low[own], high[own], Best(len(own) * slots, k)) for own, anchors in blocks(table)]
        for batch in stream:
            for ids, labels, matrix in tiles(batch):
                for anchors, low_, high_, best in known:
                    if anchors.matrix.shape[1] != matrix.shape[1]:
                        continue
                    needed = np.maximum(low_, best.least.reshape(-1, slots))
                    # an anchor's pairs live as long as any of its slots may want them; slots without a window want none
                    wants = needed <= high_
                    least_, most_ = np.where(wants, needed, UNBOUNDED).min(axis=1), np.where(wants, high_, -UNBOUNDED).max(axis=1)
                    allowed = (anchors.labels[:, None] != labels) & wants.any(axis=1)[:, None]
                    a, c, score = anchors.survivors(matrix, allowed, least_, most_)
                    pair, slot = np.nonzero((score[:, None] >= needed[a]) & (score[:, None] <= high_[a]))
                    best.add(a[pair] * slots + slot, score[pair], ids[c[pair]])
        for anchors, _, _, best in known:
            yield _results(anchors.keys[best.slot // slots], best.slot % slots, best)

    return rows.mapInArrow(search, FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """``found`` of all tasks with ``rank``, the ``k`` first of each anchor and slot."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("key", "slot").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, *, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", anchor_chunk: int = ANCHOR_CHUNK
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    For each anchor and each of its ``positives`` best rows of the same label: the ``negatives`` best rows of other labels
    that score from ``least`` to ``most`` hundredths of what the positive does; all where there are fewer. Ties go to smaller ids. A positive
    with a negative score has none, one with score 0 those with score 0. Rows with a null id, label or vector, an empty vector, a null or non-finite
    component, or one of 2^24 or more after scaling (products need not fit a long), take no part. A row is no candidate of an
    anchor with the same id, so repeated anchors don't find each other; each is worked for itself, and repeated candidates
    count each. Vectors of different lengths never meet. Other columns are ignored; an empty table gives an empty one.
    Anchors, any number, are taken in chunks of about ``anchor_chunk``, each two passes over all rows; of several chunks each
    one's finds are written to the shared folder before the next is taken.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole_numbers(F.col(vector_col), scale).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asked"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    asked = settle(rows.where("asked").select(F.monotonically_increasing_id().alias("key"), "id", "label", "vector"))
    rows = rows.select("id", "label", "vector")
    chunks = max(1, -(-asked.count() // anchor_chunk))
    if chunks == 1:
        return _chunk(rows, asked.toArrow(), positives, negatives, least, most)
    path = fresh_path(spark, "negatives")
    for n in range(chunks):
        chunk = asked.where(F.pmod(F.xxhash64("key"), F.lit(chunks)) == n).toArrow()
        _chunk(rows, chunk, positives, negatives, least, most).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _chunk(rows: DataFrame, asked: pa.Table, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    """One chunk of anchors against all rows. The driver holds the anchors and their positives, a few rows each."""
    spark = rows.sparkSession
    found = best_of(search_positives(rows, asked, positives), positives).select("key", "rank", "id", "score").toArrow()
    place = {key: k for k, key in enumerate(asked["key"].to_pylist())}
    low = np.full((asked.num_rows, positives), UNBOUNDED, np.int64)
    high = np.full((asked.num_rows, positives), -UNBOUNDED, np.int64)
    at = np.array([place[key] for key in found["key"].to_pylist()], np.int64), found["rank"].to_numpy().astype(np.int64) - 1
    score = found["score"].to_numpy()
    # 100 * negative lies between both products: rounded inwards
    low[at], high[at] = -(-least * score // 100), most * score // 100
    of_anchor = spark.createDataFrame(pa.table({"anchor": asked["key"], "anchor_id": asked["id"]}))
    of_slot = spark.createDataFrame(pa.table({"of": found["key"], "of_slot": pa.array(at[1], pa.int32()), "positive_id": found["id"], "positive_score": found["score"]}))
    mined = best_of(search_negatives(rows, asked, positives, negatives, low, high), negatives)
    named = mined.join(of_anchor, F.col("key") == F.col("anchor")).join(of_slot, (F.col("key") == F.col("of")) & (F.col("slot") == F.col("of_slot")))
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def contract_label(id_col: str = "vec_id", label_col: str = "label") -> Column:
    """The contract's labels: where 7 divides the id, the next one of ten."""
    return F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col))


NEGATIVES_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.id AS anchor_id, c.id, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])) AS BIGINT) AS score
           FROM v a, v c WHERE a.id % 100 = 0 AND a.id <> c.id AND len(a.e) = len(c.e)),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM scored WHERE same) WHERE n <= 5),
ranked AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
           FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
