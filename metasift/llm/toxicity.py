"""Toxicity grades by cumulative-link ordinal regression.

Features are words and word prefixes, hashed; a feature's value is log(1 + its count). One weight vector is shared by all
thresholds: P(grade >= k) = sigmoid(w.x - t_k) with t_1 < t_2 < ... The expected severity is the sum of these. Labels that
only say toxic or not are graded first: toxic rows are cut into equal parts by how much they hold of what marks toxic rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 22
PREFIXES = (5, 6, 7)
#: Labelled rows that the model is fitted on (those with the smallest hashed ids), and features it keeps.
FITTED, FEATURES = 6000, 1000
#: Tasks that read the sample.
FIT_PARTS = 16
#: Probability from which a grade counts as reached. Few rows are toxic, so missing one weighs more than a false mark: on held-out
#: labels this finds more of them than one half does, with the same false marks.
REACHED = 0.3
#: Likelihood ratio from which a feature counts as a mark of toxic rows (a chance of about 1e-7 for one feature).
MARK = 15.0
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # 2^64 over the golden ratio
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which characters are letters or marks."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


@lru_cache(maxsize=8)
def _powers(base: np.uint64, bits: int) -> np.ndarray:
    """The first 2 ** bits powers of ``base``, modulo 2 ** 64."""
    factors = np.full(1 << bits, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text and their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = np.zeros(len(codes) + 2, bool)
    letter[1:-1] = _letters()[codes]
    edges = np.diff(letter.astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.int32), np.empty(0, np.int32)
    # a word's hash is a polynomial of its characters: a difference of prefix sums, shifted back to its start
    bits = max(10, len(codes).bit_length())
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(MULTIPLIER, bits)[: len(codes)])))
    back = _powers(INVERSE, bits)[starts]
    hashed = lambda rows, size: (sums[starts[rows] + size] - sums[starts[rows]]) * back[rows]
    lengths, out = ends - starts, []
    for size in PREFIXES:
        longer = np.flatnonzero(lengths >= size)
        out.append((hashed(longer, size) + np.uint64(size)) * MULTIPLIER)
    out.append((hashed(np.arange(len(starts)), lengths) ^ np.uint64(1 << 40)) * MULTIPLIER)
    out = [x ^ (x >> np.uint64(32)) for x in out]
    ids = (np.concatenate(out) * MULTIPLIER) >> np.uint64(64 - BUCKET_BITS)
    found, counts = np.unique(ids.astype(np.int32), return_counts=True)
    return found, counts.astype(np.int32)


@dataclass
class Model:
    place: np.ndarray  # bucket -> place in weights, -1 for buckets that aren't used
    weights: np.ndarray
    thresholds: np.ndarray


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


def select_features(row: np.ndarray, bucket: np.ndarray, toxic: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets whose presence says most about being above grade 0, by the likelihood ratio of their two-by-two table; and which of them are strong marks (a ratio of at least MARK, and more frequent above 0)."""
    found, place = np.unique(bucket, return_inverse=True)
    with_it = np.bincount(place, toxic[row], len(found))
    present = np.bincount(place, minlength=len(found)).astype(float)
    del place
    n, n1 = float(len(toxic)), float(toxic.sum())
    gain = np.zeros(len(found))
    for seen, of_feature, of_class in ((with_it, present, n1), (present - with_it, present, n - n1), (n1 - with_it, n - present, n1), (n - n1 - present + with_it, n - present, n - n1)):
        gain += seen * np.log(np.maximum(seen, 1e-300) * n / np.maximum(of_feature * of_class, 1e-300))
    gain[present < 3] = 0
    best = np.argsort(-gain, kind="stable")[:keep]
    best = np.sort(best[gain[best] > 0])
    return found[best], (gain[best] >= MARK) & (with_it[best] * n > present[best] * n1)


def minimise(loss, start: np.ndarray, *, steps: int, memory: int = 10) -> np.ndarray:
    """L-BFGS with backtracking; ``loss`` gives a value and its gradient."""
    x, (value, grad) = start, loss(start)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, used = grad.copy(), []
        for s, y in reversed(pairs):
            used.append(s @ way / (s @ y))
            way -= used[-1] * y
        if pairs:
            way *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1])
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            way += (a - y @ way / (s @ y)) * s
        length = 1.0 if pairs else 1 / max(np.linalg.norm(grad), 1e-12)
        while length > 1e-10:
            new_value, new_grad = loss(x - length * way)
            if new_value <= value - 1e-4 * length * (grad @ way):
                break
            length /= 2
        else:
            return x
        step, change = -length * way, new_grad - grad
        x, done = x + step, value - new_value < 1e-9
        value, grad = new_value, new_grad
        if step @ change > 1e-12:
            pairs = [*pairs, (step, change)][-memory:]
        if done:
            return x
    return x


def fit_ordinal(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int, *, ridge: float = 3e-6, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds that minimise the mean negative log likelihood with a ridge penalty on the weights."""
    levels, n = int(grade.max()) if len(grade) else 1, len(grade)
    every = np.arange(n)
    at_least = np.array([np.clip((grade >= k).mean(), 1e-3, 1 - 1e-3) for k in range(1, levels + 1)])
    first = np.log(1 / at_least - 1)
    start = np.concatenate((np.zeros(width), first[:1], np.log(np.maximum(np.diff(first), 1e-2))))

    def thresholds(state: np.ndarray) -> np.ndarray:
        return np.concatenate((state[width : width + 1], state[width] + np.cumsum(np.exp(state[width + 1 :]))))

    def loss(state: np.ndarray) -> tuple[float, np.ndarray]:
        w = state[:width]
        score = np.bincount(row, w[column] * value, n)
        below = np.column_stack((np.zeros(n), sigmoid(thresholds(state)[None, :] - score[:, None]), np.ones(n)))
        slope = below * (1 - below)
        p = np.maximum(below[every, grade + 1] - below[every, grade], 1e-12)
        up, down = slope[every, grade + 1] / p, slope[every, grade] / p
        of_score = (up - down) / n
        of_t = np.array([np.where(grade == k, down, 0).sum() - np.where(grade == k - 1, up, 0).sum() for k in range(1, levels + 1)]) / n
        of_gap = [of_t[k:].sum() * np.exp(state[width + k]) for k in range(1, levels)]
        grad = np.concatenate((np.bincount(column, of_score[row] * value, width) + ridge * w, [of_t.sum()], of_gap))
        return -np.log(p).mean() + ridge * (w @ w) / 2, grad

    state = minimise(loss, start, steps=steps)
    return state[:width], thresholds(state)


def split_by_burden(toxic: np.ndarray, burden: np.ndarray, parts: int) -> np.ndarray:
    """Grades 1 to ``parts`` for toxic rows, by rank of their burden; 0 for the others."""
    grade, rows = np.zeros(len(toxic), np.int64), np.flatnonzero(toxic)
    grade[rows[np.argsort(burden[rows], kind="stable")]] = 1 + np.arange(len(rows)) * parts // max(len(rows), 1)
    return grade


def fit(labelled: DataFrame, *, keep: int = FEATURES, toxic_grades: int = 2, text_col: str = "text", grade_col: str = "grade") -> Model:
    """A model of the grades (0, 1, 2, ...) of ``labelled``, a bounded sample: see sample_of.

    Features are counted in tasks; the driver gets those of the sample. Grades that are only 0 and 1 are split first, the
    toxic rows into ``toxic_grades`` parts. With fewer than two grades every text is graded 0.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(grade_col).cast("int").alias("grade"))

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = [features(t.as_py() or "") for t in batch.column(0)]
            numbers = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*numbers, batch.column(1)], ["buckets", "counts", "grade"])

    sample = rows.select("text", "grade").mapInArrow(count, "buckets array<int>, counts array<int>, grade int").toArrow()
    grade = sample["grade"].to_numpy().astype(np.int64)
    place = np.full(1 << BUCKET_BITS, -1, np.int16)
    if len(np.unique(grade)) < 2 or grade.min() > 0:
        return Model(place, np.zeros(1), np.array([np.inf]))
    buckets, counts = sample["buckets"].combine_chunks(), sample["counts"].combine_chunks()
    row = np.repeat(np.arange(len(grade), dtype=np.int32), buckets.value_lengths().to_numpy())
    bucket, n = buckets.flatten().to_numpy(), counts.flatten().to_numpy()
    chosen, marks = select_features(row, bucket, (grade > 0).astype(float), keep)
    place[chosen] = np.arange(len(chosen))
    used = place[bucket] >= 0
    if grade.max() == 1 and toxic_grades > 1:
        burden = np.bincount(row[used], np.log1p(n[used]) * marks[place[bucket[used]]], len(grade))
        grade = split_by_burden(grade > 0, burden, toxic_grades)
    weights, thresholds = fit_ordinal(row[used], place[bucket[used]], np.log1p(n[used]), grade, max(len(chosen), 1))
    return Model(place, weights, thresholds)


def sample_of(docs: DataFrame, labels: DataFrame, grade: Column, *, fitted: int = FITTED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and grade of at most ``fitted`` rows: those of the labelled ids with the smallest hashes, or of as many of them as fit where ids have several rows.

    An id with several labels has its highest grade; ties of hashes go by id, then by the hashed text.
    """
    known = labels.select(F.col(id_col), grade.alias("grade")).where("grade IS NOT NULL")
    chosen = known.groupBy(id_col).agg(F.max("grade").alias("grade")).orderBy(F.xxhash64(id_col), id_col).limit(fitted)
    return docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).orderBy(F.xxhash64(id_col), id_col, F.xxhash64(text_col)).limit(fitted).repartition(FIT_PARTS)


def grade_texts(docs: DataFrame, model: Model, *, reached_from: float = REACHED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, grade (the largest whose probability is at least ``reached_from``), expected_severity, p_toxic, toxic.

    A null or empty text is scored without features; a very long one by all its words, and all of every word. Repeated rows
    and texts with equal features get equal scores; a probability equal to ``reached_from`` reaches its grade. Other columns are
    ignored; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), F.col(text_col))
    id_type = rows.schema[id_col].dataType.simpleString()

    def judge(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = sent.value
        for batch in stream:
            scores = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(1)):
                buckets, counts = features(text.as_py() or "")
                places = known.place[buckets]
                scores[i] = known.weights[places[places >= 0]] @ np.log1p(counts[places >= 0])
            reached = sigmoid(scores[:, None] - known.thresholds[None, :])
            arrays = [batch.column(0), pa.array((reached >= reached_from).sum(axis=1).astype(np.int32)), pa.array(reached.sum(axis=1)), pa.array(reached[:, 0]), pa.array(reached[:, 0] >= reached_from)]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "grade", "expected_severity", "p_toxic", "toxic"])

    return rows.mapInArrow(judge, f"`{id_col}` {id_type}, grade int, expected_severity double, p_toxic double, toxic boolean")
