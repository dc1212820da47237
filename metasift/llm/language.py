"""Language identification by multinomial naive Bayes over hashed character n-grams.

N-grams of one to three characters of the lower-cased text (runs of anything but letters count as one space) are hashed
into buckets. Counts by language give a matrix of log probabilities with add-one smoothing, which is broadcast; texts are
scored in numpy, a batch at a time, from the sparse list of their buckets. However many languages there are, the buckets
stay the same: the matrix is cut into blocks of languages, and each block is a pass over the texts that gives every text its best
language there and the sum that the posterior needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.llm.common import fresh_path, settle, tidy

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Documents of each language that the model is fitted on, about: a sample by hashed id.
FITTED_A_LANGUAGE = 3000
HASH_RANGE = 1 << 40
#: Languages whose part of the matrix is broadcast at a time, 128 kB each.
LANGUAGES_A_BLOCK = 256
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # 2^64 over the golden ratio
#: Characters scored at a time.
PIECE = 1 << 20


@dataclass
class Block:
    languages: list[str]
    log_probability: np.ndarray  # bucket x language
    log_prior: np.ndarray


@dataclass
class Model:
    """All languages in order, how many documents each was fitted on, and the counts (label, bucket, n), which stay with Spark."""

    languages: list[str]
    documents: np.ndarray
    counts: DataFrame
    block_size: int = LANGUAGES_A_BLOCK

    def blocks(self) -> Iterator[Block]:
        """The matrix, some languages at a time. A model without languages has none."""
        log_prior = np.log(self.documents / max(self.documents.sum(), 1))
        for at in range(0, len(self.languages), self.block_size):
            names = self.languages[at : at + self.block_size]
            rows = self.counts.where(F.col("label").between(names[0], names[-1]) & (F.col("bucket") >= 0)).toArrow()
            place = pa.array(names)
            table = np.ones((BUCKETS, len(names)))
            table[rows["bucket"].to_numpy(), pc.index_in(rows["label"], place).to_numpy()] += rows["n"].to_numpy()
            yield Block(names, np.log(table / table.sum(axis=0)).astype(np.float32), log_prior[at : at + self.block_size])


def simplified(text: Column) -> Column:
    """Lower case, with each run of anything but letters and marks as one space, and a space at both ends."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " "), F.lit(" "))


def buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket of each n-gram, some characters at a time."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, max(len(codes), 1), PIECE):
        piece = codes[at : at + PIECE + max(ORDERS) - 1].astype(np.uint64)
        for n in ORDERS:
            starts = min(PIECE, len(piece) - n + 1)
            if starts <= 0:
                continue
            mixed = np.full(starts, n, np.uint64)
            for k in range(n):
                mixed = mixed * MULTIPLIER + piece[k : k + starts]
            yield ((mixed * MULTIPLIER) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def fit(docs: DataFrame, label: Column, *, per_language: int = FITTED_A_LANGUAGE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the non-null labels, fitted on about ``per_language`` different rows of each, or all it has if fewer.

    Which rows: those whose hashed ids and texts fall under the label's share of the hash range, so a rerun takes the same, no
    task ranks a label's rows and repeated ids are chosen apart; rows that tie there are equal and chosen together. Counting
    runs in tasks, and the counts stay in the shared folder. The driver gets one row a language. Without labelled rows the model knows no language.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), label.cast("string").alias("label")).where("label IS NOT NULL AND text IS NOT NULL")
    # a row a label, as an Arrow table, whose size Spark knows: while it's small it is broadcast, so no text is moved
    sizes = labelled.groupBy("label").count().toArrow()
    under = [HASH_RANGE if n <= per_language else HASH_RANGE * per_language // n for n in sizes["count"].to_pylist()]
    shares = docs.sparkSession.createDataFrame(pa.table({"share_of": sizes["label"], "under": pa.array(under, pa.int64())}))
    chosen = labelled.join(shares, F.col("label") == F.col("share_of")).where(F.pmod(F.xxhash64("id", "text"), F.lit(HASH_RANGE)) < F.col("under"))
    texts = chosen.select("label", simplified(F.col("text")).alias("text"))

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}

        def result(name: str) -> pa.RecordBatch:
            own = counts.pop(name)
            used = np.flatnonzero(own)
            numbers, values = np.append(used, -1), np.append(own[used], documents.pop(name))
            return pa.RecordBatch.from_arrays([pa.array([name] * len(numbers)), pa.array(numbers, pa.int64()), pa.array(values, pa.int64())], ["label", "bucket", "n"])

        for batch in stream:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                documents[name] = documents.get(name, 0) + 1
                for part in buckets(text.as_py()):
                    own += np.bincount(part, minlength=BUCKETS)
                if len(counts) > LANGUAGES_A_BLOCK:
                    yield result(next(iter(counts)))
        for name in list(counts):
            yield result(name)

    summed = settle(texts.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")))
    known = sorted((r["label"], r["n"]) for r in summed.where("bucket = -1").collect())
    return Model([name for name, _ in known], np.array([n for _, n in known], float), summed)


def summed(part: np.ndarray, log_probability: np.ndarray) -> np.ndarray:
    """Log probability of some buckets by language: of each bucket once, times how often it occurs, where there are more than buckets."""
    if len(part) <= len(log_probability):
        return log_probability[part].sum(axis=0, dtype=np.float64)
    return np.bincount(part, minlength=len(log_probability)) @ log_probability.astype(np.float64)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``lang_pred``, ``score`` (posterior probability), and the columns of ``keep``.

    A null text, a text without a letter, and any text under a model without languages is ``und`` with score 0. Ties go to
    the language first in code point order. Very long texts are scored whole, a million characters at a time. Repeated rows are
    judged each; an empty table gives an empty one. With several blocks of languages the simplified texts are written to the
    shared folder once, and each block's pass over them before the next one's.
    """
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col), *keep, F.when(has_letter, simplified(F.col(text_col))).alias("simplified"))
    columns = [F.col(id_col), *keep]
    blocks = model.blocks()
    if len(model.languages) <= model.block_size:
        judged = _judge(rows, next(blocks, None))
    else:
        spark, path, finds = docs.sparkSession, fresh_path(docs.sparkSession, "texts"), fresh_path(docs.sparkSession, "judged")
        rows.select(F.monotonically_increasing_id().alias("row_"), F.struct(*columns).alias("kept_"), "simplified").write.parquet(path)
        written = spark.read.parquet(path)
        for n, block in enumerate(blocks):
            _judge(written.select("row_", "simplified"), block).withColumn("block_", F.lit(-n)).write.mode("append").parquet(finds)
        found = spark.read.parquet(finds).groupBy("row_").agg(F.collect_list(F.struct("judged_top", "block_", "judged_best", "judged_total")).alias("all_"))
        best = F.array_max("all_")
        # sums are relative to their own block's best
        total = F.aggregate("all_", F.lit(0.0), lambda s, b: s + b["judged_total"] * F.exp(b["judged_top"] - F.col("best_.judged_top")))
        found = found.withColumn("best_", best).select("row_", F.col("best_.judged_best").alias("judged_best"), F.when(F.col("best_.judged_best").isNotNull(), total).alias("judged_total"))
        judged = written.select("row_", "kept_").join(found, "row_").select("kept_.*", "judged_best", "judged_total")
    return judged.select(*columns, F.coalesce("judged_best", F.lit("und")).alias("lang_pred"), F.coalesce(1 / F.col("judged_total"), F.lit(0.0)).alias("score"))


def _judge(rows: DataFrame, block: Block | None) -> DataFrame:
    """``rows`` with judged_best (language of the block), judged_top (its log probability) and judged_total (all of the block's, relative to it) in place of the last column, the text; null where there's nothing to judge."""
    sent = rows.sparkSession.sparkContext.broadcast(block)
    kept = rows.drop("simplified").schema

    def judge(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Block | None = sent.value
        for batch in stream:
            names, tops, totals = [], [], []
            for text in batch.column(batch.num_columns - 1):
                value = text.as_py()
                if value is None or known is None:
                    names.append(None)
                    tops.append(None)
                    totals.append(None)
                    continue
                total = known.log_prior.copy()
                for part in buckets(value):
                    total += summed(part, known.log_probability)
                best = int(total.argmax())
                names.append(known.languages[best])
                tops.append(float(total[best]))
                totals.append(float(np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(tops, pa.float64()), pa.array(totals, pa.float64())], [*kept.names, "judged_best", "judged_top", "judged_total"])
            tidy()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(judge, f"{fields}, judged_best string, judged_top double, judged_total double")


def held_out(id_col: str = "doc_id") -> Column:
    """The contract's fold: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
