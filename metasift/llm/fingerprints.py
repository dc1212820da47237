"""Context-triggered piecewise hashing of whole texts, and how alike two fingerprints are.

A rolling hash of the last seven bytes decides where a piece ends, so an edit moves no borders but its own. A piece is
one character of the signature, from its CRC-32. With block size ``b`` a piece ends where the hash leaves ``b - 1``; block
sizes are 3 times a power of two, so the ends at twice a block size are among those at the block size itself. A fingerprint
holds its block size and the signatures at that size and at twice it. Two fingerprints are compared where they have a
block size in common, by the edit distance of the signatures there.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasift.llm.common import settle, tidy

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Bytes that the rolling hash sees, the smallest block size, and how many doublings of it there are.
WINDOW, LEAST_BLOCK, LEVELS = 7, 3, 40
#: Pieces that the block size aims at: it's the largest up to length / LONGEST, rounded up, that gives this many, or the smallest there is.
PIECES = 32
#: Characters of a signature; the last one covers all that is left.
LONGEST = 64
#: Run of signature characters that unrelated texts hardly share; shorter signatures ask for a quarter of their length.
COMMON_RUN = 7
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # 2^64 over the golden ratio
#: Bytes hashed at a time.
STRETCH = 1 << 20


def triggers(data: bytes) -> tuple[list[int], list[list[int]]]:
    """By level, the number of places where a piece may end at block size ``LEAST_BLOCK << level``, and the first ends among them."""
    counts, firsts = [0] * LEVELS, [[] for _ in range(LEVELS)]
    for at in range(0, len(data), STRETCH):
        before = min(at, WINDOW - 1)
        piece = np.frombuffer(data, np.uint8, min(STRETCH, len(data) - at) + before, at - before).astype(np.uint64) + np.uint64(1)
        mixed = np.zeros(len(piece), np.uint64)
        for k in range(min(WINDOW, len(piece))):
            # the byte k places back, times a power of its own
            mixed[k:] += piece[: len(piece) - k] * MULTIPLIER ** np.uint64(k + 1)
        after = (((mixed[before:] * MULTIPLIER) >> np.uint64(32)) + np.uint64(1)).astype(np.int64)
        ends = np.flatnonzero(after % LEAST_BLOCK == 0)
        # how often two divides the hash plus one
        after = after[ends]
        levels = np.log2(after & -after).astype(np.int64)
        sizes = np.bincount(levels, minlength=LEVELS)[::-1].cumsum()[::-1]
        for level in np.flatnonzero(sizes[:LEVELS]).tolist():
            counts[level] += int(sizes[level])
            if (missing := LONGEST - 1 - len(firsts[level])) > 0:
                firsts[level] += (ends[levels >= level][:missing] + at + 1).tolist()
    return counts, firsts


def signature(data: bytes, ends: list[int]) -> str:
    """A character for each piece; where the last end isn't the end of the text, the rest is a piece too."""
    out, start = [], 0
    for end in ends:
        out.append(ALPHABET[zlib.crc32(data[start:end]) & 63])
        start = end
    if start < len(data):
        out.append(ALPHABET[zlib.crc32(memoryview(data)[start:]) & 63])
    return "".join(out)


def fingerprint(text: str) -> str:
    """``block:signature:signature at twice the block``; an empty text has no pieces."""
    data = text.encode("utf-8", "surrogatepass")
    counts, firsts = triggers(data)
    # by length first: a text that repeats itself ends a piece at the same block sizes again and again
    usual = max(-(-len(data) // (LONGEST * LEAST_BLOCK)) - 1, 0).bit_length()
    level = max((k for k in range(min(usual + 1, LEVELS - 1)) if counts[k] >= PIECES), default=0)
    return f"{LEAST_BLOCK << level}:{signature(data, firsts[level])}:{signature(data, firsts[level + 1])}"


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest, a row of the table at a time as the bits of one number."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    whole = (1 << len(a)) - 1
    rows = whole
    for c in b:
        hit = rows & places.get(c, 0)
        rows = ((rows + hit) | (rows - hit)) & whole
    return len(a) - rows.bit_count()


def signature_likeness(a: str, b: str) -> float:
    """1 less the insertions and deletions that lead from one to the other, over both lengths; 0 without a common run."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = max(2, min(COMMON_RUN, min(len(a), len(b)) // 4))
    if {a[k : k + run] for k in range(len(a) - run + 1)}.isdisjoint(b[k : k + run] for k in range(len(b) - run + 1)):
        return 0.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """From 0 to 1: of the signatures at common block sizes those that agree best; 1 for equal fingerprints, 0 without a common block size."""
    if a == b:
        return 1.0
    (block, *own), (other_block, *other) = a.split(":"), b.split(":")
    ours = {int(block) << k: s for k, s in enumerate(own)}
    theirs = {int(other_block) << k: s for k, s in enumerate(other)}
    # an empty signature says nothing about where two texts agree
    return max((signature_likeness(ours[size], theirs[size]) for size in ours.keys() & theirs.keys() if ours[size] or theirs[size]), default=0.0)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the beginning of ``following``, which may be shorter."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: What a task says of each row, and of the rows at its ends: the first is what the range before goes on with, the last goes on in the next range.
ROW, HEAD, TAIL = 0, 1, 2
FOUND = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(text: str, own: str, following: str, theirs: str) -> tuple[int, str, str, str, float, float]:
    """The columns of ``FOUND`` for a text and the one that follows; ``own`` and ``theirs`` are their fingerprints."""
    changed = edited(text, following)
    mixed = own if changed == text else fingerprint(changed)
    return len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, mixed, likeness(own, mixed), likeness(own, theirs)


def _walk_range(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) of one range in order: each but the last compared with the one after it, and both ends with their texts."""
    number = TaskContext.get().partitionId()
    held: tuple[int | None, str, str] | None = None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in rows], SCHEMA)

    for batch in stream:
        out = []
        for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = value.as_py()
            own = fingerprint(text)
            if held is None:
                out.append((HEAD, number, doc, text, None, None, own, None, None, None))
            else:
                out.append((ROW, number, held[0], None, *compared(held[1], held[2], text, own)))
            held = doc, text, own
        yield batch_of(out)
        tidy()
    if held is not None:
        yield batch_of([(TAIL, number, held[0], held[1], None, None, held[2], None, None, None)])


SCHEMA = pa.schema([("kind", pa.int32()), ("number", pa.int64()), ("doc", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _join_ranges(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last rows of ranges with the first ones of the ranges after: doc, text, fingerprint, following text and fingerprint."""
    for batch in stream:
        columns = [c.to_pylist() for c in batch.columns]
        rows = [(doc, *compared(text, own, following, theirs)) for doc, text, own, following, theirs in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_pylist([dict(zip(("doc", *FOUND_NAMES), r, strict=True)) for r in rows], JOINED)


FOUND_NAMES = [part.split()[0] for part in FOUND.split(", ")]
JOINED = pa.schema([SCHEMA.field("doc"), *(SCHEMA.field(n) for n in FOUND_NAMES)])


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next smaller id, after the last the first. Rows are dealt to ranges of that order,
    whole texts once, and each task walks its range; a range's last row meets the first one of the next range afterwards,
    from the two rows that each task gave of its ends. Null texts are empty: they have no pieces, and are like each other
    alone. Very long texts are read whole. Rows that repeat an id follow each other by a hash of their texts, and equal rows,
    however many, are dealt to several ranges, each the next of another. Null ids come last. Other columns are ignored. A
    table of one row is its own next; an empty one gives an empty one.
    """
    spark = docs.sparkSession
    # the row's number only parts equal rows, which may stand in for each other
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.desc_nulls_last("doc"), F.asc("mark"), F.asc("row")]
    ranged = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    walked = settle(ranged.select("doc", "text").mapInArrow(_walk_range, f"kind int, number long, doc long, text string, {FOUND}"))

    # a row a range: its number and the next one's, the first after the last
    numbers = [r["number"] for r in walked.where(F.col("kind") == HEAD).select("number").orderBy("number").collect()]
    after = spark.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1], strict=True)), "number long, following long")
    heads = walked.where(F.col("kind") == HEAD).select(F.col("number").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    tails = walked.where(F.col("kind") == TAIL).select("number", "doc", "text", "fingerprint")
    ends = tails.join(after, "number").join(heads, "following").select("doc", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(_join_ranges, f"doc long, {FOUND}")
    inside = walked.where(F.col("kind") == ROW).select("doc", *FOUND_NAMES)
    return inside.unionAll(ends).withColumnRenamed("doc", id_col)
