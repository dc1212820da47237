"""Token ids in fixed-width bit packing.

A token table is a Parquet folder. Each row is one shard piece: the ids of some consecutive documents, written with as many
bits an id as the vocabulary needs. ``payload`` starts with a header (magic, bits, ids a block, number of ids, block
offsets); blocks hold a multiple of eight ids, so each begins on a byte and can be unpacked by itself. ``doc_ids`` and
``doc_tokens`` index the documents of the piece. Spark writes and reads the folder, so any store it reaches will do.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"MSBP"
HEADER = struct.Struct("<4sBxxxIQ")  # magic, bits an id, ids a block, ids
BLOCK_IDS = 4096
PIECE_IDS = 1 << 20
#: Bytes of text encoded at a time.
ENCODED_BYTES = 1 << 21
#: Distinct words whose ids a Python worker keeps, about.
CACHED_WORDS = 1 << 19
#: Words given to the tokenizer as one string.
JOINED_WORDS = 1000
PIECES = "shard int, piece int, first_doc long, n_ids long, doc_ids array<long>, doc_tokens array<long>, payload binary"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def _layout(bits: int) -> tuple[int, int]:
    """The fewest ids that fill whole 64-bit words, and how many words they fill."""
    shared = math.gcd(bits, 64)
    return 64 // shared, bits // shared


def pack(ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """Header, block offsets and blocks of ``ids``; each id must fit into ``bits``. Id i has the bits from i * bits on, lowest first."""
    if block_ids % 8:
        raise ValueError("a block must hold a multiple of eight ids")
    n_blocks = -(-len(ids) // block_ids)
    offsets = np.arange(n_blocks, dtype="<u8") * (block_ids * bits // 8)
    period, words = _layout(bits)
    rows = np.zeros((-(-len(ids) // period), period), "<u8")
    rows.reshape(-1)[: len(ids)] = ids
    packed = np.zeros((len(rows), words), "<u8")
    for k in range(period):
        word, shift = divmod(k * bits, 64)
        packed[:, word] |= rows[:, k] << np.uint64(shift)
        if shift + bits > 64:
            packed[:, word + 1] |= rows[:, k] >> np.uint64(64 - shift)
    return HEADER.pack(MAGIC, bits, block_ids, len(ids)) + offsets.tobytes() + packed.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop``; only the blocks that hold them are read, found by their offsets."""
    magic, bits, block_ids, n_ids = HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a packed token payload")
    stop = n_ids if stop is None else min(stop, n_ids)
    if stop <= start:
        return np.empty(0, "<u4")
    n_blocks = -(-n_ids // block_ids)
    offsets = np.frombuffer(payload, "<u8", n_blocks, HEADER.size)
    first, last = start // block_ids, (stop - 1) // block_ids
    at = HEADER.size + 8 * n_blocks
    end = int(offsets[last + 1]) if last + 1 < n_blocks else len(payload) - at
    body = payload[at + int(offsets[first]) : at + end]
    period, words = _layout(bits)
    packed = np.frombuffer(body + bytes(-len(body) % (8 * words)), "<u8").reshape(-1, words)
    ids, mask = np.empty((len(packed), period), "<u4"), np.uint64((1 << bits) - 1)
    for k in range(period):
        word, shift = divmod(k * bits, 64)
        value = packed[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value |= packed[:, word + 1] << np.uint64(64 - shift)
        ids[:, k] = value & mask
    return ids.reshape(-1)[start - first * block_ids : stop - first * block_ids]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    """The encoder of a Python worker; what it knows serves later tasks too."""
    return WordEncoder(path)


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Latin letters, but for the one whose lower case ends in a mark.
LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: A Latin letter and the punctuation after it. An apostrophe isn't listed, for it can begin a contraction.
WORD_END = rf"([{LATIN}])([.,;:!?#$%&*()]+)"
END_MARK = "</w>"


def _ids_of(encoded: list) -> np.ndarray:
    return np.concatenate([np.empty(0, "<u4"), *(np.array(e.ids, "<u4") for e in encoded)])


class WordEncoder:
    """Encodes texts word by word, each distinct word once.

    The tokenizer must be a byte-level BPE with word ends that lower-cases, drops white space and never joins across it,
    nor across the border between a letter and plain punctuation; then a text's ids are those of its words and punctuation
    runs in turn. Words of Latin letters alone are one pre-token each, so many of them go to the same BPE model as one
    string, split at spaces only, and their ids are told apart by the word ends. Texts that hold ``<|`` aren't lower-cased
    here, since case decides whether such a string is a special token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = _tokenizer(path)
        self.latin = Tokenizer(self.tokenizer.model)
        self.latin.normalizer = normalizers.Lowercase()
        self.latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[number for token, number in vocabulary.items() if token.endswith(END_MARK)]] = True
        self._forget()

    def _forget(self) -> None:
        """Words known, their ids one after another, and where each word's ids begin (one entry more than words)."""
        self.known, self.pool, self.begins = pa.array([], pa.string()), np.empty(0, "<u4"), np.zeros(1, np.int32)

    def _latin(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of Latin ``words`` one after another, and their numbers."""
        joined = [" ".join(words[at : at + JOINED_WORDS].to_pylist()) for at in range(0, len(words), JOINED_WORDS)]
        ids = _ids_of(self.latin.encode_batch_fast(joined, add_special_tokens=False))
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer doesn't end each word with a token of its own")
        return ids, np.diff(ends, prepend=0)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Adds ``words``; the place of each among the known ones."""
        before = len(self.known)
        is_latin = pc.match_substring_regex(words, f"^[{LATIN}]+$")
        latin, others = words.filter(is_latin), words.filter(pc.invert(is_latin))
        ids, counts = self._latin(latin)
        encoded = self.tokenizer.encode_batch_fast(others.to_pylist(), add_special_tokens=False)
        counts = np.concatenate((counts, np.array([len(e.ids) for e in encoded], np.int64)))
        self.known = pa.concat_arrays([self.known, latin, others])
        self.pool = np.concatenate((self.pool, ids, _ids_of(encoded)))
        self.begins = np.concatenate((self.begins, self.begins[-1] + np.cumsum(counts, dtype=np.int32)))
        first = is_latin.to_numpy(zero_copy_only=False)
        return (before + np.where(first, np.cumsum(first) - 1, len(latin) + np.cumsum(~first) - 1)).astype(np.int32)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        words = pc.split_pattern(pc.replace_substring_regex(texts, WORD_END, r"\1 \2"), " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        place = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False).copy()
        if len(self.known) + int((place < 0).sum()) > CACHED_WORDS:
            self._forget()
            place[:] = -1
        missing = np.flatnonzero(place < 0)
        place[missing] = self._learn(distinct.take(pa.array(missing)))
        word = place[coded.indices.to_numpy()]
        del coded, distinct, texts
        pa.default_memory_pool().release_unused()
        lengths = np.diff(self.begins)[word]
        total = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        from_pool = np.repeat(self.begins[word] - total[:-1].astype(np.int32), lengths)
        from_pool += np.arange(total[-1], dtype=np.int32)
        offsets = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
        return self.pool[from_pool], np.diff(total[offsets])

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First row, last row (exclusive), ids and numbers of ids by row, a bounded number of bytes at a time. A longer text is cut at spaces."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), ENCODED_BYTES, "right")))
            if sizes[at] <= ENCODED_BYTES:
                yield at, stop, *self(texts[at:stop])
            else:
                found = [self(pa.array([part]))[0] for part in cut_at_spaces(texts[at].as_py(), ENCODED_BYTES)]
                stop = at + 1
                yield at, stop, np.concatenate(found), np.array([sum(map(len, found))])
            at = stop


def cut_at_spaces(text: str, size: int) -> Iterator[str]:
    """Parts of at least ``size`` characters that begin with a space, but for the first and the last."""
    at = 0
    while (cut := text.find(" ", at + size)) >= 0:
        yield text[at:cut]
        at = cut
    yield text[at:]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def write_token_table(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", mode: str = "error") -> None:
    """Encode the texts and write them to ``path`` in ascending id order (null ids first; equal ids keep any order, each with its own row).

    A null or empty text is stored as the end id alone; a very long one is encoded in parts that begin at spaces, and is one
    document all the same. Columns besides the two are ignored. An empty table gives a folder without rows.
    """
    bits = bits_for(vocabulary)
    # the row's number parts rows of one id, so that an id of a third of all rows is dealt to several ranges
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id", "row").sortWithinPartitions("id", "row").select("id", "text")

    def pieces(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, number = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal held, number
            doc_ids = [d for part in held for d in part[0]]
            counts, ids = np.concatenate([p[1] for p in held]), np.concatenate([p[2] for p in held])
            held, number = [], number + 1
            values = [shard, number - 1, next((d for d in doc_ids if d is not None), None), len(ids), doc_ids, counts.tolist(), pack(ids, bits)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in stream:
            for at, stop, ids, counts in encoder.encode(batch.column(1)):
                ids, counts = with_end(ids, counts, end_id)
                held.append((batch.column(0)[at:stop].to_pylist(), counts, ids))
                if sum(len(p[2]) for p in held) >= PIECE_IDS:
                    yield flush()
        if held:
            yield flush()

    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    names = ["shard", "piece", "first_doc", "n_ids", "doc_ids", "doc_tokens", "payload"]
    ordered.mapInArrow(pieces, PIECES).write.mode(mode).parquet(path)


def piece_starts(pieces: DataFrame) -> DataFrame:
    """Ids before each piece, over the whole table: over shards first (few rows), then inside each shard."""
    shards = pieces.groupBy("shard").agg(F.min("first_doc").alias("least"), F.sum("n_ids").alias("shard_ids"))
    before = Window.orderBy(F.col("least").asc_nulls_first(), "shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("shard_ids").over(before), F.lit(0)).alias("shard_start"))
    own = pieces.select("shard", "piece", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inner_start"))
    return own.join(shards, "shard").select("shard", "piece", (F.col("shard_start") + F.col("inner_start")).alias("piece_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    pieces = spark.read.schema(PIECES).parquet(path)

    def unpacked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in batch.to_pylist():
                ids, ends = unpack(row["payload"]), np.cumsum(np.asarray(row["doc_tokens"], np.int64))
                starts = ends - np.asarray(row["doc_tokens"], np.int64)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["piece"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(row["doc_tokens"], pa.int64()), pa.array(crc, pa.int64())],
                    ["shard", "piece", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    documents = pieces.select("shard", "piece", "doc_ids", "doc_tokens", "payload").mapInArrow(unpacked, "shard int, piece int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return documents.join(piece_starts(pieces), ["shard", "piece"]).select("doc_id", (F.col("piece_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
