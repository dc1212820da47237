import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from metasift.llm import token_files
from metasift.llm.common import fresh_path

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 24, 31, 32])
@pytest.mark.parametrize("n", [0, 1, 8, 4096, 10_001])
def test_packing_round_trip(bits, n):
    ids = np.random.default_rng(n + bits).integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
    payload = token_files.pack(ids, bits)
    assert (token_files.unpack(payload) == ids).all()
    for start, stop in ((0, 1), (n // 2, n // 2 + 5), (max(0, n - 3), n), (4095, 4097), (n, n + 1)):
        assert (token_files.unpack(payload, start, stop) == ids[start:stop]).all()
    blocks = -(-n // token_files.BLOCK_IDS)
    assert len(payload) == token_files.HEADER.size + 8 * blocks + -(-n * bits // 8)


def test_bits():
    assert [token_files.bits_for(v) for v in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, encoder, draw = Tokenizer.from_file(PATH), token_files.WordEncoder(PATH), random.Random(1)
    stock = ["don't", "A", "É", "ß", "Σ", "ς", "'S", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", ".", ",", "!!", "́", " ", "\t", "\n", " ", "  ", "中", "😀", "1", "23", "%", "&&", "###", "a", "Bc", "'", '"', "(", ")", "\u0000", "İ", "ﬁ", "-", "_", "…", "»"]
    texts = ["".join(draw.choice(stock) for _ in range(draw.randint(0, 30))) for _ in range(3000)] + [None, ""]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        ids, counts = encoder(pa.array(part, pa.string()))
        ends = np.cumsum(counts)
        for text, end, n in zip(part, ends, counts):
            assert ids[end - n : end].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_long_texts_and_forgotten_words(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(PATH), token_files.WordEncoder(PATH)
    monkeypatch.setattr(token_files, "ENCODED_BYTES", 64)
    monkeypatch.setattr(token_files, "CACHED_WORDS", 20)
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdeéÉßœ.,!'1") for _ in range(draw.randint(1, 9)))
    texts = [" ".join(word() for _ in range(draw.choice([0, 2, 5, 90]))) for _ in range(200)] + [None, "", "x" * 300, " " * 300]
    row = 0
    for at, stop, ids, counts in encoder.encode(pa.array(texts, pa.string())):
        assert at == row
        ends = np.cumsum(counts)
        for text, end, n in zip(texts[at:stop], ends, counts, strict=True):
            assert ids[end - n : end].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids
        row = stop
    assert row == len(texts)


def test_files_hold_every_text(spark, documents, prose):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    rows = list(enumerate([*prose(60), None, "", "long words " * 20_000])) + [(7, "again seven"), (None, "no id")]
    random.Random(0).shuffle(rows)
    path = fresh_path(spark, "test-tokens")
    token_files.write_token_table(documents(rows), path, PATH, end_id=1, vocabulary=49_408)
    found = token_files.read_documents(spark, path).collect()
    expected = {}
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        expected.setdefault(doc, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    at, last = 0, None
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        assert last is None or r.doc_id >= last
        at, last = at + r.n_tokens, r.doc_id


def test_empty_table(spark, documents):
    path = fresh_path(spark, "test-tokens")
    token_files.write_token_table(documents([]), path, PATH, end_id=1, vocabulary=49_408)
    assert token_files.read_documents(spark, path).collect() == []


def test_one_id_in_a_third_of_all_rows(spark, prose):
    """Rows of one id go to several ranges, each kept as a document of its own, and starts still add up over all of them."""
    texts = prose(900, seed=12, words=30)
    rows = [(7 if i % 3 == 0 else i, t) for i, t in enumerate(texts)] + [(None, "no id")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    path = fresh_path(spark, "hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_token_table(docs, path, PATH, end_id=1, vocabulary=49_408)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = {r.shard for r in spark.read.schema(token_files.PIECES).parquet(path).collect() if 7 in r.doc_ids}
    found = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert len(shards) > 1 and len(found) == len(rows)
    assert [r.start for r in found] == np.concatenate([[0], np.cumsum([r.n_tokens for r in found])[:-1]]).tolist()
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
