import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metasift.llm import language, queries

STOCK = {"aa": "karo mizu tanek olpi", "bb": "xudre gwyn pllof rhyd", "cc": "ção não muito é bom"}


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(0)
    rows = [(i, " ".join(draw.choice(STOCK[lang].split()) for _ in range(draw.randint(3, 30))), lang) for i, lang in enumerate(draw.choice(list(STOCK)) for _ in range(300))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_fold(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", language.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def plain_buckets(text):
    """One bucket for each n-gram, character by character."""
    whole = 1 << 64
    for n in (1, 2, 3):
        for at in range(len(text) - n + 1):
            mixed = n
            for c in text[at : at + n]:
                mixed = (mixed * 0x9E3779B97F4A7C15 + ord(c)) % whole
            yield (mixed * 0x9E3779B97F4A7C15 % whole) >> (64 - 15)


def test_blocks_of_languages(spark):
    """Two thousand labels, in one matrix and in blocks of them: the same predictions and scores, and the buckets stay as they are."""
    draw = random.Random(6)
    stock = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 7))) for _ in range(3000)]
    rows = [(i, " ".join(draw.sample(stock, 5)) + f" w{i % 2000}", f"l{i % 2000:04}") for i in range(4000)]
    docs = spark.createDataFrame([*rows, (9001, None, "l0001"), (9002, "12", None)], "doc_id long, text string, lang string")
    model = language.fit(docs, F.col("lang"))
    assert len(model.languages) == 2000
    asked = docs.where("doc_id % 40 < 2")
    answers = []
    for size in (2000, 256, 999):
        split = language.Model(model.languages, model.documents, model.counts, size)
        assert {b.log_probability.shape[0] for b in split.blocks()} == {language.BUCKETS}
        answers.append({r.doc_id: r for r in language.predict(asked, split, keep=("lang",)).collect()})
    one, *others = answers
    assert len(one) == asked.count()
    for other in others:
        assert {i: r.lang_pred for i, r in one.items()} == {i: r.lang_pred for i, r in other.items()}
        assert all(other[i].score == pytest.approx(r.score) and other[i].lang == r.lang for i, r in one.items())


def test_ties_go_to_the_first_language(spark):
    """Languages with the same texts tie; in one matrix or in blocks, the first in code point order is told."""
    docs = spark.createDataFrame([(i, "karo mizu tanek", name) for i, name in enumerate(["z", "b", "B", "é", "c"])], "doc_id long, text string, lang string")
    model = language.fit(docs, F.col("lang"))
    for size in (5, 2, 1):
        split = language.Model(model.languages, model.documents, model.counts, size)
        rows = language.predict(docs, split).collect()
        assert {r.lang_pred for r in rows} == {"B"} and all(r.score == pytest.approx(0.2) for r in rows)


def test_dense_pieces():
    part, matrix = np.random.default_rng(0).integers(0, 64, 1000), np.random.default_rng(1).normal(size=(64, 3)).astype(np.float32)
    assert language.summed(part, matrix) == pytest.approx(matrix[part].sum(axis=0, dtype=np.float64))


def test_accuracy_and_brute_force(labelled):
    rows, docs = labelled
    found = {r.doc_id: r for r in queries.identify(docs.withColumn("held_out", language.held_out()), keep=("held_out",)).collect()}
    assert np.mean([found[i].lang_pred == lang for i, _, lang in rows if found[i].held_out]) > 0.98
    # the same model counted in plain Python
    counts, sizes = {x: np.ones(language.BUCKETS) for x in STOCK}, dict.fromkeys(STOCK, 0)
    clean = lambda t: " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
    for i, text, lang in rows:
        if not found[i].held_out:
            sizes[lang] += 1
            for bucket in plain_buckets(clean(text)):
                counts[lang][bucket] += 1
    for i, text, _ in rows[:60]:
        total = {}
        for lang in STOCK:
            p = np.log((counts[lang] / counts[lang].sum()).astype(np.float64))
            total[lang] = np.log(sizes[lang] / sum(sizes.values())) + sum(p[bucket] for bucket in plain_buckets(clean(text)))
        assert found[i].lang_pred == max(total, key=total.get)


def test_odd_texts(labelled, documents):
    _, docs = labelled
    model = language.fit(docs, F.col("lang"))
    texts = [None, "", "123 !!! ...", "é", "karo mizu " * 50_000, "中文"]
    rows = {r.doc_id: r for r in language.predict(documents(list(enumerate(texts))), model).collect()}
    assert [rows[i].lang_pred for i in range(3)] == ["und"] * 3
    assert rows[4].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert {rows[3].lang_pred, rows[5].lang_pred} <= set(STOCK)


def test_nothing_learned(documents):
    docs = documents([(1, "abc"), (2, None)])
    rows = language.predict(docs, language.fit(docs, F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    empty = documents([])
    assert language.predict(empty, language.fit(empty, F.col("lang"))).collect() == []


def test_sample_is_bounded_and_stable(labelled):
    _, docs = labelled
    a, b = (language.fit(docs, F.col("lang"), per_language=20) for _ in range(2))
    (one,), (other,) = a.blocks(), b.blocks()
    assert (one.log_probability == other.log_probability).all() and a.languages == sorted(STOCK)


def test_long_text_is_read_in_pieces(monkeypatch):
    text = " karo mizu tanek " * 30
    whole = np.sort(np.concatenate(list(language.buckets(text))))
    monkeypatch.setattr(language, "PIECE", 16)
    assert (np.sort(np.concatenate(list(language.buckets(text)))) == whole).all()


def test_held_out_accuracy_on_the_tables(spark):
    from tests.conftest import SF_DIR

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = queries.op10_language(spark, SF_DIR).join(docs, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9
