import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from metasift.llm import toxicity


def likelihood(w, t, x, grade):
    below = np.concatenate(([0.0], 1 / (1 + np.exp(-(t - x @ w))), [1.0]))
    return below[grade + 1] - below[grade]


def test_fit_is_a_minimum():
    """No step from the fitted weights and thresholds makes the penalised likelihood better."""
    draw = np.random.default_rng(0)
    x = draw.normal(size=(400, 3))
    score = x @ np.array([1.5, -1.0, 0.0]) + draw.logistic(size=400)
    grade = np.digitize(score, [-0.5, 1.0])
    row, column = np.repeat(np.arange(400), 3), np.tile(np.arange(3), 400)
    ridge = 1e-3
    w, t = toxicity.fit_ordinal(row, column, x.ravel(), grade, 3, ridge=ridge)
    assert w == pytest.approx([1.5, -1.0, 0.0], abs=0.35) and t == pytest.approx([-0.5, 1.0], abs=0.35)
    assert t[0] < t[1]

    def loss(w, t):
        return -np.mean([np.log(likelihood(w, t, a, g)) for a, g in zip(x, grade)]) + ridge * (w @ w) / 2

    best = loss(w, t)
    for step in np.vstack((np.eye(5), -np.eye(5))) * 1e-2:
        assert loss(w + step[:3], t + step[3:]) >= best - 1e-6


def test_features_are_words_and_prefixes():
    ids, counts = toxicity.features("Moron, moron! MORONIC")
    one, _ = toxicity.features("moron")
    assert set(one) <= set(ids)
    assert sorted(counts.tolist())[-1] == 3  # the prefix of five letters, in all three words
    assert len(toxicity.features("")[0]) == len(toxicity.features("123 --")[0]) == 0


def plain_features(text):
    """Buckets and counts, character by character."""
    low, multiplier, whole = text.lower(), 0x9E3779B97F4A7C15, 1 << 64
    words, word = [], ""
    for c in low + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            words.append(word)
            word = ""
    found = {}
    for word in words:
        value = lambda part: sum((ord(c) + 1) * pow(multiplier, j, whole) for j, c in enumerate(part)) % whole
        hashed = [(value(word[:n]) + n) * multiplier % whole for n in toxicity.PREFIXES if len(word) >= n] + [(value(word) ^ 1 << 40) * multiplier % whole]
        for h in hashed:
            bucket = ((h ^ h >> 32) * multiplier % whole) >> (64 - toxicity.BUCKET_BITS)
            found[bucket] = found.get(bucket, 0) + 1
    return found


HARD = ["", "Straße ÉCOLE über 𝔘𝔫𝔦 𐐀𐐁𐐂 zorgast", "a" * 60 + " " + "a" * 61 + "b", "x1y2 don't İstanbul", "moron moronic " * 50]


@pytest.mark.parametrize("text", HARD)
def test_features_equal_plain_python(text):
    ids, counts = toxicity.features(text)
    assert dict(zip(ids.tolist(), counts.tolist())) == plain_features(text)


def test_scores_equal_plain_python(spark, table):
    docs, labels = table
    model = toxicity.fit(toxicity.sample_of(docs, labels, F.col("toxic")))
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + HARD + [None]
    found = {r.doc_id: r for r in toxicity.grade_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        score = sum(model.weights[model.place[b]] * math.log(1 + n) for b, n in plain_features(text or "").items() if model.place[b] >= 0)
        reached = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert found[i].expected_severity == pytest.approx(sum(reached)) and found[i].p_toxic == pytest.approx(reached[0])
        assert found[i].grade == sum(p >= toxicity.REACHED for p in reached)


def test_sample_of_repeated_ids_is_bounded(spark):
    docs = spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 1)], "doc_id long, toxic int")
    rows = [toxicity.sample_of(docs, labels, F.col("toxic"), fitted=20).collect() for _ in range(2)]
    assert len(rows[0]) == 20 and {r.grade for r in rows[0]} == {1}
    assert sorted(rows[0]) == sorted(rows[1])


def test_grades_by_burden():
    grade = toxicity.split_by_burden(np.array([True, False, True, True, True]), np.array([3.0, 9.0, 1.0, 2.0, 4.0]), 2)
    assert grade.tolist() == [2, 0, 1, 1, 2]


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(0)
    calm = ["".join(draw.choice("bdfglm") + draw.choice("aeiou") for _ in range(3)) for _ in range(200)]
    bad = ["zorgast", "quixelt", "wrumpf"]
    rows, labels = [], []
    for i in range(600):
        words = [draw.choice(calm) for _ in range(draw.randint(20, 60))]
        toxic = i % 4 == 0
        for _ in range(draw.randint(2, 6) if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(bad))
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_texts(table):
    docs, labels = table
    model = toxicity.fit(toxicity.sample_of(docs, labels, F.col("toxic")))
    rows = toxicity.grade_texts(docs, model).join(labels, "doc_id", "left_anti").collect()
    truth = {r.doc_id: r.doc_id % 4 == 0 for r in rows}
    assert np.mean([r.toxic == truth[r.doc_id] for r in rows]) > 0.97
    for r in rows:
        assert 0 <= r.p_toxic <= r.expected_severity <= 2 * r.p_toxic + 1e-9
        assert r.toxic == (r.grade >= 1)


def test_sample_is_bounded(table):
    docs, labels = table
    assert toxicity.sample_of(docs, labels, F.col("toxic"), fitted=50).count() == 50


def test_odd_tables(table, documents):
    docs, labels = table
    none = toxicity.fit(toxicity.sample_of(docs, labels.where("false"), F.col("toxic")))
    calm = toxicity.fit(toxicity.sample_of(docs, labels, F.lit(0)))
    for model in (none, calm):
        rows = toxicity.grade_texts(documents([(1, None), (2, ""), (2, "zorgast"), (None, "a " * 100_000)]), model).collect()
        assert len(rows) == 4 and {r.grade for r in rows} == {0}
    assert toxicity.grade_texts(documents([]), none).collect() == []


def test_given_grades_are_kept(spark):
    rows = [(i, "mild" if i % 3 == 1 else "vile" if i % 3 == 2 else "kind", i % 3) for i in range(90)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    graded = toxicity.grade_texts(labelled, toxicity.fit(labelled)).collect()
    assert all(r.grade == r.doc_id % 3 for r in graded)
