"""run() against the same stages in plain Python, on a table small enough for it."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metasift.llm import mixing, queries
from tests.llm.test_simhash import brute_components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    from random import Random

    draw = Random(6)
    stock = {lang: ["".join(draw.choice(c) + draw.choice(v) for _ in range(draw.randint(1, 4))) for _ in range(150)] for lang, c, v in (("en", "bdfgt", "aeo"), ("de", "klmnr", "iuy"))}
    prose = lambda lang, n: " ".join(draw.choice(stock[lang]) for _ in range(n))
    rows = [(i, prose("en" if i % 2 else "de", draw.randint(30, 90)), "en" if i % 2 else "de", f"s{i % 5 if i % 3 else 0}") for i in range(90)]
    items = [(k, prose("en", 30)) for k in range(4)]
    rows += [(200 + i, rows[i][1], "en", "s1") for i in range(8)]  # copies
    rows += [(300 + k, f"{prose('en', 20)} {items[k][1]} {prose('en', 20)}", "en", "s2") for k in range(4)]  # leaks
    rows += [(400, None, "en", "s0"), (401, "", None, None), (402, "123 --", "en", "s1")]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_run_equals_plain_python(spark, folder):
    from tokenizers import Tokenizer

    import public_tokenizers

    path, rows, items = folder
    kept = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    first = {doc: component for doc, _, component in brute_components([(r[0], r[1]) for r in kept])}
    kept = [r for r in kept if first[r[0]] == r[0]]
    kept = [r for r in kept if not any(text in r[1] for _, text in items)]
    assert len(kept) == 90

    df = spark.createDataFrame([r[:2] + (r[3],) for r in kept], "doc_id long, text string, source string")
    taken = {r.doc_id: -(-r.taken // r.size) for r in mixing.mix(df, F.array("source")).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for doc, text, *_ in kept:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        expected += [(doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] * taken[doc]
    found = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == sorted(expected)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_stages_keep_the_columns(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("score", F.lit("extra"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == corpus_pipeline.COLUMNS, name
        assert stage(spark, docs.where("false"), path).count() == 0, name


def test_clashing_columns_and_a_very_long_text(spark, folder):
    """Columns named like those that stages use inside change nothing; a text of a million words goes through all stages."""
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    text = " ".join(docs.where("doc_id < 40").select("text").toPandas()["text"].dropna()) + " "
    long = spark.createDataFrame([(7001, text * (6_000_000 // len(text)), "aa", "s", 1)], docs.schema)
    docs = docs.unionAll(long)
    clashing = docs.withColumns({c: F.lit("x") for c in ("key", "fp", "leaks", "taken", "times", "copy", "size", "sources", "lang_pred", "score", "row", "id", "judged_best")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, other = (sorted((str(r.doc_id), str(r.lang)) for r in stage(spark, d, path).select("doc_id", "lang").collect()) for d in (docs, clashing))
        assert plain == other, name
        assert ("7001" in {i for i, _ in plain}) or name in ("near_dedup", "decontamination", "mixing"), name
    assert corpus_pipeline.token_files(spark, clashing, path).count() == docs.count()


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "token_files"]


def test_repeated_ids_in_dedup(spark):
    rows = [(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (None, "f g h", "en", "s", 5), (2, "quite other words in here", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == ["1", "2", "None"]


def test_dedup_goes_by_rows_not_ids(spark):
    """One id with different texts keeps each of them and merges no groups; null ids are deduplicated like others."""
    texts = {name: " ".join(f"{name}{k}" for k in range(30)) for name in "abcd"}
    rows = [(1, "a"), (1, "b"), (2, "a"), (3, "b"), (None, "c"), (None, "c"), (None, "a"), (4, "d"), (None, "d")]
    docs = spark.createDataFrame([(i, texts[t], "en", t, 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(str((r.doc_id, r.source)) for r in kept) == ["(1, 'a')", "(1, 'b')", "(4, 'd')", "(None, 'c')"]


def test_registered(spark):
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_language_stage_writes_its_prediction(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    blank = docs.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, blank, path).collect()}
    truth = {r[0]: r[2] for r in rows if r[0] < 90}
    assert {400, 401, 402} & set(kept) == set()
    assert {i for i in kept if i < 90} == set(truth)
    assert sum(kept[i] == truth[i] for i in truth) >= 88


def test_the_rest_imports_without_the_training_data_part(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(f"{root}/metasift", tmp_path / "metasift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(f"{root}/{name}", tmp_path)
        code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n.startswith('op') or n == 'pipeline']"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
