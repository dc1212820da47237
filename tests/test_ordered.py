import random

import pytest
from pyspark.sql import functions as F

from metasift.operators import ordered, providers, retrieval
from metasift.sources import records as R


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(0)
    data = [(i, draw.choice(["a", "b", None]), draw.randint(0, 50)) for i in range(500)]
    draw.shuffle(data)
    return data, spark.createDataFrame(data, "seq long, g string, v long").repartition(5)


def test_positions(rows):
    data, df = rows
    found = {r.seq: (r.pos, r.n) for r in ordered.positions(df, "seq").collect()}
    assert found == {seq: (i, len(data)) for i, (seq, _, _) in enumerate(sorted(data, key=lambda r: r[0]))}


@pytest.mark.parametrize("by", [["g"], []])
def test_greatest_before(rows, by):
    data, df = rows
    found = {r.seq: r.top for r in ordered.greatest_before(df, by, "seq", F.col("v"), "top").collect()}
    top = {}
    for seq, g, v in sorted(data, key=lambda r: r[0]):
        key = g if by else "all"
        assert found[seq] == top.get(key)
        top[key] = max(v, top.get(key, v))


def test_empty(rows):
    _, df = rows
    assert ordered.positions(df.where("false"), "seq").collect() == []
    assert ordered.greatest_before(df.where("false"), ["g"], "seq", F.col("v"), "top").collect() == []


def test_sources_in_order(spark):
    a = spark.createDataFrame([(2, "a2"), (1, "a1")], "seq long, id string")
    b = spark.createDataFrame([(1, "b1")], "seq long, id string")
    assert [r.id for r in R.dense_seq(R.in_order([a, b])).orderBy("seq").collect()] == ["a1", "a2", "b1"]


def test_retrieval_ladder(spark):
    schema = "record_id string, abstract string, pmcid string, archive_text string, archive_failed boolean, open_url string, open_status string, open_text string"
    cases = [
        ("archive", "abs", "PMC1", "full", None, "u", "ok", "other"),
        ("open", "abs", None, None, True, "u", "ok", "page"),
        ("passing", "abs", None, None, True, None, None, None),
        ("no url", None, None, "", False, "", None, None),
        ("no client", "abs", None, None, None, "u", "no_client", None),
        ("error", "abs", None, None, None, "u", "error", "x"),
        ("blank", "abs", None, None, None, "u", "ok", ""),
    ]
    found = {r.record_id: r for r in retrieval.outcomes(spark.createDataFrame(cases, schema)).collect()}
    assert {k: r.reason for k, r in found.items()} == {"archive": None, "open": None, "passing": "error_http", "no url": "sin_url_oa", "no client": "sin_httpx", "error": "error_http", "blank": "texto_vacio"}
    assert (found["archive"].text, found["open"].text, found["error"].text, found["no url"].text) == ("full", "page", "abs", "")


def test_stub_providers(spark):
    records = spark.createDataFrame([("r1", "Trial of x", None), ("r2", "Review of y", "trial"), ("r3", "Review", "")], "record_id string, title string, abstract string")
    members = {"m1": providers.keyword_screener("trial", "review"), "m2": providers.fixed(label="exclude")}
    assert {r.record_id: (r.ensemble_label, r.n_votes) for r in providers.screen(records, members).collect()} == {"r1": ("include", 2), "r2": ("unclear", 2), "r3": ("exclude", 2)}
    domains = providers.assess(records.limit(1), "RoB2", providers.fixed(judgment="low")).orderBy("domain_idx").collect()
    assert [d.domain for d in domains] == list(providers.TOOL_DOMAINS["RoB2"])
    fields = providers.extract(records.limit(1), ["n", "dose"], lambda df: df.withColumns({"found": F.lit(True), "value": F.when(F.col("key") == "n", "12")}))
    assert {r.key: r.status for r in fields.collect()} == {"n": "needs_review", "dose": "not_found"}


def test_medians_like_plain(spark):
    """Groups with many ties, one of most rows, a null group, groups of one row and without a value."""
    import random
    import statistics

    draw = random.Random(2)
    rows = [("hot", float(draw.choice([1, 1, 1, 2, 9]))) for _ in range(2001)] + [(g, draw.random()) for g in ("a", None, "b") for _ in range(draw.randint(50, 99))] + [("one", 4.5), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    want = {g: statistics.median([x for h, x in rows if h == g and x is not None]) for g in {g for g, _ in rows} - {"none"}}
    assert {r.g: r.m for r in ordered.medians(df, ["g"], "x", "m").collect()} == want
    assert [r.m for r in ordered.medians(df, [], "x", "m").collect()] == [statistics.median([x for _, x in rows if x is not None])]
    assert ordered.medians(df.where("false"), ["g"], "x", "m").collect() == []
