"""Hand-computed values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from metasift.functions import stats as S
from metasift.functions import text as T
from metasift.operators import agreement, dedup, grounding, history, ledger, meta, screening


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def matrix(spark, tp, fp, fn, tn):
    return screening.quality(spark.createDataFrame([(tp, fp, fn, tn)], "tp long, fp long, fn long, tn long")).first()


class TestMetrics:
    def test_balanced(self, spark):
        row = matrix(spark, 1, 1, 1, 1)
        assert row.mcc == 0.0
        assert row.wmcc == pytest.approx(-9 / 22)

    def test_single_class_is_null(self, spark):
        row = matrix(spark, 4, 0, 0, 0)
        assert (row.mcc, row.wmcc, row.kappa) == (None, None, None)

    def test_kappa_zero_isnt_null(self, spark):
        assert matrix(spark, 3, 2, 0, 0).kappa == 0.0

    @pytest.mark.parametrize(("k", "n", "low", "high"), [(33, 34, 0.8508, 0.9948), (5, 5, 0.5655, 1.0), (0, 10, 0.0, 0.2775), (0, 0, None, None)])
    def test_wilson(self, spark, k, n, low, high):
        found = [one(spark, c) for c in S.wilson(F.lit(k), F.lit(n))]
        assert found == [None, None] if n == 0 else found == pytest.approx([low, high], abs=5e-5)

    def test_gold_join(self, spark):
        decisions = spark.createDataFrame([("a", 1, "include"), ("b", 2, "exclude"), ("c", 3, "include"), ("d", 4, "unclear"), ("a", 0, "exclude")], "record_id string, seq long, ensemble_label string")
        gold = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True), ("zz", True)], "record_id string, relevant boolean")
        row = screening.screening_metrics(decisions, gold).first()
        assert (row.tp, row.fp, row.fn, row.tn, row.n) == (2, 1, 1, 0, 4)
        assert row.recall == pytest.approx(2 / 3)

    def test_overflowing_products(self, spark):
        assert matrix(spark, 10**12, 10**12, 10**12, 10**12).mcc == 0.0


@pytest.mark.parametrize(("votes", "label"), [(["exclude", "include", "exclude"], "include"), (["exclude", "unclear"], "unclear"), (["exclude", "exclude"], "exclude"), ([], "unclear")])
def test_recall_biased(spark, votes, label):
    records = spark.createDataFrame([("r",)], "record_id string")
    voted = spark.createDataFrame([("r", v) for v in votes], "record_id string, label string")
    assert screening.ensemble(records, voted).first().ensemble_label == label


class TestMeta:
    def studies(self, spark, pairs):
        return spark.createDataFrame([(1, f"s{i}", float(y), float(v)) for i, (y, v) in enumerate(pairs)], "review int, study_id string, yi double, vi double")

    def test_equal_precision(self, spark):
        rows = {r.model: r for r in meta.pooled(self.studies(spark, [(0.2, 0.04), (0.4, 0.04)]), ["review"]).collect()}
        assert rows["fixed"].estimate == pytest.approx(0.3)
        assert rows["fixed"].se == pytest.approx(math.sqrt(1 / 50))
        assert rows["fixed"].i2 == rows["fixed"].tau2 == 0.0
        assert rows["random"].estimate == pytest.approx(rows["fixed"].estimate)

    def test_heterogeneous(self, spark):
        rows = {r.model: r for r in meta.pooled(self.studies(spark, [(0.10, 0.02), (0.80, 0.03), (-0.30, 0.025), (0.55, 0.04)]), ["review"], p_values=True).collect()}
        assert (rows["fixed"].estimate, rows["fixed"].se) == pytest.approx((0.225280899, 0.082107083), abs=1e-8)
        assert (rows["random"].q, rows["random"].tau2, rows["random"].i2) == pytest.approx((25.467696629, 0.206146907, 88.220371698), abs=1e-8)
        assert (rows["random"].estimate, rows["random"].se, rows["random"].p_value) == pytest.approx((0.279633655, 0.242212245, 0.248295885), abs=1e-8)

    def test_weights_sum_to_100(self, spark):
        rows = meta.study_rows(self.studies(spark, [(0.2, 0.04), (0.4, 0.01)]), ["review"]).collect()
        assert sum(r.weight_fixed for r in rows) == pytest.approx(100)
        assert sum(r.weight_random for r in rows) == pytest.approx(100)

    def effects(self, spark, e1, n1, e0, n0):
        return meta.log_odds_ratio(spark.createDataFrame([("s", e1, n1, e0, n0)], "study_id string, e1 long, n1 long, e0 long, n0 long")).first()

    def test_log_odds(self, spark):
        row = self.effects(spark, 10, 100, 20, 100)
        assert (row.yi, row.vi) == pytest.approx((-0.810930, 0.173611), abs=1e-6)
        row = self.effects(spark, 0, 10, 5, 10)
        assert (row.yi, row.vi) == pytest.approx((-3.044522, 2.458874), abs=1e-6)

    def test_differences(self, spark):
        df = spark.createDataFrame([("s", 10.0, 2.0, 50, 8.0, 2.0, 50)], "study_id string, m1 double, sd1 double, cn1 long, m0 double, sd0 double, cn0 long")
        row = meta.mean_difference(df).first()
        assert (row.yi, row.vi) == pytest.approx((2.0, 0.16))
        assert 0.9 < meta.hedges_g(df).first().yi < 1.0

    def test_demo_egger(self, spark):
        cells = [("a", 12, 120, 20, 118), ("b", 8, 90, 15, 95), ("c", 18, 150, 25, 145), ("d", 5, 80, 11, 78)]
        df = spark.createDataFrame(cells, "study_id string, e1 long, n1 long, e0 long, n0 long").withColumn("review", F.lit(1))
        row = meta.egger(meta.effect_sizes(df, "logOR"), ["review"]).first()
        assert (row.intercept, row.se, row.t) == pytest.approx((-1.938955457, 0.334198189, -5.801813186), abs=1e-8)

    def test_too_few_studies(self, spark):
        assert meta.egger(self.studies(spark, [(0.2, 0.04), (0.4, 0.01)]), ["review"]).isEmpty()
        assert meta.pooled(self.studies(spark, [(0.2, 0.04)]), ["review"]).isEmpty()

    def test_bad_variance_is_an_error(self, spark):
        with pytest.raises(Exception, match="no usable effect"):
            meta.effect_sizes(self.studies(spark, [(0.2, 0.0)]), "precomputed").collect()


class TestDedup:
    SCHEMA = "seq long, record_id string, title string, doi string, source_db string, extra map<string,string>"

    def run(self, spark, rows):
        unique, duplicates, renames = dedup.deduplicate(spark.createDataFrame(rows, self.SCHEMA))
        return sorted(unique.collect(), key=lambda r: r.seq), duplicates.collect(), renames.collect()

    def test_doi_and_title(self, spark):
        unique, duplicates, _ = self.run(spark, [(1, "a", "A", "10.1/x", "s", {}), (2, "b", "B distinto", "10.1/X", "s", {})])
        assert [r.record_id for r in unique] == ["a"] and len(duplicates) == 1
        unique, duplicates, _ = self.run(spark, [(1, "a", "Hello, World!", None, "s", {}), (2, "b", "hello   world", None, "s", {})])
        assert [r.record_id for r in unique] == ["a"] and len(duplicates) == 1

    def test_extra(self, spark):
        unique, _, _ = self.run(spark, [(1, "a", "T", None, "OpenAlex", {"oa_url": "u", "pmcid": ""}), (2, "b", "T", None, "PubMed", {"pmcid": "PMC1", "oa_url": "v"})])
        assert unique[0].source_db == "OpenAlex"
        assert unique[0].extra == {"oa_url": "u", "pmcid": "PMC1"}

    def test_rename(self, spark):
        rows = [(1, "10.1000/abc", "A", "10.1000/abc", "OpenAlex", {}), (2, "10.1000/abc", "A", "https://doi.org/10.1000/abc", "RIS", {}), (3, "10.1000/abc", "A", "https://doi.org/10.1000/abc", "RIS", {})]
        unique, duplicates, renames = self.run(spark, rows)
        assert [r.record_id for r in unique] == ["10.1000/abc", "10.1000/abc#2"]
        assert duplicates[0].kept_record_id == "10.1000/abc#2"
        assert duplicates[0].key == "doi:https://doi.org/10.1000/abc"
        assert [(r.from_id, r.to_id) for r in renames] == [("10.1000/abc", "10.1000/abc#2")]

    def test_rename_skips_taken(self, spark):
        rows = [(1, "a", "one", None, "s", {}), (2, "a", "two", None, "s", {}), (3, "a#2", "three", None, "s", {}), (4, "a", "four", None, "s", {})]
        unique, _, _ = self.run(spark, rows)
        assert [r.record_id for r in unique] == ["a", "a#3", "a#2", "a#4"]

    def test_empty(self, spark):
        assert self.run(spark, []) == ([], [], [])


class TestText:
    @pytest.mark.parametrize(
        ("text", "expected"),
        [("Authorization: Bearer abc.def", "Authorization: <redacted>"), ("{'x-api-key': 'abc def'}", "{'x-api-key': '<redacted>'}"), ("key sk-abcdefghijklmnop1234", "key <redacted>"), ("https://u:p@h/x?token=1&y=2", "https://<redacted>@h/x?token=<redacted>&y=2"), ("task-force sk-x", "task-force sk-x")],
    )
    def test_redact(self, spark, text, expected):
        assert one(spark, T.redact(F.lit(text))) == expected

    def test_citations(self, spark):
        assert one(spark, T.citations(F.lit("foo [rec-1] bar [rec-2] baz [rec-1]"))) == ["rec-1", "rec-2"]

    def test_names_and_dates(self, spark):
        assert one(spark, T.is_human(F.lit("human: ana"))) is True
        assert one(spark, T.is_human(F.lit("human:​ "))) is False
        assert one(spark, T.zoned_timestamp(F.lit("2024-01-01T00:00:00"))) is None
        assert one(spark, T.zoned_timestamp(F.lit("2024-01-01T00:00:00Z"))) is not None
        assert one(spark, T.repository_doi(F.lit("https://doi.org/doi:10.1/A"))) == "10.1/a"
        assert one(spark, T.repository_doi(F.lit("http://dx.doi.org/10.1/A"))) is None


class TestAgreement:
    def test_pairs(self, spark):
        schema = "study_id string, key string, value string"
        a = spark.createDataFrame([("a", "design", "RCT"), ("b", "design", "cohorte")], schema)
        b = spark.createDataFrame([("a", "design", "rct"), ("b", "design", "RCT")], schema)
        row = agreement.agreement(a, b).first()
        assert (row.n_studies, row.n_field_pairs, row.n_value_match, row.value_agreement) == (2, 2, 1, 0.5)
        assert row.presence_kappa is None

    @pytest.mark.parametrize("n", [0, 1, 10, 126])
    def test_sample(self, spark, n):
        k = max(1, math.ceil(0.2 * n))
        expected = {min(n - 1, int(i * (n / k))) for i in range(k)} if n else set()
        found = agreement.systematic_sample(spark.createDataFrame([(f"r{i:03}",) for i in range(n)], "record_id string"), "record_id").collect()
        assert {r.pos for r in found} == expected


class TestLedger:
    SCHEMA = "seq long, stage string, action string, actor string, autonomy string, target string, request_sha256 string, decision_sha256 string, to_label string, reason string"

    def log(self, spark, *entries):
        return spark.createDataFrame([(i, stage, action, "human:x", "A1", target, "r", sha, label, None) for i, (stage, action, target, sha, label) in enumerate(entries)], self.SCHEMA)

    def test_last_decision_counts_its_labels(self, spark):
        log = self.log(spark, ("screening_ta", "label", "t", "old", "include"), ("screening_ta", "reject", None, "old", None), ("screening_ta", "label", "t", "new", "include"), ("screening_ta", "label", "u", "new", "exclude"), ("screening_ta", "approve", None, "new", None), ("rob", "label", "t", "new", "include"))
        row = ledger.gate_summary(log).collect()
        assert [(r.stage, r.action, r.n_labels) for r in row] == [("screening_ta", "approve", 2)]
        assert {(r.target, r.label) for r in ledger.labels_from_log(log).collect()} == {("t", "include"), ("u", "exclude")}
        assert {(r.problem, r.target) for r in ledger.label_breaks(log).collect()} == {("with a rejection", "t")}

    def test_registering_twice_adds_nothing(self, spark):
        log = self.log(spark, ("rob", "approve", None, None, None))
        assert ledger.missing_entries(log, log).isEmpty()


def test_history_delta(spark):
    events = spark.createDataFrame([("s", 1, "t1", ["a", "b"])], "slug string, seq long, ts string, included_ids array<string>")
    arriving = spark.createDataFrame([("s", 2, "t2", ["b", "c"]), ("s", 3, "t1", ["x"])], events.schema)
    rows = history.with_delta(events, arriving).collect()
    assert [(r.ts, r.included_new, r.included_dropped) for r in rows] == [("t2", ["c"], ["a"])]


def test_grounding(spark):
    corpus = spark.createDataFrame([("rec-1", "aspirin lowers fever in adults"), ("rec-2", None)], "record_id string, source string")
    texts = spark.createDataFrame([(1, "aspirin lowers fever [rec-1]"), (2, "quantum chromodynamics lattice [rec-1]"), (3, "x [rec-999]"), (4, "y [rec-2]")], "doc_id long, text string")
    found = {r.doc_id: r for r in grounding.reports(grounding.verify(grounding.cited(texts), corpus)).collect()}
    assert {k: r.hallucination_flagged for k, r in found.items()} == {1: False, 2: True, 3: True, 4: False}


class TestTails:
    """Tail probabilities against published tables and plain integration."""

    def test_known_values(self, spark):
        one = spark.range(1).select(
            S.normal_two_sided(F.lit(1.959963984540054)).alias("z"),
            S.normal_two_sided(F.lit(-5.0)).alias("far"),
            S.student_two_sided(F.lit(math.tan(0.475 * math.pi)), F.lit(1)).alias("t1"),
            S.student_two_sided(F.lit(-2.2281388519649385), F.lit(10)).alias("t10"),
            S.student_two_sided(F.lit(2.0), F.lit(0)).alias("t0"),
            S.chi2_tail(F.lit(3.841458820694124), F.lit(1)).alias("c1"),
            S.chi2_tail(F.lit(18.307038053275146), F.lit(10)).alias("c10"),
            S.chi2_tail(F.lit(0.0), F.lit(3)).alias("c3"),
            S.normal_two_sided(F.lit(None)).alias("none"),
        )
        r = one.first()
        for name in ("z", "t1", "t10", "c1", "c10"):
            assert r[name] == pytest.approx(0.05, abs=1e-9), name
        assert r.far == pytest.approx(math.erfc(5 / math.sqrt(2)), rel=1e-11)
        assert (r.t0, r.c3, r.none) == (None, 1.0, None)


class TestSimilarity:
    def test_any_number_of_queries_equals_brute_force(self, spark):
        draw = random.Random(2)
        vectors = [(i, [float(draw.randint(-2, 2)) for _ in range(3 if i % 7 else 4)]) for i in range(300)] + [(300, None), (301, [1.0, None, 2.0])]
        df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
        unit = lambda v: [x / (math.sqrt(sum(y * y for y in v)) or 1) for x in v]
        good = [(i, unit(v)) for i, v in vectors if v and None not in v]
        expected = []
        for q, a in good:
            near = sorted((-round(sum(x * y for x, y in zip(a, b)), 12) + 0.0, i) for i, b in good if len(a) == len(b))[:4]
            expected += [(q, n, i) for n, (_, i) in enumerate(near, 1)]
        for chunk in (2048, 40):
            found = grounding.most_similar(df, df.repartition(3), 4, query_chunk=chunk).collect()
            assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == sorted(expected)
