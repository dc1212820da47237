"""What ties calls, lines, decisions, requests and artifacts together: sound tables, then one planted break each."""

import pytest

from metasift.operators import bindings, ledger

LOG = "seq long, stage string, action string, actor string, target string, request_sha256 string, decision_sha256 string, to_label string, reason string, verdict string, forced_human boolean, n_labels long"


def row(seq, stage, action, target=None, *, actor="human:ana", request="r", decision="d", label=None, reason="seen", verdict=None, forced=None, n_labels=None):
    return (seq, stage, action, actor, target, request, decision, label, reason, verdict, forced, n_labels)


class TestVotes:
    def found(self, spark, *votes, models=("a", "b")):
        decisions = spark.createDataFrame([("x",), ("y",)], "record_id string")
        table = spark.createDataFrame(votes, "record_id string, model string")
        return {r.record_id for r in bindings.vote_faults(decisions, table, spark.createDataFrame([(m,) for m in models], "model string")).collect()}

    def test_each_screener_once(self, spark):
        assert self.found(spark, ("x", "a"), ("x", "b"), ("y", "a"), ("y", "b")) == set()

    def test_strange_missing_and_null(self, spark):
        assert self.found(spark, ("x", "a"), ("x", "c")) == {"x", "y"}
        assert self.found(spark, ("x", "a"), ("x", None), ("y", "a"), ("y", "b")) == {"x"}

    def test_no_votes_and_no_screeners(self, spark):
        assert self.found(spark) == {"x", "y"}
        assert self.found(spark, models=()) == set()


class TestLines:
    def found(self, spark, lines, members=2, judging=None):
        table = spark.createDataFrame(lines, "line_no long, stage string, roles array<string>, n_judged long")
        return {(r.line_no, r.fault) for r in bindings.line_faults(table, members, judging).collect()}

    def test_sound(self, spark):
        lines = [(1, "screening_ta", ["a", "b"], None), (2, "retrieval", None, None), (3, "retrieval", [], None), (4, "verification", ["j", "j", "j"], 3), (5, "rob", ["r"], None)]
        assert self.found(spark, lines) == set()
        assert self.found(spark, lines, judging=True) == set()

    def test_faults(self, spark):
        lines = [(1, "screening_ta", ["a", "a"], None), (2, "screening_ta", ["a", "a", "b"], None), (3, "retrieval", ["x"], None), (4, "verification", [], None), (5, "rob", None, None), (6, "verification", ["j"], 3)]
        assert self.found(spark, lines) == {(1, "role called twice"), (2, "role called twice"), (2, "number of calls"), (3, "number of calls"), (4, "unknown"), (5, "number of calls"), (6, "number of calls")}

    def test_settings(self, spark):
        judged = [(1, "verification", ["j"], 1), (2, "verification", [], 1)]
        assert self.found(spark, judged, judging=True) == {(2, "number of calls")}
        assert self.found(spark, judged, judging=False) == {(1, "number of calls")}
        assert self.found(spark, [(1, "screening_ta", ["a"], None)], members=None) == {(1, "unknown")}
        assert self.found(spark, []) == set()


def test_marks_and_spans(spark):
    marks = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2024-01-01 00:00:00'), ('b', TIMESTAMP '2024-01-01 00:00:08'), ('c', TIMESTAMP '2024-01-01 00:00:23'), ('d', NULL) AS v(label, ts)")
    span = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:10' AS started, TIMESTAMP '2024-01-01 00:00:20' AS finished")
    assert {(r.label, r.fault) for r in bindings.mark_faults(marks, span).collect()} == {("a", "before the start"), ("c", "after the end")}
    half_open = span.selectExpr("started", "CAST(NULL AS TIMESTAMP) AS finished")
    assert {r.label for r in bindings.mark_faults(marks, half_open).collect()} == {"a"}
    spans = spark.sql("SELECT * FROM VALUES ('x', TIMESTAMP '2024-01-01 00:00:03', TIMESTAMP '2024-01-01 00:00:01'), ('y', TIMESTAMP '2024-01-01 00:00:04', TIMESTAMP '2024-01-01 00:00:01'), ('z', NULL, NULL) AS v(label, started, finished)")
    assert [r.label for r in bindings.span_faults(spans).collect()] == ["y"]


def test_fewest_calls(spark):
    counts = spark.sql("SELECT 10 AS screened, 6 AS fulltext_assessed, 1 AS fulltext_rescued, 3 AS included, 2 AS members, 1 AS doubles")
    assert bindings.fewest_calls(counts, counts.members, counts.doubles).first().fewest == 10 * 2 + 5 + 2 * 3 + 1 + 1


class TestBindings:
    ENTRIES = (row(1, "screening_ta", "label", "x", label="include"), row(2, "screening_ta", "approve", n_labels=1), row(3, "extraction", "approve"))
    ASKED = (("screening_ta", "r", None), ("extraction", "r", "a"), ("rob", "other", None))

    def found(self, spark, entries=ENTRIES, asked=ASKED, there=(("extraction", "a"),), listed=("x", "y"), decided=("x", "y")):
        rows = lambda ids: spark.createDataFrame([("screening_ta", i) for i in ids], "stage string, record_id string")
        requests = spark.createDataFrame(asked, "stage string, sha256 string, artifact_sha256 string")
        faults = bindings.binding_faults(spark.createDataFrame(entries, LOG), requests, spark.createDataFrame(there, "stage string, sha256 string"), rows(listed), rows(decided))
        return {(r.stage, r.fault, r.n) for r in faults.collect()}

    def test_sound(self, spark):
        assert self.found(spark) == set()

    def test_undecided_stages_are_left_alone(self, spark):
        assert self.found(spark, entries=()) == set()
        assert self.found(spark, asked=()) == set()

    @pytest.mark.parametrize(
        ("change", "fault"),
        [
            ({"asked": (("screening_ta", "changed", None), ASKED[1])}, ("screening_ta", "another request", 1)),
            ({"asked": (ASKED[0], ("extraction", "r", None))}, ("extraction", "no artifact hash", 1)),
            ({"there": (("extraction", "edited"),)}, ("extraction", "another artifact", 1)),
            ({"decided": ("x",)}, ("screening_ta", "other records", 1)),
            ({"decided": ("x", "y", "y")}, ("screening_ta", "other records", 1)),
            ({"decided": ("x", None), "listed": ("x", None, None)}, ("screening_ta", "other records", 1)),
            ({"listed": ("y",), "decided": ("y",)}, ("screening_ta", "label outside the request", 1)),
            ({"entries": (*ENTRIES, row(4, "screening_ta", "flag_review", "x", request="s"))}, ("screening_ta", "marks under another request", 1)),
            ({"entries": (*ENTRIES, row(4, "screening_ta", "label", "y", label="include"))}, ("screening_ta", "another number of labels", 1)),
        ],
    )
    def test_one_break(self, spark, change, fault):
        assert self.found(spark, **change) == {fault}

    def test_no_decision_hash(self, spark):
        assert self.found(spark, entries=(self.ENTRIES[0], self.ENTRIES[1], row(3, "extraction", "approve", decision=None))) == {("extraction", "no decision hash", 1)}

    def test_log_without_declared_numbers(self, spark):
        log = spark.createDataFrame(self.ENTRIES, LOG).drop("n_labels")
        none = spark.createDataFrame([], "stage string, record_id string")
        requests = spark.createDataFrame(self.ASKED, "stage string, sha256 string, artifact_sha256 string")
        assert {r.fault for r in bindings.binding_faults(log, requests, none.selectExpr("stage", "record_id AS sha256"), none, none).collect()} == {"label outside the request"}


class TestFinal:
    REVIEW = dict(verdict=bindings.FALSE_POSITIVE)

    def found(self, spark, entries, places=("3",), status="completed", forced=True):
        stated = spark.createDataFrame([(status, forced)], "status string, forced_human boolean")
        return {(r.fault, r.place) for r in bindings.final_faults(spark.createDataFrame(entries, LOG), stated, spark.createDataFrame([(p,) for p in places], "place string")).collect()}

    def test_sound(self, spark):
        assert self.found(spark, [row(1, "report", "flag_review", "3", **self.REVIEW), row(2, "report", "approve", forced=True)]) == set()
        assert self.found(spark, [row(2, "report", "approve")], places=(), forced=None) == set()

    def test_someone_else_or_without_reason(self, spark):
        approve = row(9, "report", "approve", forced=True)
        open_ = {("flagged citation not reviewed", "3")}
        assert self.found(spark, [row(1, "report", "flag_review", "3", actor="human:bo", **self.REVIEW), approve]) == open_
        assert self.found(spark, [row(1, "report", "flag_review", "3", reason=" ", **self.REVIEW), approve]) == open_
        assert self.found(spark, [row(1, "report", "flag_review", "3", decision="old", **self.REVIEW), approve]) == open_
        assert self.found(spark, [row(1, "report", "flag_review", "3", verdict="real"), approve]) == open_

    def test_not_forced(self, spark):
        entries = [row(1, "report", "flag_review", "3", **self.REVIEW), row(2, "report", "approve")]
        assert self.found(spark, entries, forced=False) == {("the run says otherwise who had to decide", None), ("the decision says otherwise who had to decide", None)}

    def test_completed_without_approval(self, spark):
        assert self.found(spark, [row(2, "report", "reject")]) == {("completed without an approval", None)}
        assert self.found(spark, []) == {("completed without an approval", None)}
        assert self.found(spark, [], status="paused") == set()


def test_stages_are_parted():
    assert set(bindings.LISTING_STAGES) | set(bindings.ARTIFACT_STAGES) == set(ledger.STAGES)
