import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from metasift.streaming import gates

EVENT = "run string, stage string, seq long, ts timestamp, kind string, request_sha256 string, autonomy string, forced boolean, unresolved boolean, auto_approve boolean, approved boolean, actor string"
START = dt.datetime(2024, 1, 1)


def made(n, seed=0):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        kind = draw.choice(["request", "decision", "label"])
        asked = kind == "request"
        rows.append((
            f"run{draw.randint(0, 5)}", draw.choice(["screening_ta", "rob", "report"]), k, START + dt.timedelta(hours=k), kind, draw.choice(["r1", "r2"]), draw.choice(["A0", "A1", "A2", "A3"]) if asked else None,
            draw.choice([True, False, None]) if asked else None, draw.random() < 0.3 if asked else None, draw.random() < 0.4 if asked else None, None if asked else draw.random() < 0.6, None if asked else draw.choice(["human:ana", "human:", "ana", "agent:x", None]),
        ))
    return rows


def plain(rows, now=None):
    """Events one after another."""
    state = {}
    for run, stage, seq, ts, kind, sha, autonomy, forced, unresolved, auto, approved, actor in sorted(rows, key=lambda r: r[2]):
        gate = state.setdefault((run, stage), {})
        if kind in ("request", "decision"):
            gate[kind] = (seq, ts, sha, autonomy, forced, unresolved, auto) if kind == "request" else (seq, ts, sha, approved, actor)
    out = []
    for (run, stage), gate in state.items():
        if not gate:
            continue
        asked, given = gate.get("request"), gate.get("decision")
        seq = max(x[0] for x in (asked, given) if x)
        if not asked:
            out.append((run, stage, "open", None, None, None, seq))
            continue
        _, ts, sha, autonomy, forced, unresolved, auto = asked
        verdict, why, actor = "paused", None, None
        if autonomy in ("A2", "A3") and not forced:
            verdict, actor = "approved", f"agent:{stage}"
        elif given and given[2] != sha:
            why = "other_request"
        elif given and forced and not (given[4] or "").removeprefix("human:").strip() * (given[4] or "").startswith("human:"):
            why = "not_a_person"
        elif given:
            verdict, actor = ("approved" if given[3] else "rejected"), given[4]
        elif forced or unresolved:
            why = "person_needed"
        elif auto:
            verdict, actor = "approved", "auto-approve (demo)"
        else:
            why = "undecided"
        if why and now and ts + dt.timedelta(days=3) <= now:
            why = "overdue_" + why
        out.append((run, stage, verdict, why, actor, sha, seq))
    return sorted(out)


def shown(df):
    return sorted(tuple(r[c] for c in ("run", "stage", "state", "reason", "actor", "request_sha256", "seq")) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_batch_like_plain(spark, seed):
    rows = made(150, seed)
    events = spark.createDataFrame(rows + rows[:20], EVENT).repartition(3)
    assert shown(gates.states(events)) == plain(rows)
    now = START + dt.timedelta(hours=120)
    assert shown(gates.states(events, F.lit(now))) == plain(rows, now)


def test_few_events(spark):
    none = spark.createDataFrame([], EVENT)
    assert shown(gates.states(none)) == []
    only = (None, None, 1, None, "decision", None, None, None, None, None, None, None)
    assert [r.state for r in gates.states(spark.createDataFrame([only, ("x", "y", None, *only[3:]), ("x", "z", 5, None, "label", *only[5:])], EVENT)).collect()] == ["open"]


@pytest.mark.parametrize("cuts", [[], [70], [10, 11, 60, 130]])
def test_stream_in_any_split_like_batch(spark, tmp_path, cuts):
    """Batches cut anywhere, one of them delivered twice, the stream stopped and begun again after each."""
    rows = [r for r in made(150, 5) if r[4] != "label"]
    edges = [0, *[c for c in cuts if c < len(rows)], len(rows)]
    parts = [rows[a:b] for a, b in zip(edges, edges[1:])]
    stream = lambda: spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    for n, part in enumerate([*parts, parts[0]]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = gates.run_gates(spark, stream(), str(tmp_path / "out"), str(tmp_path / f"state"), patience=dt.timedelta(days=300))
        query.awaitTermination(120)
        assert query.exception() is None
    found = gates.latest(spark.read.parquet(str(tmp_path / "out")))
    assert shown(found) == plain(rows)


def test_timer_tells_what_waits(spark, tmp_path):
    """A request that nobody answers is overdue once the events' time is past its patience; one answered in time isn't."""
    at = lambda hours: START + dt.timedelta(hours=hours)
    ask = lambda run, seq, hours: (run, "rob", seq, at(hours), "request", "r", "A1", False, False, False, None, None)
    decide = lambda run, seq, hours: (run, "rob", seq, at(hours), "decision", "r", None, None, None, None, True, "human:ana")
    batches = [[ask("waits", 1, 0), ask("answered", 2, 0)], [decide("answered", 3, 20), ask("asked again", 4, 21)], [ask("clock", 5, 90), ask("asked again", 6, 89)], [ask("clock", 7, 91)]]
    for part in batches:
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        gates.run_gates(spark, spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    found = {r.run: (r.state, r.reason) for r in gates.latest(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert found == {"waits": ("paused", "overdue_undecided"), "answered": ("approved", None), "asked again": ("paused", "undecided"), "clock": ("paused", "undecided")}


def streamed(spark, folder, *batches, patience=dt.timedelta(days=3), late="1 hour"):
    """The state of each gate after a run for each batch."""
    for part in batches:
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        gates.run_gates(spark, spark.readStream.schema(EVENT).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state", patience=patience, late=late).awaitTermination(120)
    return gates.latest(spark.read.parquet(f"{folder}/out"))


def test_python_is_called_for_buckets_not_gates(spark, tmp_path, monkeypatch):
    own = next(c for c in vars(gates).values() if isinstance(c, type) and issubclass(c, StatefulProcessor) and c is not StatefulProcessor)
    calls = str(tmp_path / "calls")

    class Counted(own):
        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            with open(calls, "a") as log:
                log.write(".")
            yield from super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(gates, own.__name__, Counted)
    monkeypatch.setattr(gates, "BUCKETS", 8, raising=False)
    rows = [(f"run{k % 200}", *r[1:]) for k, r in enumerate(made(600, 7))]
    assert shown(streamed(spark, tmp_path, rows, patience=dt.timedelta(days=300))) == plain(rows)
    assert len(open(calls).read()) <= 8


def test_timers_of_many_gates_like_batch(spark, tmp_path, monkeypatch):
    """Gates that share buckets and times, some asking again; the watermark ends half an hour before the last event."""
    monkeypatch.setattr(gates, "BUCKETS", 2)
    rows = [(*r[:3], START + dt.timedelta(hours=r[2] // 4 * 4), *r[4:]) for r in made(150, 11)]
    rows = [(f"run{k % 29}", *r[1:]) for k, r in enumerate(rows)]
    now = max(r[3] for r in rows if r[4] != "label") - dt.timedelta(minutes=30)
    expected = plain(rows, now)
    assert {(r[3] or "")[:8] == "overdue_" for r in expected if r[2] == "paused"} == {True, False}
    assert shown(streamed(spark, tmp_path, rows, late="30 minutes")) == expected


def test_time_zone_and_request_without_time(spark, tmp_path):
    """Patience is counted from the instant of asking; a request without a time is never overdue, whatever was asked before."""
    ask = lambda run, seq, ts: (run, "rob", seq, ts, "request", "r", "A1", False, False, False, None, None)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        at = lambda hours: START + dt.timedelta(hours=hours)
        found = streamed(spark, tmp_path, [ask("waits", 1, at(0)), ask("soon", 2, at(4)), ask("again", 3, at(0))], [ask("again", 4, None)], [ask("clock", 5, at(75))], [ask("clock", 6, at(75))]).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert {r.run: r.reason for r in found} == {"waits": "overdue_undecided", "soon": "undecided", "again": "undecided", "clock": "undecided"}


def test_large_numbers_of_events(spark, tmp_path):
    """Numbers that a double can't hold, beside an event without one."""
    big = 2**53
    decide = lambda seq, approved: ("x", "rob", seq, START, "decision", "r", None, None, None, None, approved, "human:ana")
    ask = ("x", "rob", 1, START, "request", "r", "A1", True, False, False, None, None)
    found = streamed(spark, tmp_path, [ask, decide(big, False), decide(big + 1, True), decide(None, False)])
    assert [(r.state, r.seq) for r in found.collect()] == [("approved", big + 1)]
