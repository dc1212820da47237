"""Review gates: a stage of a run goes on once its request is decided, and waits for that in keyed state.

Events have run, stage, seq (their order), ts, kind, and of a request: request_sha256, autonomy (A0 to A3), forced (only a person may
decide), unresolved (some records only a person can settle) and auto_approve; of a decision: request_sha256, approved, actor.

A gate's state follows from its last request and its last decision, so events may come in any order and more than once.
The same rule serves a batch, where both are found by an aggregation, and a stream, where they are kept in keyed state with a
timer that tells a gate that is still waiting after a while. Its keys are buckets of gates, as each key that has rows costs Python
milliseconds and each row of such a key microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from metasift.functions import text as T
from metasift.operators.ledger import AUTO_APPROVER

#: Fixed: levels of autonomy at which a stage goes on and only tells so.
UNATTENDED = ("A2", "A3")
REQUEST = "seq long, ts timestamp, request_sha256 string, autonomy string, forced boolean, unresolved boolean, auto_approve boolean"
DECISION = "seq long, ts timestamp, request_sha256 string, approved boolean, actor string"
KEY = ("run", "stage")
#: Fixed: a gate's bucket is part of the kept state. Many more than tasks, so that these get about the same number of gates.
BUCKETS = 1024
#: When a request without a time is due.
NEVER = 2**63 - 1
#: What a gate's state holds, and what comes out of it; a request or a decision is kept as the JSON that the stream made of it.
KEPT = "request string, decision string, asked long, given long, due long"
SIDES = "run string, stage string, request string, decision string, due boolean"


def judged(sides: DataFrame) -> DataFrame:
    """run, stage, state, reason, actor, request_sha256 and seq (the last event's) from the last request, the last decision and ``due``.

    States: ``open`` (decided on, but not asked yet), ``approved``, ``rejected``, ``paused``. Why it's paused: ``other_request`` (the
    decision answers another request: nothing of it is applied), ``not_a_person`` (a person must decide, and whoever did isn't a named one),
    ``person_needed``, ``undecided``; with ``overdue_`` before it where the timer told so.
    """
    asked, given = F.col("request"), F.col("decision")
    flag = lambda c: F.coalesce(c, F.lit(False))
    forced = flag(asked["forced"])
    alone = asked["autonomy"].isin(*UNATTENDED) & ~forced
    decided, answers = given.isNotNull(), given["request_sha256"].eqNullSafe(asked["request_sha256"])
    person = ~forced | flag(T.is_human(given["actor"]))
    demo = ~decided & ~forced & ~flag(asked["unresolved"]) & flag(asked["auto_approve"])
    verdict = F.when(flag(given["approved"]), "approved").otherwise("rejected")
    state = F.when(asked.isNull(), "open").when(flag(alone) | demo, "approved").when(decided & answers & person, verdict).otherwise("paused")
    why = F.when(decided & ~answers, "other_request").when(decided, "not_a_person").when(forced | flag(asked["unresolved"]), "person_needed").otherwise("undecided")
    reason = F.when(F.col("state") == "paused", F.concat(F.when(flag(F.col("due")), "overdue_").otherwise(""), why))
    actor = F.when(flag(alone), F.concat(F.lit("agent:"), "stage")).when(demo, AUTO_APPROVER).when(F.col("state").isin("approved", "rejected"), given["actor"])
    told = sides.withColumn("state", state)
    return told.select(*KEY, "state", reason.alias("reason"), actor.alias("actor"), asked["request_sha256"].alias("request_sha256"), F.greatest(asked["seq"], given["seq"]).alias("seq"))


def _side(kind: str, schema: str) -> Column:
    fields = [part.split()[0] for part in schema.split(", ")]
    return F.max_by(F.when(F.col("kind") == kind, F.struct(*fields)), F.when(F.col("kind") == kind, F.col("seq")))


def states(events: DataFrame, now: Column | None = None, patience: str = "3 days") -> DataFrame:
    """The state of every gate after all ``events``. A gate is overdue where its request is older than ``patience`` at ``now``.

    Aggregated before the shuffle, so a gate with most of the events is two rows a task. Events of other kinds, and with a
    null seq, are ignored.
    """
    sides = events.groupBy(*KEY).agg(_side("request", REQUEST).alias("request"), _side("decision", DECISION).alias("decision")).where("request IS NOT NULL OR decision IS NOT NULL")
    due = F.lit(False) if now is None else F.coalesce(F.col("request.ts") + F.expr(f"INTERVAL {patience}") <= now, F.lit(False))
    return judged(sides.withColumn("due", due))


class _Gates(StatefulProcessor):
    """The last request and decision of each gate of a bucket; a row of both for each batch that changes one, and once when the request's time is up.

    ``waiting`` has the gates by the time when their request is due, which is when the bucket's timer calls. A gate that asked
    again since is due at another time and is passed over.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.gates = handle.getMapState("gates", "run string, stage string", KEPT)
        self.waiting = handle.getMapState("waiting", "due long", "gates array<struct<run:string,stage:string>>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last: dict[tuple, dict[str, tuple]] = {}
        for batch in rows:
            for run, stage, kind, *side in zip(*(batch[c].tolist() for c in (*KEY, "kind", "seq", "due", "body")), strict=True):
                sides = last.setdefault((run, stage), {})
                if kind not in sides or sides[kind][0] < side[0]:
                    sides[kind] = side
        changed, waiting = [], {}
        for gate, sides in last.items():
            before = self.gates.getValue(gate) or (None,) * 5
            request, decision, asked, given, due = before
            if "request" in sides and (asked is None or asked < sides["request"][0]):
                asked, due, request = sides["request"]
                if due != NEVER:
                    waiting.setdefault(due, []).append(gate)
            if "decision" in sides and (given is None or given < sides["decision"][0]):
                given, _, decision = sides["decision"]
            if (asked, given) != (before[2], before[3]):
                self.gates.updateValue(gate, (request, decision, asked, given, due))
                changed.append((*gate, request, decision, False))
        for due, gates in waiting.items():
            others = self.waiting.getValue((due,))
            self.waiting.updateValue((due,), ([*map(tuple, others[0] if others else ()), *gates],))
            if others is None:
                self.handle.registerTimer(due)
        if changed:
            yield self._rows(changed)

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*KEY, "request", "decision", "due"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        overdue = []
        for gate in dict.fromkeys(tuple(gate) for gate in self.waiting.getValue((now,))[0]):
            request, decision, _, _, due = self.gates.getValue(gate)
            if due == now:
                overdue.append((*gate, request, decision, True))
        self.waiting.removeKey((now,))
        if overdue:
            yield self._rows(overdue)

    def close(self) -> None:
        """Nothing to give back."""


def watch(events: DataFrame, patience: timedelta = timedelta(days=3), late: str = "1 hour") -> DataFrame:
    """``events``, a stream, to the states that its gates come to; a gate's last row (by seq, then overdue) is its state.

    Timers follow the events' own time, ``late`` behind it; late events still count, as the watermark only drives the timers.
    """
    schemas = {kind: schema.replace("ts timestamp, ", "") for kind, schema in (("request", REQUEST), ("decision", DECISION))}
    body = F.to_json(F.struct(*dict.fromkeys(part.split()[0] for schema in schemas.values() for part in schema.split(", "))))
    due = F.coalesce(F.unix_millis(F.col("ts") + F.lit(patience)), F.lit(NEVER))
    told = events.where(F.col("kind").isin("request", "decision") & F.col("seq").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    told = told.select(F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).alias("bucket"), *KEY, "kind", "seq", "ts", due.alias("due"), body.alias("body"))
    sides = told.groupBy("bucket").transformWithStateInPandas(_Gates(), SIDES, outputMode="Append", timeMode="EventTime")
    return judged(sides.withColumns({kind: F.from_json(kind, schema) for kind, schema in schemas.items()})).withColumn("overdue", F.coalesce(F.col("reason").startswith("overdue_"), F.lit(False)))


#: Keyed state with timers is kept in this store.
PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_gates(spark: SparkSession, events: DataFrame, path: str, checkpoint: str, patience: timedelta = timedelta(days=3), late: str = "1 hour") -> StreamingQuery:
    """``watch`` into a folder of Parquet files, over what is there now. Begun again with the same folders it goes on where it ended."""
    name, store = PROVIDER
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        return watch(events, patience, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


def latest(rows: DataFrame) -> DataFrame:
    """The state of each gate among the rows of ``watch``."""
    others = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*others), F.struct("seq", "overdue")).alias("last")).select(*KEY, "last.*").drop("overdue")
