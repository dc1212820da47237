"""What ties the tables of a run to each other: calls to journal lines, decisions to the requests they answer, requests to the
artifacts they show, marks of time to the run's span. Each function returns the faults it finds, one row each; none is no fault.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.functions import text as T
from metasift.operators import ledger

#: Fixed: stages whose request lists records, stages whose request shows an artifact, and what a person says of a citation that is right after all.
LISTING_STAGES = ledger.STAGES[:2]
ARTIFACT_STAGES = ledger.STAGES[2:]
FALSE_POSITIVE = "false_positive"


def vote_faults(decisions: DataFrame, votes: DataFrame, screeners: DataFrame) -> DataFrame:
    """record_id of decisions without as many votes as there are screeners, or with a vote of somebody else. ``screeners``: model."""
    members = screeners.select("model").distinct().withColumn("known", F.lit(True))
    counted = votes.join(members, "model", "left").groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("strange"))
    wanted = members.agg(F.count(F.lit(1)).alias("members"))
    judged = decisions.select("record_id").join(counted, "record_id", "left").crossJoin(F.broadcast(wanted))  # one row
    return judged.where((F.coalesce("n", F.lit(0)) != F.col("members")) | (F.coalesce("strange", F.lit(0)) > 0)).select("record_id")


def fewest_calls(counts: DataFrame, members: Column, doubles: Column) -> DataFrame:
    """One row, ``fewest``: a call a record and member, a text judged by models, two an included study, one a second extraction, and the synthesis."""
    judged = F.col("fulltext_assessed") - F.col("fulltext_rescued")
    return counts.select((F.col("screened") * members + judged + 2 * F.col("included") + doubles + 1).alias("fewest"))


def line_faults(lines: DataFrame, members: int | None, judging: bool | None) -> DataFrame:
    """Journal lines (line_no, stage, roles: one a call, n_judged) with a wrong number of calls: line_no, stage, fault.

    Screening by title takes a call a member, all of different roles; retrieval takes none; verification one a citation that was
    judged where an agent judges and none elsewhere (either, where ``judging`` is null); other stages one. ``unknown``: nobody can
    tell, for want of ``members`` or ``n_judged``. A null list holds no call.
    """
    n = F.when(F.col("roles").isNull(), 0).otherwise(F.size("roles"))
    judged = {None: F.array(F.lit(0), F.col("n_judged")), True: F.array("n_judged"), False: F.array(F.lit(0).cast("long"))}[judging]
    wanted = (
        F.when(F.col("stage") == "screening_ta", F.array(F.lit(members).cast("long")))
        .when(F.col("stage") == "retrieval", F.array(F.lit(0).cast("long")))
        .when(F.col("stage") == "verification", judged.cast("array<long>"))
        .otherwise(F.array(F.lit(1).cast("long")))
    )
    doubled = (F.col("stage") == "screening_ta") & (F.size(F.array_distinct("roles")) < F.size("roles"))
    miscounted = F.when(F.exists(wanted, lambda w: w.isNull()), "unknown").when(~F.array_contains(wanted, n.cast("long")), "number of calls")
    faults = F.array_compact(F.array(miscounted, F.when(doubled, "role called twice")))
    return lines.select("line_no", "stage", F.explode(faults).alias("fault"))


def mark_faults(marks: DataFrame, span: DataFrame, tolerance: str = "INTERVAL 2 SECONDS") -> DataFrame:
    """Marks (label, ts) outside the run's span (one row: started, finished; null: open) by more than the tolerance: label, ts, fault."""
    placed = marks.select("label", "ts").crossJoin(F.broadcast(span.select("started", "finished")))  # one row
    early, late = F.expr(f"started - ts > {tolerance}"), F.expr(f"ts - finished > {tolerance}")
    return placed.select("label", "ts", F.when(early, "before the start").when(late, "after the end").alias("fault")).where("fault IS NOT NULL")


def span_faults(spans: DataFrame, tolerance: str = "INTERVAL 2 SECONDS") -> DataFrame:
    """Spans (label, started, finished) that end before they start."""
    return spans.where(F.expr(f"started - finished > {tolerance}")).select("label", "started", "finished")


def binding_faults(log: DataFrame, requests: DataFrame, artifacts: DataFrame, requested: DataFrame, decided: DataFrame) -> DataFrame:
    """Effective decisions that aren't of what was asked: stage, fault, n (rows concerned).

    ``requests``: stage, sha256, artifact_sha256. ``artifacts``: stage, sha256 of what lies there now. ``requested`` and ``decided``:
    (stage, record_id), the records that a request lists and those that were decided. ``log`` may hold n_labels, as declared by a decision.
    Only stages with a request and an effective decision are judged; a stage of screening without a listed record has an unreadable request.
    """
    gates = ledger.effective(log)
    gates = gates if "n_labels" in log.columns else gates.withColumn("n_labels", F.lit(None).cast("long"))
    shown = requests.select("stage", F.col("sha256").alias("asked"), F.col("artifact_sha256").alias("shown")).join(artifacts.select("stage", F.col("sha256").alias("there")), "stage", "left")
    gates = gates.select("stage", F.col("request_sha256").alias("request"), F.col("decision_sha256").alias("decision"), "n_labels").join(shown, "stage")
    # marks of each stage by how they stand to its effective decision, counted before they meet anything else
    kinds = log.where(F.col("action").isin("label", "flag_review")).groupBy("stage", "action", "request_sha256", "decision_sha256").agg(F.count(F.lit(1)).alias("k"))
    own = F.col("request_sha256").eqNullSafe(F.col("request")) & F.col("decision_sha256").eqNullSafe(F.col("decision"))
    strange = (F.col("decision_sha256") == F.col("decision")) & ~F.col("request_sha256").eqNullSafe(F.col("request"))
    marks = kinds.join(gates.select("stage", "request", "decision"), "stage").groupBy("stage").agg(F.sum(F.when(own & (F.col("action") == "label"), F.col("k"))).alias("labels"), F.sum(F.when(strange, F.col("k"))).alias("strange"))
    judged = gates.join(marks, "stage", "left").fillna(0, ["labels", "strange"])
    artifact = F.col("stage").isin(*ARTIFACT_STAGES)
    one = F.lit(1).cast("long")
    faults = {
        "another request": F.when(~F.col("request").eqNullSafe(F.col("asked")), one),
        "no decision hash": F.when(F.col("decision").isNull(), one),
        "marks under another request": F.when(F.col("strange") > 0, F.col("strange")),
        "another number of labels": F.when(F.col("n_labels").isNotNull() & (F.col("n_labels") != F.col("labels")), F.abs(F.col("n_labels") - F.col("labels"))),
        "no artifact hash": F.when(artifact & F.col("shown").isNull(), one),
        "another artifact": F.when(artifact & (F.col("shown") != F.col("there")), one),
    }
    found = judged.select("stage", F.explode(F.array(*[F.struct(F.lit(name).alias("fault"), n.alias("n")) for name, n in faults.items()])).alias("f")).select("stage", "f.*").where("n IS NOT NULL")
    # only stages that were asked and decided; their records as numbers of copies, so equal rows meet once
    listing = gates.where(F.col("stage").isin(*LISTING_STAGES)).select("stage")
    copies = lambda rows, name: rows.join(F.broadcast(listing), "stage", "left_semi").groupBy("stage", "record_id").agg(F.count(F.lit(1)).alias(name))
    same_record = F.col("q.stage").eqNullSafe(F.col("d.stage")) & F.col("q.record_id").eqNullSafe(F.col("d.record_id"))
    both = copies(requested, "asked").alias("q").join(copies(decided, "had").alias("d"), same_record, "full")
    differ = both.where(~F.col("asked").eqNullSafe(F.col("had"))).select(F.coalesce("q.stage", "d.stage").alias("stage"), F.lit("other records").alias("fault"))
    labelled = ledger.labels_from_log(log).join(F.broadcast(listing), "stage", "left_semi").select("stage", F.col("target").alias("record_id"))
    outside = labelled.join(requested.select("stage", "record_id").distinct(), ["stage", "record_id"], "left_anti").select("stage", F.lit("label outside the request").alias("fault"))
    rows = differ.unionByName(outside).groupBy("stage", "fault").agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(rows)


def final_faults(log: DataFrame, stated: DataFrame, flags: DataFrame) -> DataFrame:
    """What speaks against the last gate: fault, place (of a citation, else null).

    ``stated``: one row with status and forced_human as the run states them. ``flags``: place of each flagged citation. ``log`` holds
    forced_human, verdict and reason. A flagged citation calls for a person: both must say so, and for an approval the approver must
    have found each flagged citation right, with a reason, under the effective decision. A null forced_human counts as false.
    """
    gate = ledger.effective(log).where(F.col("stage") == ledger.STAGES[-1])
    approved = gate.where(F.col("action") == "approve")
    flagged = flags.agg((F.count(F.lit(1)) > 0).alias("flagged"))
    said = lambda rows, name: rows.select(F.coalesce("forced_human", F.lit(False)).alias("said")).crossJoin(F.broadcast(flagged)).where("said <> flagged").select(F.lit(name).alias("fault"))
    approval = approved.agg((F.count(F.lit(1)) > 0).alias("approved"))
    early = stated.where("status = 'completed'").crossJoin(F.broadcast(approval)).where("NOT approved").select(F.lit("completed without an approval").alias("fault"))
    whole = [said(stated.crossJoin(F.broadcast(approval)).where("approved"), "the run says otherwise who had to decide"), said(approved, "the decision says otherwise who had to decide"), early]
    reviews = ledger.belongs_to_effective(log).where((F.col("stage") == ledger.STAGES[-1]) & (F.col("action") == "flag_review") & (F.col("verdict") == FALSE_POSITIVE) & (F.length(T.strip(F.col("reason"))) > 0))
    by_approver = reviews.join(F.broadcast(approved.select("actor")), "actor", "left_semi").select(F.col("target").alias("place")).distinct()
    open_ = flags.select("place").crossJoin(F.broadcast(approval)).where("approved").select("place").join(by_approver, "place", "left_anti")
    rows = open_.select(F.lit("flagged citation not reviewed").alias("fault"), F.col("place").cast("string").alias("place"))
    return reduce(lambda a, b: a.unionByName(b), [w.withColumn("place", F.lit(None).cast("string")) for w in whole]).unionByName(rows)
