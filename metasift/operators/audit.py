"""Data-quality audit: relations between the tables of a run, checks, and the report.

A relation is true, false or null (can't be verified). A check is PASS, WARN, FAIL or N/A. ``Run`` holds the tables by name;
a table that is missing makes what needs it unverifiable, never true.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metasift.functions import stats as S
from metasift.functions import text as T
from metasift.operators import agreement, bindings, grounding, ledger, screening, searchlog
from metasift.operators.ordered import positions, settled

RELATION = "family string, name string, ok boolean, detail string"
#: Fixed: the mark of a run that the pipeline itself made; a run put together afterwards has none.
PROVENANCE = "pipeline"
CHECK = "check_id string, status string, detail string"


@dataclass
class Run:
    """Tables of a run. ``counts`` is one row of flow counts as declared; ``thresholds`` and ``stages_reached`` are settings."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)
    stages_reached: tuple[str, ...] = ledger.STAGES
    deliverables: tuple[str, ...] = ()
    registration: str = ""
    #: Whether an agent judges citations; null where the settings can't be read.
    judging: bool | None = None
    #: Made by ``gathered``.
    ready: bool = False

    def has(self, *names: str) -> bool:
        return all(n in self.tables for n in names)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def gathered(self) -> Run:
        """The same run with its one-row tables read once, and those that most relations look at computed once."""
        if self.ready:
            return self
        one_row = {name: local(self[name]) for name in ("counts", "metrics", "stated") if self.has(name)}
        shared = {name: settled(self[name]) for name in ("screened", "fulltext", "reports", "calls", "log") if self.has(name)}
        return replace(self, tables=self.tables | one_row | shared, ready=True)


def local(few: DataFrame, most: int = 1000) -> DataFrame:
    """A table of a few rows, computed once."""
    rows = few.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return few.sparkSession.createDataFrame(rows, few.schema)


def stacked(parts: list[DataFrame]) -> DataFrame:
    """All rows of the parts. Pairs of pairs, so that no part is analysed again for each one that follows."""
    while len(parts) > 1:
        parts = [reduce(DataFrame.unionByName, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


def relation(one_row: DataFrame, family: str, name: str, ok: Column, detail: Column | None = None) -> DataFrame:
    text = detail if detail is not None else F.lit("")
    return one_row.select(F.lit(family).alias("family"), F.lit(name).alias("name"), ok.cast("boolean").alias("ok"), F.coalesce(text.cast("string"), F.lit("")).alias("detail"))


def unverifiable(run: Run, family: str, name: str, why: str) -> DataFrame:
    return run.spark.sql("SELECT 1").select(F.lit(family).alias("family"), F.lit(name).alias("name"), F.lit(None).cast("boolean").alias("ok"), F.lit(why).alias("detail"))


def equal(run: Run, family: str, name: str, declared: str, counted: DataFrame) -> DataFrame:
    """A declared count against a counted one (one row, one column)."""
    value = counted.select(F.col(counted.columns[0]).cast("long").alias("counted"))
    both = run["counts"].select(F.col(declared).cast("long").alias("declared")).crossJoin(F.broadcast(value))
    return relation(both, family, name, F.col("declared") == F.col("counted"), F.concat(F.lit("declared "), F.col("declared"), F.lit(", counted "), F.col("counted")))


def empty(rows: DataFrame, family: str, name: str) -> DataFrame:
    """True where ``rows`` has none."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return relation(n, family, name, F.col("n") == 0, F.concat(F.col("n").cast("string"), F.lit(" rows")))


def rows_of(df: DataFrame, where: Column | None = None) -> DataFrame:
    return df.agg((F.count(F.lit(1)) if where is None else F.count_if(F.coalesce(where, F.lit(False)))).alias("n"))


def same_sequence(a: DataFrame, b: DataFrame, id_col: str = "record_id", seq_col: str = "seq") -> DataFrame:
    """Positions where two ordered id lists differ. """
    place = lambda df, name: positions(df.select(id_col, seq_col), seq_col).select("pos", F.col(id_col).alias(name))
    return place(a, "a").join(place(b, "b"), "pos", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def multiset_missing(part: DataFrame, whole: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``part`` that ``whole`` doesn't hold often enough."""
    return part.select(*columns).exceptAll(whole.select(*columns))


def relations(run: Run) -> DataFrame:
    """Every relation that the tables allow, and a null row for each group that they don't."""
    run = run.gathered()
    out: list[DataFrame] = []
    label = screening.effective_label()

    def needs(family: str, *names: str) -> bool:
        if run.has(*names):
            return True
        out.append(unverifiable(run, family, ", ".join(names), "missing table"))
        return False

    if needs("1", "counts", "records"):
        c = run["counts"]
        total = F.aggregate(F.map_values("identified_by_source"), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
        out.append(relation(c, "1", "sum of identified_by_source = identified", total == F.col("identified")))
        out.append(equal(run, "1", "identified = records", "identified", rows_of(run["records"])))
        declared = c.select(F.explode("identified_by_source").alias("source_db", "declared"))
        counted = run["records"].groupBy("source_db").agg(F.count(F.lit(1)).alias("counted"))
        differ = declared.join(counted, "source_db", "full_outer").where(~F.col("declared").cast("long").eqNullSafe(F.col("counted")))
        out.append(empty(differ, "1", "identified_by_source = records by source"))
    if needs("4", "counts", "dedup", "duplicates"):
        out.append(relation(run["counts"], "4", "screened = identified - duplicates", F.col("screened") == F.col("identified") - F.col("duplicates_removed")))
        out.append(equal(run, "4", "duplicates_removed = duplicates", "duplicates_removed", rows_of(run["duplicates"])))
        out.append(equal(run, "4", "screened = unique records", "screened", rows_of(run["dedup"])))
        out.append(empty(run["dedup"].groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "4", "unique ids"))
    if needs("4", "journal", "dedup"):
        out.append(empty(run["journal"].join(run["dedup"], "record_id", "left_anti"), "4", "journal ids among unique records"))
    if needs("5", "counts", "screened", "votes"):
        d = run["screened"]
        out.append(equal(run, "5", "decisions = screened", "screened", rows_of(d)))
        voted = run["votes"].groupBy("record_id").agg(screening.recall_biased(F.col("label")).alias("from_votes"))
        out.append(empty(d.join(voted, "record_id", "left").where(~F.coalesce("from_votes", F.lit("unclear")).eqNullSafe(F.col("ensemble_label"))), "5", "ensemble label follows the votes"))
        out.append(empty(d.where(~F.col("final_label").eqNullSafe(F.coalesce("human_label", "ensemble_label"))), "5", "final label = human label, else ensemble label"))
        if run.has("dedup"):
            out.append(empty(same_sequence(d, run["dedup"]), "5", "decisions in the order of unique records"))
    if needs("6", "counts", "screened"):
        d, c = run["screened"], run["counts"]
        out.append(equal(run, "6", "excluded_ta = excluded decisions", "excluded_ta", rows_of(d, label == "exclude")))
        out.append(relation(c, "6", "human + ai = excluded_ta", F.col("excluded_ta_human") + F.col("excluded_ta_ai") == F.col("excluded_ta")))
        out.append(relation(c, "6", "sought = screened - excluded_ta", F.col("fulltext_sought") == F.col("screened") - F.col("excluded_ta")))
        out.append(equal(run, "6", "sought = passing decisions", "fulltext_sought", rows_of(d, screening.passes(label))))
    if needs("7", "fulltext", "screened"):
        passed = run["screened"].where(screening.passes(label)).select("record_id", "seq")
        out.append(empty(same_sequence(run["fulltext"], passed), "7", "full-text ids = passing ids in order"))
        out.append(empty(run["fulltext"].where("final_label = 'unclear'"), "7", "no final label is unclear"))
    if needs("7", "fulltext", "retrieval"):
        got = run["fulltext"].join(run["retrieval"].select("record_id", "available"), "record_id", "left")
        retrieved = F.coalesce(F.col("fulltext_status") == "retrieved", F.lit(False))
        out.append(empty(got.where(~(retrieved == F.coalesce("available", F.lit(False)))), "7", "retrieved if and only if available"))
        texts = run["retrieval"].where("available AND text IS NOT NULL")
        out.append(empty(texts.where((F.sha2("text", 256) != F.col("text_sha256")) | (F.length("text") != F.col("n_chars"))), "7", "kept texts match hash and length"))
    if needs("8", "counts", "fulltext"):
        lost = F.col("fulltext_status") == "not_retrieved"
        out.append(equal(run, "8", "not retrieved", "fulltext_not_retrieved", rows_of(run["fulltext"], lost & F.col("human_label").isNull())))
        out.append(equal(run, "8", "rescued", "fulltext_rescued", rows_of(run["fulltext"], lost & F.col("human_label").isNotNull())))
        out.append(relation(run["counts"], "8", "assessed = sought - not retrieved", F.col("fulltext_assessed") == F.col("fulltext_sought") - F.col("fulltext_not_retrieved")))
    if needs("9", "counts", "reports"):
        c = run["counts"]
        reasons = F.aggregate(F.map_values("ft_exclusion_reasons"), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
        out.append(equal(run, "9", "excluded_ft = reports", "excluded_ft", rows_of(run["reports"])))
        out.append(relation(c, "9", "human + ai = excluded_ft", F.col("excluded_ft_human") + F.col("excluded_ft_ai") == F.col("excluded_ft")))
        out.append(relation(c, "9", "sum of reasons = excluded_ft", reasons == F.col("excluded_ft")))
        if run.has("fulltext", "records"):
            again = screening.excluded_reports(run["fulltext"], run["records"]).select("record_id", "reason", "reason_source")
            declared = run["reports"].select("record_id", "reason", "reason_source")
            out.append(empty(again.exceptAll(declared).unionAll(declared.exceptAll(again)), "9", "reports follow the decisions"))
    if needs("10", "counts", "fulltext"):
        out.append(relation(run["counts"], "10", "included = assessed - excluded_ft", F.col("included") == F.col("fulltext_assessed") - F.col("excluded_ft")))
        out.append(equal(run, "10", "included = including decisions", "included", rows_of(run["fulltext"], label == "include")))
        for name in ("extractions", "assessments"):
            if run.has(name):
                chosen = run["fulltext"].where(label == "include").select(F.col("record_id").alias("study_id")).distinct()
                have = run[name].select("study_id").distinct()
                out.append(empty(chosen.exceptAll(have).unionAll(have.exceptAll(chosen)), "10", f"{name} = included"))
    if needs("11", "counts", "cells"):
        from metasift.operators.flow import flow_cells

        again = flow_cells(run["counts"]).select("data", "n")
        declared = run["cells"].select("data", "n").where("data IS NOT NULL AND data <> 'NA'")
        differ = declared.join(again.withColumnRenamed("n", "again"), "data").where(~F.col("n").eqNullSafe(F.col("again")))
        out.append(empty(differ.where(~F.col("data").startswith("total_studies_ma") & ~F.col("data").startswith("total_reports_ma")), "11", "exchange cells = counts"))
    if needs("12", "journal_metas", "calls"):
        columns = [c for c in run["journal_metas"].columns if c in run["calls"].columns]
        out.append(empty(multiset_missing(run["journal_metas"], run["calls"], columns), "12", "journalled calls are in the call log"))
    if needs("13", "outputs", "consolidated"):
        out.append(empty(run["consolidated"].join(run["outputs"], ["record_id", "output_sha256"], "left_anti"), "13", "consolidated rows come from the journal"))
    if needs("9.3", "metrics", "gold", "screened"):
        again = screening.screening_metrics(run["screened"], run["gold"])
        pairs = run["metrics"].crossJoin(F.broadcast(again.select(*[F.col(c).alias("again_" + c) for c in again.columns])))
        whole = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col("again_" + c)) for c in ("tp", "fp", "fn", "tn")])
        out.append(relation(pairs, "9.3", "matrix from decisions and gold", whole))
        for c in ("recall", "lost_evidence", "mcc", "wmcc", "kappa"):
            out.append(relation(pairs, "9.3", f"{c} recomputed", S.close(F.col(c), F.col("again_" + c))))
    if needs("9.3", "screened", "votes", "screeners"):
        out.append(empty(bindings.vote_faults(run["screened"], run["votes"], run["screeners"]), "9.3", "one vote of each screener"))
    if needs("9.3", "stated", "calls"):
        both = run["stated"].crossJoin(F.broadcast(ledger.manifest(run["calls"]).select(F.col("models_used").alias("models"), F.col("all_deterministic").alias("certain"))))
        out.append(relation(both, "9.3", "models stated = models called", F.array_sort("models_used") == F.col("models")))
        out.append(relation(both, "9.3", "stated as deterministic = all calls are", F.col("all_deterministic") == F.col("certain")))
    if needs("9.3", "call_copies", "calls"):
        columns = [c for c in run["call_copies"].columns if c in run["calls"].columns]
        line = lambda df: df.select("seq", F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("line"))
        out.append(empty(same_sequence(line(run["call_copies"]), line(run["calls"]), "line"), "9.3", "copied calls = calls in order"))
    if needs("9.3", "counts", "calls", "screeners", "stated"):
        members = run["screeners"].agg(F.countDistinct("model").alias("members"))
        floor = bindings.fewest_calls(run["counts"].crossJoin(F.broadcast(members)).crossJoin(F.broadcast(run["stated"].select("n_double"))), F.col("members"), F.coalesce("n_double", F.lit(0)))
        both = floor.crossJoin(F.broadcast(rows_of(run["calls"])))
        out.append(relation(both, "9.3", "no fewer calls than the decisions took", F.col("n") >= F.col("fewest"), F.concat(F.col("n").cast("string"), F.lit(" calls, at least "), F.col("fewest").cast("string"))))
    if needs("9.3", "stated", "fulltext", "second_lines"):
        chosen = run["fulltext"].where(label == "include").select("record_id", "seq")
        sample = agreement.systematic_sample(chosen, "seq").select("record_id")
        both = run["stated"].select("n_double").crossJoin(F.broadcast(rows_of(sample)))
        out.append(relation(both, "9.3", "studies extracted twice = the sample", F.col("n_double") == F.col("n")))
        out.append(empty(sample.join(run["second_lines"], "record_id", "left_anti"), "13", "each study of the sample in the second journal"))
    if needs("9.3", "stated", "assessments"):
        other = run["assessments"].join(F.broadcast(run["stated"].select("rob_tool")), ~F.col("tool").eqNullSafe(F.col("rob_tool")), "left_semi")
        out.append(empty(other, "9.3", "assessed with the tool stated"))
    if needs("10", "stated", "counts"):
        both = run["stated"].select("total_excluded").crossJoin(F.broadcast(run["counts"].select("excluded_ta", "excluded_ft")))
        out.append(relation(both, "10", "total_excluded = excluded_ta + excluded_ft", F.col("total_excluded") == F.col("excluded_ta") + F.col("excluded_ft")))
    if needs("12", "journal_lines", "screeners", "stated"):
        members = local(run["screeners"].select("model").distinct()).count()
        one = bindings.line_faults(run["journal_lines"], members or None, run.judging).agg(F.count_if(F.col("fault") != "unknown").alias("wrong"), F.count_if(F.col("fault") == "unknown").alias("unknown"))
        out.append(relation(one, "12", "calls of each journal line", F.when(F.col("wrong") > 0, False).when(F.col("unknown") == 0, True)))
    for table in ("calls", "log"):
        if needs("14", "stated", table):
            marks = run[table].select(F.lit(table).alias("label"), "ts")
            out.append(empty(bindings.mark_faults(marks, run["stated"]), "14", f"{table} within the run"))
    if needs("14", "spans"):
        out.append(empty(bindings.span_faults(run["spans"]), "14", "spans end after their start"))
    if needs("15", "log", "requests", "artifacts", "requested", "decided"):
        out.append(empty(bindings.binding_faults(run["log"], run["requests"], run["artifacts"], run["requested"], run["decided"]), "15", "decisions are of what was asked"))
    if needs("16", "log"):
        out.append(empty(ledger.label_breaks(run["log"]), "16", "labels before approval, none with a rejection, no repeats"))
    if needs("17", "log", "stated", "flags"):
        faults = bindings.final_faults(run["log"], run["stated"], run["flags"])
        early = F.col("fault") == "completed without an approval"
        out.append(empty(faults.where(~early), "17", "a person decided on flagged citations"))
        out.append(empty(faults.where(early), "18", "completed only with an approval"))
    return stacked(out)


def check(one_row: DataFrame, check_id: str, status: Column, detail: Column | None = None) -> DataFrame:
    text = detail if detail is not None else F.lit("")
    return one_row.select(F.lit(check_id).alias("check_id"), status.alias("status"), F.coalesce(text.cast("string"), F.lit("")).alias("detail"))


def none_left(rows: DataFrame, check_id: str, bad: str = "FAIL") -> DataFrame:
    return check(rows.agg(F.count(F.lit(1)).alias("n")), check_id, F.when(F.col("n") == 0, "PASS").otherwise(bad), F.concat(F.col("n").cast("string"), F.lit(" found")))


def arithmetic(found: DataFrame) -> DataFrame:
    """A broken relation fails, an unverifiable one warns."""
    one = found.agg(F.count_if(~F.col("ok")).alias("broken"), F.count_if(F.col("ok").isNull()).alias("unknown"))
    return check(one, "arithmetic", F.when(F.col("broken") > 0, "FAIL").when(F.col("unknown") > 0, "WARN").otherwise("PASS"), F.concat_ws(", ", F.concat(F.col("broken").cast("string"), F.lit(" broken")), F.concat(F.col("unknown").cast("string"), F.lit(" unknown"))))


def checks(run: Run) -> DataFrame:
    """One row for each check whose tables there are; N/A for the others."""
    run = run.gathered()
    out: list[DataFrame] = []

    def needs(check_id: str, *names: str) -> bool:
        if run.has(*names):
            return True
        out.append(run.spark.sql("SELECT 1").select(F.lit(check_id).alias("check_id"), F.lit("N/A").alias("status"), F.lit("missing: " + ", ".join(names)).alias("detail")))
        return False

    if needs("manifest", "calls"):
        one = run["calls"].agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("provider") == "fake").alias("fakes"))
        out.append(check(one, "manifest", F.when((F.col("n") == 0) | (F.col("fakes") > 0), "WARN").otherwise("PASS")))
    if needs("provenance", "manifest"):
        out.append(check(run["manifest"], "provenance", F.when(F.col("provenance") == PROVENANCE, "PASS").otherwise("FAIL"), F.coalesce("provenance", F.lit("absent"))))
    if needs("schemas", "lines"):
        out.append(none_left(run["lines"].where("status = 'bad'"), "schemas"))
    if needs("protocol_snapshot", "declared_hashes", "actual_hashes"):
        a, b = run["declared_hashes"].select("file", F.col("sha256").alias("declared")), run["actual_hashes"].select("file", F.col("sha256").alias("actual"))
        out.append(none_left(a.join(b, "file", "full_outer").where(~F.col("declared").eqNullSafe(F.col("actual"))), "protocol_snapshot"))
    if needs("prompts", "calls"):
        out.append(none_left(run["calls"].where("prompt_sha256 IS NULL OR response_sha256 IS NULL"), "prompts"))
    if needs("timing", "log", "calls"):
        late = ledger.late_marks(run["log"].withColumn("run", F.lit(1)), ["run"]).agg(F.count(F.lit(1)).alias("late"))
        real = run["calls"].where(~((F.col("provider") == "fake") & F.col("deterministic")))
        gaps = ledger.call_gaps(real.withColumn("run", F.lit(1)), ["run"]).agg(F.coalesce(F.bool_or(F.col("too_fast") | F.col("rounded")), F.lit(False)).alias("odd"))
        wrong = run["calls"].agg(F.count_if(F.col("deterministic") & (F.col("provider") != "fake")).alias("wrong"))
        one = late.crossJoin(F.broadcast(gaps)).crossJoin(F.broadcast(wrong))
        out.append(check(one, "timing", F.when((F.col("late") > 0) | (F.col("wrong") > 0), "FAIL").when(F.col("odd"), "WARN").otherwise("PASS")))
    if needs("ledger", "log"):
        unknown = run["log"].where(~F.col("action").isin(*ledger.GATE_ACTIONS, "label", "flag_review") | ~F.col("stage").isin(*ledger.STAGES)).select("seq")
        out.append(none_left(unknown.unionAll(ledger.stage_order_breaks(run["log"]).select(F.col("first_seq").alias("seq"))).unionAll(ledger.label_breaks(run["log"]).select("seq")), "ledger"))
    if needs("hitl", "log", "screened"):
        mine = ledger.labels_from_log(run["log"]).where("stage = 'screening_ta'").select(F.col("target").alias("record_id"), F.col("label").alias("logged"))
        both = run["screened"].select(F.col("record_id").cast("string").alias("record_id"), "human_label").join(mine, "record_id", "full_outer")
        differ = both.where(~F.col("human_label").eqNullSafe(F.col("logged"))).select(F.lit("label").alias("fault"))
        faults = ledger.gate_faults(run["log"], run.stages_reached, run["requests"] if run.has("requests") else None).select("fault").unionAll(differ)
        if run.has("counts"):
            backed = run["counts"].select("excluded_ta_human").crossJoin(F.broadcast(ledger.human_exclusions(run["log"])))
            faults = faults.unionAll(backed.where("excluded_ta_human > backed").select(F.lit("human exclusions without labels").alias("fault")))
        # without the requests nobody can tell that the gates were passed
        n = F.col("n")
        one = faults.agg(F.count(F.lit(1)).alias("n"))
        out.append(check(one, "hitl", F.when(n > 0, "FAIL").otherwise("PASS" if run.has("requests") else "WARN"), F.concat(n.cast("string"), F.lit(" found"))))
    if needs("request_hash", "log", "requests"):
        asked = run["requests"].select("stage", F.col("sha256").alias("asked"))
        decided = ledger.effective(run["log"]).where("action <> 'auto-proceed'")
        out.append(none_left(decided.join(asked, "stage", "left").where(~F.col("request_sha256").eqNullSafe(F.col("asked"))), "request_hash"))
    if needs("final_gate", "log"):
        last = ledger.effective(run["log"]).where("stage = 'report'")
        one = last.agg(F.count_if((F.col("action") == "approve") & T.is_human(F.col("actor"))).alias("n"))
        out.append(check(one, "final_gate", F.when(F.col("n") == 1, "PASS").otherwise("FAIL")))
    if needs("stage_artifacts", "required", "present"):
        reached = run["required"].where(F.col("stage").isin(*run.stages_reached))
        out.append(none_left(reached.join(run["present"], "file", "left_anti"), "stage_artifacts"))
    out.append(arithmetic(relations(run)))
    if needs("exclusions", "counts", "screened"):
        again = screening.exclusion_breakdown(run["screened"])
        one = run["counts"].select("excluded_ta", "excluded_ta_ai", "excluded_ta_human").crossJoin(F.broadcast(again))
        ok = (F.col("excluded_ta") == F.col("total_excluded")) & (F.col("excluded_ta_ai") == F.col("excluded_ai")) & (F.col("excluded_ta_human") == F.col("excluded_human"))
        out.append(check(one, "exclusions", F.when(ok, "PASS").otherwise("FAIL")))
    if needs("deliverable", "present"):
        wanted = run.spark.createDataFrame([(f,) for f in run.deliverables], "file string")
        out.append(none_left(wanted.join(run["present"].where("n_bytes > 0"), "file", "left_anti"), "deliverable"))
    if needs("gold", "metrics"):
        m = run["metrics"]
        ok = F.coalesce(S.is_correlation(F.col("mcc")) & S.is_correlation(F.col("kappa")), F.lit(True))
        informative = F.col("mcc").isNotNull() & F.col("kappa").isNotNull()
        out.append(check(m, "gold", F.when(~ok, "FAIL").when(~informative, "WARN").otherwise("PASS")))
    if needs("thresholds", "metrics"):
        m, target, kappa = run["metrics"], run.thresholds.get("recall"), run.thresholds.get("kappa")
        low = F.lit(False) if target is None else F.coalesce(F.col("recall") < target, F.lit(True))
        weak = F.lit(False) if kappa is None else F.coalesce(F.col("kappa") < kappa, F.lit(True))
        few = F.lit(False) if target is None else F.coalesce((F.col("tp") + F.col("fn")) < S.least_positives(F.lit(target)), F.lit(False))
        out.append(check(m, "thresholds", F.when(low, "FAIL").when(weak | few, "WARN").otherwise("PASS")))
    if needs("grounding", "citation_checks"):
        out.append(none_left(run["citation_checks"].where(grounding.flagged(F.col("exists_in_corpus"), F.col("grounded"))), "grounding"))
    if needs("search_log", "search_log", "records"):
        given = {name: run[table] for name, table in (("failures", "failures"), ("strings", "search_strings"), ("declared", "databases")) if run.has(table)}
        single = searchlog.entry_faults(run["search_log"], given.get("failures"), given.get("strings"))
        found = single.unionByName(searchlog.log_faults(run["search_log"], run["records"], given.get("failures"), given.get("declared")))
        one = found.agg(F.count_if(F.col("level") == "FAIL").alias("fails"), F.count_if(F.col("level") == "WARN").alias("warns"))
        out.append(check(one, "search_log", F.when(F.col("fails") > 0, "FAIL").when(F.col("warns") > 0, "WARN").otherwise("PASS"), F.concat(F.col("fails").cast("string"), F.lit(" faults, "), F.col("warns").cast("string"), F.lit(" warnings"))))
    if needs("search_window", "search_log", "window"):
        engine = run["search_log"].agg(F.min("started_utc").alias("started"))
        one = engine.crossJoin(F.broadcast(run["window"]))
        out.append(check(one, "search_window", F.when(T.days_between(F.col("declared"), F.substring("started", 1, 10)) <= 1, "PASS").otherwise("WARN")))
    out.append(check(run.spark.sql("SELECT 1"), "registration", F.when(F.length(T.strip(F.lit(run.registration))) > 0, "PASS").otherwise("WARN")))
    if needs("response_overlap", "calls"):
        out.append(none_left(ledger.response_overlap(run["calls"]).where("suspicious"), "response_overlap", "WARN"))
    return fail_closed(local(stacked(out)), run)


def fail_closed(found: DataFrame, run: Run) -> DataFrame:
    """A run that reached its last stage can't leave checks out: without a failure elsewhere, N/A fails."""
    if ledger.STAGES[-1] not in run.stages_reached:
        return found
    any_fail = found.agg(F.coalesce(F.bool_or(F.col("status") == "FAIL"), F.lit(False)).alias("any_fail"))
    return found.crossJoin(F.broadcast(any_fail)).withColumn("status", F.when((F.col("status") == "N/A") & ~F.col("any_fail"), "FAIL").otherwise(F.col("status"))).drop("any_fail")


def report(found: DataFrame) -> DataFrame:
    """n_fail, n_warn, n_na, n_pass and publishable."""
    count = lambda s: F.count_if(F.col("status") == s)
    return found.agg(count("FAIL").alias("n_fail"), count("WARN").alias("n_warn"), count("N/A").alias("n_na"), count("PASS").alias("n_pass"), (count("FAIL") == 0).alias("publishable"))


def merge_issues(issues: DataFrame) -> DataFrame:
    """(level, message, place, seq) to one row for each level and message with its places in order."""
    places = F.transform(F.array_sort(F.collect_list(F.struct("seq", "place"))), lambda x: x["place"])
    return issues.groupBy("level", "message").agg(F.array_join(F.array_distinct(places), ", ").alias("places"), F.min("seq").alias("seq"))


def retirements(models: DataFrame, table: DataFrame, today: Column | None = None) -> DataFrame:
    """Models (column ``model``) with their shutdown date, by full name first, then without the tag. ``table``: name, shutdown."""
    tried = models.select("model", F.posexplode(T.model_candidates(F.col("model"))).alias("place", "name")).join(F.broadcast(table), "name")
    found = tried.groupBy("model").agg(F.min_by("shutdown", "place").alias("shutdown"))
    return models.join(found, "model", "left").withColumn("is_past", F.coalesce((today if today is not None else F.current_date()) >= F.col("shutdown"), F.lit(False)))
