"""Decision log: effective decisions, order checks, labels from the log, and idempotent registration.

Log rows have stage, actor, autonomy, action, target, request_sha256, decision_sha256, to_label, reason, ts and seq (file order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metasift.functions import text as T
from metasift.operators.ordered import greatest_before, medians, settled

#: Fixed orders and names.
STAGES = ("screening_ta", "screening_ft", "extraction", "rob", "report")
GATE_ACTIONS = ("approve", "reject", "auto-proceed")
#: Fixed: stages whose decision a person must take, and the actor of a demonstration run.
JUDGMENT_STAGES = STAGES[:4]
AUTO_APPROVER = "auto-approve (demo)"
ENTRY_KEY = ("stage", "action", "target", "request_sha256", "decision_sha256")


def stage_index(stage: Column) -> Column:
    """Place of a stage in the pipeline; unknown ones come last."""
    order = F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage)
    return F.when(order > 0, order).otherwise(99)


def effective(log: DataFrame) -> DataFrame:
    """The last gate decision of each stage."""
    others = [c for c in log.columns if c != "stage"]
    return log.where(F.col("action").isin(*GATE_ACTIONS)).groupBy("stage").agg(F.max_by(F.struct(*others), "seq").alias("d")).select("stage", "d.*")


def gate_summary(log: DataFrame) -> DataFrame:
    """Effective decision of each stage and how many labels and flag reviews carry its hash (none if it has no hash)."""
    decided = effective(log)
    own = log.groupBy(F.col("stage").alias("own_stage"), F.col("decision_sha256").alias("own_sha")).agg(F.count_if(F.col("action") == "label").alias("n_labels"), F.count_if(F.col("action") == "flag_review").alias("n_flag_reviews"))
    joined = decided.join(own, (F.col("stage") == F.col("own_stage")) & (F.col("decision_sha256") == F.col("own_sha")), "left")
    return joined.select("stage", "action", "actor", "autonomy", "request_sha256", "decision_sha256", F.coalesce("n_labels", F.lit(0)).alias("n_labels"), F.coalesce("n_flag_reviews", F.lit(0)).alias("n_flag_reviews"), "seq")


def belongs_to_effective(log: DataFrame) -> DataFrame:
    """Log rows that share both hashes with their stage's effective decision; nulls match nulls."""
    decided = effective(log).select(F.col("stage").alias("s"), F.col("request_sha256").alias("r"), F.col("decision_sha256").alias("d"))
    return log.join(decided, (F.col("stage") == F.col("s")) & F.col("request_sha256").eqNullSafe(F.col("r")) & F.col("decision_sha256").eqNullSafe(F.col("d")), "left_semi")


def labels_from_log(log: DataFrame) -> DataFrame:
    """Last label of each target under the effective decision."""
    rows = belongs_to_effective(log).where("action = 'label'")
    return rows.groupBy("stage", "target").agg(F.max_by("to_label", "seq").alias("label"), F.max_by("reason", "seq").alias("reason"), F.max_by("actor", "seq").alias("actor"))


def missing_entries(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` that the log doesn't have, so registering twice adds nothing; a repeated row is wanted once."""
    have = log.select(*[F.col(c).alias("have_" + c) for c in ENTRY_KEY]).distinct()
    same = F.lit(True)
    for c in ENTRY_KEY:
        same = same & F.col(c).eqNullSafe(F.col("have_" + c))
    return wanted.dropDuplicates(list(ENTRY_KEY)).join(have, same, "left_anti")


def gate_faults(log: DataFrame, reached: tuple[str, ...], requests: DataFrame | None = None) -> DataFrame:
    """Judgment stages that no person decided: stage, fault. ``missing``: reached, or followed by a decided stage, without a decision;
    ``not human``; ``no request``: decided by a person without its row in ``requests`` (stage). ``automatic``: any stage decided by
    the demonstration's actor at any time."""
    decided = effective(log).select("stage", F.coalesce(T.is_human(F.col("actor")), F.lit(False)).alias("human"))
    last = decided.agg(F.max(F.when(F.col("stage").isin(*STAGES), stage_index(F.col("stage")))).alias("last"))
    stages = log.sparkSession.createDataFrame([(s, place, s in reached) for place, s in enumerate(JUDGMENT_STAGES, 1)], "stage string, place int, reached boolean")
    asked = stages.select("stage", F.lit(True).alias("asked")) if requests is None else requests.select("stage", F.lit(True).alias("asked")).distinct()
    judged = stages.join(decided, "stage", "left").join(asked, "stage", "left").crossJoin(F.broadcast(last))
    missing = F.col("human").isNull() & (F.col("reached") | F.coalesce(F.col("last") > F.col("place"), F.lit(False)))
    fault = F.when(missing, "missing").when(~F.col("human"), "not human").when(F.col("human") & F.col("asked").isNull(), "no request")
    automatic = log.where(F.col("action").isin(*GATE_ACTIONS) & (F.col("actor") == AUTO_APPROVER)).select("stage", F.lit("automatic").alias("fault")).distinct()
    return judged.select("stage", fault.alias("fault")).where("fault IS NOT NULL").unionByName(automatic)


def human_exclusions(log: DataFrame) -> DataFrame:
    """One row: targets that people's labels under the effective decisions of the two screening stages exclude, each once a stage."""
    mine = belongs_to_effective(log).where((F.col("action") == "label") & F.col("stage").isin(*STAGES[:2]) & (F.col("to_label") == "exclude") & T.is_human(F.col("actor")) & (F.length("target") > 0))
    return mine.agg(F.countDistinct("stage", "target").alias("backed"))


def late_marks(log: DataFrame, by: list[str], tolerance: str = "INTERVAL 2 SECONDS") -> DataFrame:
    """Rows whose time lies more than the tolerance before the latest time of any earlier row. ``by`` parts the log."""
    return greatest_before(log, by, "seq", F.col("ts"), "latest_before").where(F.expr(f"latest_before - ts > {tolerance}"))


def call_gaps(calls: DataFrame, by: list[str], least: int = 20, low_ms: float = 5.0) -> DataFrame:
    """Per group: calls, median gap in ms between sorted marks, marks on a whole second, and whether either looks made up.

    The median is exact, by ranks over ranges: no group's gaps meet in one aggregate.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    # in order of time the greatest mark before a row is the one before it
    gaps = settled(greatest_before(calls.withColumn("us", micros).select(*by, "ts", "us"), by, "ts", F.col("us"), "us_before").withColumn("gap_ms", (F.col("us") - F.col("us_before")) / 1000))
    whole = micros % 1_000_000 == 0
    counts = gaps.groupBy(*by).agg(F.count("ts").alias("n_calls"), F.count_if(whole).alias("n_whole_seconds")).alias("c")
    middle = medians(gaps, by, "gap_ms", "median_gap_ms").alias("m")
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"c.{c}").eqNullSafe(F.col(f"m.{c}"))
    out = counts.join(middle, same, "left").select(*[F.col(f"c.{c}") for c in by], "n_calls", "median_gap_ms", "n_whole_seconds")
    return out.withColumns({"too_fast": F.coalesce((F.col("n_calls") >= least) & (F.col("median_gap_ms") < low_ms), F.lit(False)), "rounded": (F.col("n_calls") >= 4) & (F.col("n_whole_seconds") * 2 >= F.col("n_calls"))})


def stage_order_breaks(log: DataFrame) -> DataFrame:
    """Stages whose first decision stands before the first decision of an earlier stage."""
    firsts = log.where(F.col("action").isin(*GATE_ACTIONS)).groupBy("stage").agg(F.min("seq").alias("first_seq")).withColumn("idx", stage_index(F.col("stage")))
    return firsts.withColumn("previous", F.lag("first_seq").over(Window.orderBy("idx", "stage"))).where("first_seq < previous").select("stage", "first_seq", "previous")


def label_breaks(log: DataFrame) -> DataFrame:
    """Labels after the decision that closes them, labels under a rejection, and repeated entries: stage, target, problem, seq."""
    closers = log.where("action IN ('approve', 'reject')").groupBy("stage", "decision_sha256").agg(F.min("seq").alias("closed"), F.bool_or(F.col("action") == "reject").alias("rejected"))
    marks = log.where("action IN ('label', 'flag_review')").join(closers, ["stage", "decision_sha256"], "left")
    late = marks.where("seq > closed").select("stage", "target", F.lit("after closing").alias("problem"), "seq")
    rejected = marks.where("rejected").select("stage", "target", F.lit("with a rejection").alias("problem"), "seq")
    counted = log.withColumn("n", F.row_number().over(Window.partitionBy(*ENTRY_KEY).orderBy("seq")))
    repeated = counted.where("n > 1").select("stage", "target", F.lit("repeated").alias("problem"), "seq")
    return late.unionAll(rejected).unionAll(repeated)


def response_overlap(calls: DataFrame, least_calls: int = 10, threshold: float = 0.5) -> DataFrame:
    """Pairs of models by shared response hashes over the smaller set. An equi-join on the hash: only equal responses meet."""
    per_model = calls.groupBy("model").agg(F.count(F.lit(1)).alias("n_calls"), F.countDistinct("response_sha256").alias("n_distinct")).where(F.col("n_calls") >= least_calls)
    hashes = calls.select("model", "response_sha256").distinct().join(per_model, "model")
    # a response's models in one array: pairs come from the models of a response, never from its calls
    together = hashes.groupBy("response_sha256").agg(F.array_sort(F.collect_set("model")).alias("models"))
    pairs = together.select(F.explode(F.flatten(F.transform("models", lambda a: F.transform(F.filter("models", lambda b: b > a), lambda b: F.struct(a.alias("model_a"), b.alias("model_b"))))) ).alias("p")).select("p.*")
    shared = pairs.groupBy("model_a", "model_b").agg(F.count(F.lit(1)).alias("shared"))
    size = lambda name: per_model.select(F.col("model").alias(f"model_{name}"), F.col("n_distinct").alias(f"n_{name}"))
    ratio = F.col("shared") / F.least("n_a", "n_b")
    return shared.join(size("a"), "model_a").join(size("b"), "model_b").select("model_a", "model_b", "shared", ratio.alias("overlap"), (ratio >= threshold).alias("suspicious"))


def manifest(calls: DataFrame) -> DataFrame:
    """models_used (sorted), all_deterministic (true without calls), n_calls."""
    return calls.agg(F.array_sort(F.collect_set(F.concat_ws(":", "provider", "model"))).alias("models_used"), F.coalesce(F.bool_and("deterministic"), F.lit(True)).alias("all_deterministic"), F.count(F.lit(1)).alias("n_calls"))


def human_validated(gates: DataFrame) -> DataFrame:
    return gates.agg(F.coalesce(F.bool_and(T.is_human(F.col("actor")) & (F.col("action") != "auto-proceed")), F.lit(True)).alias("all_human"))


def run_state(run: DataFrame, gates: DataFrame, requests: DataFrame) -> DataFrame:
    """state of a run (one row with ``completed``): rejected, paused (``pending`` stage) or by its completion; the first that holds."""
    rejected = gates.where("action = 'reject'").agg(F.min_by("stage", stage_index(F.col("stage"))).alias("rejected_stage"))
    open_ = requests.join(gates.select("stage"), "stage", "left_anti").agg(F.min_by("stage", stage_index(F.col("stage"))).alias("pending"))
    joined = run.crossJoin(F.broadcast(rejected)).crossJoin(F.broadcast(open_))
    state = F.when(F.col("rejected_stage").isNotNull(), "rejected").when(F.col("pending").isNotNull(), "paused").when(F.col("completed"), "completed").otherwise("interrupted")
    return joined.select(state.alias("state"), F.coalesce("rejected_stage", "pending").alias("at_stage"))
