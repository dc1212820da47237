"""Votes, labels and screening quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.functions import stats as S
from metasift.functions import text as T

NO_REASON = "criterio no especificado"


def recall_biased(label: Column) -> Column:
    """Aggregate: any include wins, then any unclear; no vote at all is unclear."""
    is_ = lambda value: F.coalesce(F.bool_or(label == value), F.lit(False))
    return F.when(is_("include"), "include").when(is_("unclear"), "unclear").when(F.coalesce(F.bool_and(label == "exclude"), F.lit(False)), "exclude").otherwise("unclear")


def ensemble(records: DataFrame, votes: DataFrame, id_col: str = "record_id") -> DataFrame:
    """id, ensemble_label, n_votes for every record, also those without votes."""
    voted = votes.groupBy(id_col).agg(recall_biased(F.col("label")).alias("ensemble_label"), F.count("label").alias("n_votes"))
    return records.select(id_col).distinct().join(voted, id_col, "left").fillna({"ensemble_label": "unclear", "n_votes": 0})


def apply_labels(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Human labels (record_id, label, reason, actor) over proposals: human_label, final_label, human_reason, human_actor."""
    human = labels.select("record_id", F.col("label").alias("human_label"), F.col("reason").alias("human_reason"), F.col("actor").alias("human_actor"))
    return decisions.drop("human_label", "human_reason", "human_actor", "final_label").join(human, "record_id", "left").withColumn("final_label", F.coalesce("human_label", "ensemble_label"))


def passes(final_label: Column) -> Column:
    """Past title and abstract."""
    return F.coalesce(final_label.isin("include", "unclear"), F.lit(False))


def effective_label() -> Column:
    return F.coalesce("final_label", "human_label", "ensemble_label")


def last_decision(decisions: DataFrame) -> DataFrame:
    """The last row of each record, in order of ``seq``."""
    others = [c for c in decisions.columns if c != "record_id"]
    return decisions.groupBy("record_id").agg(F.max_by(F.struct(*others), "seq").alias("last")).select("record_id", "last.*")


def confusion(rows: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    count = lambda c: F.count_if(c)
    return rows.groupBy(*(by or [])).agg(count(predicted & actual).alias("tp"), count(predicted & ~actual).alias("fp"), count(~predicted & actual).alias("fn"), count(~predicted & ~actual).alias("tn"))


def quality(matrix: DataFrame, fn_weight: float = 10.0) -> DataFrame:
    """Metrics of a confusion matrix; what is undefined is null."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    low, high = S.wilson(tp, tp + fn)
    return matrix.withColumns(
        {
            "n": tp + fp + fn + tn,
            "recall": S.ratio(tp, tp + fn),
            "lost_evidence": S.ratio(fn, tp + fn),
            "precision": S.ratio(tp, tp + fp),
            "mcc": S.mcc(tp, fp, fn, tn),
            "wmcc": S.mcc(tp, fp, fn, tn, fn_weight),
            "kappa": S.kappa(tp, fp, fn, tn),
            "recall_low": low,
            "recall_high": high,
        }
    )


def screening_metrics(decisions: DataFrame, gold: DataFrame, fn_weight: float = 10.0) -> DataFrame:
    """Gold (record_id, relevant) against the models' proposals; anything but exclude counts as kept. The last decision of a record counts."""
    latest = last_decision(decisions).select("record_id", "ensemble_label")
    both = gold.join(latest, "record_id")
    kept = F.coalesce(F.col("ensemble_label") != "exclude", F.lit(True))
    return quality(confusion(both, kept, F.col("relevant")), fn_weight)


def exclusion_breakdown(decisions: DataFrame) -> DataFrame:
    """total, by models, by humans, and the changes humans made either way."""
    ai, human, out = F.col("ensemble_label"), F.col("human_label"), F.coalesce(effective_label() == "exclude", F.lit(False))
    by_human = F.coalesce(human == "exclude", F.lit(False))
    return decisions.agg(
        F.count_if(out).alias("total_excluded"),
        F.count_if(out & ~by_human).alias("excluded_ai"),
        F.count_if(out & by_human).alias("excluded_human"),
        F.count_if((ai == "exclude") & (human == "include")).alias("overridden_to_include"),
        F.count_if(ai.isin("include", "unclear") & (human == "exclude")).alias("overridden_to_exclude"),
    )


def excluded_reports(decisions: DataFrame, records: DataFrame) -> DataFrame:
    """Reports excluded at full text, with reason and who gave it. ``criteria``: the criteria models found violated, in voting order."""
    known = records.select("record_id", "title", "year", "doi")
    named = F.get(F.filter(F.transform(F.coalesce("criteria", F.array().cast("array<string>")), T.strip), lambda c: F.length(c) > 0), F.lit(0))
    human = F.coalesce(F.col("human_label") == "exclude", F.lit(False))
    reason = F.when(human, T.empty_to_null(T.strip(F.col("human_reason")))).otherwise(named)
    return (
        decisions.where(effective_label() == "exclude")
        .join(known, "record_id", "left")
        .select("record_id", F.coalesce("title", F.col("record_id").cast("string")).alias("title"), "year", "doi", F.coalesce(reason, F.lit(NO_REASON)).alias("reason"), F.when(human, "human").otherwise("ai").alias("reason_source"))
    )


def required_labels(decisions: DataFrame, autonomy: str) -> DataFrame:
    """Which records a person must label before full text goes on: all under A0, else those whose text wasn't found or stayed unclear; three id lists."""
    lost = F.coalesce(F.col("fulltext_status") == "not_retrieved", F.lit(False))
    unclear = F.coalesce(F.col("ensemble_label") == "unclear", F.lit(False))
    must = F.lit(True) if autonomy == "A0" else lost | unclear
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("record_id"))))
    return decisions.agg(ids(must).alias("must_label"), ids(lost).alias("not_retrieved"), ids(unclear).alias("unclear"))


def unlabelled_ai_exclusions(decisions: DataFrame, human_labelled: DataFrame) -> DataFrame:
    """Records that models excluded and nobody has looked at."""
    return decisions.where("ensemble_label = 'exclude'").join(human_labelled.select("record_id").distinct(), "record_id", "left_anti").select("record_id")
