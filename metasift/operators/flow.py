"""Study flow: counts of each stage, their exchange formats, and the flow of an updated review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.functions import text as T
from metasift.operators import screening


def counts_map(df: DataFrame, key_col: str, name: str) -> DataFrame:
    """One row: a map of key to count."""
    per_key = df.groupBy(key_col).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(key_col).alias("key"), F.col("n").alias("value"))))
    return per_key.agg(F.map_from_entries(entries).alias(name))


def flow_counts(records: DataFrame, deduped: DataFrame, screened: DataFrame, fulltext: DataFrame, reports: DataFrame) -> DataFrame:
    """One row with every box of the flow. ``screened``/``fulltext``: decisions; ``reports``: excluded_reports' rows."""
    one = lambda df, **aggs: df.agg(*[c.alias(k) for k, c in aggs.items()])
    label = screening.effective_label()
    human = F.coalesce(F.col("human_label") == "exclude", F.lit(False))
    out = F.coalesce(label == "exclude", F.lit(False))
    lost = F.coalesce(F.col("fulltext_status") == "not_retrieved", F.lit(False))
    rows = F.count(F.lit(1))
    parts = [
        one(records, identified=rows),
        counts_map(records, "source_db", "identified_by_source"),
        one(deduped, screened=rows),
        one(screened, excluded_ta=F.count_if(out), excluded_ta_human=F.count_if(out & human), excluded_ta_ai=F.count_if(out & ~human), fulltext_sought=F.count_if(screening.passes(label))),
        one(fulltext, fulltext_not_retrieved=F.count_if(lost & F.col("human_label").isNull()), fulltext_rescued=F.count_if(lost & F.col("human_label").isNotNull()), included=F.count_if(F.coalesce(label == "include", F.lit(False)))),
        one(reports, excluded_ft=rows, excluded_ft_human=F.count_if(F.col("reason_source") == "human"), excluded_ft_ai=F.count_if(F.col("reason_source") == "ai")),
        counts_map(reports, "reason", "ft_exclusion_reasons"),
    ]
    joined = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each
    return joined.withColumns({"duplicates_removed": F.col("identified") - F.col("screened"), "fulltext_assessed": F.col("fulltext_sought") - F.col("fulltext_not_retrieved")})


def reason_counts(reports: DataFrame) -> DataFrame:
    """reason, n: most frequent first, then by reason."""
    return reports.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def listed(counts: Column) -> Column:
    """A map as ``label, n; label, n`` in order of the labels."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(T.list_label(e["key"]), F.lit(", "), e["value"].cast("string"))), "; ")


#: Fixed: data names of the flow exchange format and the counts that fill them.
FLOW_CELLS = {
    "database_results": "identified", "database_specific_results": "identified_by_source", "duplicates": "duplicates_removed",
    "records_screened": "screened", "records_excluded": "excluded_ta", "dbr_sought_reports": "fulltext_sought", "dbr_notretrieved_reports": "fulltext_not_retrieved",
    "dbr_assessed": "fulltext_assessed", "dbr_excluded": "ft_exclusion_reasons", "new_studies": "included", "new_reports": "included", "total_studies": "included", "total_reports": "included",
}
FLOW_ZEROS = (
    "register_results", "register_specific_results", "excluded_automatic", "excluded_other", "previous_studies", "previous_reports", "website_results", "organisation_results",
    "citations_results", "other_sought_reports", "other_notretrieved_reports", "other_assessed", "other_excluded",
)


def flow_cells(counts: DataFrame, meta_k: int = 0) -> DataFrame:
    """data, n (text) for the exchange format's cells."""
    is_map = dict(counts.dtypes)
    value = lambda c: F.coalesce(T.empty_to_null(listed(F.col(c))), F.lit("0")) if is_map[c].startswith("map") else F.col(c).cast("string")
    cells = [F.struct(F.lit(data).alias("data"), value(c).alias("n")) for data, c in FLOW_CELLS.items()]
    cells += [F.struct(F.lit(data).alias("data"), F.lit("0").alias("n")) for data in FLOW_ZEROS]
    cells += [F.struct(F.lit(data).alias("data"), F.lit(str(meta_k)).alias("n")) for data in ("total_studies_ma", "total_reports_ma")]
    return counts.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def fill_template(template: DataFrame, cells: DataFrame) -> DataFrame:
    """Template rows with ``n`` replaced where ``data`` names a cell."""
    new = cells.select(F.col("data").alias("cell_data"), F.col("n").alias("cell_n"))
    return template.join(F.broadcast(new), F.col("data") == F.col("cell_data"), "left").withColumn("n", F.coalesce("cell_n", F.col("n").cast("string"))).drop("cell_data", "cell_n")


def flow_rows(counts: DataFrame) -> DataFrame:
    """The counts as rows (item, n), in the order of the columns."""
    plain = [c for c, kind in counts.dtypes if not kind.startswith("map")]
    return counts.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("long").alias("n")) for c in plain])).alias("pos", "cell")).select("pos", "cell.*")


def living_delta(previous: DataFrame, current: DataFrame, id_col: str = "record_id") -> DataFrame:
    """id, change: ``new`` or ``dropped`` since the previous run."""
    a, b = previous.select(id_col).distinct(), current.select(id_col).distinct()
    return b.join(a, id_col, "left_anti").withColumn("change", F.lit("new")).unionAll(a.join(b, id_col, "left_anti").withColumn("change", F.lit("dropped")))


def updated_flow(previous: DataFrame, current: DataFrame, id_col: str = "record_id") -> DataFrame:
    """previous, dropped, new, total = previous - dropped + new."""
    changes = living_delta(previous, current, id_col).agg(F.count_if(F.col("change") == "new").alias("new_included"), F.count_if(F.col("change") == "dropped").alias("dropped"))
    before = previous.select(id_col).distinct().agg(F.count(F.lit(1)).alias("previous_included"))
    return before.crossJoin(F.broadcast(changes)).withColumn("total_included", F.col("previous_included") - F.col("dropped") + F.col("new_included"))
