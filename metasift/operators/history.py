"""Memory of past reviews: an append-only event table (slug, seq, ts, included_ids)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(events: DataFrame) -> DataFrame:
    """slug, n_runs, last_ts, last_included, first_seq: one row for each review."""
    return events.groupBy("slug").agg(F.count(F.lit(1)).alias("n_runs"), F.max_by("ts", "seq").alias("last_ts"), F.max_by("included_ids", "seq").alias("last_included"), F.min("seq").alias("first_seq"))


def new_runs(events: DataFrame, arriving: DataFrame) -> DataFrame:
    """Arriving runs (slug, ts) that memory doesn't have yet."""
    return arriving.join(events.select("slug", "ts").distinct(), ["slug", "ts"], "left_anti")


def with_delta(events: DataFrame, arriving: DataFrame) -> DataFrame:
    """Arriving runs with ``included_new`` and ``included_dropped`` against the last run of their slug."""
    last = recall(events).select("slug", F.col("last_included").alias("before"))
    joined = new_runs(events, arriving).join(last, "slug", "left")
    none = F.array().cast("array<string>")
    before = F.coalesce("before", none)
    return joined.withColumns({"included_new": F.array_sort(F.array_except("included_ids", before)), "included_dropped": F.array_sort(F.array_except(before, "included_ids"))}).drop("before")
