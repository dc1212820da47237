"""The index of past reviews as a kept view: a batch of new events adds what it changes, nothing is built anew.

A batch writes a row for each review that it has events of: their number, the first and the last of them. Such rows add up
in any order, so the index is their sum, whatever way the events were split into batches. They are written under the batch's
number, so a batch that is replayed after a failure replaces its own.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PART = "slug string, n_runs long, first_seq long, last_seq long, last_ts timestamp, last_included array<string>, batch long"


def part(events: DataFrame) -> DataFrame:
    """What ``events`` (slug, seq, ts, included_ids) add to the index; a null slug is a review like any other, rows with a null seq count only."""
    last = F.max_by(F.struct(F.col("ts").cast("timestamp").alias("ts"), "included_ids"), "seq")
    found = events.groupBy("slug").agg(F.count(F.lit(1)).alias("n_runs"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), last.alias("last"))
    return found.select("slug", "n_runs", "first_seq", "last_seq", F.col("last.ts").alias("last_ts"), F.col("last.included_ids").alias("last_included"))


def merged(parts: DataFrame) -> DataFrame:
    """slug, n_runs, last_ts, last_included and first_seq, as ``history.recall`` gives them of all events."""
    last = F.max_by(F.struct("last_ts", "last_included"), "last_seq")
    found = parts.groupBy("slug").agg(F.sum("n_runs").alias("n_runs"), last.alias("last"), F.min("first_seq").alias("first_seq"))
    return found.select("slug", "n_runs", F.col("last.last_ts").alias("last_ts"), F.col("last.last_included").alias("last_included"), "first_seq")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index; an empty one where no batch was written."""
    try:
        return merged(spark.read.schema(PART).parquet(path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return merged(spark.createDataFrame([], PART))


def keep_index(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """``events``, a stream, into the index at ``path``, over what is there now."""

    def write(batch: DataFrame, number: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
