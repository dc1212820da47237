"""Journalled computation: each (record_id, input) is computed once, in batch or over an append-only stream of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ["record_id", "input_sha256"]
#: Fixed: reasons of a failed retrieval that say nothing about the text; they aren't kept, so the next run tries again.
TRANSIENT = ("error_http", "sin_httpx")


def keyed(requests: DataFrame, *inputs: Column) -> DataFrame:
    """``input_sha256`` of the inputs, as a JSON array with nulls kept."""
    return requests.withColumn("input_sha256", F.sha2(F.to_json(F.array(*[c.cast("string") for c in inputs]), {"ignoreNullFields": "false"}), 256))


def pending(requests: DataFrame, journal: DataFrame) -> DataFrame:
    """Requests that the journal hasn't answered, each key once."""
    return requests.dropDuplicates(KEY).join(journal.select(*KEY).distinct(), KEY, "left_anti")


def conflicts(journal: DataFrame) -> DataFrame:
    """Keys that were answered in different ways: an error, so they are never merely deduplicated."""
    return journal.groupBy(*KEY).agg(F.countDistinct(F.sha2("output", 256)).alias("n_outputs")).where("n_outputs > 1")


def answered(journal: DataFrame) -> DataFrame:
    """The first answer of each key, in order of ``seq``."""
    return journal.groupBy(*KEY).agg(F.min_by("output", "seq").alias("output"), F.min("seq").alias("seq"))


def lookup(requests: DataFrame, journal: DataFrame) -> DataFrame:
    return requests.join(answered(journal).select(*KEY, "output"), KEY, "left")


def lasting(outcomes: DataFrame) -> DataFrame:
    """Outcomes to keep: all but transient failures."""
    return outcomes.where(~F.coalesce(F.col("reason").isin(*TRANSIENT), F.lit(False)))


def run_batch(requests: DataFrame, journal: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """New journal rows: ``compute`` adds ``output`` to what is pending."""
    return compute(pending(requests, journal))


def run_stream(spark: SparkSession, requests: DataFrame, journal_path: str, checkpoint: str, compute: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """A stream of requests against a journal folder. Each micro-batch is written under its number, so a batch that is replayed
    after a failure replaces its own rows and answers nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        known = read_journal(spark, journal_path).where(F.col("batch") != number)
        new = run_batch(batch, known, compute).select(*KEY, "output", "seq")
        new.write.mode("overwrite").parquet(f"{journal_path}/batch={number}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_journal(spark: SparkSession, journal_path: str) -> DataFrame:
    """Journal rows with their batch; without any, an empty table."""
    schema = "record_id string, input_sha256 string, output string, seq long, batch long"
    try:
        return spark.read.schema(schema).parquet(journal_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def cached_texts(outcomes: DataFrame, texts: DataFrame) -> DataFrame:
    """Outcomes with their text where the kept file still has the recorded hash; others have null."""
    good = texts.withColumn("actual", F.sha2("text", 256)).select("text_file", "text", "actual")
    return outcomes.join(good, "text_file", "left").withColumn("text", F.when(F.col("actual") == F.col("text_sha256"), F.col("text"))).drop("actual")
