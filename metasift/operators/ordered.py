"""Whole-table order without a task that holds the whole table.

Rows are dealt to ranges of the order and kept there, so every later step sees the same ranges. What a row needs from the
rows before it is then its own range's part, by a window, and a summary of the earlier ranges, which are few.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _checkpoints(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and Spark runs in this process alone, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can read and write")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="metasift-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """The path of a new folder that every executor sees; all of an application's lie in its own."""
    return f"{_checkpoints(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, where a lost executor can't take it along."""
    _checkpoints(df.sparkSession)
    return df.checkpoint()


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``range_no``; a range's rows come before those of the next. Ranges are drawn from a sample, so they must be settled."""
    return settled(df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()))


def earlier(by: list[str]) -> Window:
    return Window.partitionBy(*(by or [F.lit(1)])).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)


def positions(df: DataFrame, order_col: str) -> DataFrame:
    """``pos`` from 0 in order, and ``n``, the number of rows."""
    ranged = in_ranges(df, order_col)
    sizes = ranged.groupBy("range_no").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.select("range_no", F.coalesce(F.sum("size").over(earlier([])), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy(F.lit(1))).alias("n"))
    inside = ranged.withColumn("inner", F.row_number().over(Window.partitionBy("range_no").orderBy(order_col)) - 1)
    return inside.join(sizes, "range_no").withColumn("pos", F.col("inner") + F.col("before")).drop("inner", "before", "range_no")


def greatest_before(df: DataFrame, by: list[str], order_col: str, value: Column, name: str) -> DataFrame:
    """``name``: the greatest value of any earlier row of the same group; null for a group's first row."""
    ranged = in_ranges(df.withColumn("value_", value), *by, order_col)
    tops = ranged.groupBy("range_no", *by).agg(F.max("value_").alias("top"))
    tops = tops.select("range_no", *by, F.max("top").over(earlier(by)).alias("before_"))
    own = Window.partitionBy("range_no", *by).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("r.range_no") == F.col("t.range_no")
    for c in by:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
    joined = ranged.withColumn("inside_", F.max("value_").over(own)).alias("r").join(tops.alias("t"), same, "left")
    return joined.select("r.*", F.greatest("r.inside_", "t.before_").alias(name)).drop("range_no", "value_", "inside_")


def summed_before(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all earlier rows of the same group, 0 for its first; a group may fill any number of ranges."""
    ranged = in_ranges(df.withColumn("value_", value), *by, *order)
    sums = ranged.groupBy("range_no", *by).agg(F.sum("value_").alias("in_range_"))
    sums = sums.select("range_no", *by, F.coalesce(F.sum("in_range_").over(earlier(by)), F.lit(0)).alias("before_"))
    own = Window.partitionBy("range_no", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("r.range_no") == F.col("t.range_no")
    for c in by:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
    joined = ranged.withColumn("inside_", F.coalesce(F.sum("value_").over(own), F.lit(0))).alias("r").join(sums.alias("t"), same)
    return joined.select("r.*", (F.col("r.inside_") + F.col("t.before_")).alias(name)).drop("range_no", "value_", "inside_")


def medians(df: DataFrame, by: list[str], value_col: str, name: str) -> DataFrame:
    """``by`` and ``name``: the exact median of each group's values, the mean of the two in the middle; groups without a value have no row.

    Equal values are counted before they meet, and the different ones are dealt to ranges, so neither a value nor a group that
    fills the table falls to one task. Which values stand in the middle follows from the counts before them.
    """
    counted = df.where(F.col(value_col).isNotNull()).groupBy(*by, value_col).agg(F.count(F.lit(1)).alias("times_"))
    ranged = in_ranges(counted, *by, value_col)
    sums = ranged.groupBy("range_no", *by).agg(F.sum("times_").alias("in_range_"))
    whole = Window.partitionBy(*(by or [F.lit(1)]))
    sums = sums.select("range_no", *by, F.coalesce(F.sum("in_range_").over(earlier(by)), F.lit(0)).alias("before_"), F.sum("in_range_").over(whole).alias("n_"))
    own = Window.partitionBy("range_no", *by).orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("r.range_no") == F.col("t.range_no")
    for c in by:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
    placed = ranged.withColumn("inside_", F.coalesce(F.sum("times_").over(own), F.lit(0))).alias("r").join(sums.alias("t"), same).select("r.*", "t.before_", "t.n_")
    at = F.col("before_") + F.col("inside_")
    holds = lambda rank: F.when((at <= rank) & (rank < at + F.col("times_")), F.col(value_col))
    low, high = holds(F.floor((F.col("n_") - 1) / 2)), holds(F.floor(F.col("n_") / 2))
    return placed.groupBy(*by).agg(((F.max(low) + F.max(high)) / 2).alias(name)).where(F.col(name).isNotNull())
