"""A budget shared fairly: everybody gets what they need up to an equal share, and what the small leave goes to the large."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metasift.operators.ordered import earlier, in_ranges


def fair_shares(df: DataFrame, id_col: str, need_col: str, total: int) -> DataFrame:
    """id, need and share, whole numbers that add up to ``total``, or to all needs where they're less.

    In order of need, then id, each may take an equal part of what is left. Those whose need is below it get their need; from
    the first who needs more on, all get the same, but for the remainder, one each for the last. So no loop is needed: a row's rank and
    the needs before it, from ranges of the order, tell which it is. A null or negative need is none; equal rows, however many,
    fall to several ranges; ids that repeat share each.
    """
    need = F.greatest(F.coalesce(F.col(need_col), F.lit(0)), F.lit(0)).cast("long")
    ranged = in_ranges(df.select(F.col(id_col).alias("id"), need.alias("need"), F.monotonically_increasing_id().alias("row")), "need", "id", "row")
    sums = ranged.groupBy("range_no").agg(F.count(F.lit(1)).alias("n_range"), F.sum("need").alias("need_range"))
    everything = Window.partitionBy(F.lit(1))
    before = sums.select("range_no", F.coalesce(F.sum("n_range").over(earlier([])), F.lit(0)).alias("n_before"), F.coalesce(F.sum("need_range").over(earlier([])), F.lit(0)).alias("need_before"), F.sum("n_range").over(everything).alias("n"))
    own = Window.partitionBy("range_no").orderBy("need", "id", "row")
    placed = ranged.join(before, "range_no").select(
        "id", "need", "n", (F.row_number().over(own) - 1 + F.col("n_before")).alias("rank"), (F.coalesce(F.sum("need").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("need_before")).alias("taken")
    )
    # once a row needs more than its part all later ones do, as they need no less
    left = F.lit(max(total, 0)) - F.col("taken")
    over = placed.where(F.col("need") * (F.col("n") - F.col("rank")) > left).agg(F.min_by(F.struct("rank", "taken"), "rank").alias("first"))
    met = placed.crossJoin(over)
    k = F.col("n") - F.col("first.rank")
    rest = F.lit(max(total, 0)) - F.col("first.taken")
    part = (rest - rest % k) / k + F.when(F.col("rank") >= F.col("n") - rest % k, 1).otherwise(0)
    share = F.when(F.col("first").isNull() | (F.col("rank") < F.col("first.rank")), F.col("need")).otherwise(part)
    return met.select(F.col("id").alias(id_col), "need", share.cast("long").alias("share"))
