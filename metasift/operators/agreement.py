"""Double extraction: the sample, and how far two extractors agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasift.functions import stats as S
from metasift.functions import text as T
from metasift.operators.ordered import positions


def systematic_sample(df: DataFrame, order_col: str, fraction: float = 0.2) -> DataFrame:
    """Every (n/k)-th row in order, k = at least one and the fraction rounded up. The step is a double, so position i is int(i * (n / k))."""
    placed = positions(df, order_col)
    k = F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.col("n")).cast("long"))
    step = F.col("n").cast("double") / k
    # the drawing that could fall on this position, and its neighbours against rounding
    near = F.floor(F.col("pos") / step).cast("long")
    drawn = lambda i: (i >= 0) & (i < k) & (F.least(F.col("n") - 1, (i * step).cast("long")) == F.col("pos"))
    return placed.where((k >= F.col("n")) | drawn(near) | drawn(near + 1) | drawn(near - 1)).drop("n")


def agreement(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Two long tables (study_id, key, value) over their common studies: studies, field pairs, matches, shares, kappa of presence."""
    common = primary.select("study_id").distinct().join(secondary.select("study_id").distinct(), "study_id")
    side = lambda df, name: df.join(common, "study_id", "left_semi").select("study_id", "key", T.compared_value(F.col("value")).alias(name))
    pairs = side(primary, "a").join(side(secondary, "b"), ["study_id", "key"], "full_outer")
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    counts = pairs.agg(
        F.countDistinct("study_id").alias("n_studies"),
        F.count(F.lit(1)).alias("n_field_pairs"),
        F.count_if(F.col("a") == F.col("b")).alias("n_value_match"),
        F.count_if(a & b).alias("tp"), F.count_if(a & ~b).alias("fp"), F.count_if(~a & b).alias("fn"), F.count_if(~a & ~b).alias("tn"),
    )
    return counts.select("n_studies", "n_field_pairs", "n_value_match", S.ratio(F.col("n_value_match"), F.col("n_field_pairs")).alias("value_agreement"), S.kappa(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))).alias("presence_kappa"))
