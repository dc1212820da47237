"""Effect sizes and inverse-variance pooling, for many reviews at once: ``by`` names the columns of a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metasift.functions.stats import chi2_tail, expit, normal_two_sided, student_two_sided

Z95 = 1.96


def log_odds_ratio(effects: DataFrame) -> DataFrame:
    """yi, vi from e1 of n1 against e0 of n0; one half is added to all four cells if any is empty."""
    cells = {"a": F.col("e1"), "b": F.col("n1") - F.col("e1"), "c": F.col("e0"), "d": F.col("n0") - F.col("e0")}
    half = F.when(F.least(*cells.values()) == 0, 0.5).otherwise(0.0)
    a, b, c, d = (x.cast("double") + half for x in cells.values())
    return effects.withColumns({"yi": F.ln(a * d / (b * c)), "vi": 1 / a + 1 / b + 1 / c + 1 / d})


def mean_difference(effects: DataFrame) -> DataFrame:
    return effects.withColumns({"yi": F.col("m1") - F.col("m0"), "vi": F.col("sd1") * F.col("sd1") / F.col("cn1") + F.col("sd0") * F.col("sd0") / F.col("cn0")})


def hedges_g(effects: DataFrame) -> DataFrame:
    """Standardised mean difference with the small-sample correction."""
    n1, n0 = F.col("cn1").cast("double"), F.col("cn0").cast("double")
    n = n1 + n0
    pooled = F.sqrt(((n1 - 1) * F.col("sd1") * F.col("sd1") + (n0 - 1) * F.col("sd0") * F.col("sd0")) / (n - 2))
    g = (F.col("m1") - F.col("m0")) / pooled * (1 - 3 / (4 * n - 9))
    return effects.withColumn("yi", g).withColumn("vi", n / (n1 * n0) + F.col("yi") * F.col("yi") / (2 * n))


def precomputed(effects: DataFrame) -> DataFrame:
    return effects


MEASURES = {"logOR": log_odds_ratio, "MD": mean_difference, "SMD": hedges_g, "precomputed": precomputed}


def effect_sizes(effects: DataFrame, measure: str) -> DataFrame:
    """yi and vi; rows where either can't be computed, or the variance isn't positive, are an error when read."""
    sized = MEASURES[measure](effects)
    bad = F.col("yi").isNull() | F.col("vi").isNull() | ~(F.col("vi") > 0)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no usable effect: "), F.col("study_id"))).cast("double")).otherwise(F.col("vi"))
    return sized.withColumn("vi", checked)


def _sums(rows: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.sum(c).alias(name) for name, c in sums.items()])


def _with(rows: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    """Study rows with their review's sums. One review: a broadcast of its single row."""
    if not by:
        return rows.crossJoin(F.broadcast(summary))
    return rows.join(summary, by)


def heterogeneity(effects: DataFrame, by: list[str]) -> DataFrame:
    """k, mean_fixed, sw, q, df, tau2 (DerSimonian-Laird), i2. Q is summed round the mean in a second pass, which doesn't cancel."""
    w = 1 / F.col("vi")
    first = effects.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("sw"), F.sum(w * F.col("yi")).alias("swy"), F.sum(w * w).alias("sww")).withColumn("mean_fixed", F.col("swy") / F.col("sw"))
    gaps = _with(effects.select(*by, "yi", "vi"), first, by)
    q = gaps.groupBy(*by).agg(F.sum((F.col("yi") - F.col("mean_fixed")) * (F.col("yi") - F.col("mean_fixed")) / F.col("vi")).alias("q"))
    joined = first.join(q, by) if by else first.crossJoin(F.broadcast(q))
    df, c = F.col("k") - 1, F.col("sw") - F.col("sww") / F.col("sw")
    tau2 = F.when(c > 0, F.greatest(F.lit(0.0), (F.col("q") - df) / c)).otherwise(0.0)
    i2 = F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - df) / F.col("q")) * 100).otherwise(0.0)
    return joined.select(*by, "k", "sw", "mean_fixed", "q", df.alias("df"), tau2.alias("tau2"), i2.alias("i2"))


def study_rows(effects: DataFrame, by: list[str]) -> DataFrame:
    """One row for each study: se, interval, and weights under both models in percent."""
    review = heterogeneity(effects, by)
    rows = _with(effects.select(*by, "study_id", "yi", "vi"), review, by).withColumn("w_random", 1 / (F.col("vi") + F.col("tau2")))
    whole = _sums(rows, by, sw_random=F.col("w_random"))
    se = F.sqrt("vi")
    return _with(rows, whole, by).select(
        *by, "study_id", "yi", "vi", se.alias("se"), (F.col("yi") - Z95 * se).alias("ci_low"), (F.col("yi") + Z95 * se).alias("ci_high"),
        (100 / F.col("vi") / F.col("sw")).alias("weight_fixed"), (100 * F.col("w_random") / F.col("sw_random")).alias("weight_random"),
    )


def pooled(effects: DataFrame, by: list[str], p_values: bool = False) -> DataFrame:
    """Both models for each review: estimate, se, interval, z; reviews of one study are left out. ``p_values`` adds two-sided normal p and the chi-square tail of Q."""
    review = heterogeneity(effects, by).where("k >= 2")
    rows = _with(effects.select(*by, "yi", "vi"), review.select(*by, "tau2"), by)
    models = rows.select(*by, F.explode(F.array(F.struct(F.lit("fixed").alias("model"), (1 / F.col("vi")).alias("w")), F.struct(F.lit("random").alias("model"), (1 / (F.col("vi") + F.col("tau2"))).alias("w")))).alias("m"), "yi")
    sums = models.groupBy(*by, F.col("m.model").alias("model")).agg(F.sum("m.w").alias("sw"), F.sum(F.col("m.w") * F.col("yi")).alias("swy"))
    est, se = F.col("swy") / F.col("sw"), F.sqrt(1 / F.col("sw"))
    out = sums.select(*by, "model", est.alias("estimate"), se.alias("se"), (est - Z95 * se).alias("ci_low"), (est + Z95 * se).alias("ci_high"), (est / se).alias("z"))
    out = _with(out, review.select(*by, "k", "q", "df", "tau2", "i2"), by)
    return out.withColumns({"p_value": normal_two_sided(F.col("z")), "q_p_value": chi2_tail(F.col("q"), F.col("df"))}) if p_values else out


def egger(effects: DataFrame, by: list[str], p_values: bool = False) -> DataFrame:
    """Regression of the standardised effect on precision: intercept, se, t; reviews of fewer than three studies, or of equal precision, are left out. ``p_values`` adds Student's two-sided p with k - 2 degrees of freedom."""
    points = effects.select(*by, (1 / F.sqrt("vi")).alias("x"), (F.col("yi") / F.sqrt("vi")).alias("y"))
    means = points.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    centred = _with(points, means, by).withColumns({"dx": F.col("x") - F.col("mx"), "dy": F.col("y") - F.col("my")})
    lines = centred.groupBy(*by).agg(F.first("k").alias("k"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.sum(F.col("dx") * F.col("dx")).alias("sxx"), F.sum(F.col("dx") * F.col("dy")).alias("sxy")).where("k >= 3 AND sxx > 0")
    lines = lines.withColumn("slope", F.col("sxy") / F.col("sxx")).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    gap = F.col("y") - (F.col("intercept") + F.col("slope") * F.col("x"))
    left = _with(points, lines, by).groupBy(*by).agg(F.first("k").alias("k"), F.first("mx").alias("mx"), F.first("sxx").alias("sxx"), F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.sum(gap * gap).alias("ss"))
    se = F.sqrt(F.col("ss") / (F.col("k") - 2) * (1 / F.col("k") + F.col("mx") * F.col("mx") / F.col("sxx")))
    out = left.select(*by, "k", "intercept", "slope", se.alias("se"), F.when(se > 0, F.col("intercept") / se).otherwise(0.0).alias("t"))
    return out.withColumn("p_value", student_two_sided(F.col("t"), F.col("k") - 2)) if p_values else out


def forest(studies: DataFrame, display: str = "raw") -> DataFrame:
    """Study rows as a forest table shows them; ``proportion`` turns log odds into proportions."""
    if display == "raw":
        return studies
    return studies.withColumns({c: expit(F.col(c)) for c in ("yi", "ci_low", "ci_high")})
