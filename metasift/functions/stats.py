"""Ratios, agreement and effect sizes as Column expressions. What is undefined is null, never zero."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column) -> Column:
    return c.cast("double")


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(_d(num), _d(den))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column, fn_weight: float = 1.0) -> Column:
    """Matthews correlation; with ``fn_weight`` a lost positive counts more. Doubles throughout: products of counts overflow a long."""
    tp, fp, fn, tn = _d(tp), _d(fp), _d(fn) * fn_weight, _d(tn)
    return F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def kappa(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Cohen's kappa; null without rows or where chance agrees fully."""
    tp, fp, fn, tn = _d(tp), _d(fp), _d(fn), _d(tn)
    n = tp + fp + fn + tn
    agreed = F.try_divide(tp + tn, n)
    chance = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return F.try_divide(agreed - chance, 1 - chance)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval, inside [0, 1]; null without trials."""
    k, n = _d(k), F.when(n > 0, _d(n))
    p, z2 = k / n, z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    # greatest and least pass over nulls
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


def least_positives(target: Column) -> Column:
    """Positives needed before a recall of ``target`` can be told from 1; null unless it lies inside (0, 1)."""
    return F.when((target > 0) & (target < 1), F.ceil(F.round(1 / (1 - target), 9)))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def is_correlation(x: Column) -> Column:
    return x.between(-1 - 1e-9, 1 + 1e-9)


def close(a: Column, b: Column, rel: float = 1e-9, abs_: float = 1e-9) -> Column:
    """Equal within tolerance; two nulls are equal."""
    near = F.abs(a - b) <= F.greatest(F.lit(abs_), rel * F.greatest(F.abs(a), F.abs(b)))
    return (a.isNull() & b.isNull()) | F.coalesce(near, F.lit(False))


def _steps(first: int, last: Column) -> Column:
    """first, first + 1, ... up to ``last``; nothing where that is less."""
    return F.when(last >= first, F.sequence(F.lit(first), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def _series(first: Column, steps: Column, ratio_: Callable[[Column], Column]) -> Column:
    """first * (1 + r(k) + r(k) r(k+1) + ...) over ``steps``."""
    state = lambda term, total: F.struct(term.alias("term"), total.alias("total"))
    return F.aggregate(steps, state(first, first), lambda s, k: state(s["term"] * ratio_(k), s["total"] + s["term"] * ratio_(k)), lambda s: s["total"])


def erfc(x: Column) -> Column:
    """The complementary error function of ``x >= 0``: a power series near zero, a continued fraction beyond 2.5; about 12 digits."""
    x = _d(x)
    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * _series(x, F.sequence(F.lit(1), F.lit(60)), lambda k: 2 * x * x / (2 * k + 1))
    below = F.aggregate(F.sequence(F.lit(60), F.lit(1)), x, lambda s, k: x + k / 2 / s)
    return F.when(x < 2.5, near).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / below)


def normal_two_sided(z: Column) -> Column:
    """Both tails of the standard normal distribution."""
    return erfc(F.abs(_d(z)) / math.sqrt(2))


def student_two_sided(t: Column, df: Column) -> Column:
    """Both tails of Student's t for a whole number of degrees of freedom (a finite sum); null below one."""
    t, df = F.abs(_d(t)), df.cast("int")
    angle, c = F.atan(t / F.sqrt(_d(df))), df / (df + t * t)
    s, even = F.sqrt(1 - c), df % 2 == 0
    of_even = s * _series(F.lit(1.0), _steps(1, df / 2 - 1), lambda j: (2 * j - 1) / (2 * j) * c)
    of_odd = 2 / math.pi * (angle + F.when(df > 1, s * F.sqrt(c) * _series(F.lit(1.0), _steps(1, (df - 3) / 2), lambda j: 2 * j / (2 * j + 1) * c)).otherwise(0.0))
    return F.when(df >= 1, F.greatest(F.lit(0.0), 1 - F.when(even, of_even).otherwise(of_odd)))


def chi2_tail(x: Column, df: Column) -> Column:
    """Upper tail of chi-square for a whole number of degrees of freedom (a finite sum); null below one."""
    half, df = F.greatest(F.lit(0.0), _d(x) / 2), df.cast("int")
    of_even = _series(F.exp(-half), _steps(1, df / 2 - 1), lambda i: half / i)
    of_odd = erfc(F.sqrt(half)) + F.when(df > 1, _series(F.exp(-half) * F.sqrt(half) * 2 / math.sqrt(math.pi), _steps(2, (df - 1) / 2), lambda i: half / (i - 0.5))).otherwise(0.0)
    return F.when(df >= 1, F.least(F.lit(1.0), F.when(df % 2 == 0, of_even).otherwise(of_odd)))
