"""Sample and population moments in one place (Spark's built-ins are the population forms)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skew(n: Column, g1: Column) -> Column:
    """Adjusted skewness from the count and the population skewness; NULL below 3 rows."""
    n = n.cast("double")
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(n: Column, g2: Column) -> Column:
    """Adjusted excess kurtosis from the count and the population excess; NULL below 4 rows."""
    n = n.cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def skew_of(x: Column) -> Column:
    return sample_skew(F.count(x), F.skewness(x))


def kurtosis_of(x: Column) -> Column:
    return sample_kurtosis(F.count(x), F.kurtosis(x))


def adjust_skew(n: int, g1: float | None) -> float | None:
    """Driver twin of :func:`sample_skew` for statistics already collected."""
    if g1 is None or n < 3 or math.isnan(g1):
        return None
    return g1 * math.sqrt(n * (n - 1)) / (n - 2)


def adjust_kurtosis(n: int, g2: float | None) -> float | None:
    if g2 is None or n < 4 or math.isnan(g2):
        return None
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)


def clean_corr(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson correlation, NULL when a side does not vary.

    Written over covariance and deviations because ``corr`` raises on a constant column in
    ANSI mode.
    """
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(~F.isnan(r), r)
