"""Shapiro-Wilk test over all rows: runs of equal values weighted where they lie, one aggregate at the end."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.normal import normal_quantiles, polynomial
from millrace.plans.frames import col, small_frame, stats_row
from millrace.plans.prefix import running_totals

#: Places of one value that are weighted one by one; longer runs have a closed form.
RUN = 16
#: Outermost places on each side, always weighted one by one: the closed form is a series that needs smooth weights.
EDGE = 2_000
SCHEMA = "column string, n bigint, statistic double, p_value double, is_normal boolean"

# Royston's fixed values: corrections of the two outermost weights, then mean and deviation of the transformed statistic.
OUTER = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_GAMMA = (-2.273, 0.459)
SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
SMALL_DEVIATION = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_DEVIATION = (-0.4803, -0.082676, 0.0030302)


def run_weights(low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of the weights of the places ``low`` to ``high`` of ``n``, for each run.

    Short runs and the EDGE outermost places are weighted one by one. In between the sum is Euler and Maclaurin's: the integral of the
    quantile is minus the density, the next terms are its first and third derivative at the borders.
    """
    size = n + 0.25
    left, right = np.maximum(low, EDGE + 1), np.minimum(high, n - EDGE)
    closed = (high - low >= RUN) & (left <= right)

    def upto(place: np.ndarray) -> np.ndarray:
        z = normal_quantiles((place - 0.375) / size[closed])
        density = np.exp(-z * z / 2.0) / math.sqrt(2 * math.pi)
        step = 1.0 / (density * size[closed])
        return -size[closed] * density - step / 24.0 + 7.0 / 5760.0 * (2 * z * z + 1) * step**3

    out = np.zeros(len(low))
    out[closed] = upto(right[closed] + 0.5) - upto(left[closed] - 0.5)
    run = np.arange(len(low))
    owner = np.concatenate([run[~closed], run[closed], run[closed]])
    first = np.concatenate([low[~closed], low[closed], right[closed] + 1])
    last = np.concatenate([high[~closed], left[closed] - 1, high[closed]])
    held = np.maximum(last - first + 1, 0)
    place = np.repeat(first - (np.cumsum(held) - held), held) + np.arange(int(held.sum()))
    owner = np.repeat(owner, held)
    return out + np.bincount(owner, normal_quantiles((place - 0.375) / size[owner]), len(low))


def _squares(n: int) -> float:
    """Sum of the squared weights of all places: the outer ones in turn, those between by Euler and Maclaurin."""
    normal, size = NormalDist(), n + 0.25
    edge = min(EDGE, n // 2)
    outer = 2 * math.fsum(normal.inv_cdf((i - 0.375) / size) ** 2 for i in range(1, edge + 1))
    if n - 2 * edge <= 2 * EDGE:
        return outer + math.fsum(normal.inv_cdf((i - 0.375) / size) ** 2 for i in range(edge + 1, n - edge + 1))

    def upto(place: float) -> float:
        p = (place - 0.375) / size
        z = normal.inv_cdf(p)
        density = normal.pdf(z)
        step = 1.0 / (density * size)
        # first and third derivative of z^2 by the place, where z changes by step and step by z * step^2
        return size * (p - z * density) - 2 * z * step / 24.0 + 7.0 / 5760.0 * (8 * z + 4 * z * z * z) * step**3

    return outer + upto(n - edge + 0.5) - upto(edge + 0.5)


def _weighted_sum(df: DataFrame, column: str, centre: float) -> dict:
    """Sums over the order statistics, with m the normal quantile of a place: m * x, m * m, the two least and greatest x.

    Values are counted first, so a value that a third of the rows holds is one row. Its run of places is weighted place by place where
    it is short or among the outermost EDGE places, else by the sum's closed form: the work grows with the distinct values.
    """
    values = df.select((col(column).cast("double") - F.lit(centre)).alias("x"), F.lit(1).cast("long").alias("n")).where("x IS NOT NULL AND NOT isnan(x)")
    runs = running_totals(values, "x", ["n"]).select("x", (F.col("cum_n") - F.col("n") + 1).alias("low"), F.col("cum_n").alias("high"), F.col("all_n").alias("all"))

    @F.pandas_udf("double")
    def weight(low: pd.Series, high: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(run_weights(low.to_numpy(), high.to_numpy(), n.to_numpy()))

    at = lambda i: F.max(F.when((F.col("low") <= i) & (i <= F.col("high")), F.col("x")))
    found = stats_row(
        runs.withColumn("m", weight("low", "high", "all")),
        {"mx": F.sum(F.col("m") * F.col("x")), "n": F.max("all"),
         "first": at(F.lit(1)), "second": at(F.lit(2)), "last": at(F.col("all")), "last_but_one": at(F.col("all") - 1)},
    )
    return {**found, "mm": _squares(found["n"])}


def w_statistic(n: int, mx: float, mm: float, outer: float, second: float, squares: float) -> float:
    """W from sum(m * x), sum(m * m), the spreads x(n) - x(1) and x(n-1) - x(2), and the sum of squared deviations."""
    if n == 3:
        return min(1.0, (math.sqrt(0.5) * outer) ** 2 / squares)
    u = 1.0 / math.sqrt(n)
    m_outer = NormalDist().inv_cdf((n - 0.375) / (n + 0.25))
    m_second = NormalDist().inv_cdf((n - 1.375) / (n + 0.25))
    a_outer = m_outer / math.sqrt(mm) + polynomial(OUTER, u)
    if n <= 5:
        phi = (mm - 2 * m_outer**2) / (1 - 2 * a_outer**2)
        total = (mx - m_outer * outer) / math.sqrt(phi) + a_outer * outer
    else:
        a_second = m_second / math.sqrt(mm) + polynomial(SECOND, u)
        phi = (mm - 2 * m_outer**2 - 2 * m_second**2) / (1 - 2 * a_outer**2 - 2 * a_second**2)
        total = (mx - m_outer * outer - m_second * second) / math.sqrt(phi) + a_outer * outer + a_second * second
    return min(1.0, total * total / squares)


def w_p_value(n: int, w: float) -> float:
    """Chance of a W this small from normal values."""
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1.0:
        return 1.0
    y = math.log(1.0 - w)
    if n <= 11:
        gamma = polynomial(SMALL_GAMMA, n)
        if y >= gamma:
            return 0.0
        y, mean, deviation = -math.log(gamma - y), polynomial(SMALL_MEAN, n), math.exp(polynomial(SMALL_DEVIATION, n))
    else:
        size = math.log(n)
        mean, deviation = polynomial(LARGE_MEAN, size), math.exp(polynomial(LARGE_DEVIATION, size))
    return 0.5 * math.erfc((y - mean) / deviation / math.sqrt(2))


def shapiro_wilk(df: DataFrame, cols: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """(column, n, statistic, p_value, is_normal) of each column over all its values; missing ones take no part.

    Below three values, for constant columns and those with infinite values, statistic and p-value are null and the
    column is not called normal. Royston fitted the p-value up to 5 000 rows; beyond, the same curve is continued,
    which for tables of millions calls almost any rounding a departure, while W itself stays exact to its weights.
    """
    valid = {c: F.when(~F.isnan(col(c).cast("double")), col(c).cast("double")) for c in cols}
    exprs = {}
    for c, x in valid.items():
        exprs.update({(c, "n"): F.count(x), (c, "mean"): F.avg(x), (c, "var"): F.var_pop(x), (c, "low"): F.min(x), (c, "high"): F.max(x)})
    moments = stats_row(df, exprs)
    rows = []
    for c in cols:
        n, mean, var = (moments[(c, s)] for s in ("n", "mean", "var"))
        if n < 3 or moments[(c, "low")] == moments[(c, "high")] or not var or not math.isfinite(var):
            rows.append((c, n, None, None, False))
            continue
        s = _weighted_sum(df, c, mean)
        w = w_statistic(n, s["mx"], s["mm"], s["last"] - s["first"], s["last_but_one"] - s["second"], n * var)
        p = w_p_value(n, w)
        rows.append((c, n, w, p, p > alpha))
    return small_frame(df.sparkSession, rows, SCHEMA)
