"""Shapiro-Wilk against a plain implementation and published values."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.normal import normal_quantile
from millrace.operators.clean import normality
from millrace.operators.clean.normality import shapiro_wilk


def plain(values):
    """W with every weight written out."""
    x, n = sorted(values), len(values)
    m = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm, u = sum(v * v for v in m), 1 / math.sqrt(n)
    power = lambda table: sum(c * u**k for k, c in enumerate(table))
    a = [0.0] * n
    a[-1] = m[-1] / math.sqrt(mm) + power(normality.OUTER)
    edge = 1
    if n > 5:
        a[-2] = m[-2] / math.sqrt(mm) + power(normality.SECOND)
        edge = 2
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        phi = (mm - 2 * sum(v * v for v in m[-edge:])) / (1 - 2 * sum(v * v for v in a[-edge:]))
        for i in range(n):
            if i < edge:
                a[i] = -a[n - 1 - i]
            elif i < n - edge:
                a[i] = m[i] / math.sqrt(phi)
    mean = sum(x) / n
    return sum(p * q for p, q in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x)


def test_normal_quantile(spark):
    p = [1e-300, 1e-20, 1e-9, 0.01, 0.075, 0.3, 0.5, 0.6, 0.925, 0.99, 1 - 1e-12]
    got = spark.createDataFrame([(v,) for v in [*p, 0.0, 1.0]], "p double").select(normal_quantile(F.col("p"))).collect()
    assert [r[0] for r in got[:-2]] == pytest.approx([NormalDist().inv_cdf(v) for v in p], rel=1e-12, abs=1e-14)
    assert got[-2][0] is None and got[-1][0] is None


def test_published_example(spark):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    row = shapiro_wilk(spark.createDataFrame([(w,) for w in weights], "w int"), ["w"]).first()
    assert row.statistic == pytest.approx(0.78881, abs=1e-4) and row.p_value == pytest.approx(0.006704, abs=2e-5) and not row.is_normal


@pytest.mark.parametrize("n", [3, 4, 5, 6, 11, 12, 50, 3000])
def test_equals_plain(spark, monkeypatch, n):
    monkeypatch.setattr(normality, "RUN", 7)
    rng = np.random.default_rng(n)
    data = {"bell": rng.normal(1e6, 2, n), "tied": np.round(rng.normal(0, 1, n)), "skew": rng.exponential(1, n)}
    data["tied"][0] += 3
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in data.values()])), "bell double, tied double, skew double")
    for row in shapiro_wilk(df, list(data)).collect():
        assert row.n == n and row.statistic == pytest.approx(plain(data[row.column].tolist()), rel=1e-7)
        assert 0 <= row.p_value <= 1
    if n == 3000:
        assert not shapiro_wilk(df, ["skew"]).first().is_normal


@pytest.mark.parametrize("n", [4, 8, 11, 12, 40, 400])
def test_p_values_of_normal_samples_are_even(n):
    rng = np.random.default_rng(n)
    p = [normality.w_p_value(n, plain(rng.normal(0, 1, n).tolist())) for _ in range(400)]
    assert all(abs(np.mean(np.array(p) < level) - level) < 0.07 for level in (0.05, 0.25, 0.5, 0.75))


def test_gaps_constants_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 5.0, None, inf, 1), (2.0, 5.0, None, 1.0, 2), (None, 5.0, 3.0, 2.0, 3), (nan, 5.0, None, 3.0, 4), (4.0, 5.0, None, 4.0, 9)]
    got = {r.column: r for r in shapiro_wilk(spark.createDataFrame(rows, "`a.b` double, flat double, few double, wild double, x int"), ["a.b", "flat", "few", "wild", "x"]).collect()}
    assert got["a.b"].n == 3 and got["a.b"].statistic == pytest.approx(plain([1.0, 2.0, 4.0]))
    assert all(got[c].statistic is None and not got[c].is_normal for c in ("flat", "few", "wild"))
    assert got["x"].statistic == pytest.approx(plain([1, 2, 3, 4, 9]))
    assert shapiro_wilk(spark.createDataFrame([], "v double"), ["v"]).first().n == 0


def test_long_runs_are_summed_in_closed_form(spark):
    """One value on hundreds of thousands of rows costs two quantiles, not one a row, and W stays the same."""
    n = 60_000
    df = spark.range(n).select(F.floor(F.col("id") / 6_000).cast("double").alias("v"))
    x = [math.floor(i / 6_000) for i in range(n)]
    assert shapiro_wilk(df, ["v"]).first().statistic == pytest.approx(plain(x), rel=1e-11)
    assert normality._squares(n) == pytest.approx(math.fsum(NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) ** 2 for i in range(1, n + 1)), rel=1e-13)
    half = 4_000_000_000
    low, high = np.array([1, half + 1]), np.array([half, 2 * half])
    weights = normality.run_weights(low, high, np.array([2 * half] * 2))
    assert weights.tolist() == pytest.approx([-2 * half / math.sqrt(2 * math.pi), 2 * half / math.sqrt(2 * math.pi)], rel=1e-9)
