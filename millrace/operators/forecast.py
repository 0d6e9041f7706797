"""Forecasts of a (time, value) series already aggregated to its grain."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.clean.impute import fill_ordered
from millrace.plans.frames import col, one_row
from millrace.plans.prefix import row_positions
from millrace.plans.rolling import blocks_with_halo, finish

# weights below this share of the newest one vanish in double precision
NEGLIGIBLE = 1e-18


def _ahead(series: DataFrame, time: str, horizon: int) -> DataFrame:
    """(step, time) for the ``horizon`` future points, spaced like the last two."""
    last = series.orderBy(F.desc(time)).limit(2)
    ends = last.agg(F.max(time).alias("t1"), F.min(time).alias("t0"))
    kind = series.schema[time].dataType.simpleString()
    if kind == "date":
        future = F.date_add(F.col("t1"), (F.col("step") * F.datediff("t1", "t0")).cast("int"))
    elif kind.startswith("timestamp"):
        future = F.col("t1") + (F.col("t1") - F.col("t0")) * F.col("step")
    else:
        future = F.col("t1") + (F.col("t1") - F.col("t0")) * F.col("step")
    return ends.select("t1", "t0", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")).select("step", future.alias(time))


def _flat(series: DataFrame, time: str, horizon: int, level: Column) -> DataFrame:
    return _ahead(series, time, horizon).select(time, "step", level.alias("forecast"))


def forecast_sma(series: DataFrame, time: str, value: str, w: int = 7, horizon: int = 30) -> DataFrame:
    """Mean of the last ``w`` values, repeated."""
    level = series.orderBy(F.desc(time)).limit(w).agg(F.avg(col(value))).scalar()
    return _flat(series, time, horizon, level)


def forecast_ewm(series: DataFrame, time: str, value: str, alpha: float = 0.3, horizon: int = 30) -> DataFrame:
    """Last level of the bias-corrected exponential mean, repeated.

    Rows without a value keep their place: they carry no weight, but age the values before them. Ages
    count from the last value, so a long gap at the end does not make all weights vanish.
    """
    ranked = row_positions(series.select(time, value), time).where(col(value).isNotNull())
    newest = ranked.agg(F.max("position")).scalar()
    weight = F.exp((newest - F.col("position")) * math.log(1 - alpha))
    level = ranked.agg(F.sum(col(value) * weight) / F.sum(weight)).scalar()
    return _flat(series, time, horizon, level)


def linear_fit(series: DataFrame, time: str, value: str) -> DataFrame:
    """Slope, intercept and R2 of the value over its 0-based index."""
    ranked = row_positions(series.select(time, value), time)
    x, y = (F.col("position") - 1).cast("double"), col(value).cast("double")
    return ranked.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.count(y).alias("n"),
    )


def forecast_linear(series: DataFrame, time: str, value: str, horizon: int = 30) -> DataFrame:
    fit = one_row(linear_fit(series, time, value))
    return _ahead(series, time, horizon).select(
        time, "step", (fit["intercept"] + fit["slope"] * (fit["n"] - 1 + F.col("step"))).alias("forecast")
    )


def smoothed(series: DataFrame, time: str, value: str, w: int = 7, alpha: float = 0.3) -> DataFrame:
    """History with ``moving_avg``, ``exp_smooth`` and ``trend`` columns.

    The exponential mean is a ratio of two running sums inside blocks about as long as weights matter in
    double precision, each row scaled by its place in the block: constant work a row. Rows without a
    value keep their place and take the level of the last one; before the first value there is none.
    """
    decay = math.log(1 - alpha)
    reach = max(w - 1, math.ceil(math.log(NEGLIGIBLE) / decay))
    spread, window = blocks_with_halo(series.select(time, value), time, reach, block_rows=reach + 1)
    x = col(value).cast("double")
    # Scaled from the block's first row, at most two reaches back, so neither sum leaves the range of doubles.
    scale = F.exp((F.col("position") - F.col("_block") * (reach + 1)) * F.lit(-decay))
    running = window.rowsBetween(Window.unboundedPreceding, 0)
    level = F.try_divide(F.sum(x * scale).over(running), F.sum(F.when(x.isNotNull(), scale)).over(running))
    fit = one_row(linear_fit(series, time, value))
    recent = window.rowsBetween(-(w - 1), 0)
    # both windows are taken on the blocked rows before the repeated ones are dropped
    out = spread.withColumn("exp_smooth", level).withColumn(
        "moving_avg", F.when(F.col("position") >= w, F.avg(col(value)).over(recent))
    )
    out = finish(out)
    if series.where(col(value).isNull() & col(time).isNotNull()).limit(1).count():
        # A gap longer than the reach takes the level before it.
        first = one_row(out.where(col(value).isNotNull()).agg(F.min("position").alias("first")))["first"]
        out = fill_ordered(out, ["exp_smooth"], "position").withColumn(
            "exp_smooth", F.when(F.col("position") >= first, F.col("exp_smooth"))
        )
    return out.select(
        time, value, "moving_avg", "exp_smooth", (fit["intercept"] + fit["slope"] * (F.col("position") - 1)).alias("trend")
    )


def combine_forecast(actual: DataFrame, forecast: DataFrame, time: str, value: str) -> DataFrame:
    """History and forecast under one roof, told apart by ``type``."""
    return actual.select(time, col(value).cast("double").alias("value"), F.lit("actual").alias("type")).unionByName(
        forecast.select(time, F.col("forecast").alias("value"), F.lit("forecast").alias("type"))
    )
