"""Anomaly filters on one numeric column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.explore import fences
from millrace.plans.frames import col
from millrace.plans.quantiles import quantiles
from millrace.plans.rolling import blocks_with_halo, finish


def anomalies_zscore(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Rows whose z-score (sample standard deviation) exceeds the threshold, with ``z_score``."""
    x = col(column).cast("double")
    mean, std = df.agg(F.avg(x), F.stddev_samp(x)).first()
    if not std:
        return df.withColumn("z_score", F.lit(None).cast("double")).where(F.lit(False))
    return df.withColumn("z_score", (x - mean) / std).where(F.abs("z_score") > threshold)


def anomalies_iqr(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Rows outside the quartile fences; the bounds are literals, so they reach the scan."""
    q1, q3 = quantiles(df, [column], [0.25, 0.75])[column]
    if q1 is None:
        return df.where(F.lit(False))
    low, high = fences(q1, q3, factor)
    return df.where((col(column) < low) | (col(column) > high))


def moving_stats(
    df: DataFrame, column: str, order_by: str, w: int = 7, by: Sequence[str] = (), tie: Sequence[str] = ()
) -> DataFrame:
    """Trailing mean and sample standard deviation over ``w`` rows, the current one included."""
    spread, window = blocks_with_halo(df, order_by, w - 1, by, tie)
    frame = window.rowsBetween(-(w - 1), 0)
    x = col(column).cast("double")
    out = spread.withColumn("moving_avg", F.avg(x).over(frame)).withColumn("moving_std", F.stddev_samp(x).over(frame))
    return finish(out).drop("total")


def anomalies_moving(
    df: DataFrame,
    column: str,
    order_by: str,
    by: Sequence[str] = (),
    w: int = 7,
    deviations: float = 2.0,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Rows further than ``deviations`` trailing standard deviations from the trailing mean.

    The first ``w - 1`` rows of each group have no full window and are left out.
    """
    stats = moving_stats(df, column, order_by, w, by, tie).where(F.col("position") >= w)
    gap = F.abs(F.try_divide(col(column) - F.col("moving_avg"), F.col("moving_std")))
    return stats.withColumn("deviation", gap).where(F.col("deviation") > deviations).drop("position")
