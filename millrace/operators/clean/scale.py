"""Scaler choice and scaling with literal statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.moments import adjust_skew
from millrace.operators.clean.log import TransformationLog
from millrace.plans.frames import col, numeric_columns, small_frame, stats_row
from millrace.plans.quantiles import quantiles

SKEW_LIMIT = 1.0
MIN_VALUES = 5


@dataclass(frozen=True)
class Scaler:
    column: str
    method: str  # standard, robust or minmax
    center: float
    spread: float


def choose_scalers(
    df: DataFrame, cols: Sequence[str] | None = None, skip: Sequence[str] = (), log: TransformationLog | None = None
) -> list[Scaler]:
    """Min-max inside [0, 1], robust when abs(skew) > 1, else standard; binary columns stay."""
    log = log or TransformationLog()
    cols = [c for c in (cols or numeric_columns(df)) if c not in skip]
    exprs = {}
    for c in cols:
        x = col(c).cast("double")
        exprs.update(
            {
                (c, "n"): F.count(x), (c, "lo"): F.min(x), (c, "hi"): F.max(x), (c, "mean"): F.avg(x),
                (c, "pop"): F.stddev_pop(x), (c, "g1"): F.skewness(x), (c, "other"): F.count_if(~x.isin(-1.0, 0.0, 1.0)),
            }
        )
    s = stats_row(df, exprs)
    chosen = {}
    for c in cols:
        if s[(c, "n")] < MIN_VALUES or not s[(c, "other")]:
            continue
        skew = abs(adjust_skew(s[(c, "n")], s[(c, "g1")]) or 0.0)
        bounded = s[(c, "lo")] >= 0.0 and s[(c, "hi")] <= 1.0
        chosen[c] = "minmax" if bounded else "robust" if skew > SKEW_LIMIT else "standard"
    robust = [c for c, m in chosen.items() if m == "robust"]
    quarts = quantiles(df, robust, [0.25, 0.5, 0.75]) if robust else {}
    out = []
    for c, method in chosen.items():
        if method == "standard":
            center, spread = s[(c, "mean")], s[(c, "pop")]
        elif method == "minmax":
            center, spread = s[(c, "lo")], s[(c, "hi")] - s[(c, "lo")]
        else:
            q1, q2, q3 = quarts[c]
            center, spread = q2, q3 - q1
        out.append(Scaler(c, method, float(center), float(spread) or 1.0))
        log.add("scaling", f"scale_{method}", column=c)
    return out


def scale(df: DataFrame, plan: Sequence[Scaler]) -> DataFrame:
    by = {s.column: s for s in plan}
    return df.select(
        *[
            ((col(c).cast("double") - by[c].center) / by[c].spread).cast("float").alias(c) if c in by else col(c)
            for c in df.columns
        ]
    )


def scaler_frame(spark: SparkSession, plan: Sequence[Scaler]) -> DataFrame:
    return small_frame(
        spark, [(s.column, s.method, s.center, s.spread) for s in plan], "column string, method string, center double, spread double"
    )
