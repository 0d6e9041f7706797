"""Outlier detection and capping from aggregated moments and exact order statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.moments import adjust_kurtosis, adjust_skew
from millrace.operators.clean.log import TransformationLog
from millrace.operators.clean.schema import NUMERIC, Schema
from millrace.operators.explore import fences
from millrace.plans.frames import col, small_frame, stats_row
from millrace.plans.quantiles import quantiles

Z_LIMIT = 3.0
IQR_FACTOR = 1.5
HEAVY_TAIL = 7.0
MIN_ROWS = 20
WARN_RATE = 0.10
WINSOR = 0.01
REPORT_SCHEMA = (
    "column string, method string, n_outliers bigint, outlier_rate double, is_normal boolean, skewness double, kurtosis double, "
    "lower double, upper double, before_mean double, before_std double, after_mean double, after_std double"
)


def _moments(df: DataFrame, cols: Sequence[str]) -> dict:
    exprs = {}
    for c in cols:
        x = col(c).cast("double")
        exprs.update(
            {
                (c, "n"): F.count(x), (c, "mean"): F.avg(x), (c, "std"): F.stddev_samp(x), (c, "pop"): F.stddev_pop(x),
                (c, "g1"): F.skewness(x), (c, "g2"): F.kurtosis(x),
            }
        )
    return stats_row(df, exprs)


def jarque_bera(n: int, g1: float | None, g2: float | None) -> tuple[float, float] | None:
    """Statistic and p-value from population skewness and excess kurtosis."""
    if n < 8 or g1 is None or g2 is None or math.isnan(g1) or math.isnan(g2):
        return None
    jb = n / 6.0 * (g1 * g1 + g2 * g2 / 4.0)
    return jb, math.exp(-jb / 2.0)


def normality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Jarque-Bera test over all rows; normal means p > 0.05 and abs(skew) < 1."""
    m = _moments(df, cols)
    rows = []
    for c in cols:
        n = m[(c, "n")]
        skew = adjust_skew(n, m[(c, "g1")])
        test = jarque_bera(n, m[(c, "g1")], m[(c, "g2")])
        normal = test is not None and test[1] > 0.05 and abs(skew or 0.0) < 1.0
        rows.append((c, n, skew, adjust_kurtosis(n, m[(c, "g2")]), test and test[0], test and test[1], normal))
    return small_frame(
        df.sparkSession,
        rows,
        "column string, n bigint, skewness double, kurtosis double, statistic double, p_value double, is_normal boolean",
    )


def _clip(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Clip with literal bounds; gaps stay gaps."""
    out = []
    for c in df.columns:
        if c in bounds and bounds[c][0] is not None:
            lo, hi = bounds[c]
            x = col(c).cast("double")
            out.append(F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x).alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


def cap_zscore(df: DataFrame, column: str, threshold: float = Z_LIMIT) -> DataFrame:
    x = col(column).cast("double")
    mean, std = df.agg(F.avg(x), F.stddev_samp(x)).first()
    return _clip(df, {column: (mean - threshold * std, mean + threshold * std)}) if std else df


def cap_iqr(df: DataFrame, column: str, factor: float = IQR_FACTOR) -> DataFrame:
    q1, q3 = quantiles(df, [column], [0.25, 0.75])[column]
    return _clip(df, {column: fences(q1, q3, factor)})


def winsor_bounds(df: DataFrame, cols: Sequence[str], low: float, high: float, sizes: dict[str, int]) -> dict:
    """Order statistics next to the int(share * n) extreme rows on each side."""
    out = {}
    for c in cols:
        n = sizes[c]
        if n < 2:
            continue
        k_low, k_high = int(low * n), n - 1 - int(high * n)
        lo, hi = quantiles(df, [c], [k_low / (n - 1), k_high / (n - 1)])[c]
        out[c] = (lo, hi)
    return out


def winsorize(df: DataFrame, column: str, low: float = WINSOR, high: float = WINSOR) -> DataFrame:
    n = df.agg(F.count(col(column))).first()[0]
    return _clip(df, winsor_bounds(df, [column], low, high, {column: n}))


@dataclass(frozen=True)
class Cap:
    column: str
    method: str
    lower: float
    upper: float
    n_outliers: int
    rate: float
    is_normal: bool
    skewness: float | None
    kurtosis: float | None
    mean: float
    std: float


def plan_outliers(df: DataFrame, schema: Schema, target: str | None = None, log: TransformationLog | None = None) -> list[Cap]:
    """Method and bounds per numeric column: winsorize heavy tails, z-score normal ones, IQR the rest."""
    log = log or TransformationLog()
    cols = [
        c for c in df.columns
        if c in schema and schema[c].inferred_type == NUMERIC and not schema[c].is_id_like and c != target
    ]
    m = _moments(df, cols)
    cols = [c for c in cols if m[(c, "n")] >= MIN_ROWS]
    method, facts = {}, {}
    for c in cols:
        n = m[(c, "n")]
        skew, kurt = adjust_skew(n, m[(c, "g1")]), adjust_kurtosis(n, m[(c, "g2")])
        test = jarque_bera(n, m[(c, "g1")], m[(c, "g2")])
        normal = test is not None and test[1] > 0.05 and abs(skew or 0.0) < 1.0
        facts[c] = (normal, skew, kurt)
        method[c] = "winsorize" if abs(kurt or 0.0) > HEAVY_TAIL else "zscore" if normal else "iqr"
    bounds: dict[str, tuple[float, float]] = {}
    boxed = [c for c in cols if method[c] == "iqr"]
    for c, (q1, q3) in (quantiles(df, boxed, [0.25, 0.75]) if boxed else {}).items():
        bounds[c] = fences(q1, q3, IQR_FACTOR)
    heavy = [c for c in cols if method[c] == "winsorize"]
    bounds.update(winsor_bounds(df, heavy, WINSOR, WINSOR, {c: m[(c, "n")] for c in heavy}))
    for c in cols:
        if method[c] == "zscore":
            bounds[c] = (m[(c, "mean")] - Z_LIMIT * m[(c, "std")], m[(c, "mean")] + Z_LIMIT * m[(c, "std")])
    # z outliers are counted with the population deviation, capped with the sample one
    counted = {}
    for c in cols:
        x = col(c).cast("double")
        if method[c] == "zscore":
            counted[c] = F.count_if(F.abs(x - m[(c, "mean")]) > Z_LIMIT * m[(c, "pop")])
        elif method[c] == "iqr":
            counted[c] = F.count_if((x < bounds[c][0]) | (x > bounds[c][1]))
    counts = stats_row(df, counted)
    plan = []
    for c in cols:
        n = m[(c, "n")]
        hits = counts[c] if c in counts else int(2 * WINSOR * n)
        normal, skew, kurt = facts[c]
        plan.append(Cap(c, method[c], *bounds[c], hits, hits / n, normal, skew, kurt, m[(c, "mean")], m[(c, "std")]))
        if hits / n > WARN_RATE:
            log.warn("outlier_handling", f"high_outlier_rate_{method[c]}", column=c, reason=f"{hits / n:.1%} flagged")
        log.add("outlier_handling", f"cap_{method[c]}", column=c, reason=f"normal={normal}, skew={skew}, kurt={kurt}")
    return plan


def apply_outliers(df: DataFrame, plan: Sequence[Cap]) -> DataFrame:
    return _clip(df, {p.column: (p.lower, p.upper) for p in plan})


def outlier_report(df: DataFrame, plan: Sequence[Cap]) -> DataFrame:
    """Plan with the mean and deviation after capping."""
    after = apply_outliers(df, plan)
    stats = stats_row(
        after,
        {k: v for p in plan for k, v in (((p.column, "m"), F.avg(col(p.column))), ((p.column, "s"), F.stddev_samp(col(p.column))))},
    ) if plan else {}
    rnd = lambda v, d: None if v is None else round(float(v), d)
    rows = [
        (
            p.column, p.method, p.n_outliers, rnd(p.rate, 4), p.is_normal, rnd(p.skewness, 3), rnd(p.kurtosis, 3),
            float(p.lower), float(p.upper), rnd(p.mean, 4), rnd(p.std, 4), rnd(stats[(p.column, "m")], 4), rnd(stats[(p.column, "s")], 4),
        )
        for p in plan
    ]
    return small_frame(df.sparkSession, rows, REPORT_SCHEMA)
