"""Distribution drift between a reference frame and a new one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.pvalue import chi2_sf, kolmogorov_sf
from millrace.operators.clean.schema import BOOLEAN, CATEGORICAL, NUMERIC, ORDINAL, Schema
from millrace.plans.frames import col, small_frame
from millrace.plans.prefix import running_totals

DRIFT_P = 0.05
MIN_ROWS = 10
DRIFT_SCHEMA = (
    "column string, type string, test string, statistic double, p_value double, drifted boolean, "
    "ref_mean double, new_mean double, ref_std double, new_std double"
)


def drift_ks(ref: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance over all rows: (ks, n_ref, n_new)."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = ref.select(col(column).cast("double").alias("v"), one.alias("r"), zero.alias("w")).unionByName(
        new.select(col(column).cast("double").alias("v"), zero.alias("r"), one.alias("w"))
    )
    ranked = running_totals(both, "v", ["r", "w"])
    gap = F.abs(F.col("cum_r") / F.col("all_r") - F.col("cum_w") / F.col("all_w"))
    return ranked.agg(F.max(gap).alias("ks"), F.max("all_r").alias("n_ref"), F.max("all_w").alias("n_new"))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """(c, n): rows of each category as text, missing ones left out."""
    return df.select(col(column).cast("string").alias("c")).where("c IS NOT NULL").groupBy("c").agg(F.count(F.lit(1)).alias("n"))


def drift_chi2(ref: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """Chi-square of the new category counts against the reference shares: (chi2, dof, n_ref, n_new).

    Counts are smoothed by one per category and both scaled to the size of the new frame.
    """
    return drift_of_counts(category_counts(ref, column), category_counts(new, column))


def drift_of_counts(ref: DataFrame, new: DataFrame) -> DataFrame:
    """The same from category counts (c, n)."""
    zero = F.lit(0).cast("bigint")
    both = ref.select("c", F.col("n").alias("r"), zero.alias("w")).unionByName(new.select("c", zero.alias("r"), F.col("n").alias("w")))
    counts = both.groupBy("c").agg(F.sum("r").alias("r"), F.sum("w").alias("w"))
    t = counts.agg(
        F.sum(F.col("r") + 1).alias("sr"), F.sum(F.col("w") + 1).alias("sw"), F.sum("w").alias("m"),
    )
    s = t.select(F.struct("sr", "sw", "m")).scalar()
    expected = (F.col("r") + 1) * s["m"] / s["sr"]
    observed = (F.col("w") + 1) * s["m"] / s["sw"]
    return counts.agg(
        F.sum((observed - expected) * (observed - expected) / expected).alias("chi2"),
        (F.count(F.lit(1)) - 1).alias("dof"),
        F.sum("r").alias("n_ref"),
        F.sum("w").alias("n_new"),
    )


def detect_drift(ref: DataFrame, new: DataFrame, schema: Schema) -> DataFrame:
    """One row per column tested: KS for numeric, chi-square for categorical columns."""
    rows = []
    rnd = lambda v, d: None if v is None else round(float(v), d)
    for c in ref.columns:
        if c not in new.columns or c not in schema:
            continue
        kind = schema[c].inferred_type
        if kind == NUMERIC:
            x = col(c).cast("double")
            moments = [F.count(x), F.avg(x), F.stddev_samp(x)]
            (n1, m1, s1), (n2, m2, s2) = ref.agg(*moments).first(), new.agg(*moments).first()
            if n1 < MIN_ROWS or n2 < MIN_ROWS:
                continue
            d = drift_ks(ref, new, c).first()["ks"]
            p = kolmogorov_sf(d, n1, n2)
            rows.append((c, kind, "KS", rnd(d, 5), rnd(p, 5), p < DRIFT_P, rnd(m1, 4), rnd(m2, 4), rnd(s1, 4), rnd(s2, 4)))
        elif kind in (CATEGORICAL, ORDINAL, BOOLEAN):
            chi2, dof, n1, n2 = drift_chi2(ref, new, c).first()
            if (n1 or 0) < MIN_ROWS or (n2 or 0) < MIN_ROWS:
                continue
            p = chi2_sf(chi2, dof) if dof else 1.0
            rows.append((c, kind, "chi2", rnd(chi2, 5), rnd(p, 5), p < DRIFT_P, None, None, None, None))
    return small_frame(ref.sparkSession, rows, DRIFT_SCHEMA)


def drift_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count(F.lit(1)).alias("tested"),
        F.count_if("drifted").alias("drifted"),
        F.round(F.try_divide(F.count_if("drifted"), F.count(F.lit(1))), 4).alias("drift_rate"),
    )
