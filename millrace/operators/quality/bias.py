"""Group fairness: target statistics per sensitive group and their significance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.pvalue import chi2_sf, f_sf
from millrace.operators.clean.schema import BOOLEAN, CATEGORICAL, ORDINAL, Schema
from millrace.plans.frames import col, is_numeric, small_frame

# Name parts of sensitive columns.
SENSITIVE_WORDS = (
    "gender", "sex", "race", "ethnicity", "age", "religion",
    "nationality", "disability", "income", "education", "marital",
)
DISPARITY = 0.10
MIN_GROUP = 5
GROUPS = (2, 20)


def sensitive_columns(schema: Schema, target: str | None = None) -> list[str]:
    return [
        p.name for p in schema.values()
        if p.name != target
        and any(w in p.name.lower() for w in SENSITIVE_WORDS)
        and p.inferred_type in (CATEGORICAL, BOOLEAN, ORDINAL)
    ]


def group_report(df: DataFrame, group: str, target: str) -> DataFrame:
    """Numeric target: size, mean, deviation and distance from the overall mean per group."""
    y = col(target).cast("double")
    overall = df.agg(F.avg(y)).scalar()
    return (
        df.where(col(group).isNotNull())
        .groupBy(col(group).cast("string").alias("group"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("_mean"), F.stddev_samp(y).alias("_std"))
        .where(F.col("n") >= MIN_GROUP)
        .select(
            F.lit(group).alias("column"), "group", "n",
            F.round("_mean", 4).alias("mean"), F.round("_std", 4).alias("std"),
            F.round(F.abs(F.col("_mean") - overall), 4).alias("diff_from_overall"),
        )
    )


def positive_rates(df: DataFrame, group: str, target: str, positive) -> DataFrame:
    """Binary target: share of the positive class per group."""
    hit = (col(target) == F.lit(positive)).cast("double")
    return (
        df.where(col(group).isNotNull())
        .groupBy(col(group).cast("string").alias("group"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(hit, F.lit(0.0))), 4).alias("positive_rate"))
        .where(F.col("n") >= MIN_GROUP)
        .select(F.lit(group).alias("column"), "group", "n", "positive_rate")
    )


def bias_report(
    df: DataFrame, schema: Schema, target: str, sensitive: Sequence[str] | None = None
) -> DataFrame:
    """One row per sensitive column: disparity between groups, verdict, test statistic, p-value."""
    columns = list(sensitive) if sensitive is not None else sensitive_columns(schema, target)
    numeric = is_numeric(df.schema[target].dataType)
    rows = []
    for c in columns:
        groups = df.select(c).where(col(c).isNotNull()).distinct().limit(GROUPS[1] + 1).count()
        if not GROUPS[0] <= groups <= GROUPS[1]:
            continue
        if numeric:
            span = group_report(df, c, target).agg(F.max("mean") - F.min("mean")).first()[0]
            if span is None:
                continue
            # A spread is judged against the level of the target; around a mean of zero any spread counts.
            level = df.agg(F.abs(F.avg(col(target).cast("double")))).first()[0]
            biased = span > 0 if level == 0 else span / level > DISPARITY
            statistic, p = anova_test(df, c, target)
            rows.append((c, groups, "anova", round(span, 4), bool(biased), statistic, p))
        else:
            classes = [r[0] for r in df.select(target).where(col(target).isNotNull()).distinct().limit(3).collect()]
            if len(classes) != 2:
                continue
            span = positive_rates(df, c, target, max(classes)).agg(F.max("positive_rate") - F.min("positive_rate")).first()[0]
            if span is None:
                continue
            statistic, p = chi2_test(df, c, target)
            rows.append((c, groups, "chi2", round(span, 4), span > DISPARITY, statistic, p))
    return small_frame(
        df.sparkSession, rows,
        "column string, groups int, test string, disparity double, biased boolean, statistic double, p_value double",
    )


def anova(df: DataFrame, group: str, target: str) -> DataFrame:
    """One-way ANOVA F with its degrees of freedom; groups of at least 5 rows."""
    y = col(target).cast("double")
    g = (
        df.where(col(group).isNotNull() & y.isNotNull())
        .groupBy(group)
        .agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
        .where(F.col("n") >= MIN_GROUP)
    )
    grand = g.agg(F.sum(F.col("n") * F.col("m")) / F.sum("n")).scalar()
    totals = g.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * (F.col("m") - grand) * (F.col("m") - grand)).alias("between"),
    )
    return totals.select(
        F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("N") - F.col("k"))).alias("f"),
        (F.col("k") - 1).alias("df_between"), (F.col("N") - F.col("k")).alias("df_within"),
    )


def anova_test(df: DataFrame, group: str, target: str) -> tuple[float | None, float | None]:
    f, d1, d2 = anova(df, group, target).first()
    return (f, f_sf(f, d1, d2)) if f is not None and d1 > 0 and d2 > 0 else (None, None)


def chi2_independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square of the crosstab; Yates correction only for 2 x 2 tables.

    chi2 over the full grid equals the observed cells' terms plus the expected counts of the
    empty cells, so the grid itself is never built.
    """
    cells = (
        df.where(col(a).isNotNull() & col(b).isNotNull())
        .groupBy(col(a).alias("a"), col(b).alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rows = cells.groupBy("a").agg(F.sum("n").alias("na"))
    columns = cells.groupBy("b").agg(F.sum("n").alias("nb"))
    shape = cells.agg(F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"), F.sum("n").alias("N"))
    s = shape.select(F.struct("ka", "kb", "N")).scalar()
    expected = F.col("na") * F.col("nb") / s["N"]
    two_by_two = (s["ka"] == 2) & (s["kb"] == 2)
    gap = F.abs(F.col("n") - expected)
    gap = F.when(two_by_two, F.greatest(gap - F.lit(0.5), F.lit(0.0))).otherwise(gap)
    terms = cells.join(rows, "a").join(columns, "b").select((gap * gap / expected).alias("t"), expected.alias("e"))
    empty = F.when(two_by_two, F.lit(0.0)).otherwise(s["N"] - F.sum("e"))
    return terms.agg(
        (F.sum("t") + empty).alias("chi2"), ((F.first(s["ka"]) - 1) * (F.first(s["kb"]) - 1)).alias("dof")
    )


def chi2_test(df: DataFrame, a: str, b: str) -> tuple[float | None, float | None]:
    chi2, dof = chi2_independence(df, a, b).first()
    return (chi2, chi2_sf(chi2, dof)) if chi2 is not None and dof else (None, None)
