"""Table profiling: one aggregate pass per table, plus one for exact distinct counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.frames import AGG_CHUNK, col, is_numeric, is_orderable, is_temporal, long_values, to_long

PROFILE_TYPE = (
    "column string, type string, ordinal int, row_count bigint, null_count bigint, min string, max string, "
    "avg double, approx_distinct bigint"
)


def _chunks(df: DataFrame, cols: Sequence[str]) -> list[list[str]]:
    """Column groups aggregated together: fixed-width and variable-width apart, 20 at most.

    One text column would push the whole aggregate off the generated hash path; the groups
    read disjoint columns, so splitting costs no extra input.
    """
    step = AGG_CHUNK // 5
    fixed = [c for c in cols if is_numeric(df.schema[c].dataType) or is_temporal(df.schema[c].dataType)]
    groups = (fixed, [c for c in cols if c not in fixed])
    return [g[i : i + step] for g in groups for i in range(0, len(g), step)]


def _first_pass(df: DataFrame, cols: Sequence[str], approx: bool) -> DataFrame:
    parts = []
    names = list(df.columns)
    for chunk in _chunks(df, cols):
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(chunk):
            dtype = df.schema[c].dataType
            ordered = is_orderable(dtype)
            aggs += [
                F.count(col(c)).alias(f"c{i}"),
                (F.min(col(c)).cast("string") if ordered else F.lit(None).cast("string")).alias(f"lo{i}"),
                (F.max(col(c)).cast("string") if ordered else F.lit(None).cast("string")).alias(f"hi{i}"),
            ]
            if is_numeric(dtype):
                aggs.append(F.avg(col(c).cast("double")).alias(f"m{i}"))
            if approx and not isinstance(dtype, (T.MapType, T.VariantType)):
                aggs.append(F.approx_count_distinct(col(c)).alias(f"d{i}"))
        wide = df.agg(*aggs)
        records = []
        for i, c in enumerate(chunk):
            dtype = df.schema[c].dataType
            records.append(
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(dtype.simpleString()).alias("type"),
                    F.lit(names.index(c)).alias("ordinal"),
                    F.col("n").alias("row_count"),
                    (F.col("n") - F.col(f"c{i}")).alias("null_count"),
                    F.col(f"lo{i}").alias("min"),
                    F.col(f"hi{i}").alias("max"),
                    (F.col(f"m{i}") if is_numeric(dtype) else F.lit(None).cast("double")).alias("avg"),
                    (F.col(f"d{i}") if f"d{i}" in wide.columns else F.lit(None).cast("bigint")).alias("approx_distinct"),
                )
            )
        parts.append(to_long(wide, records))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


MAX_BRANCHES = 64


def value_counts(df: DataFrame, cols: Sequence[str] | None = None, stored: bool = False) -> DataFrame:
    """(column, value, n) for every distinct non-null value, values as text.

    One pass over ``df`` by default. With ``stored`` (a table or cached frame, cheap to read
    column by column) each column is counted in its own type in its own branch and only the
    distinct values become text.
    """
    cols = list(cols or df.columns)
    n = F.count(F.lit(1)).alias("n")
    if not stored or len(cols) > MAX_BRANCHES:
        return long_values(df, cols).where("value IS NOT NULL").groupBy("column", "value").agg(n)
    out = None
    for c in cols:
        part = df.where(col(c).isNotNull()).groupBy(col(c).alias("value")).agg(n)
        part = part.select(F.lit(c).alias("column"), F.col("value").cast("string").alias("value"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def profile(
    df: DataFrame, table: str | None = None, approx: bool = False, cols: Sequence[str] | None = None, stored: bool = False
) -> DataFrame:
    """One row per column: counts, null and distinct shares, min / max as text, mean, quality.

    ``approx`` replaces the exact distinct counts (a shuffle of the distinct values of every
    column) by HyperLogLog in the first pass; ``stored`` is passed to :func:`value_counts`.
    """
    cols = list(cols or df.columns)
    base = _first_pass(df, cols, approx)
    if approx:
        stats = base.withColumn("distinct_count", F.col("approx_distinct"))
    else:
        distinct = value_counts(df, cols, stored).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
        stats = base.join(F.broadcast(distinct), "column", "left").withColumn(
            "distinct_count", F.coalesce("distinct_count", F.lit(0))
        )
    rows = F.col("row_count")
    null_pct = F.coalesce(F.round(F.try_divide(100.0 * F.col("null_count"), rows), 2), F.lit(0.0))
    out = stats.select(
        *([F.lit(table).alias("table")] if table else []),
        "column",
        "type",
        "ordinal",
        "row_count",
        "null_count",
        null_pct.alias("null_pct"),
        "distinct_count",
        F.coalesce(F.round(F.try_divide(100.0 * F.col("distinct_count"), rows), 2), F.lit(0.0)).alias("distinct_pct"),
        ((rows > 0) & (F.col("distinct_count") == rows)).alias("is_unique"),
        "min",
        "max",
        F.round("avg", 4).alias("avg"),
    )
    return out.withColumn("quality", column_quality(F.col("null_pct")))


def column_quality(null_pct):
    """100 minus the null share, which costs at most 50 points."""
    return F.greatest(F.lit(0.0), 100.0 - F.least(null_pct, F.lit(50.0)))


def profile_tables(tables: dict[str, DataFrame], approx: bool = False) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = profile(df, name, approx, stored=True)
        out = part if out is None else out.unionByName(part)
    return out


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out


def sample_values(df: DataFrame, n: int = 5, cols: Sequence[str] | None = None, stored: bool = False) -> DataFrame:
    """The ``n`` smallest distinct non-null values of each column, as text."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    return value_counts(df, cols, stored).select("column", "value", rank.alias("rank")).where(F.col("rank") <= n)


def top_values(df: DataFrame, k: int = 5, cols: Sequence[str] | None = None, stored: bool = False) -> DataFrame:
    """The ``k`` most common non-null values of each column; ties by value."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return value_counts(df, cols, stored).select("column", "value", "n", rank.alias("rank")).where(F.col("rank") <= k)


def quality_scores(profiles: DataFrame) -> DataFrame:
    """Table score: mean of its column scores, 100 for an empty table."""
    return profiles.groupBy("table").agg(
        F.max("row_count").alias("row_count"),
        F.round(F.when(F.max("row_count") == 0, F.lit(100.0)).otherwise(F.avg("quality")), 1).alias("score"),
    )


def quality_issues(profiles: DataFrame) -> DataFrame:
    """Null-heavy and single-valued columns with a severity."""
    keys = [c for c in ("table", "column") if c in profiles.columns]
    nulls = profiles.where("null_pct > 20").select(
        *keys,
        F.when(F.col("null_pct") > 50, "High").otherwise("Medium").alias("severity"),
        F.lit("missing values").alias("issue"),
        F.col("null_pct").alias("measure"),
    )
    single = profiles.where("distinct_count = 1 AND row_count > 1").select(
        *keys,
        F.lit("Low").alias("severity"),
        F.lit("single value").alias("issue"),
        F.col("distinct_count").cast("double").alias("measure"),
    )
    return nulls.unionByName(single)


def status_band(score):
    return F.when(score >= 80, "good").when(score >= 50, "fair").otherwise("poor")


def quality_summary(profiles: DataFrame) -> DataFrame:
    """Totals over all profiled tables and how many fall in each status band."""
    widths = profiles.groupBy("table").agg(F.count(F.lit(1)).alias("columns"))
    scored = quality_scores(profiles).join(widths, "table").withColumn("status", status_band(F.col("score")))
    return scored.agg(
        F.count(F.lit(1)).alias("tables"),
        F.sum("row_count").alias("rows"),
        F.sum("columns").alias("columns"),
        F.round(F.avg("score"), 1).alias("avg_score"),
        F.count_if(F.col("status") == "good").alias("good"),
        F.count_if(F.col("status") == "fair").alias("fair"),
        F.count_if(F.col("status") == "poor").alias("poor"),
    )


def column_report(df: DataFrame, table: str, columns: int | None = None, values: int = 3) -> DataFrame:
    """Flat export: profile, category, and frequent values of the categorical columns (the first ``columns`` if given)."""
    from millrace.operators.catalog import category_of

    stats = profile(df, table).withColumn("category", category_of(F.col("column"), F.col("type")))
    wanted = (F.col("category").isin("categorical", "boolean", "name", "text")) & ~F.col("is_unique")
    rank = F.row_number().over(Window.partitionBy("table", F.col("wanted")).orderBy("ordinal"))
    chosen = stats.withColumn("wanted", wanted).withColumn("_rank", rank)
    tops = (
        top_values(df, values)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("_top"))
        .select(
            F.col("column").alias("_column"),
            F.array_join(F.transform("_top", lambda r: F.concat(r["value"], F.lit(" ("), r["n"].cast("string"), F.lit(")"))), ", ").alias("_text"),
        )
    )
    return chosen.join(F.broadcast(tops), F.col("column") == F.col("_column"), "left").select(
        "table", "column", "type", "category", "row_count", "null_pct", "distinct_count", "is_unique", "quality",
        F.when(F.col("wanted") & (F.lit(columns is None) | (F.col("_rank") <= (columns or 0))), F.col("_text")).alias("frequent"),
    )
