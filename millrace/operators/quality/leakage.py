"""Columns that give the target away."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.moments import clean_corr
from millrace.operators.clean.schema import DATETIME, Schema
from millrace.plans.frames import col, is_numeric, numeric_columns, small_frame, stats_row
from millrace.plans.quantiles import quantiles

LEAK_CORR = 0.98
LEAK_SCHEMA = "column string, correlation double, corr_flag boolean, name_flag boolean, datetime_flag boolean"


def class_places(df: DataFrame, target: str) -> DataFrame:
    """(_class, _place): distinct values in ascending order from 0, however many.

    Values meet in buckets of their first characters; a bucket's offset is the size of those before it.
    """
    classes = df.select(col(target).alias("_class")).where("_class IS NOT NULL").distinct().withColumn("_head", F.substring(F.col("_class").cast("string"), 1, 2))
    heads = classes.groupBy("_head").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    offsets = heads.select("_head", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_head").orderBy("_class")) - 1
    return classes.withColumn("_row", inside).join(offsets, "_head").select("_class", (F.col("_row") + F.col("_offset")).alias("_place"))


def detect_leakage(df: DataFrame, schema: Schema, target: str) -> DataFrame:
    """Rows for columns with a correlation of at least 0.98 (gaps at the median), a leaky name or a date.

    A text target is coded by the alphabetical place of its classes, joined from a ranked frame of them.
    """
    names, cols = df.columns, [c for c in numeric_columns(df) if c != target]
    if is_numeric(df.schema[target].dataType):
        y = col(target).cast("double")
    else:
        df = df.join(class_places(df, target), col(target) == F.col("_class"), "left")
        y = F.col("_place").cast("double")
    gaps = stats_row(df, {c: F.count_if(col(c).isNull()) for c in cols})
    holed = [c for c in cols if gaps[c]]
    medians = {c: v[0] for c, v in quantiles(df, holed, [0.5]).items()} if holed else {}
    filled = {c: F.coalesce(col(c).cast("double"), F.lit(medians[c])) if c in medians else col(c).cast("double") for c in cols}
    r = stats_row(df, {c: clean_corr(filled[c], y) for c in cols})
    rows = []
    for c in names:
        if c == target:
            continue
        value = None if r.get(c) is None else abs(r[c])
        flags = (
            value is not None and value >= LEAK_CORR,
            c in schema and schema[c].is_leakage_risk,
            c in schema and schema[c].inferred_type == DATETIME,
        )
        if any(flags):
            rows.append((c, None if value is None else round(value, 4), *flags))
    return small_frame(df.sparkSession, rows, LEAK_SCHEMA)
