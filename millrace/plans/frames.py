"""Plan shapes shared by many operators: long forms, one-row statistics, literals."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns aggregated in one agg call; wider tables run in chunks so that generated
# code stays below the JVM method limits.
AGG_CHUNK = 100


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by its exact name, dots included."""
    return F.col(quote(name))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_orderable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.MapType, T.VariantType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def stats_row(df: DataFrame, exprs: dict[str, Column]) -> Row | dict:
    """Run all aggregates over ``df`` and hand back one small driver dict.

    Every chunk of AGG_CHUNK expressions is one map-side-combined scan.
    """
    names = list(exprs)
    out: dict = {}
    for start in range(0, len(names), AGG_CHUNK):
        part = names[start : start + AGG_CHUNK]
        row = df.agg(*[exprs[n].alias(f"s{i}") for i, n in enumerate(part)]).first()
        out.update({n: row[i] for i, n in enumerate(part)})
    return out


def one_row(agg_df: DataFrame) -> Column:
    """One-row frame as a struct column (scalar subquery): lazy, no join in the plan."""
    return agg_df.select(F.struct(*[col(c) for c in agg_df.columns])).scalar()


def to_long(df: DataFrame, records: Sequence[Column]) -> DataFrame:
    """Turn per-column structs of a (small) wide frame into rows; no shuffle."""
    return df.select(F.inline(F.array(*records)))


def long_values(df: DataFrame, cols: Iterable[str], value: str = "value") -> DataFrame:
    """(column, value) rows with values as text; narrow, one scan of the chosen columns."""
    records = [
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias(value)) for c in cols
    ]
    return df.select(F.inline(F.array(*records)))


def long_numbers(df: DataFrame, cols: Iterable[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value) rows with values as double."""
    records = [
        F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("value")) for c in cols
    ]
    return df.select(*[col(k) for k in keep], F.inline(F.array(*records)))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value everywhere in this package."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns]
    )


def small_frame(spark, rows: list[tuple], schema: str) -> DataFrame:
    """Frame of a few driver-side records (plans, decisions, reports)."""
    return spark.createDataFrame(rows, schema)
