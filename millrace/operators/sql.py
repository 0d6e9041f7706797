"""SQL text over named DataFrames; planning is Spark's."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

PARAMETER_TYPES = {"string": str, "integer": int, "float": float, "boolean": bool, "date": date}


def register(views: dict[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def typed_args(args: dict[str, object], types: dict[str, str] | None = None) -> dict[str, object]:
    """Convert parameter values to their declared types (string, integer, float, boolean, date)."""
    types = types or {}
    out = {}
    for name, value in args.items():
        kind = types.get(name)
        if value is None or kind is None or isinstance(value, PARAMETER_TYPES[kind]) and kind != "integer":
            out[name] = value
        elif kind == "boolean":
            out[name] = str(value).strip().lower() in ("true", "1", "yes", "y", "on")
        elif kind == "date":
            out[name] = date.fromisoformat(str(value))
        else:
            out[name] = PARAMETER_TYPES[kind](value)
    return out


def run_sql(
    spark: SparkSession,
    views: dict[str, DataFrame],
    query: str,
    args: dict[str, object] | None = None,
    types: dict[str, str] | None = None,
) -> DataFrame:
    """Run one statement with named parameters (``:name``) bound as values, never as text.

    Recursive statements end with their data: the session's limit on levels is lifted.
    """
    register(views)
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
    if args:
        return spark.sql(query, args=typed_args(args, types))
    return spark.sql(query)


def run_batch(spark: SparkSession, views: dict[str, DataFrame], statements: Iterable[str]) -> DataFrame | None:
    """Run statements in order; the result of the last one that returns rows."""
    register(views)
    result = None
    for statement in statements:
        frame = spark.sql(statement)
        if frame.columns:
            result = frame
    return result
