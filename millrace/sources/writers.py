"""Sinks: table writes, exports and bulk extracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.frames import col
from millrace.sources.readers import read_csv, read_json_flat

FORMATS = ("csv", "json", "parquet")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] | None = None) -> None:
    """Replace or append a parquet table; created when missing."""
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be overwrite or append, not {mode!r}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    write_table(df, path, "append")


def export(df: DataFrame, path: str, fmt: str, mode: str = "overwrite") -> None:
    """Write a result as CSV (header), JSON records (lines) or parquet; one file per partition."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {FORMATS}")
    if fmt == "csv":
        nested = (T.ArrayType, T.MapType, T.StructType)
        flat = [
            F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else col(f.name)
            for f in df.schema.fields
        ]
        df.select(*flat).write.mode(mode).option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
    else:
        df.write.mode(mode).parquet(path)


def first_rows(df: DataFrame, n: int, order_by: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows; with ``order_by`` a distributed top-n, deterministic."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n)


def extract_tables(
    tables: dict[str, DataFrame],
    n: int,
    path: str,
    fmt: str = "parquet",
    order_by: dict[str, Sequence[str]] | None = None,
) -> dict[str, str]:
    """Export the first ``n`` rows of each table; returns {table: written path}."""
    written = {}
    for name, df in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        export(first_rows(df, n, (order_by or {}).get(name, ())), target, fmt)
        written[name] = target
    return written


def transfer(spark: SparkSession, mapping: dict[str, str], mode: str = "overwrite", to_format: str = "parquet") -> None:
    """Copy files to tables (or back) by a {source path: target path} mapping.

    Formats follow the source's extension; any Hadoop file system URL works.
    """
    for source, target in mapping.items():
        name = source.rstrip("/").lower()
        if name.endswith(".csv"):
            df = read_csv(spark, source)
        elif name.endswith((".json", ".jsonl")):
            df = read_json_flat(spark, source, multi_line=name.endswith(".json"))
        else:
            df = spark.read.parquet(source)
        export(df, target, to_format, mode)
