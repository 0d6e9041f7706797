"""Scans: CSV, JSON, parquet, JDBC and table folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.frames import quote


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str | None = None
) -> DataFrame:
    """CSV with header. Without ``encoding``, UTF-8 first and latin-1 when bytes fail to decode.

    Passing a schema avoids the extra inference scan; do so for large inputs.
    """

    def scan(charset: str) -> DataFrame:
        reader = spark.read.option("header", True).option("encoding", charset).option("mode", "PERMISSIVE")
        if schema is not None:
            return reader.schema(schema).csv(path)
        return reader.option("inferSchema", True).csv(path)

    if encoding:
        return scan(encoding)
    undecodable = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1)
    return scan("ISO-8859-1" if undecodable.count() else "UTF-8")


def flatten(df: DataFrame) -> DataFrame:
    """Structs become dotted columns; arrays and maps become JSON text."""
    out = []

    def walk(path: list[str], dtype: T.DataType) -> None:
        column = F.col(".".join(quote(p) for p in path))
        if isinstance(dtype, T.StructType):
            for field in dtype.fields:
                walk([*path, field.name], field.dataType)
        elif isinstance(dtype, (T.ArrayType, T.MapType)):
            out.append(F.to_json(column).alias(".".join(path)))
        else:
            out.append(column.alias(".".join(path)))

    for field in df.schema.fields:
        walk([field.name], field.dataType)
    return df.select(*out)


def read_json_flat(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """JSON array / single object files (``multi_line``) or JSON lines, flattened.

    JSON lines split across tasks; a multi-line file is one task each, so large inputs
    should come as lines.
    """
    reader = spark.read.option("multiLine", multi_line)
    if schema is not None:
        reader = reader.schema(schema)
    return flatten(reader.json(path))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_col: str | None = None,
    lower: int | str | None = None,
    upper: int | str | None = None,
    partitions: int = 8,
    **options: str,
) -> DataFrame:
    """JDBC table; with a partition column the read runs as ``partitions`` range queries."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_col is not None:
        reader = (
            reader.option("partitionColumn", partition_col)
            .option("lowerBound", str(lower))
            .option("upperBound", str(upper))
            .option("numPartitions", str(partitions))
        )
    return reader.load()


def collection_schema(df: DataFrame, json_column: str) -> DataFrame:
    """One row with the merged schema of all documents in a JSON text column."""
    parsed = F.try_parse_json(F.col(quote(json_column)))
    return df.agg(
        F.count(F.col(quote(json_column))).alias("documents"),
        F.count(parsed).alias("parsed"),
        F.schema_of_variant_agg(parsed).alias("schema"),
    )


def document_fields(df: DataFrame, json_column: str) -> DataFrame:
    """Top-level keys of a JSON text column with how many documents carry each."""
    keys = F.explode(F.json_object_keys(F.col(quote(json_column)))).alias("field")
    return df.select(keys).groupBy("field").agg(F.count(F.lit(1)).alias("documents"))
