"""Column catalogue of a set of tables, and declared keys, as small DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.frames import small_frame


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    ref_table: str
    ref_column: str


@dataclass(frozen=True)
class Keys:
    """Declared keys; Spark tables carry none of their own."""

    primary: dict[str, tuple[str, ...]] = field(default_factory=dict)
    foreign: tuple[ForeignKey, ...] = ()


CATALOG_SCHEMA = "table string, column string, type string, ordinal int"
FK_SCHEMA = "table string, column string, ref_table string, ref_column string"


def catalog_frame(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type, ordinal) for every column of the given tables."""
    rows = [
        (name, f.name, f.dataType.simpleString(), i)
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return small_frame(spark, rows, CATALOG_SCHEMA)


def foreign_key_frame(spark: SparkSession, keys: Keys) -> DataFrame:
    rows = [(k.table, k.column, k.ref_table, k.ref_column) for k in keys.foreign]
    return small_frame(spark, rows, FK_SCHEMA)


def primary_key_frame(spark: SparkSession, keys: Keys) -> DataFrame:
    rows = [(t, c) for t, cols in keys.primary.items() for c in cols]
    return small_frame(spark, rows, "table string, column string")
