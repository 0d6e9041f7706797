"""Column packing shared by the operators: a row's own columns never meet the working ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST_ID = (1 << 63) - 1


def packed(docs: DataFrame, **working: Column) -> DataFrame:
    """One struct ``row`` with every column of ``docs`` beside the working columns, whatever their names."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in working.items()])


def unpacked(frame: DataFrame, docs: DataFrame, **replaced: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them replaced."""
    return frame.select(*[replaced.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def ordered_id(column: str = "doc_id") -> Column:
    """Document id in which a missing one comes after all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))
