"""Join forms the SQL surface needs beyond a plain equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.frames import col


def range_join(
    points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float
) -> DataFrame:
    """Rows with ``low <= point < high`` through a bucketed equi-join.

    Every range is replicated to the buckets of ``width`` it touches, so the join shuffles
    on a key instead of comparing all pairs. Choose ``width`` near the usual range length.
    """
    b_points = points.withColumn("_bucket", F.floor(col(point) / F.lit(width)))
    b_ranges = ranges.withColumn(
        "_range_bucket",
        F.explode(F.sequence(F.floor(col(low) / F.lit(width)), F.floor(col(high) / F.lit(width)))),
    )
    return (
        b_points.join(b_ranges, F.col("_bucket") == F.col("_range_bucket"))
        .where((col(point) >= col(low)) & (col(point) < col(high)))
        .drop("_bucket", "_range_bucket")
    )
