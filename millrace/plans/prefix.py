"""Running totals over an ordered value without a single-task window.

A global ``SUM() OVER (ORDER BY v)`` sends every row to one task. Here values are first
counted (map-side combined, so a hot value is one row), then cut into range buckets at
approximate quantiles, summed per bucket, and the bucket offsets - one small row per
group and bucket - are added back to a running total taken inside each bucket.
The bucket number is a plain column derived from literal boundaries, so a task that is
recomputed after an executor loss lands on the same bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.frames import col, is_temporal

ROWS_PER_BUCKET = 500_000
MAX_BUCKETS = 8_192
FIRST_BUCKETS = 64


def order_number(df: DataFrame, order: str) -> Column:
    """The order column as a double that sorts alike (times through their epoch seconds)."""
    if is_temporal(df.schema[order].dataType):
        return col(order).cast("timestamp").cast("double")
    return col(order).cast("double")


def range_boundaries(df: DataFrame, order: str, buckets: int | None = None) -> list[float]:
    """Sorted distinct cut points that split ``order`` into buckets of similar row count."""
    number = order_number(df, order)
    # one pass finds the row count and enough cut points for most tables
    probs = [i / FIRST_BUCKETS for i in range(1, FIRST_BUCKETS)]
    rows, cuts = df.agg(F.count(number), F.percentile_approx(number, probs, 10_000)).first()
    if buckets is None:
        buckets = min(MAX_BUCKETS, rows // ROWS_PER_BUCKET + 1)
    if buckets <= 1 or not cuts:
        return []
    if buckets <= FIRST_BUCKETS:
        cuts = [cuts[round(i * FIRST_BUCKETS / buckets) - 1] for i in range(1, buckets)]
    else:
        probs = [i / buckets for i in range(1, buckets)]
        cuts = df.agg(F.percentile_approx(number, probs, 4 * buckets)).first()[0]
    return sorted(set(cuts))


def with_bucket(df: DataFrame, order: str, cuts: Sequence[float], out: str = "bucket") -> DataFrame:
    """Add the range bucket of ``order`` (binary search over the literal cut points)."""
    if not cuts:
        return df.withColumn(out, F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    keyed = df.withColumn("_order_double", order_number(df, order))
    cutter = Bucketizer(splits=splits, inputCol="_order_double", outputCol=out, handleInvalid="keep")
    return cutter.transform(keyed).drop("_order_double")


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    *,
    buckets: int | None = None,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Rows (by..., order, sums..., cum_<sum>..., all_<sum>...) per distinct order value.

    ``sums`` are summed per distinct value first. ``cum_`` is the total up to and including
    the value in ascending order, ``all_`` the total of the whole group. NULL order values
    take no part. ``order`` is a number, date or timestamp column.
    """
    by = list(by)
    df = df.where(col(order).isNotNull())
    if cuts is None:
        cuts = range_boundaries(df, order, buckets)
    counted = df.groupBy(*by, order).agg(*[F.sum(col(s)).alias(s) for s in sums])
    cut = with_bucket(counted, order, cuts)

    totals = cut.groupBy(*by, "bucket").agg(*[F.sum(col(s)).alias(f"_t_{s}") for s in sums])
    # one row per (group, bucket): at most MAX_BUCKETS rows inside any window partition
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = over.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "bucket",
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(over).alias(f"all_{s}") for s in sums],
    )
    inside = (
        Window.partitionBy(*by, "bucket")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = cut.select("*", *[F.sum(s).over(inside).alias(f"_i_{s}") for s in sums])
    joined = _join_null_safe(joined, offsets, [*by, "bucket"])
    return joined.select(
        *by,
        order,
        *sums,
        *[(col(f"_i_{s}") + col(f"_o_{s}")).alias(f"cum_{s}") for s in sums],
        *[col(f"all_{s}") for s in sums],
    )


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.select(*[col(k).alias(f"_k_{k}") if k in keys else col(k) for k in right.columns])
    condition = F.lit(True)
    for k in keys:
        condition = condition & col(k).eqNullSafe(col(f"_k_{k}"))
    return left.join(renamed, condition).drop(*[f"_k_{k}" for k in keys])


def row_positions(
    df: DataFrame,
    order: str,
    tie: Sequence[str] = (),
    by: Sequence[str] = (),
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Add ``position`` (1-based rank in ``order`` within ``by``, ties broken by ``tie``) and ``total``.

    A group is ranked through range buckets of the order column, so a hot group is spread
    over many tasks; only rows of one and the same order value stay together.
    """
    by = list(by)
    df = df.where(col(order).isNotNull())
    if cuts is None:
        cuts = range_boundaries(df, order)
    cut = with_bucket(df, order, cuts)
    totals = cut.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(group).alias("total"),
    )
    inside = Window.partitionBy(*by, "bucket").orderBy(order, *tie)
    ranked = cut.withColumn("_row", F.row_number().over(inside))
    return (
        _join_null_safe(ranked, offsets, [*by, "bucket"])
        .withColumn("position", F.col("_row") + F.col("_offset"))
        .drop("_row", "_offset", "bucket")
    )
