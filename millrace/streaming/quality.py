"""Quality checks and drift on micro-batches, through the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.quality.drift import category_counts, drift_of_counts
from millrace.plans.frames import col
from millrace.plans.lineage import cut_lineage
from millrace.streaming.windows import event_time


def batch_checks(batch: DataFrame, ts: str, size: str, cols: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(start, column, n, nulls, infinite): mergeable check counts per event-time window."""
    timed = event_time(batch, ts).withColumn("start", F.window("event_time", size)["start"])
    aggs = [F.count(F.lit(1)).alias("n")]
    records = []
    for i, c in enumerate(cols):
        x = col(c)
        numeric = batch.schema[c].dataType.typeName() in ("double", "float")
        infinite = F.count_if(x.isin(float("inf"), float("-inf"))) if numeric else F.lit(0).cast("bigint")
        aggs += [F.count_if(x.isNull()).alias(f"u{i}"), infinite.alias(f"f{i}"), F.min(x.cast("string")).alias(f"lo{i}"), F.max(x.cast("string")).alias(f"hi{i}")]
        records.append(
            F.struct(
                F.lit(c).alias("column"), F.col("n"), F.col(f"u{i}").alias("nulls"), F.col(f"f{i}").alias("infinite"),
                F.col(f"lo{i}").alias("low"), F.col(f"hi{i}").alias("high"),
            )
        )
    return timed.groupBy("start").agg(*aggs).select("start", F.inline(F.array(*records)))


def merge_checks(parts: DataFrame) -> DataFrame:
    """Combine the partial counts of all batches into one verdict per window and column."""
    return parts.groupBy("start", "column").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("infinite").alias("infinite"),
        (F.min("low").eqNullSafe(F.max("high"))).alias("constant"),
    ).withColumn("passed", (F.col("nulls") == 0) & (F.col("infinite") == 0) & ~F.col("constant"))


def baseline_counts(baseline: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """Category counts of the baseline, made once and kept in the checkpoint folder for all batches."""
    return {c: cut_lineage(category_counts(baseline, c)) for c in columns}


def batch_drift(batch: DataFrame, baseline: dict[str, DataFrame]) -> DataFrame:
    """(column, chi2, dof) of one batch against the kept counts of a baseline."""
    out = None
    for c, counts in baseline.items():
        part = drift_of_counts(counts, category_counts(batch, c)).select(F.lit(c).alias("column"), "chi2", "dof")
        out = part if out is None else out.unionByName(part)
    return out


def to_batches(handle: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function writing each batch's result under its own id.

    A batch replayed after a failure overwrites its folder, so results count once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            handle(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write
