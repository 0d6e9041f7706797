"""Z-score alerts against stored statistics, each event once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.frames import col
from millrace.streaming.windows import event_time


def key_statistics(history: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., mean, std) for the static side of the alert join."""
    x = col(value).cast("double")
    return history.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))


def zscore_alerts(
    stream: DataFrame, statistics: DataFrame, by: Sequence[str], value: str, ts: str, event_id: str,
    threshold: float = 3.0, late: str = "1 hour",
) -> DataFrame:
    """Events whose z-score exceeds the threshold for their key; redelivered events are dropped."""
    once = event_time(stream, ts).withWatermark("event_time", late).dropDuplicatesWithinWatermark([event_id])
    joined = once.join(statistics, list(by))
    z = F.try_divide(col(value) - F.col("mean"), F.col("std"))
    return joined.withColumn("z_score", z).where(F.abs("z_score") > threshold)
