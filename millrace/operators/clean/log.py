"""Transformation log of a cleaning run."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.frames import small_frame

LOG_SCHEMA = (
    "ts timestamp, stage string, action string, column string, reason string, before string, after string, severity string"
)


@dataclass
class TransformationLog:
    """A few records per column and step, kept on the driver."""

    entries: list[tuple] = field(default_factory=list)

    def add(self, stage, action, column=None, reason=None, before=None, after=None, severity="info") -> None:
        text = lambda v: None if v is None else str(v)
        self.entries.append(
            (datetime.now(timezone.utc), stage, action, column, text(reason), text(before), text(after), severity)
        )

    def warn(self, stage, action, **details) -> None:
        self.add(stage, action, severity="warning", **details)

    def critical(self, stage, action, **details) -> None:
        self.add(stage, action, severity="critical", **details)


def log_df(spark: SparkSession, log: TransformationLog, severity: str | None = None) -> DataFrame:
    df = small_frame(spark, log.entries, LOG_SCHEMA)
    return df.where(F.col("severity") == severity) if severity else df


def log_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("stage", "severity").agg(F.count(F.lit(1)).alias("n"))
