"""Group S: stream forms of counts, checks and alerts, run over the events file to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.queries.exploring import rounded
from millrace.queries.quality import CHI2, CHI2_VALUE, CUT
from millrace.queries.registry import query
from millrace.queries.sources import _scratch
from millrace.streaming import alerts, quality, runner, windows


def event_stream(t):
    return runner.file_stream(t.spark, t.folder, "events.parquet", t.events.schema)


def _local(df):
    """Window bounds back to the zone-less clock of the files."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in ("start", "end") else F.col(c) for c in df.columns])


@query(
    "s1_tumbling_counts",
    "SELECT event_type, date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", count(*) AS n FROM events GROUP BY event_type, date_trunc('hour', ts)",
)
def s1_tumbling_counts(t):
    return _local(runner.drain_updates(windows.window_counts(event_stream(t), "ts", "1 hour", by=["event_type"]), _scratch(t, "tumbling"), ["event_type", "start", "end"]))


@query(
    "s1_sliding_counts",
    """SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start, date_trunc('hour', ts) - INTERVAL 1 HOUR * k + INTERVAL 2 HOUR AS "end", count(*) AS n
       FROM events, (VALUES (0), (1)) s(k) GROUP BY 1, 2""",
)
def s1_sliding_counts(t):
    return _local(runner.drain_updates(windows.window_counts(event_stream(t), "ts", "2 hours", "1 hour"), _scratch(t, "sliding"), ["start", "end"]))


@query(
    "s1_session_counts",
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
       SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, s""",
)
def s1_session_counts(t):
    return _local(runner.drain_sessions(windows.session_updates(event_stream(t), "ts", 1800, ["user_id"]), _scratch(t, "sessions"), ["user_id"]))


@query(
    "s2_window_checks",
    """SELECT date_trunc('hour', ts) AS start, 'value' AS "column", count(*) AS n, count(*) - count(value) AS nulls, count(*) FILTER (WHERE isinf(value)) AS infinite, count(DISTINCT value) <= 1 AS constant FROM events GROUP BY 1
       UNION ALL SELECT date_trunc('hour', ts), 'event_type', count(*), count(*) - count(event_type), 0, count(DISTINCT event_type) <= 1 FROM events GROUP BY 1""",
)
def s2_window_checks(t):
    path = _scratch(t, "checks")
    handle = lambda batch: quality.batch_checks(batch, "ts", "1 hour", ["value", "event_type"], ["event_id"])
    runner.drain_batches(event_stream(t), quality.to_batches(handle, path))
    return _local(quality.merge_checks(t.spark.read.parquet(path)).drop("passed"))


@query(
    "s2_batch_drift",
    CHI2.replace("sum(CASE WHEN ts < " + CUT + " THEN 0 ELSE 1 END)", "count(*)")
    + f" SELECT 'event_type' AS \"column\", round(CAST({CHI2_VALUE} AS DOUBLE), 6) AS chi2, count(*) - 1 AS dof FROM k CROSS JOIN t",
)
def s2_batch_drift(t):
    path = _scratch(t, "drift")
    before = t.events.where(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))
    baseline = quality.baseline_counts(before, ["event_type"])
    runner.drain_batches(event_stream(t), quality.to_batches(lambda batch: quality.batch_drift(batch, baseline), path))
    return rounded(t.spark.read.parquet(path).drop("batch"), 6)


@query(
    "s3_zscore_alerts",
    """SELECT event_id, user_id, round((value - mean) / std, 6) AS z_score FROM events JOIN (SELECT user_id, avg(value) AS mean, stddev_samp(value) AS std FROM events GROUP BY user_id) s USING (user_id)
       WHERE abs((value - mean) / std) > 3""",
)
def s3_zscore_alerts(t):
    stats = alerts.key_statistics(t.events, ["user_id"], "value")
    found = alerts.zscore_alerts(event_stream(t), stats, ["user_id"], "value", "ts", "event_id")
    out = runner.drain_to_files(found.select("event_id", "user_id", "z_score"), _scratch(t, "alerts"))
    return rounded(out, 6)
