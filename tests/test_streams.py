"""Streams over several files equal the batch result."""

import pytest
from pyspark.sql import functions as F

from millrace.streaming import alerts, quality, runner, windows


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Events in time order, one file per range of event ids."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartitionByRange(4, "ts").write.mode("overwrite").parquet(folder)
    return folder, spark.read.parquet(folder)


def stream(spark, parts):
    return runner.file_stream(spark, parts[0], "*.parquet", parts[1].schema)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("size, slide", [("1 hour", None), ("2 hours", "30 minutes")])
def test_counts(spark, parts, tmp_path, size, slide):
    counted = windows.window_counts(stream(spark, parts), "ts", size, slide, ["event_type"], late="30 days")
    live = runner.drain_updates(counted, str(tmp_path / "w"), ["event_type", "start", "end"])
    assert rows(live) == rows(windows.window_counts(parts[1], "ts", size, slide, ["event_type"]))


def test_rows_beyond_the_bound_are_dropped(spark, parts, tmp_path):
    """Day 1, day 9, then a row of day 1 and one of day 9: only the latter still counts."""
    folder = str(tmp_path / "late")
    for k, days in enumerate(((1, 1), (9,), (9,), (1, 9))):
        frame = spark.range(len(days)).select(F.element_at(F.array(*[F.lit(f"2024-01-0{d} 10:00:00") for d in days]), (F.col("id") + 1).cast("int")).cast("timestamp_ntz").alias("ts"))
        frame.coalesce(1).write.mode("append").parquet(folder)
        __import__("time").sleep(1.1)  # files are taken in the order of their times
    live = runner.file_stream(spark, folder, "*.parquet", frame.schema)
    out = runner.drain_updates(windows.window_counts(live, "ts", "1 day", late="1 day"), str(tmp_path / "o"), ["start", "end"])
    assert sorted(r.n for r in out.collect()) == [2, 3]


def test_sessions(spark, parts, tmp_path):
    live = runner.drain_complete(windows.session_counts(stream(spark, parts), "ts", "3 hours", ["user_id"], late="30 days"), str(tmp_path / "s"))
    assert rows(live) == rows(windows.session_counts(parts[1], "ts", "3 hours", ["user_id"]))


def test_session_updates_equal_the_batch(spark, parts, tmp_path):
    live = runner.drain_sessions(windows.session_updates(stream(spark, parts), "ts", 3 * 3600, ["user_id"], late="30 days"), str(tmp_path / "u"), ["user_id"])
    assert rows(live) == rows(windows.session_counts(parts[1], "ts", "3 hours", ["user_id"]))


def test_sessions_merge_close_and_free_their_state(spark, tmp_path):
    """Out of order rows join two sessions; a row beyond the bound changes nothing; closed keys leave no state."""
    folder = str(tmp_path / "in")
    batches = (
        [("a", "01 10:00"), ("a", "01 11:30"), (None, "01 10:00"), ("b", None)],
        [("a", "01 10:50"), ("a", "01 09:30")],
        [("a", "05 10:00")],
        [("a", "01 10:10"), ("z", "01 10:10"), ("a", "05 10:20"), ("a", "09 10:00")],
    )
    for batch in batches:
        frame = spark.createDataFrame(batch, "k string, t string").select("k", F.expr("CAST('2024-01-' || t || ':00' AS TIMESTAMP_NTZ)").alias("ts"))
        frame.coalesce(1).write.mode("append").parquet(folder)
        __import__("time").sleep(1.1)
    live = windows.session_updates(runner.file_stream(spark, folder, "*.parquet", frame.schema), "ts", 3600, ["k"], late="3 hours")
    seen = []
    query = (
        live.writeStream.outputMode("update").foreachBatch(lambda b, i: seen.extend((i, *r) for r in b.selectExpr("k", "date_format(start, 'dd HH:mm')", "n").collect()))
        .option("checkpointLocation", runner._checkpoint(spark)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    newest = {}
    for _, k, start, n in seen:
        newest[k, start] = n
    assert {x: n for x, n in newest.items() if n} == {("a", "01 09:30"): 4, (None, "01 10:00"): 1, ("a", "05 10:00"): 2, ("a", "09 10:00"): 1}
    assert left == 1  # the last session lies within the bound of the newest row


def test_sessions_of_an_empty_stream(spark, tmp_path):
    folder = str(tmp_path / "none")
    spark.range(0).selectExpr("id AS user_id", "CAST(NULL AS TIMESTAMP_NTZ) AS ts").write.parquet(folder)
    live = windows.session_updates(runner.file_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema), "ts", 60, ["user_id"])
    out = runner.drain_sessions(live, str(tmp_path / "o"), ["user_id"])
    assert out.columns == ["user_id", "start", "end", "n"] and out.count() == 0


def test_checks_merge_over_batches(spark, parts, tmp_path):
    handle = lambda b: quality.batch_checks(b, "ts", "1 day", ["value", "event_type"], ["event_id"])
    runner.drain_batches(stream(spark, parts), quality.to_batches(handle, str(tmp_path / "c")))
    live = spark.read.parquet(str(tmp_path / "c"))
    assert live.select("batch").distinct().count() > 1
    whole = quality.merge_checks(quality.batch_checks(parts[1], "ts", "1 day", ["value", "event_type"], ["event_id"]))
    assert rows(quality.merge_checks(live)) == rows(whole)


def test_replayed_batch_counts_once(spark, parts, tmp_path):
    write = quality.to_batches(lambda b: b.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "r"))
    write(parts[1], 0)
    write(parts[1], 0)
    assert spark.read.parquet(str(tmp_path / "r")).agg(F.sum("n")).first()[0] == parts[1].count()


def test_alerts_drop_redelivered_events(spark, parts, tmp_path):
    twice = str(tmp_path / "twice")
    parts[1].unionByName(parts[1]).coalesce(1).write.parquet(twice)
    live = runner.file_stream(spark, twice, "*.parquet", parts[1].schema)
    stats = alerts.key_statistics(parts[1], ["event_type"], "value")
    found = alerts.zscore_alerts(live, stats, ["event_type"], "value", "ts", "event_id", 2.0, late="60 days")
    out = runner.drain_to_files(found.select("event_id", "z_score"), str(tmp_path / "out"))
    batch = parts[1].join(stats, "event_type").withColumn("z", (F.col("value") - F.col("mean")) / F.col("std")).where("abs(z) > 2")
    assert out.count() == batch.count() > 0


def test_drift_per_batch(spark, parts, tmp_path):
    counts = quality.baseline_counts(parts[1], ["event_type"])
    runner.drain_batches(stream(spark, parts), quality.to_batches(lambda b: quality.batch_drift(b, counts), str(tmp_path / "d")))
    assert spark.read.parquet(str(tmp_path / "d")).where("chi2 >= 0").count() > 1
