"""Windowed counts over event streams with a bound on late data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.plans.frames import col

OPEN_SESSIONS = "starts array<bigint>, lasts array<bigint>, counts array<bigint>"


def event_time(stream: DataFrame, ts: str, out: str = "event_time") -> DataFrame:
    """Zoned event time: watermarks need it, zone-less files do not carry it."""
    return stream.withColumn(out, col(ts).cast("timestamp"))


def window_counts(
    stream: DataFrame, ts: str, size: str, slide: str | None = None, by: Sequence[str] = (), late: str = "1 hour"
) -> DataFrame:
    """Tumbling (no ``slide``) or sliding counts: (by..., start, end, n)."""
    w = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    counted = event_time(stream, ts).withWatermark("event_time", late).groupBy(w.alias("w"), *[col(b) for b in by])
    return counted.agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def session_counts(stream: DataFrame, ts: str, gap: str, by: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Sessions per key closed by ``gap`` of silence: (by..., start, end, n)."""
    w = F.session_window("event_time", gap)
    counted = event_time(stream, ts).withWatermark("event_time", late).groupBy(w.alias("w"), *[col(b) for b in by])
    return counted.agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _merge_sessions(starts: np.ndarray, lasts: np.ndarray, counts: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sessions after joining those less than ``gap`` apart."""
    order = np.argsort(starts, kind="stable")
    starts, lasts, counts = starts[order], lasts[order], counts[order]
    if not len(starts):
        return starts, lasts, counts
    reach = np.maximum.accumulate(lasts)
    first = np.flatnonzero(np.append(True, starts[1:] - reach[:-1] >= gap))
    return starts[first], np.maximum.reduceat(lasts, first), np.add.reduceat(counts, first)


def session_updates(stream: DataFrame, ts: str, gap_seconds: float, by: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Sessions per key as they grow: (by..., start, end, n), for update mode.

    State of a key is its open sessions only. A session whose end lies at or before the watermark is closed and forgotten,
    a key without open sessions has no state, and rows before the watermark change nothing. Where an earlier row moves a
    session's start, or joins two, the row of the former start comes again with n = 0; the newest row of (by..., start)
    with n > 0 is the result (``runner.drain_sessions``). Rows without a time take no part; a missing key is a key.
    """
    gap = round(gap_seconds * 1_000_000)
    by = list(by)
    timed = event_time(stream, ts).withWatermark("event_time", late)
    rows = timed.select(*[col(b) for b in by], "event_time", F.unix_micros("event_time").alias("_at"))
    fields = [rows.schema[b] for b in by]
    out = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("_start", "_last", "n")]])

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bound = state.getCurrentWatermarkMs() * 1000
        empty = np.zeros(0, np.int64)
        old = [np.array(v, np.int64) for v in state.get] if state.exists else [empty, empty, empty]
        now = old
        if not state.hasTimedOut:
            for chunk in chunks:
                at = chunk["_at"].dropna().to_numpy(np.int64)
                at = at[at >= bound]
                fresh = _merge_sessions(at, at, np.ones(len(at), np.int64), gap)
                now = _merge_sessions(*[np.concatenate(pair) for pair in zip(now, fresh)], gap)
        before = dict(zip(old[0].tolist(), zip(old[1].tolist(), old[2].tolist())))
        after = dict(zip(now[0].tolist(), zip(now[1].tolist(), now[2].tolist())))
        changed = [(s, *v) for s, v in after.items() if before.get(s) != v] + [(s, s, 0) for s in before if s not in after]
        still = now[1] + gap > bound
        if still.any():
            state.update(tuple(v[still].tolist() for v in now))
            state.setTimeoutTimestamp(max(int((now[1][still].min() + gap) // 1000), bound // 1000 + 1))
        elif state.exists:
            state.remove()
        if changed:
            table = {b: pd.Series([None if pd.isna(k) else k] * len(changed), dtype=object) for b, k in zip(by, key)}
            yield pd.DataFrame({**table, **{c: [row[i] for row in changed] for i, c in enumerate(("_start", "_last", "n"))}})

    found = rows.groupBy(*by).applyInPandasWithState(step, out, OPEN_SESSIONS, "update", GroupStateTimeout.EventTimeTimeout)
    return found.select(*by, F.timestamp_micros("_start").alias("start"), F.timestamp_micros(F.col("_last") + gap).alias("end"), "n")
