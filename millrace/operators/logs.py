"""Queries over operational logs: audit trail, versions, lineage, tags, notifications, comments."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.frames import col
from millrace.plans.lineage import cut_lineage

WINDOWS = ("today", "yesterday", "last 7 days", "last 30 days")

#: Frontiers of a closure that are read side by side before they are written as one.
HOPS_KEPT_APART = 8


def audit_query(
    log: DataFrame,
    *,
    user: object = None,
    action: str | None = None,
    window: str | None = None,
    as_of: date | None = None,
    ts: str = "ts",
    user_col: str = "user",
    action_col: str = "action",
) -> DataFrame:
    """Log rows by user, action and relative date window, newest first."""
    today = F.lit(as_of) if as_of else F.current_date()
    if user is not None:
        log = log.where(col(user_col) == F.lit(user))
    if action is not None:
        log = log.where(col(action_col) == F.lit(action))
    if window == "today":
        log = log.where(col(ts) >= today)
    elif window == "yesterday":
        log = log.where((col(ts) >= F.date_sub(today, 1)) & (col(ts) < today))
    elif window == "last 7 days":
        log = log.where(col(ts) >= F.date_sub(today, 7))
    elif window == "last 30 days":
        log = log.where(col(ts) >= F.date_sub(today, 30))
    elif window is not None:
        raise ValueError(f"window must be one of {WINDOWS}")
    return log.orderBy(F.desc(ts))


def keep_latest(df: DataFrame, key: Sequence[str], ts: str, n: int = 20, tie: Sequence[str] = ()) -> DataFrame:
    """Newest ``n`` rows per key; each task drops all but its own newest ``n`` before the shuffle."""
    order = Window.partitionBy(*key).orderBy(F.desc(ts), *tie)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def recent(df: DataFrame, ts: str, n: int = 20, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(ts), *tie).limit(n)


def lineage_edges(entries: DataFrame) -> DataFrame:
    """(src, dst, dst_type) from (artifact, type, sources)."""
    return entries.select(F.explode("sources").alias("src"), F.col("artifact").alias("dst"), F.col("type").alias("dst_type"))


def lineage_search(entries: DataFrame, term: str) -> DataFrame:
    """Artifacts whose own name or one of whose sources contains the term (any case)."""
    needle = term.lower()
    own = F.lower("artifact").contains(needle)
    source = F.exists("sources", lambda s: F.lower(s).contains(needle))
    return entries.where(own | source).select("artifact", "type", F.when(own, "artifact").otherwise("source").alias("found_in"))


def lineage_closure(edges: DataFrame, node: str, direction: str = "downstream") -> DataFrame:
    """(node, depth): everything reachable from ``node``, with the smallest number of hops.

    One join per hop over the frontier only; visited nodes never come back, so it ends with the last
    new node, however deep the chain. Frontiers are appended, and joined into one every few hops.
    """
    if direction not in ("downstream", "upstream"):
        raise ValueError("direction must be downstream or upstream")
    a, b = ("src", "dst") if direction == "downstream" else ("dst", "src")
    hops = edges.select(col(a).alias("node"), col(b).alias("next")).distinct()
    seen = edges.sparkSession.createDataFrame([(node, 0)], "node string, depth int")
    frontier, depth = seen, 0
    while True:
        depth += 1
        fresh = hops.join(frontier.select("node"), "node").select(F.col("next").alias("node")).distinct()
        frontier = cut_lineage(fresh.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen.where("depth > 0")
        seen = seen.unionByName(frontier)
        if depth % HOPS_KEPT_APART == 0:
            seen = cut_lineage(seen)


def filter_tags(df: DataFrame, tag: str | None = None, author: object = None, tags: str = "tags", author_col: str = "author") -> DataFrame:
    if tag is not None:
        df = df.where(F.array_contains(col(tags), tag))
    if author is not None:
        df = df.where(col(author_col) == F.lit(author))
    return df


def fan_out(events: DataFrame, members: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """One notification per event and member of its group, the actor left out.

    ``events`` is (event_id, group, actor, type), ``members`` (group, member).
    """
    if types is not None:
        events = events.where(F.col("type").isin(list(types)))
    return events.join(members, "group").where(F.col("member") != F.col("actor"))


def unread_counts(notifications: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """Unread notifications per member and type; ``read`` is (event_id, member)."""
    if read is not None:
        notifications = notifications.join(read, ["event_id", "member"], "left_anti")
    return notifications.groupBy("member", "type").agg(F.count(F.lit(1)).alias("unread"))


def rank_by_latest(
    rows: DataFrame, item: str, viewer: object, *, ts: str = "ts", author: str = "author", private: str = "private", tie: Sequence[str] = ()
) -> DataFrame:
    """Visible comments with the newest time of their item, ordered by it and newest first inside.

    Private rows show to their author only.
    """
    visible = rows.where(~col(private) | (col(author) == F.lit(viewer)))
    latest = visible.groupBy(col(item).alias("_item")).agg(F.max(ts).alias("latest"))
    joined = visible.join(latest, col(item) == F.col("_item")).drop("_item")
    return joined.orderBy(F.desc("latest"), item, F.desc(ts), *tie)
