"""Group I: operational logs over events, trade tables and conversations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from millrace.operators import logs as lg
from millrace.operators.clean.log import log_df, log_summary
from millrace.operators.clean.run import clean, save_result
from millrace.queries.registry import query
from millrace.queries.sources import _scratch

AS_OF = date(2024, 1, 20)
AUDIT = {
    "today": "ts >= DATE '2024-01-20'",
    "yesterday": "ts >= DATE '2024-01-19' AND ts < DATE '2024-01-20'",
    "last 7 days": "ts >= DATE '2024-01-13'",
    "last 30 days": "ts >= DATE '2023-12-21'",
}


@query(
    "i1_audit_windows",
    " UNION ALL ".join(f"SELECT '{w}' AS span, event_id, user_id FROM events WHERE event_type = 'error' AND {p}" for w, p in AUDIT.items()),
)
def i1_audit_windows(t):
    out = None
    for w in lg.WINDOWS:
        part = lg.audit_query(t.events, action="error", window=w, as_of=AS_OF, action_col="event_type").select(F.lit(w).alias("span"), "event_id", "user_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("i1_audit_user", "SELECT event_id, ts FROM events WHERE user_id = 7 AND event_type = 'purchase'")
def i1_audit_user(t):
    return lg.audit_query(t.events, user=7, action="purchase", user_col="user_id", action_col="event_type").select("event_id", "ts")


@query("i2_keep_latest", "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) x WHERE n <= 20")
def i2_keep_latest(t):
    return lg.keep_latest(t.events, ["user_id"], "ts", 20, ["event_id"]).select("event_id", "user_id")


@query("i3_recent", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20")
def i3_recent(t):
    return lg.recent(t.events, "ts", 20, ["event_id"]).select("event_id", "ts")


def entries(t):
    """Every customer, supplier and nation as an artifact with the artifacts it is made of."""
    name = lambda kind, key: F.concat(F.lit(kind + ":"), F.col(key).cast("string"))
    make = lambda df, kind, key, parent, ref: df.select(name(kind, key).alias("artifact"), F.lit(kind).alias("type"), F.array(name(parent, ref)).alias("sources"))
    lines = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("s")).select(
        name("book", "o_custkey").alias("artifact"), F.lit("book").alias("type"),
        F.concat(F.transform("s", lambda v: F.concat(F.lit("status:"), v)), F.array(name("customer", "o_custkey"))).alias("sources"),
    )
    return (
        make(t.nation, "nation", "n_nationkey", "region", "n_regionkey")
        .unionByName(make(t.customer, "customer", "c_custkey", "nation", "c_nationkey"))
        .unionByName(make(t.supplier, "supplier", "s_suppkey", "nation", "s_nationkey"))
        .unionByName(lines)
    )


EDGES = """(SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'nation' AS dst_type FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'customer' FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'supplier' FROM supplier
  UNION ALL SELECT DISTINCT 'status:' || o_orderstatus, 'book:' || o_custkey, 'book' FROM orders
  UNION ALL SELECT DISTINCT 'customer:' || o_custkey, 'book:' || o_custkey, 'book' FROM orders)"""


@query("i4_lineage_edges", f"SELECT * FROM {EDGES} e")
def i4_lineage_edges(t):
    return lg.lineage_edges(entries(t))


@query(
    "i4_lineage_search",
    f"""SELECT dst AS artifact, min(dst_type) AS type, CASE WHEN dst LIKE '%nation:1%' THEN 'artifact' ELSE 'source' END AS found_in FROM {EDGES} e
        WHERE dst LIKE '%nation:1%' OR src LIKE '%nation:1%' GROUP BY dst""",
)
def i4_lineage_search(t):
    return lg.lineage_search(entries(t), "NATION:1")


@query(
    "i5_lineage_downstream",
    f"""WITH RECURSIVE e AS (SELECT * FROM {EDGES} x), r(node, depth) AS (SELECT dst, 1 FROM e WHERE src = 'region:1' UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node)
        SELECT node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY node""",
)
def i5_lineage_downstream(t):
    return lg.lineage_closure(lg.lineage_edges(entries(t)), "region:1")


@query(
    "i5_lineage_upstream",
    f"""WITH RECURSIVE e AS (SELECT * FROM {EDGES} x), r(node, depth) AS (SELECT src, 1 FROM e WHERE dst = 'book:7' UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node)
        SELECT node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY node""",
)
def i5_lineage_upstream(t):
    return lg.lineage_closure(lg.lineage_edges(entries(t)), "book:7", "upstream")


@query("i6_filter_tags", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src7'")
def i6_filter_tags(t):
    docs = t.documents.select("doc_id", F.array("lang", F.lit("document")).alias("tags"), F.col("source").alias("author"))
    return lg.filter_tags(docs, "en", "src7").select("doc_id")


def _turns(t):
    return t.conversations.select(
        F.concat_ws("/", "conv_id", "turn").alias("event_id"), F.col("conv_id").alias("group"), F.col("role").alias("actor"),
        F.when(F.length("text") > 200, "long").otherwise("short").alias("type"),
    )


TURNS = "(SELECT conv_id || '/' || turn AS event_id, conv_id AS grp, role AS actor, CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END AS type FROM conversations)"


@query("i7_fan_out", f"SELECT event_id, member, type FROM {TURNS} x JOIN (SELECT DISTINCT conv_id AS g, role AS member FROM conversations) m ON g = grp WHERE member <> actor AND type IN ('long', 'short')")
def i7_fan_out(t):
    members = t.conversations.select(F.col("conv_id").alias("group"), F.col("role").alias("member")).distinct()
    return lg.fan_out(_turns(t), members, ["long", "short"]).select("event_id", "member", "type")


@query("i7_unread_counts", f"SELECT member, type, count(*) AS unread FROM {TURNS} x JOIN (SELECT DISTINCT conv_id AS g, role AS member FROM conversations) m ON g = grp WHERE member <> actor GROUP BY member, type")
def i7_unread_counts(t):
    members = t.conversations.select(F.col("conv_id").alias("group"), F.col("role").alias("member")).distinct()
    return lg.unread_counts(lg.fan_out(_turns(t), members))


@query(
    "i8_rank_by_latest",
    """WITH v AS (SELECT conv_id, turn, role FROM conversations WHERE NOT (role = 'system') OR role = 'user')
       SELECT v.conv_id, v.turn, v.role, l.latest FROM v JOIN (SELECT conv_id, max(turn) AS latest FROM v GROUP BY conv_id) l ON l.conv_id = v.conv_id""",
)
def i8_rank_by_latest(t):
    rows = t.conversations.withColumn("private", F.col("role") == "system")
    return lg.rank_by_latest(rows, "conv_id", "user", ts="turn", author="role").select("conv_id", "turn", "role", "latest")


def _clean_input(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("o_orderkey") % 9 != 0, F.col("c_mktsegment")).alias("segment"),
        "o_orderpriority",
        F.col("c_nationkey").alias("nation"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("outcome_flag"),
        (F.col("o_totalprice") / 1000 + F.col("o_orderkey") % 7).alias("target_cost"),
    )


@query("f42_transformation_log")
def f42_transformation_log(t):
    result = clean(_clean_input(t), "target_cost", key=["o_orderkey"])
    return log_summary(log_df(t.spark, result.log))


@query("f43_clean_run")
def f43_clean_run(t):
    return clean(_clean_input(t), "target_cost", key=["o_orderkey"]).data


CLEAN = "(SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN value END AS value, CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS DOUBLE) END AS member FROM events)"


CLEAN_VALUES = f"""WITH s AS (SELECT CASE WHEN abs(skewness(value)) > 2 THEN quantile_cont(value, 0.5) ELSE avg(value) END AS fv, avg(member) AS fm FROM {CLEAN} c),
        f AS (SELECT event_id, coalesce(value, fv) AS value, coalesce(member, fm) AS member FROM {CLEAN} c, s),
        k AS (SELECT kurtosis(value) AS kv, quantile_cont(value, 0.25) AS v1, quantile_cont(value, 0.75) AS v3, quantile_cont(member, 0.25) AS m1, quantile_cont(member, 0.75) AS m3, count(*) AS n FROM f),
        o AS (SELECT value AS x, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM f),
        w AS (SELECT max(CASE WHEN i = CAST(floor(0.01 * n) AS INT) + 1 THEN x END) AS lo, max(CASE WHEN i = n - CAST(floor(0.01 * n) AS INT) THEN x END) AS hi FROM o),
        c AS (SELECT event_id, CASE WHEN kv > 7 THEN least(greatest(value, lo), hi) ELSE least(greatest(value, v1 - 1.5 * (v3 - v1)), v3 + 1.5 * (v3 - v1)) END AS value,
          least(greatest(member, m1 - 1.5 * (m3 - m1)), m3 + 1.5 * (m3 - m1)) AS member FROM f, k, w),
        z AS (SELECT skewness(value) AS sv, avg(value) AS av, stddev_pop(value) AS dv, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3, avg(member) AS am, stddev_pop(member) AS dm FROM c)
        SELECT event_id, round(CASE WHEN abs(sv) > 1 THEN (value - q2) / (q3 - q1) ELSE (value - av) / dv END, 3) AS value, round((member - am) / dm, 3) AS member FROM c, z"""


def _holed_events(t):
    k = F.col("event_id")
    return t.events.select(
        "event_id",
        F.when(k % 6 != 0, F.col("value")).alias("value"),
        F.when(k % 5 != 0, F.col("user_id").cast("double")).alias("member"),
    )


def _three_decimals(data):
    return data.select(F.col("event_id").cast("bigint"), *[F.round(F.col(c).cast("double"), 3).alias(c) for c in ("value", "member")])


@query("f43_clean_values", CLEAN_VALUES)
def f43_clean_values(t):
    return _three_decimals(clean(_holed_events(t), None, key=["event_id"]).data)


@query("f44_replay", CLEAN_VALUES)
def f44_replay(t):
    """The fitted steps on the rows they were fitted on."""
    df = _holed_events(t)
    return _three_decimals(clean(df, None, key=["event_id"]).apply(df))


@query(
    "f43_clean_times",
    """WITH g AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts FROM events)
       SELECT event_id, coalesce(last_value(ts IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         first_value(ts IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS ts FROM g""",
)
def f43_clean_times(t):
    df = t.events.select("event_id", "value", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"))
    return clean(df, None, key=["event_id"]).data.select(F.col("event_id").cast("bigint"), "ts")


@query("f44_saved_result")
def f44_saved_result(t):
    path = _scratch(t, "cleaned")
    save_result(clean(_clean_input(t), "target_cost", key=["o_orderkey"]), path)
    return t.spark.read.parquet(f"{path}/data")



