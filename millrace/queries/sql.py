"""Group B: the SQL surface, one query per expected feature."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.joins import range_join
from millrace.operators.sql import run_batch, run_sql
from millrace.plans.quantiles import group_quantiles
from millrace.queries.registry import query
from millrace.sources.writers import append_rows
from millrace.queries.sources import _scratch

B1 = """
SELECT l_returnflag, l_linestatus, count(*) AS lines, round(sum(l_quantity), 2) AS qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-01-01 00:00:00'
GROUP BY l_returnflag, l_linestatus
"""


@query("b1_run_sql", B1)
def b1_run_sql(t):
    return run_sql(t.spark, t.some("lineitem"), B1.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


@query(
    "b2_run_batch",
    """SELECT n.n_name AS nation, round(sum(o_totalprice), 2) AS total
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey
       WHERE o_orderstatus = 'F' GROUP BY n.n_name""",
)
def b2_run_batch(t):
    return run_batch(
        t.spark,
        t.some("orders", "customer", "nation"),
        [
            "CREATE OR REPLACE TEMPORARY VIEW closed_orders AS SELECT * FROM orders WHERE o_orderstatus = 'F'",
            """CREATE OR REPLACE TEMPORARY VIEW closed_by_nation AS
               SELECT c_nationkey, o_totalprice FROM closed_orders JOIN customer ON o_custkey = c_custkey""",
            """SELECT n_name AS nation, round(sum(o_totalprice), 2) AS total
               FROM closed_by_nation JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
        ],
    )


@query(
    "b3_parameters",
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE o_orderstatus = 'O' AND o_totalprice > 250000.5 AND o_custkey < 700
         AND o_orderdate >= DATE '1997-01-01' AND true""",
)
def b3_parameters(t):
    return run_sql(
        t.spark,
        t.some("orders"),
        """SELECT o_orderkey, o_totalprice FROM orders
           WHERE o_orderstatus = :status AND o_totalprice > :floor AND o_custkey < :cust
             AND o_orderdate >= :since AND :enabled""",
        {"status": "O", "floor": "250000.5", "cust": "700", "since": date(1997, 1, 1), "enabled": "true"},
        {"status": "string", "floor": "float", "cust": "integer", "since": "date", "enabled": "boolean"},
    )


@query("b4_append_rows", "SELECT count(*) AS n, count(DISTINCT c_custkey) AS keys FROM (SELECT c_custkey FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def b4_append_rows(t):
    path = _scratch(t, "append")
    append_rows(t.customer, path)
    append_rows(t.customer.where("c_acctbal < 0"), path)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("keys"))


@query(
    "b5_projection_case",
    """SELECT o_orderkey AS order_id, round(o_totalprice * 1.1, 4) AS with_tax,
       CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS size_band
       FROM orders""",
)
def b5_projection_case(t):
    price = F.col("o_totalprice")
    return t.orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.round(price * 1.1, 4).alias("with_tax"),
        F.when(price > 300000, "large").when(price > 100000, "medium").otherwise("small").alias("size_band"),
    )


@query(
    "b6_filters",
    """SELECT p_partkey, coalesce(nullif(p_type, 'PROMO'), 'none') AS kind, p_size FROM part
       WHERE p_name LIKE '%ring%' OR (p_name ILIKE 'RED%' AND p_size BETWEEN 5 AND 20)
          OR (p_brand IN ('Brand#1', 'Brand#2') AND p_retailprice IS NOT NULL)""",
)
def b6_filters(t):
    return t.part.where(
        F.col("p_name").like("%ring%")
        | (F.col("p_name").ilike("RED%") & F.col("p_size").between(5, 20))
        | (F.col("p_brand").isin("Brand#1", "Brand#2") & F.col("p_retailprice").isNotNull())
    ).select("p_partkey", F.coalesce(F.nullif("p_type", F.lit("PROMO")), F.lit("none")).alias("kind"), "p_size")


@query(
    "b7_inner_join",
    """SELECT c_mktsegment, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderpriority""",
)
def b7_inner_join(t):
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment", "o_orderpriority")
        .agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


_BIG = "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY o_custkey"
_RICH = "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000"


def _outer(kind: str) -> str:
    return f"""SELECT c.c_custkey, round(c.c_acctbal, 2) AS acctbal, b.o_custkey, b.n
               FROM ({_RICH}) c {kind} JOIN ({_BIG}) b ON c.c_custkey = b.o_custkey"""


def _outer_query(how: str):
    def build(t):
        big = t.orders.where("o_totalprice > 400000").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
        rich = t.customer.where("c_acctbal > 5000").select("c_custkey", F.round("c_acctbal", 2).alias("acctbal"))
        return rich.join(big, F.col("c_custkey") == F.col("o_custkey"), how)

    return build


for _how in ("left", "right", "full"):
    query(f"b8_{_how}_outer_join", _outer(f"{_how.upper()} OUTER"))(_outer_query(_how))


@query("b9_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def b9_cross_join(t):
    return t.region.select("r_name").crossJoin(t.nation.select("n_name"))


@query(
    "b9_self_join",
    """SELECT a.n_name AS nation, count(*) AS peers FROM nation a JOIN nation b
       ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY a.n_name""",
)
def b9_self_join(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return (
        a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey")))
        .groupBy(F.col("a.n_name").alias("nation"))
        .agg(F.count(F.lit(1)).alias("peers"))
    )


@query(
    "b9_range_join",
    """WITH bands AS (SELECT p_size AS band, min(p_retailprice) AS lo, avg(p_retailprice) AS hi FROM part GROUP BY p_size)
       SELECT band, count(*) AS parts, round(sum(p_retailprice), 2) AS total FROM part JOIN bands
       ON p_retailprice >= lo AND p_retailprice < hi GROUP BY band""",
)
def b9_range_join(t):
    bands = t.part.groupBy(F.col("p_size").alias("band")).agg(
        F.min("p_retailprice").alias("lo"), F.avg("p_retailprice").alias("hi")
    )
    return (
        range_join(t.part.select("p_retailprice"), bands, "p_retailprice", "lo", "hi", width=50.0)
        .groupBy("band")
        .agg(F.count(F.lit(1)).alias("parts"), F.round(F.sum("p_retailprice"), 2).alias("total"))
    )


@query(
    "b10_semi_anti",
    """SELECT 'with' AS side, count(*) AS customers FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
       UNION ALL SELECT 'without', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
       UNION ALL SELECT 'in', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def b10_semi_anti(t):
    big = t.orders.where("o_totalprice > 400000")
    match = F.col("o_custkey") == F.col("c_custkey")
    count = F.count(F.lit(1)).alias("customers")
    sides = [
        ("with", t.customer.join(big, match, "left_semi")),
        ("without", t.customer.join(big, match, "left_anti")),
        ("in", t.customer.join(t.orders.where("o_orderstatus = 'P'"), match, "left_semi")),
    ]
    parts = [df.agg(count).select(F.lit(name).alias("side"), "customers") for name, df in sides]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


B11 = """
SELECT s.s_suppkey, t.l_orderkey, t.l_linenumber, t.l_extendedprice
FROM supplier s, LATERAL (
  SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
  WHERE l_suppkey = s.s_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 3) t
"""


@query("b11_lateral_join", B11)
def b11_lateral_join(t):
    return run_sql(t.spark, t.some("supplier", "lineitem"), B11)


B12 = """
SELECT o_orderkey, o_totalprice FROM orders o
WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)
  AND o_totalprice > (SELECT 1.8 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)
"""


@query("b12_subqueries", B12)
def b12_subqueries(t):
    return run_sql(t.spark, t.some("orders"), B12)


B13 = """
WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
ranked AS (SELECT c_mktsegment, round(avg(total), 2) AS avg_spend, count(*) AS buyers
           FROM spend JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment)
SELECT c_mktsegment, avg_spend, buyers FROM ranked
"""


@query("b13_cte", B13)
def b13_cte(t):
    return run_sql(t.spark, t.some("orders", "customer"), B13)


B13R = """
WITH RECURSIVE months(m, last) AS (
  SELECT min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)) FROM orders
  UNION ALL
  SELECT CAST(m + INTERVAL '1' MONTH AS DATE), last FROM months WHERE m + INTERVAL '1' MONTH <= last)
SELECT m AS month_start, count(o_orderkey) AS orders
FROM months LEFT JOIN orders ON CAST(o_orderdate AS DATE) = m GROUP BY m
"""


@query("b13_recursive_cte", B13R)
def b13_recursive_cte(t):
    return run_sql(t.spark, t.some("orders"), B13R)


@query(
    "b14_group_having",
    """SELECT l_suppkey, count(*) AS lines, count(DISTINCT l_partkey) AS parts, round(sum(l_quantity), 2) AS qty,
       round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS min_discount, max(l_tax) AS max_tax
       FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > (SELECT 2.0 * 25.5 * count(*) / 200 FROM lineitem)""",
)
def b14_group_having(t):
    bar = t.lineitem.select(2.0 * 25.5 * F.count(F.lit(1)) / 200).scalar()
    return (
        t.lineitem.groupBy("l_suppkey")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.count_distinct("l_partkey").alias("parts"),
            F.sum("l_quantity").alias("q"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.min("l_discount").alias("min_discount"),
            F.max("l_tax").alias("max_tax"),
        )
        .where(F.col("q") > bar)
        .select("l_suppkey", "lines", "parts", F.round("q", 2).alias("qty"), "avg_price", "min_discount", "max_tax")
    )


def _grouping(kind: str) -> str:
    return f"""SELECT c_mktsegment, o_orderstatus, CAST(grouping(c_mktsegment) AS INT) AS g_seg, CAST(grouping(o_orderstatus) AS INT) AS g_status,
               count(*) AS orders, round(sum(o_totalprice), 2) AS total
               FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY {kind}"""


def _grouped(op: str):
    def build(t):
        joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        return getattr(joined, op)("c_mktsegment", "o_orderstatus").agg(
            F.grouping("c_mktsegment").cast("int").alias("g_seg"),
            F.grouping("o_orderstatus").cast("int").alias("g_status"),
            F.count(F.lit(1)).alias("orders"),
            F.round(F.sum("o_totalprice"), 2).alias("total"),
        )

    return build


query("b15_rollup", _grouping("ROLLUP (c_mktsegment, o_orderstatus)"))(_grouped("rollup"))
query("b15_cube", _grouping("CUBE (c_mktsegment, o_orderstatus)"))(_grouped("cube"))
B15 = _grouping("GROUPING SETS ((c_mktsegment), (o_orderstatus), ())")


@query("b15_grouping_sets", B15)
def b15_grouping_sets(t):
    return run_sql(t.spark, t.some("orders", "customer"), B15)


B16 = """
SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
       count(*) FILTER (WHERE event_type = 'error') AS errors,
       round(coalesce(sum(CASE WHEN event_type = 'purchase' THEN value END), 0), 2) AS spend
FROM events GROUP BY user_id
"""


@query("b16_filtered_aggregates", B16)
def b16_filtered_aggregates(t):
    return run_sql(t.spark, t.some("events"), B16)


@query(
    "b17_ranking",
    """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk,
       dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, ntile(4) OVER w AS quarter
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""",
)
def b17_ranking(t):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    p = W.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t.orders.select(
        "o_orderkey",
        F.row_number().over(w).alias("rn"),
        F.rank().over(p).alias("rk"),
        F.dense_rank().over(p).alias("dr"),
        F.ntile(4).over(w).alias("quarter"),
    )


@query(
    "b18_analytic",
    """SELECT event_id, lag(value) OVER w AS prev_value, lead(event_type) OVER w AS next_type,
       first_value(value) OVER w AS first_value,
       last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_value
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def b18_analytic(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    full = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return t.events.select(
        "event_id",
        F.lag("value").over(w).alias("prev_value"),
        F.lead("event_type").over(w).alias("next_type"),
        F.first("value").over(w).alias("first_value"),
        F.last("value").over(full).alias("last_value"),
    )


@query(
    "b19_frames",
    """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS running,
       round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS moving_avg,
       count(*) OVER (PARTITION BY user_id) AS user_events,
       count(*) OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) RANGE BETWEEN INTERVAL '2' DAY PRECEDING AND CURRENT ROW) AS last_3_days
       FROM events""",
)
def b19_frames(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    return t.events.select(
        "event_id",
        F.round(F.sum("value").over(w.rowsBetween(W.unboundedPreceding, 0)), 2).alias("running"),
        F.round(F.avg("value").over(w.rowsBetween(-6, 0)), 6).alias("moving_avg"),
        F.count(F.lit(1)).over(W.partitionBy("user_id")).alias("user_events"),
        F.count(F.lit(1)).over(W.partitionBy("user_id").orderBy(day).rangeBetween(-2, 0)).alias("last_3_days"),
    )


@query(
    "b20_top_n_per_group",
    """SELECT c_nationkey, c_custkey, c_acctbal, rn FROM (
         SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) x
       WHERE rn <= 3""",
)
def b20_top_n_per_group(t):
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t.customer.select("c_nationkey", "c_custkey", "c_acctbal", F.row_number().over(w).alias("rn")).where("rn <= 3")


@query(
    "b20_distinct_on",
    "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id",
)
def b20_distinct_on(t):
    latest = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", -F.col("event_id"))).alias("r")
    return t.events.groupBy("user_id").agg(latest).select("user_id", "r.event_id", "r.event_type")


@query(
    "b21_percentiles",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS med,
       round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY l_returnflag""",
)
def b21_percentiles(t):
    q = group_quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"q1": 0.25, "med": 0.5, "p95": 0.95})
    return q.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("q1", "med", "p95")])


@query(
    "b22_top_k",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10",
)
def b22_top_k(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(25)


@query(
    "b23_set_operations",
    """SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
       UNION ALL SELECT 'union_all', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
       UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
       UNION ALL SELECT 'except', count(*) FROM (SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 10)""",
)
def b23_set_operations(t):
    nations, homes = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    frames = {
        "union": nations.unionByName(homes).distinct(),
        "union_all": nations.unionByName(homes),
        "intersect": t.customer.select("c_custkey").intersect(t.orders.select("o_custkey")),
        "except": t.lineitem.select("l_partkey").subtract(t.part.where("p_size > 10").select("p_partkey")),
    }
    out = None
    for op, df in frames.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "b24_strings",
    """SELECT doc_id, length(text) AS chars, lower(substring(text, 1, 40)) AS head, upper(lang) AS lang,
       trim(concat('  ', source, ' ')) AS source, lang || ':' || source AS tag FROM documents""",
)
def b24_strings(t):
    return t.documents.select(
        "doc_id",
        F.length("text").cast("bigint").alias("chars"),
        F.lower(F.substring("text", 1, 40)).alias("head"),
        F.upper("lang").alias("lang"),
        F.trim(F.concat(F.lit("  "), "source", F.lit(" "))).alias("source"),
        F.concat_ws(":", "lang", F.trim("source")).alias("tag"),
    )


@query(
    "b25_dates",
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(o_orderdate + INTERVAL '7' DAY AS DATE) AS due,
       CAST(year(o_orderdate) AS INT) AS y, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS INT) AS age_days FROM orders""",
)
def b25_dates(t):
    day = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey",
        F.trunc(day, "month").alias("month_start"),
        F.date_add(day, 7).alias("due"),
        F.year(day).alias("y"),
        F.datediff(F.lit(date(2001, 12, 31)), day).alias("age_days"),
    )


@query(
    "b26_date_spine",
    """SELECT CAST(d AS DATE) AS day, count(o_orderkey) AS orders
       FROM (SELECT unnest(generate_series((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS d) s
       LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(d AS DATE) GROUP BY CAST(d AS DATE)""",
)
def b26_date_spine(t):
    days = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    spine = days.agg(F.sequence(F.min("day"), F.max("day")).alias("s")).select(F.explode("s").alias("day"))
    return spine.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("orders"))


@query(
    "b27_pivot",
    """SELECT c_mktsegment, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS F,
       round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS O, round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS P
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
)
def b27_pivot(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.sum("o_totalprice"), 2))
