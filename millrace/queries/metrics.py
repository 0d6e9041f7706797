"""Group C: metrics layer and KPI packs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from millrace.operators import kpis
from millrace.operators import metrics as m
from millrace.queries.registry import Tables, query


def trade_model(t: Tables) -> m.Model:
    """Orders with customers and nations, line items as a second fact."""
    fields = lambda *names: tuple(m.Field(*n) if isinstance(n, tuple) else m.Field(n) for n in names)
    return m.Model(
        t.some("orders", "customer", "nation", "region", "lineitem", "part"),
        (
            m.Entity("Orders", "orders", fields("o_orderkey", "o_custkey", ("o_totalprice", "order value"), ("o_orderdate", "order date"), ("o_orderstatus", "status"), ("o_orderpriority", None, False))),
            m.Entity("Customers", "customer", fields("c_custkey", ("c_mktsegment", "segment"), ("c_acctbal", "balance"), ("c_name", None, False))),
            m.Entity("Nations", "nation", fields(("n_name", "nation"),)),
            m.Entity("Regions", "region", fields(("r_name", "region"),)),
            m.Entity("Lines", "lineitem", fields("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")),
            m.Entity("Parts", "part", fields(("p_brand", "brand"), ("p_retailprice", "retail"))),
        ),
        (
            m.Relationship("Orders", "o_custkey", "Customers", "c_custkey"),
            m.Relationship("Customers", "c_nationkey", "Nations", "n_nationkey"),
            m.Relationship("Nations", "n_regionkey", "Regions", "r_regionkey"),
            m.Relationship("Lines", "l_orderkey", "Orders", "o_orderkey"),
            m.Relationship("Lines", "l_partkey", "Parts", "p_partkey"),
        ),
        (
            m.Metric("revenue", "measure", "order_value", "Orders", "SUM"),
            m.Metric("orders", "measure", "o_orderkey", "Orders", "COUNT"),
            m.Metric("buyers", "measure", "o_custkey", "Orders", "COUNT DISTINCT"),
            m.Metric("avg_value", "measure", "order_value", "Orders", "AVG"),
            m.Metric("min_value", "measure", "order_value", "Orders", "MIN"),
            m.Metric("max_value", "measure", "order_value", "Orders", "MAX"),
            m.Metric("closed_revenue", "measure", "order_value", "Orders", "SUM", filter="status = 'F'"),
            m.Metric("sold", "measure", "l_extendedprice * (1 - l_discount)", "Lines", "SUM"),
            m.Metric("list_price", "measure", "l_quantity * Parts.retail", "Lines", "SUM"),
            m.Metric("segment", "dimension", "segment", "Customers"),
            m.Metric("region", "dimension", "region", "Regions"),
            m.Metric("order_date", "dimension", "order_date", "Orders"),
            m.Metric("value_per_order", "calculated", "[revenue] / [orders]"),
            m.Metric("closed_share", "calculated", "[closed_revenue] / [revenue]"),
            m.Metric("sold_per_order", "calculated", "[sold] / [orders]"),
        ),
    )


@query(
    "c1_entity_view",
    "SELECT o_orderkey, o_custkey, o_totalprice AS order_value, CAST(o_orderdate AS DATE) AS order_date, o_orderstatus AS status FROM orders",
)
def c1_entity_view(t):
    return m.entity_df(trade_model(t), "Orders").withColumn("order_date", F.col("order_date").cast("date"))


C2 = """SELECT c_mktsegment AS segment, n_name AS nation, r_name AS region, p_brand AS brand, count(*) AS lines,
       round(sum(o_totalprice), 2) AS order_value, round(sum(l_extendedprice), 2) AS price
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
       LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON l_partkey = p_partkey
       LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY c_mktsegment, n_name, r_name, p_brand"""


@query("c2_model_view", C2)
def c2_model_view(t):
    view = m.model_view(trade_model(t))
    return view.groupBy(
        F.col("Customers_segment").alias("segment"),
        F.col("Nations_nation").alias("nation"),
        F.col("Regions_region").alias("region"),
        F.col("Parts_brand").alias("brand"),
    ).agg(
        F.count(F.lit(1)).alias("lines"),
        F.round(F.sum("order_value"), 2).alias("order_value"),
        F.round(F.sum("Lines_l_extendedprice"), 2).alias("price"),
    )


def _rounded(df, digits=2):
    doubles = [c for c, kind in df.dtypes if kind == "double"]
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if c in doubles else F.col(f"`{c}`") for c in df.columns])


@query(
    "c3_measures",
    """SELECT round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS orders, count(DISTINCT o_custkey) AS buyers,
       round(avg(o_totalprice), 2) AS avg_value, min(o_totalprice) AS min_value, max(o_totalprice) AS max_value,
       round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS closed_revenue FROM orders""",
)
def c3_measures(t):
    names = ["revenue", "orders", "buyers", "avg_value", "min_value", "max_value", "closed_revenue"]
    return _rounded(m.query_metrics(trade_model(t), names))


@query("c4_dimension", "SELECT DISTINCT c_mktsegment AS segment FROM customer")
def c4_dimension(t):
    return m.dimension(trade_model(t), "segment")


@query(
    "c5_calculated",
    """SELECT round(sum(o_totalprice) / count(*), 4) AS value_per_order,
       round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / sum(o_totalprice), 4) AS closed_share,
       round((SELECT sum(l_extendedprice * (1 - l_discount)) FROM lineitem) / count(*), 4) AS sold_per_order FROM orders""",
)
def c5_calculated(t):
    return _rounded(m.query_metrics(trade_model(t), ["value_per_order", "closed_share", "sold_per_order"]), 4)


@query(
    "c6_metrics_by_dimensions",
    """WITH o AS (SELECT c_mktsegment AS segment, r_name AS region, sum(o_totalprice) AS revenue, count(*) AS orders
         FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
         JOIN region ON n_regionkey = r_regionkey GROUP BY c_mktsegment, r_name),
       l AS (SELECT c_mktsegment AS segment, r_name AS region, sum(l_extendedprice * (1 - l_discount)) AS sold, sum(l_quantity * p_retailprice) AS list_price
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
         JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey GROUP BY c_mktsegment, r_name)
       SELECT o.segment, o.region, round(revenue, 2) AS revenue, orders, round(sold, 2) AS sold, round(list_price, 2) AS list_price,
         round(sold / orders, 2) AS sold_per_order FROM o JOIN l ON o.segment = l.segment AND o.region = l.region""",
)
def c6_metrics_by_dimensions(t):
    names = ["revenue", "orders", "sold", "list_price", "sold_per_order"]
    return _rounded(m.query_metrics(trade_model(t), names, ["segment", "region"]))


AS_OF = date(2001, 7, 18)
_BOUNDS = {
    "today": "d >= DATE '2001-07-18' AND d < DATE '2001-07-19'",
    "yesterday": "d >= DATE '2001-07-17' AND d < DATE '2001-07-18'",
    "this week": "d >= date_trunc('week', DATE '2001-07-18')",
    "last week": "d >= date_trunc('week', DATE '2001-07-11') AND d < date_trunc('week', DATE '2001-07-18')",
    "this month": "d >= date_trunc('month', DATE '2001-07-18')",
    "last month": "d >= date_trunc('month', DATE '2001-06-18') AND d < date_trunc('month', DATE '2001-07-18')",
    "this year": "d >= date_trunc('year', DATE '2001-07-18')",
    "last year": "d >= date_trunc('year', DATE '2000-07-18') AND d < date_trunc('year', DATE '2001-07-18')",
}


@query(
    "c7_time_filters",
    " UNION ALL ".join(
        f"SELECT '{name}' AS span, count(*) AS orders, round(coalesce(sum(v), 0), 2) AS revenue FROM (SELECT o_orderdate AS d, o_totalprice AS v FROM orders) x WHERE {bound}"
        for name, bound in _BOUNDS.items()
    ),
)
def c7_time_filters(t):
    out = None
    for name in m.TIME_FILTERS:
        span = t.orders.where(m.time_predicate(F.col("o_orderdate"), name, AS_OF)).agg(
            F.count(F.lit(1)).alias("orders"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("revenue")
        )
        part = span.select(F.lit(name).alias("span"), "orders", "revenue")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "c7_metrics_with_time_filter",
    """SELECT o_orderdate AS order_date, round(sum(o_totalprice), 2) AS revenue, count(*) AS orders FROM orders
       WHERE o_orderdate >= DATE '2001-06-01' AND o_orderdate < DATE '2001-07-01' GROUP BY o_orderdate""",
)
def c7_metrics_with_time_filter(t):
    return _rounded(m.query_metrics(trade_model(t), ["revenue", "orders"], ["order_date"], "last month", AS_OF))


@query(
    "c8_neighbours",
    """SELECT c_mktsegment AS segment, l_returnflag AS flag, count(*) AS lines, round(sum(o_totalprice), 2) AS order_value
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_mktsegment, l_returnflag""",
)
def c8_neighbours(t):
    return (
        m.neighbours(trade_model(t), "Orders")
        .groupBy(F.col("Customers_segment").alias("segment"), F.col("Lines_l_returnflag").alias("flag"))
        .agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("order_value"), 2).alias("order_value"))
    )


def _sales(t: Tables) -> m.Model:
    return kpis.sales_model(
        customers=t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("country")
        ),
        products=t.part.select(
            F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"), (F.col("p_retailprice") * 0.5).alias("cost")
        ),
        orders=t.orders.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.trunc(F.col("o_orderdate").cast("date"), "month").alias("order_date"),
            F.col("o_totalprice").alias("total_amount"),
        ),
        items=t.lineitem.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("line_amount"),
        ),
    )


def _named(df, **names):
    return _rounded(df.select(*[F.col(f"`{source}`").alias(alias) for alias, source in names.items()]))


@query(
    "c9_sales_by_location",
    """WITH o AS (SELECT n_name AS location, sum(o_totalprice) AS revenue, count(*) AS orders, avg(o_totalprice) AS aov FROM orders
         JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name),
       l AS (SELECT n_name AS location, sum(l_quantity * (p_retailprice * 0.5)) AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey
         JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY n_name)
       SELECT o.location, round(revenue, 2) AS revenue, orders, round(aov, 2) AS aov, round(revenue - cost, 2) AS profit FROM o LEFT JOIN l ON o.location = l.location""",
)
def c9_sales_by_location(t):
    df = m.query_metrics(_sales(t), ["Total Revenue", "Order Count", "Average Order Value", "Profit"], ["Customer Location"])
    return _named(df, location="Customer Location", revenue="Total Revenue", orders="Order Count", aov="Average Order Value", profit="Profit")


@query(
    "c9_sales_by_month",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(o_totalprice), 2) AS revenue, count(*) AS orders,
       round(avg(o_totalprice), 2) AS aov FROM orders GROUP BY 1""",
)
def c9_sales_by_month(t):
    df = m.query_metrics(_sales(t), ["Total Revenue", "Order Count", "Average Order Value"], ["Order Date"])
    return _named(df, month="Order Date", revenue="Total Revenue", orders="Order Count", aov="Average Order Value")


@query(
    "c9_sales_by_category",
    """SELECT p_type AS category, round(sum(l_extendedprice), 2) AS revenue, round(sum(l_quantity * (p_retailprice * 0.5)), 2) AS cost
       FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY p_type""",
)
def c9_sales_by_category(t):
    df = m.query_metrics(_sales(t), ["Item Revenue", "Product Cost"], ["Product Category"])
    return _named(df, category="Product Category", revenue="Item Revenue", cost="Product Cost")


@query(
    "c10_marketing",
    """WITH s AS (SELECT user_id, sum(value) AS spend FROM events WHERE event_type = 'click' GROUP BY user_id),
       c AS (SELECT user_id, count(*) AS conversions, sum(value) AS worth FROM events WHERE event_type = 'purchase' GROUP BY user_id)
       SELECT coalesce(s.user_id, c.user_id) AS campaign, round(spend, 2) AS spend, conversions, round(worth, 2) AS worth,
         round((worth - spend) / nullif(spend, 0), 4) AS roi, round(spend / nullif(conversions, 0), 4) AS cost_per_conversion
       FROM s FULL JOIN c ON s.user_id = c.user_id""",
)
def c10_marketing(t):
    model = kpis.marketing_model(
        campaigns=t.events.select(F.col("user_id").alias("campaign_id")).distinct().withColumn("campaign_name", F.col("campaign_id")),
        ads=t.events.where("event_type = 'click'").select(F.col("event_id").alias("ad_id"), F.col("user_id").alias("campaign_id"), F.col("value").alias("cost")),
        conversions=t.events.where("event_type = 'purchase'").select(
            F.col("event_id").alias("conversion_id"), F.col("user_id").alias("campaign_id"), F.col("value").alias("conversion_value"), F.col("ts").alias("conversion_date")
        ),
    )
    df = m.query_metrics(model, ["Total Ad Spend", "Conversion Count", "Conversion Value", "ROI", "Cost per Conversion"], ["Campaign Name"])
    return df.select(
        F.col("`Campaign Name`").alias("campaign"),
        F.round(F.col("`Total Ad Spend`"), 2).alias("spend"),
        F.col("`Conversion Count`").alias("conversions"),
        F.round(F.col("`Conversion Value`"), 2).alias("worth"),
        F.round("ROI", 4).alias("roi"),
        F.round(F.col("`Cost per Conversion`"), 4).alias("cost_per_conversion"),
    )


@query(
    "c11_finance",
    """WITH x AS (SELECT c_mktsegment AS account_type, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS income,
         sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS expenses, count(*) AS transactions
         FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment),
       b AS (SELECT c_mktsegment AS account_type, sum(c_acctbal) AS budget FROM customer GROUP BY c_mktsegment)
       SELECT x.account_type, round(income, 2) AS income, round(expenses, 2) AS expenses, transactions,
         round(income - expenses, 2) AS net_income, round(budget - expenses, 2) AS budget_variance FROM x JOIN b ON x.account_type = b.account_type""",
)
def c11_finance(t):
    status = F.col("o_orderstatus")
    model = kpis.finance_model(
        accounts=t.customer.select(F.col("c_custkey").alias("account_id"), F.col("c_mktsegment").alias("account_type")),
        transactions=t.orders.select(
            F.col("o_orderkey").alias("transaction_id"),
            F.col("o_custkey").alias("account_id"),
            F.col("o_totalprice").alias("amount"),
            F.when(status == "F", "income").when(status == "P", "expense").otherwise("open").alias("type"),
            F.col("o_orderdate").alias("transaction_date"),
        ),
        budgets=t.customer.select(F.col("c_custkey").alias("account_id"), F.col("c_acctbal").alias("budget")),
    )
    df = m.query_metrics(model, ["Total Income", "Total Expenses", "Transaction Count", "Net Income", "Budget Variance"], ["Account Type"])
    return _named(
        df, account_type="Account Type", income="Total Income", expenses="Total Expenses",
        transactions="Transaction Count", net_income="Net Income", budget_variance="Budget Variance",
    )
