"""Group E: exploration, anomalies and forecasts."""

from __future__ import annotations

from datetime import datetime
from itertools import combinations

from pyspark.sql import functions as F

from millrace.operators import anomalies as an
from millrace.operators import explore as ex
from millrace.operators import forecast as fc
from millrace.queries.profiling import COLUMNS, HOLED, holed
from millrace.queries.registry import query

NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df, digits=4):
    doubles = {c for c, kind in df.dtypes if kind == "double"}
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if c in doubles else F.col(f"`{c}`") for c in df.columns])


@query(
    "e1_column_stats",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS avg, round(stddev_samp({c}), 4) AS std,
        count(DISTINCT {c}) AS distinct, count(*) - count({c}) AS missing, floor(10000.0 * (count(*) - count({c})) / count(*) + 0.5) / 100 AS missing_pct FROM {HOLED} h"""
        for c in NUMS
    ),
)
def e1_column_stats(t):
    return ex.column_stats(holed(t), NUMS)


def hist_sql(column, source, bins):
    return f"""WITH b AS (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}),
        k AS (SELECT least(floor(({column} - lo) / ((hi - lo) / {bins})) + 1, {bins}) AS bin, count(*) AS n FROM {source}, b WHERE {column} IS NOT NULL GROUP BY 1),
        g AS (SELECT CAST(unnest(generate_series(1, {bins})) AS INT) AS bin)
        SELECT g.bin, round(lo + (g.bin - 1) * ((hi - lo) / {bins}), 4) AS low, round(lo + g.bin * ((hi - lo) / {bins}), 4) AS high, coalesce(n, 0) AS n
        FROM g CROSS JOIN b LEFT JOIN k ON k.bin = g.bin"""


@query("e2_histogram", hist_sql("l_extendedprice", "lineitem", 20))
def e2_histogram(t):
    return rounded(ex.histogram(t.lineitem, "l_extendedprice", 20))


@query("e2_histogram_events", hist_sql("value", "events", 100))
def e2_histogram_events(t):
    return rounded(ex.histogram(t.events, "value", 100))


def _describe_sql(table):
    parts = []
    for c, kind in COLUMNS[table]:
        if kind == "string":
            parts.append(
                f"""SELECT '{c}' AS "column", count({c}) AS count, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS q25,
                CAST(NULL AS DOUBLE) AS q50, CAST(NULL AS DOUBLE) AS q75, CAST(NULL AS DOUBLE) AS max, count(DISTINCT {c}) AS unique,
                (SELECT {c} FROM {table} GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top, (SELECT count(*) FROM {table} GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS freq FROM {table}"""
            )
        elif kind in ("int", "bigint", "double"):
            parts.append(
                f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 4) AS q25,
                round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, CAST(max({c}) AS DOUBLE) AS max, CAST(NULL AS BIGINT) AS unique,
                CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq FROM {table}"""
            )
    return " UNION ALL ".join(parts)


@query("e3_describe", _describe_sql("part"))
def e3_describe(t):
    return rounded(ex.describe_all(t.part))


@query("e3_describe_lineitem", _describe_sql("lineitem"))
def e3_describe_lineitem(t):
    return rounded(ex.describe_all(t.lineitem))


BOX = """WITH q AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3 FROM {t})"""


@query(
    "e4_box_stats",
    BOX.format(c="value", t="events")
    + """ SELECT count(value) AS n, round(max(q1), 4) AS q1, round(max(med), 4) AS median, round(max(q3), 4) AS q3, round(max(q1 - 1.5 * (q3 - q1)), 4) AS lower_fence,
        round(max(q3 + 1.5 * (q3 - q1)), 4) AS upper_fence, count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers FROM events, q""",
)
def e4_box_stats(t):
    return rounded(ex.box_stats(t.events, "value"))


@query("e5_daily_counts", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def e5_daily_counts(t):
    return ex.daily_counts(t.events, "ts")


@query(
    "e6_seasonality",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
       SELECT 'weekday' AS cycle, CAST(isodow(day) AS INT) AS position, strftime(min(day), '%a') AS label, round(avg(n), 4) AS mean FROM d GROUP BY isodow(day)
       UNION ALL SELECT 'month', CAST(month(day) AS INT), strftime(min(day), '%b'), round(avg(n), 4) FROM d GROUP BY month(day)""",
)
def e6_seasonality(t):
    return rounded(ex.seasonality(ex.daily_counts(t.orders, "o_orderdate")))


def _corr_sql(source, cols, where=""):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM {source} {where}" for a, b in combinations(cols, 2)
    )


COMPLETE = "WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in NUMS)


@query("e7_correlation", _corr_sql(HOLED, NUMS, COMPLETE))
def e7_correlation(t):
    return rounded(ex.corr_matrix(holed(t), NUMS), 6)


DERIVED = "(SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross, l_discount FROM lineitem)"
DERIVED_COLS = ["l_quantity", "l_extendedprice", "net", "gross", "l_discount"]


def _derived(t):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select("l_quantity", "l_extendedprice", net.alias("net"), (net * (1 + F.col("l_tax"))).alias("gross"), "l_discount")


@query("e8_strong_correlations", f"SELECT * FROM ({_corr_sql(DERIVED, DERIVED_COLS)}) c WHERE abs(r) > 0.5")
def e8_strong_correlations(t):
    return rounded(ex.strong_corrs(ex.corr_matrix(_derived(t), DERIVED_COLS)), 6)


@query(
    "e9_trend_lines",
    f"""WITH c AS (SELECT x, y FROM ({_corr_sql(DERIVED, DERIVED_COLS)}) p ORDER BY abs(r) DESC, x, y LIMIT 3),
        f AS ({' UNION ALL '.join(f"SELECT '{a}' AS x, '{b}' AS y, round(regr_slope({b}, {a}), 6) AS slope, round(regr_intercept({b}, {a}), 4) AS intercept FROM {DERIVED}" for a, b in combinations(DERIVED_COLS, 2))})
        SELECT f.* FROM f JOIN c ON f.x = c.x AND f.y = c.y""",
)
def e9_trend_lines(t):
    df = _derived(t)
    lines = ex.top_trends(df, ex.corr_matrix(df, DERIVED_COLS), 3)
    return lines.select("x", "y", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(
    "e10_zscore_anomalies",
    """SELECT event_id, round((value - m) / s, 6) AS z_score FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) q WHERE abs((value - m) / s) > 3""",
)
def e10_zscore_anomalies(t):
    return an.anomalies_zscore(t.events, "value", 3.0).select("event_id", F.round("z_score", 6).alias("z_score"))


@query(
    "e11_iqr_anomalies",
    BOX.format(c="o_totalprice", t="orders") + " SELECT o_orderkey, o_totalprice FROM orders, q WHERE o_totalprice < q1 - 0.5 * (q3 - q1) OR o_totalprice > q3 + 0.5 * (q3 - q1)",
)
def e11_iqr_anomalies(t):
    return an.anomalies_iqr(t.orders, "o_totalprice", 0.5).select("o_orderkey", "o_totalprice")


MOVING = """SELECT event_id, round(moving_avg, 4) AS moving_avg, round(abs(value - moving_avg) / moving_std, 4) AS deviation FROM (
  SELECT event_id, value, avg(value) OVER w AS moving_avg, stddev_samp(value) OVER w AS moving_std, row_number() OVER (PARTITION BY {by} ORDER BY ts, event_id) AS rn
  FROM events WINDOW w AS (PARTITION BY {by} ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) x WHERE rn >= 7 AND abs(value - moving_avg) / moving_std > 2"""


@query("e12_moving_anomalies", MOVING.format(by="user_id"))
def e12_moving_anomalies(t):
    found = an.anomalies_moving(t.events, "value", "ts", by=["user_id"], w=7, deviations=2.0, tie=["event_id"])
    return rounded(found.select("event_id", "moving_avg", "deviation"))


@query("e12_moving_anomalies_whole", MOVING.format(by="1"))
def e12_moving_anomalies_whole(t):
    found = an.anomalies_moving(t.events, "value", "ts", w=7, deviations=2.0, tie=["event_id"])
    return rounded(found.select("event_id", "moving_avg", "deviation"))


DAILY = "WITH d AS (SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1), o AS (SELECT day, n, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS k FROM d)"
AHEAD = "FROM (SELECT CAST(unnest(generate_series(1, 30)) AS INT) AS step) s, (SELECT max(day) AS last, CAST(max(day) - (SELECT max(day) FROM o WHERE i = k - 1) AS INT) AS gap FROM o) e"


def _daily(t):
    return ex.daily_counts(t.events, "ts").withColumn("n", F.col("n").cast("double"))


@query("e13_forecast_sma", f"{DAILY} SELECT CAST(last + step * gap AS DATE) AS day, step, round((SELECT avg(n) FROM o WHERE i > k - 7), 4) AS forecast {AHEAD}")
def e13_forecast_sma(t):
    return rounded(fc.forecast_sma(_daily(t), "day", "n", 7, 30))


EWM_LEVEL = "(SELECT sum(n * exp((k - i) * ln(0.7))) / sum(exp((k - i) * ln(0.7))) FROM o)"


@query("e14_forecast_ewm", f"{DAILY} SELECT CAST(last + step * gap AS DATE) AS day, step, round({EWM_LEVEL}, 4) AS forecast {AHEAD}")
def e14_forecast_ewm(t):
    return rounded(fc.forecast_ewm(_daily(t), "day", "n", 0.3, 30))


@query("e15_linear_fit", f"{DAILY} SELECT round(regr_slope(n, i - 1), 6) AS slope, round(regr_intercept(n, i - 1), 6) AS intercept, round(regr_r2(n, i - 1), 6) AS r2, count(*) AS n FROM o")
def e15_linear_fit(t):
    return rounded(fc.linear_fit(_daily(t), "day", "n"), 6)


GAPS = "o2 AS (SELECT day, i, k, CASE WHEN day(day) % 4 = 0 OR day(day) BETWEEN 10 AND 17 THEN NULL ELSE n END AS v FROM o)"


def _daily_gaps(t):
    """Daily counts in which single days and a run of days have no value."""
    d = F.dayofmonth("day")
    return _daily(t).withColumn("v", F.when((d % 4 == 0) | d.between(10, 17), None).otherwise(F.col("n"))).select("day", "v")


def _gap_level(keep: float) -> str:
    return f"(SELECT sum(v * exp((k - i) * ln({keep}))) / sum(CASE WHEN v IS NOT NULL THEN exp((k - i) * ln({keep})) END) FROM o2)"


@query(
    "e14_forecast_ewm_gaps",
    f"{DAILY}, {GAPS} SELECT CAST(last + step * gap AS DATE) AS day, step, round({_gap_level(0.7)}, 4) AS fast, round({_gap_level(0.99)}, 4) AS slow {AHEAD}",
)
def e14_forecast_ewm_gaps(t):
    fast, slow = (fc.forecast_ewm(_daily_gaps(t), "day", "v", a, 30).withColumnRenamed("forecast", n) for a, n in ((0.3, "fast"), (0.01, "slow")))
    return rounded(fast.join(slow, ["day", "step"]))


@query(
    "e16_smoothed_gaps",
    f"""{DAILY}, {GAPS} SELECT day, round((SELECT sum(p.v * exp((o2.i - p.i) * ln(0.99))) / sum(CASE WHEN p.v IS NOT NULL THEN exp((o2.i - p.i) * ln(0.99)) END)
        FROM o2 p WHERE p.i <= o2.i), 4) AS exp_smooth FROM o2""",
)
def e16_smoothed_gaps(t):
    return rounded(fc.smoothed(_daily_gaps(t), "day", "v", alpha=0.01).select("day", "exp_smooth"))


LINEAR = f"{DAILY}, f AS (SELECT regr_slope(n, i - 1) AS b, regr_intercept(n, i - 1) AS a, count(*) AS c FROM o)"


@query("e15_forecast_linear", f"{LINEAR} SELECT CAST(last + step * gap AS DATE) AS day, step, round((SELECT a + b * (c - 1 + step) FROM f), 4) AS forecast {AHEAD}")
def e15_forecast_linear(t):
    return rounded(fc.forecast_linear(_daily(t), "day", "n", 30))


@query(
    "e16_smoothed_history",
    f"""{LINEAR} SELECT o.day, o.n, round(CASE WHEN i >= 7 THEN avg(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END, 4) AS moving_avg,
        round((SELECT sum(p.n * exp((o.i - p.i) * ln(0.7))) / sum(exp((o.i - p.i) * ln(0.7))) FROM o p WHERE p.i <= o.i), 4) AS exp_smooth,
        round((SELECT a + b * (o.i - 1) FROM f), 4) AS trend FROM o""",
)
def e16_smoothed_history(t):
    return rounded(fc.smoothed(_daily(t), "day", "n"))


@query(
    "e16_actual_and_forecast",
    f"""{DAILY} SELECT day, n AS value, 'actual' AS type FROM o UNION ALL
        SELECT CAST(last + step * gap AS DATE) AS day, round((SELECT avg(n) FROM o WHERE i > k - 7), 4) AS value, 'forecast' AS type {AHEAD}""",
)
def e16_actual_and_forecast(t):
    daily = _daily(t)
    return rounded(fc.combine_forecast(daily, fc.forecast_sma(daily, "day", "n", 7, 30), "day", "n"))


@query(
    "e17_pivot_mean",
    "SELECT p_brand, " + ", ".join(f"round(avg(CASE WHEN p_type = '{k}' THEN p_retailprice END), 4) AS {k}" for k in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM part GROUP BY p_brand",
)
def e17_pivot_mean(t):
    return rounded(ex.pivot_mean(t.part, "p_type", "p_brand", "p_retailprice"))


@query("e18_share", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 6) AS share FROM orders GROUP BY o_orderpriority")
def e18_share(t):
    return ex.share(t.orders, "o_orderpriority", "o_totalprice").select("o_orderpriority", F.round("total", 2).alias("total"), F.round("share", 6).alias("share"))


@query("e19_scalar", "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem")
def e19_scalar(t):
    return ex.scalar(t.lineitem, "round(sum(l_extendedprice * (1 - l_discount)), 2)", "revenue")


@query(
    "e20_filters",
    """SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'
       AND event_type IN ('click', 'view') AND value <= 120""",
)
def e20_filters(t):
    filters = [
        ex.Filter("ts", "range", datetime(2024, 1, 5), datetime(2024, 1, 20)),
        ex.Filter("event_type", "among", ("click", "view")),
        ex.Filter("value", "at_most", 120),
    ]
    return ex.apply_filters(t.events, filters).select("event_id", "value")


@query("e20_filter_options", "SELECT DISTINCT event_type AS option FROM events")
def e20_filter_options(t):
    return ex.filter_options(t.events, "event_type")


_GAPS = ["l_quantity", "l_tax", "l_returnflag"]


@query(
    "e21_missing_map",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL) AS n FROM {HOLED} h"
        for i, a in enumerate(_GAPS) for b in _GAPS[i:]
    ),
)
def e21_missing_map(t):
    return ex.missing_map(holed(t))


@query(
    "e22_histogram_pair",
    """WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events), g AS (SELECT CAST(unnest(generate_series(1, 40)) AS INT) AS bin),
       x AS (SELECT least(floor((value - lo) / ((hi - lo) / 40)) + 1, 40) AS bin, count(*) AS n FROM events, b GROUP BY 1),
       y AS (SELECT least(floor((least(value, 100.0) - lo) / ((hi - lo) / 40)) + 1, 40) AS bin, count(*) AS n FROM events, b GROUP BY 1)
       SELECT 'value' AS "column", g.bin, round(lo + (g.bin - 1) * ((hi - lo) / 40), 6) AS low, round(lo + g.bin * ((hi - lo) / 40), 6) AS high,
       coalesce(x.n, 0) AS n_before, coalesce(y.n, 0) AS n_after FROM g CROSS JOIN b LEFT JOIN x ON x.bin = g.bin LEFT JOIN y ON y.bin = g.bin""",
)
def e22_histogram_pair(t):
    capped = t.events.withColumn("value", F.least("value", F.lit(100.0)))
    return rounded(ex.histogram_pair(t.events, capped, ["value"], 40), 6)


@query(
    "e23_overview",
    f"""WITH a AS (SELECT l_suppkey, l_quantity, l_tax, l_returnflag FROM {HOLED} h),
        s AS (SELECT count(*) AS n, CAST(sum((l_quantity IS NULL)::INT + (l_tax IS NULL)::INT + (l_returnflag IS NULL)::INT) AS BIGINT) AS m, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM a) d) AS dup FROM a),
        c AS (SELECT count(*) AS n, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS dup FROM (SELECT DISTINCT * FROM a WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL AND l_returnflag IS NOT NULL) d)
        SELECT 'rows' AS measure, s.n AS before, c.n AS after, c.n - s.n AS delta FROM s, c UNION ALL SELECT 'columns', 4, 4, 0
        UNION ALL SELECT 'missing_cells', s.m, c.m, c.m - s.m FROM s, c UNION ALL SELECT 'duplicate_rows', s.dup, c.dup, c.dup - s.dup FROM s, c""",
)
def e23_overview(t):
    before = holed(t).select("l_suppkey", "l_quantity", "l_tax", "l_returnflag")
    return ex.overview_change(before, before.na.drop().distinct())
