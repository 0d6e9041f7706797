"""Group F (first part): type inference, missing values, outliers, encoding, scaling, selection, checks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from millrace.functions import normal
from millrace.operators.clean import encode, impute, normality, outliers, scale, schema, select, validate
from millrace.queries.exploring import NUMS, rounded
from millrace.queries.profiling import COLUMNS, HOLED, holed
from millrace.queries.registry import query


def messy(t):
    """orders as text with thousands separators, slash dates, word flags and scales, and gaps."""
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("order_id"),
        F.when(k % 10 != 0, F.regexp_replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), r"^(\d+)(\d{3})\.", "$1,$2.")).alias("amount"),
        F.when(k % 9 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("order_date"),
        F.when(F.col("o_orderstatus") == "F", " YES ").otherwise("no").alias("closed"),
        F.element_at(F.array(*[F.lit(w) for w in ("Low", "MEDIUM", "high")]), (k % 3 + 1).cast("int")).alias("urgency"),
        F.col("o_orderpriority").alias("priority"),
        (k % 2).alias("flag"),
        F.concat(F.lit("order number "), k.cast("string"), F.lit(" placed by customer number "), F.col("o_custkey").cast("string"), F.lit(" in good time")).alias("note"),
        F.col("o_totalprice").alias("target_value"),
    )


MESSY = r"""(SELECT o_orderkey AS order_id,
  CASE WHEN o_orderkey % 10 <> 0 THEN regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR), '^(\d+)(\d{3})\.', '\1,\2.') END AS amount,
  CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y/%m/%d') END AS order_date,
  CASE WHEN o_orderstatus = 'F' THEN ' YES ' ELSE 'no' END AS closed,
  CASE o_orderkey % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'MEDIUM' ELSE 'high' END AS urgency,
  o_orderpriority AS priority, o_orderkey % 2 AS flag,
  'order number ' || o_orderkey || ' placed by customer number ' || o_custkey || ' in good time' AS note, o_totalprice AS target_value FROM orders)"""


@query(
    "f1_infer_schema",
    f"""SELECT c AS "column", kind AS inferred_type, card AS cardinality, round(miss, 4) AS missing_rate, idlike AS is_id_like, tgt AS is_potential_target FROM (
        SELECT 'order_id' AS c, 'numeric' AS kind, count(DISTINCT order_id) AS card, 1 - count(order_id) * 1.0 / count(*) AS miss, true AS idlike, false AS tgt FROM {MESSY} m
        UNION ALL SELECT 'amount', CASE WHEN count(TRY_CAST(replace(amount, ',', '') AS DOUBLE)) * 1.0 / count(amount) >= 0.8 THEN 'numeric' END, count(DISTINCT amount), 1 - count(amount) * 1.0 / count(*), count(DISTINCT amount) > 0.95 * count(*), false FROM {MESSY} m
        UNION ALL SELECT 'order_date', CASE WHEN count(try_strptime(order_date, '%Y/%m/%d')) * 1.0 / count(*) >= 0.8 THEN 'datetime' END, count(DISTINCT order_date), 0, false, false FROM {MESSY} m
        UNION ALL SELECT 'closed', 'boolean', count(DISTINCT closed), 0, false, false FROM {MESSY} m
        UNION ALL SELECT 'urgency', 'ordinal', count(DISTINCT urgency), 0, false, true FROM {MESSY} m
        UNION ALL SELECT 'priority', 'categorical', count(DISTINCT priority), 0, false, true FROM {MESSY} m
        UNION ALL SELECT 'flag', 'boolean', count(DISTINCT flag), 0, false, false FROM {MESSY} m
        UNION ALL SELECT 'note', CASE WHEN avg(length(note)) > 50 THEN 'text' ELSE 'categorical' END, count(DISTINCT note), 0, true, false FROM {MESSY} m
        UNION ALL SELECT 'target_value', 'numeric', count(DISTINCT target_value), 0, count(DISTINCT target_value) > 0.95 * count(*), true FROM {MESSY} m) x""",
)
def f1_infer_schema(t):
    frame = schema.schema_frame(t.spark, schema.infer_schema(messy(t)))
    return frame.select("column", "inferred_type", "cardinality", F.round("missing_rate", 4).alias("missing_rate"), "is_id_like", "is_potential_target")


@query(
    "f2_numeric_rate",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(count(TRY_CAST(replace({c}, ',', '') AS DOUBLE)) * 1.0 / count({c}), 4) AS numeric_rate FROM {MESSY} m"""
        for c in ("amount", "order_date", "closed", "priority")
    ),
)
def f2_numeric_rate(t):
    return schema.conversion_rates(messy(t), ["amount", "order_date", "closed", "priority"]).select("column", "numeric_rate")


@query(
    "f3_datetime_rate",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(count(try_strptime({c}, '%Y/%m/%d')) * 1.0 / count({c}), 4) AS datetime_rate FROM {MESSY} m"""
        for c in ("amount", "order_date", "priority")
    ),
)
def f3_datetime_rate(t):
    return schema.conversion_rates(messy(t), ["amount", "order_date", "priority"]).select("column", "datetime_rate")


@query(
    "f4_entropy",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS cardinality, round(-sum(p * ln(p)) / ln(count(*)), 4) AS entropy FROM (SELECT n / sum(n) OVER () AS p FROM (SELECT count(*) * 1.0 AS n FROM events GROUP BY {c}) c) p"""
        for c in ("event_type", "user_id", "props")
    ),
)
def f4_entropy(t):
    return schema.entropy(t.events, ["event_type", "user_id", "props"])


@query(
    "f5_word_scales",
    f"""SELECT 'closed' AS "column", 'boolean' AS inferred_type, NULL AS ordinal_map, count(DISTINCT closed) AS cardinality FROM {MESSY} m
        UNION ALL SELECT 'urgency', 'ordinal', '{{"low": 0, "medium": 1, "high": 2}}', count(DISTINCT urgency) FROM {MESSY} m""",
)
def f5_word_scales(t):
    frame = schema.schema_frame(t.spark, schema.infer_schema(messy(t).select("closed", "urgency")))
    return frame.select("column", "inferred_type", "ordinal_map", "cardinality")


_FLAG_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", regexp_matches(lower('{c}'), '^id$|_id$|^id_|\\bidentif|\\bkey$|\\bindex$|\\buuid|\\bguid')
        OR ({'true' if k in ('bigint', 'int', 'double', 'string') else 'false'} AND count(DISTINCT {c}) > 0.95 * count(*)) AS is_id_like FROM events"""
    for c, k in COLUMNS["events"]
)


@query("f6_id_flags", _FLAG_SQL)
def f6_id_flags(t):
    return schema.schema_frame(t.spark, schema.infer_schema(t.events)).select("column", "is_id_like")


SIGNAL = """(SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice < 350000 OR o_orderkey % 3 = 0 THEN o_custkey END AS c_signal,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS c_noise, CASE WHEN o_orderkey % 50 = 0 THEN o_orderstatus END AS c_sparse FROM orders)"""


def signal(t):
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey", "o_totalprice",
        F.when((price < 350000) | (key % 3 == 0), F.col("o_custkey")).alias("c_signal"),
        F.when(key % 4 != 0, F.col("o_orderpriority")).alias("c_noise"),
        F.when(key % 50 == 0, F.col("o_orderstatus")).alias("c_sparse"),
    )


@query(
    "f7_missingness_corr",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(abs(corr(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END, o_totalprice)), 6) AS corr FROM {SIGNAL} s"""
        for c in ("c_signal", "c_noise", "c_sparse")
    ),
)
def f7_missingness_corr(t):
    found = impute.missingness_corr(signal(t), "o_totalprice")
    return t.spark.createDataFrame([(c, round(r, 6)) for c, r in found.items()], "column string, corr double")


@query("f8_drop_sparse", f"SELECT o_orderkey, o_totalprice, c_signal, c_noise FROM {SIGNAL} s")
def f8_drop_sparse(t):
    df = signal(t)
    return impute.drop_sparse(df, schema.infer_schema(df), "o_totalprice")


@query(
    "f9_missing_indicator",
    f"SELECT *, CAST(CASE WHEN c_signal IS NULL THEN 1 ELSE 0 END AS TINYINT) AS c_signal__was_missing FROM {SIGNAL} s",
)
def f9_missing_indicator(t):
    return impute.add_missing_indicators(signal(t), "o_totalprice")


SKEWED = "(SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN value * value END AS squared, CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS DOUBLE) END AS user_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS kind FROM events)"


def skewed(t):
    k = F.col("event_id")
    return t.events.select(
        "event_id",
        F.when(k % 6 != 0, F.col("value") * F.col("value")).alias("squared"),
        F.when(k % 5 != 0, F.col("user_id").cast("double")).alias("user_id"),
        F.when(k % 4 != 0, F.col("event_type")).alias("kind"),
    )


@query(
    "f10_impute_numeric",
    f"""SELECT event_id, round(coalesce(squared, (SELECT CASE WHEN abs(skewness(squared)) > 2 THEN quantile_cont(squared, 0.5) ELSE avg(squared) END FROM {SKEWED} s)), 4) AS squared,
        round(coalesce(user_id, (SELECT CASE WHEN abs(skewness(user_id)) > 2 THEN quantile_cont(user_id, 0.5) ELSE avg(user_id) END FROM {SKEWED} s)), 4) AS user_id FROM {SKEWED} s""",
)
def f10_impute_numeric(t):
    return rounded(impute.impute_numeric(skewed(t).drop("kind"), ["squared", "user_id"]))


REG = "(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_orderkey % 4 <> 0 THEN l_extendedprice * (1 - l_discount) END AS net, l_extendedprice FROM lineitem)"


@query(
    "f11_impute_regression",
    f"""WITH f AS (SELECT regr_slope(net, l_extendedprice) AS b, regr_intercept(net, l_extendedprice) AS a FROM {REG} r)
        SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(net, a + b * l_extendedprice), 4) AS net FROM {REG} r, f""",
)
def f11_impute_regression(t):
    df = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        F.when(F.col("l_orderkey") % 4 != 0, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), "l_extendedprice",
    )
    out = impute.impute_regression(df, ["net"], ["l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("net", 4).alias("net"))


@query("f11_impute_iterative")
def f11_impute_iterative(t):
    return impute.impute_iterative(holed(t).select("l_orderkey", "l_linenumber", *NUMS), NUMS)


@query(
    "f12_fill_ordered",
    """WITH g AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)
       SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM g""",
)
def f12_fill_ordered(t):
    df = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return impute.fill_ordered(df, ["v"], "ts", ["user_id"], ["event_id"]).select("event_id", "v")


@query(
    "f12_fill_ordered_whole",
    """WITH g AS (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)
       SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         first_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM g""",
)
def f12_fill_ordered_whole(t):
    df = t.events.select("event_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return impute.fill_ordered(df, ["v"], "ts", tie=["event_id"]).select("event_id", "v")


@query(
    "f13_impute_categorical",
    f"""WITH m AS (SELECT kind, count(*) AS n FROM {SKEWED} s WHERE kind IS NOT NULL GROUP BY kind ORDER BY n DESC, kind LIMIT 1),
        p AS (SELECT c_mostly, count(*) AS n FROM (SELECT CASE WHEN event_id % 4 = 1 THEN 'a' WHEN event_id % 4 <> 0 THEN 'b' END AS c_mostly FROM events) x WHERE c_mostly IS NOT NULL GROUP BY 1 ORDER BY n DESC LIMIT 1)
        SELECT s.event_id, coalesce(s.kind, CASE WHEN (SELECT n FROM m) >= 0.5 * (SELECT count(kind) FROM {SKEWED} q) THEN (SELECT kind FROM m) ELSE 'Missing' END) AS kind,
          coalesce(CASE WHEN s.event_id % 4 = 1 THEN 'a' WHEN s.event_id % 4 <> 0 THEN 'b' END, (SELECT c_mostly FROM p)) AS mostly FROM {SKEWED} s""",
)
def f13_impute_categorical(t):
    k = F.col("event_id") % 4
    df = skewed(t).select("event_id", "kind", F.when(k == 1, "a").when(k != 0, "b").alias("mostly"))
    return impute.impute_categorical(df, ["kind", "mostly"])


_SKEW = "skewness({c})"


@query(
    "f14_normality",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis,
        round(count({c}) / 6.0 * (power(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)), 2) + power(kurtosis_pop({c}), 2) / 4), 2) AS statistic FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice")
    ),
)
def f14_normality(t):
    n = outliers.normality(t.lineitem, ["l_quantity", "l_extendedprice"])
    return n.select("column", "n", F.round("skewness", 4).alias("skewness"), F.round("kurtosis", 4).alias("kurtosis"), F.round("statistic", 2).alias("statistic"))


def _horner(coefficients, x):
    text = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + {c!r})"
    return text


def _z_sql(p):
    ratio = lambda table, x: f"{_horner(table[0], x)} / {_horner(table[1], x)}"
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"""CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {ratio(normal.CENTRAL, f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))')}
        ELSE sign({p} - 0.5) * CASE WHEN {r} <= 5 THEN {ratio(normal.MIDDLE, f'({r} - 1.6)')} ELSE {ratio(normal.TAIL, f'({r} - 5)')} END END"""


def _shapiro_sql(table, c):
    # outermost weights a, next ones b, the others m / sqrt(phi)
    return f"""SELECT '{c}' AS "column", n, round(CAST(power((mx - m1 * x1 - m2 * x2) / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a * a - 2 * b * b)) + a * x1 + b * x2, 2) / ss AS DOUBLE), 6) AS statistic
      FROM (SELECT *, m1 / sqrt(mm) + {_horner(normality.OUTER, '(1 / sqrt(n))')} AS a, m2 / sqrt(mm) + {_horner(normality.SECOND, '(1 / sqrt(n))')} AS b
        FROM (SELECT n, sum(m * x) AS mx, sum(m * m) AS mm, sum(x * x) AS ss, max(m) AS m1, max(m) FILTER (WHERE i = n - 1) AS m2, max(x) - min(x) AS x1,
              max(x) FILTER (WHERE i = n - 1) - max(x) FILTER (WHERE i = 2) AS x2
          FROM (SELECT x, i, n, {_z_sql('p')} AS m FROM (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM (
            SELECT {c} - avg({c}) OVER () AS x, CAST(row_number() OVER (ORDER BY {c}) AS DOUBLE) AS i, count(*) OVER () AS n FROM {table} WHERE {c} IS NOT NULL) r) w) z GROUP BY n) s) t"""


@query("f14_shapiro_wilk", " UNION ALL ".join(_shapiro_sql(t, c) for t, c in (("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"), ("events", "value"))))
def f14_shapiro_wilk(t):
    lines = normality.shapiro_wilk(t.lineitem, ["l_quantity", "l_extendedprice"])
    return rounded(lines.unionByName(normality.shapiro_wilk(t.events, ["value"])).select("column", "n", "statistic"), 6)


_HEAVY = "(SELECT event_id, value, value * value * value AS cubed, sqrt(value) AS root FROM events)"


@query(
    "f15_outlier_report",
    f"""WITH b AS (SELECT {', '.join(f"quantile_cont({c}, 0.25) AS {c}1, quantile_cont({c}, 0.75) AS {c}3, abs(kurtosis({c})) > 7 AS {c}h, skewness({c}) AS {c}s" for c in ('value', 'cubed', 'root'))}, count(*) AS n FROM {_HEAVY} h)
        SELECT * FROM (""" + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CASE WHEN max({c}h) THEN 'winsorize' ELSE 'iqr' END AS method,
        CASE WHEN max({c}h) THEN CAST(floor(0.02 * count(*)) AS BIGINT) ELSE count(*) FILTER (WHERE {c} < {c}1 - 1.5 * ({c}3 - {c}1) OR {c} > {c}3 + 1.5 * ({c}3 - {c}1)) END AS n_outliers,
        round(max({c}s), 3) AS skewness, round(avg({c}), 4) AS before_mean FROM {_HEAVY} h, b"""
        for c in ("value", "cubed", "root")
    ) + ") r",
)
def f15_outlier_report(t):
    df = t.events.select("event_id", "value", F.pow("value", F.lit(3)).alias("cubed"), F.sqrt("value").alias("root"))
    plan = outliers.plan_outliers(df, _as_numeric(df.drop("event_id")))
    return outliers.outlier_report(df, plan).select("column", "method", "n_outliers", "skewness", "before_mean")


def _as_numeric(df):
    """Schema that treats every column as a plain measurement, whatever its uniqueness."""
    from dataclasses import replace

    return {c: replace(p, is_id_like=False) for c, p in schema.infer_schema(df).items()}


@query(
    "f16_cap_zscore",
    """WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events)
       SELECT event_id, round(least(greatest(value, m - 3 * d), m + 3 * d), 4) AS value FROM events, s""",
)
def f16_cap_zscore(t):
    return rounded(outliers.cap_zscore(t.events.select("event_id", "value"), "value"))


@query(
    "f17_cap_iqr",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
       SELECT event_id, round(least(greatest(value, a - 1.5 * (b - a)), b + 1.5 * (b - a)), 4) AS value FROM events, q""",
)
def f17_cap_iqr(t):
    return rounded(outliers.cap_iqr(t.events.select("event_id", "value"), "value"))


@query(
    "f18_winsorize",
    """WITH o AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) AS i, count(*) OVER () AS n FROM lineitem),
       b AS (SELECT max(CASE WHEN i = CAST(floor(0.01 * n) AS INT) + 1 THEN x END) AS lo, max(CASE WHEN i = n - CAST(floor(0.01 * n) AS INT) THEN x END) AS hi FROM o)
       SELECT l_orderkey, l_linenumber, l_partkey, round(least(greatest(l_extendedprice, lo), hi), 4) AS price FROM lineitem, b""",
)
def f18_winsorize(t):
    capped = outliers.winsorize(t.lineitem, "l_extendedprice")
    return capped.select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_extendedprice", 4).alias("price"))


@query("f20_encode_boolean", f"SELECT order_id, CAST(CASE WHEN trim(lower(closed)) = 'yes' THEN 1 ELSE 0 END AS TINYINT) AS closed FROM {MESSY} m")
def f20_encode_boolean(t):
    return encode.encode_boolean(messy(t), "closed").select("order_id", "closed")


@query(
    "f21_encode_ordinal",
    f"SELECT order_id, CAST(CASE lower(urgency) WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE -1 END AS TINYINT) AS urgency FROM {MESSY} m",
)
def f21_encode_ordinal(t):
    scales = schema.matching_scale({"low", "medium", "high"})
    return encode.encode_ordinal(messy(t), "urgency", scales).select("order_id", "urgency")


@query(
    "f22_encode_onehot",
    "SELECT c_custkey, " + ", ".join(
        f"CAST(CASE WHEN c_mktsegment = '{v}' THEN 1 ELSE 0 END AS TINYINT) AS \"c_mktsegment_{v}\"" for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    ) + " FROM customer",
)
def f22_encode_onehot(t):
    return encode.encode_onehot(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query(
    "f23_encode_target",
    """WITH b AS (SELECT c_custkey AS k, c_nationkey AS c, c_acctbal AS y, c_custkey % 5 AS f FROM customer),
       a AS (SELECT c, sum(y) AS s, count(*) AS n FROM b GROUP BY c), h AS (SELECT c, f, sum(y) AS s, count(*) AS n FROM b GROUP BY c, f), g AS (SELECT avg(y) AS m FROM b)
       SELECT b.k AS c_custkey, round(CASE WHEN a.n = h.n THEN g.m ELSE (a.s - h.s) / (a.n - h.n) END, 8) AS c_nationkey
       FROM b JOIN a ON a.c = b.c JOIN h ON h.c = b.c AND h.f = b.f CROSS JOIN g""",
)
def f23_encode_target(t):
    out = encode.encode_target_kfold(t.customer, "c_nationkey", "c_acctbal", F.pmod("c_custkey", F.lit(5)))
    return rounded(out.select("c_custkey", "c_nationkey"), 8)


@query(
    "f24_encode_frequency",
    "SELECT p_partkey, round(count(*) OVER (PARTITION BY p_brand) * 1.0 / count(*) OVER (), 6) AS p_brand FROM part",
)
def f24_encode_frequency(t):
    return rounded(encode.encode_frequency(t.part, "p_brand").select("p_partkey", "p_brand"), 6)


@query(
    "f25_encoding_replay",
    """WITH b AS (SELECT p_brand, avg(p_retailprice) AS m FROM part GROUP BY p_brand)
       SELECT p_partkey, round(m, 4) AS p_brand, """ + ", ".join(
        f"CAST(CASE WHEN p_type = '{v}' THEN 1 ELSE 0 END AS TINYINT) AS \"p_type_{v}\"" for v in ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    ) + " FROM part JOIN b USING (p_brand)",
)
def f25_encoding_replay(t):
    df = t.part.select("p_partkey", "p_brand", "p_type", "p_retailprice")
    plan = encode.fit_encoding(df, schema.infer_schema(df), "p_retailprice")
    return rounded(plan.apply(df).drop("p_retailprice"))


SCALED = ["l_quantity", "l_discount", "l_extendedprice"]


@query(
    "f26_choose_scalers",
    """SELECT 'l_quantity' AS "column", 'standard' AS method, round(avg(l_quantity), 4) AS center, round(stddev_pop(l_quantity), 4) AS spread FROM lineitem
       UNION ALL SELECT 'l_discount', 'minmax', round(min(l_discount), 4), round(max(l_discount) - min(l_discount), 4) FROM lineitem
       UNION ALL SELECT 'l_extendedprice', CASE WHEN abs(skewness(l_extendedprice)) > 1 THEN 'robust' ELSE 'standard' END, round(avg(l_extendedprice), 4), round(stddev_pop(l_extendedprice), 4) FROM lineitem""",
)
def f26_choose_scalers(t):
    return rounded(scale.scaler_frame(t.spark, scale.choose_scalers(t.lineitem, SCALED)))


@query(
    "f27_scale",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b, avg(user_id) AS um, stddev_pop(user_id) AS us FROM events)
       SELECT event_id, round(CAST(CAST((value - m) / (b - a) AS FLOAT) AS DOUBLE), 3) AS value, round(CAST(CAST((user_id - um) / us AS FLOAT) AS DOUBLE), 3) AS user_id FROM events, q""",
)
def f27_scale(t):
    df = t.events.select("event_id", "value", "user_id")
    out = scale.scale(df, scale.choose_scalers(df, ["value", "user_id"]))
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["bigint", "float", "float"]
    return out.select("event_id", *[F.round(F.col(c).cast("double"), 3).alias(c) for c in ("value", "user_id")])


@query(
    "f28_low_variance",
    """SELECT c AS "column", v <= 0.001 AS dropped FROM (SELECT 'l_discount' AS c, var_pop(l_discount) AS v FROM lineitem UNION ALL SELECT 'l_tax', var_pop(l_tax) FROM lineitem
       UNION ALL SELECT 'l_quantity', var_pop(l_quantity) FROM lineitem) x""",
)
def f28_low_variance(t):
    cols = ["l_discount", "l_tax", "l_quantity"]
    gone = select.low_variance(t.lineitem, cols)
    return t.spark.createDataFrame([(c, c in gone) for c in cols], "column string, dropped boolean")


@query(
    "f29_correlated",
    """SELECT * FROM (SELECT 'net' AS "column", abs(corr(l_extendedprice, l_extendedprice * (1 - l_discount))) AS r FROM lineitem
       UNION ALL SELECT 'gross', abs(corr(l_extendedprice, l_extendedprice * (1 - l_discount) * (1 + l_tax))) FROM lineitem) x WHERE r > 0.95""".replace("SELECT * FROM", 'SELECT "column" FROM'),
)
def f29_correlated(t):
    from millrace.queries.exploring import _derived

    df = _derived(t)
    cols = ["l_quantity", "l_extendedprice", "net", "gross", "l_discount"]
    return t.spark.createDataFrame([(c,) for c in select.correlated(df, cols)], "column string")


def mi_sql(source, target, cols, bins=10):
    parts = []
    for c in cols:
        edges = ", ".join(str(i / bins) for i in range(1, bins))
        parts.append(
            f"""SELECT '{c}' AS "column", round(sum(n / nt * ln(n * nt / (nx * ny))), 5) AS mi FROM (
              SELECT CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY x) AS DOUBLE) AS nx, CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE) AS ny, CAST(sum(n) OVER () AS DOUBLE) AS nt FROM (
                SELECT len(list_filter(list_distinct(e), lambda v: {c} >= v)) AS x, {target} AS y, count(*) AS n FROM {source}, (SELECT quantile_cont({c}, [{edges}]) AS e FROM {source}) q GROUP BY 1, 2) j) w"""
        )
    return " UNION ALL ".join(parts)


@query("f30_mutual_information", mi_sql("lineitem", "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"]))
def f30_mutual_information(t):
    return rounded(select.mutual_information(t.lineitem, "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"]), 5)


VALID = "(SELECT l_suppkey, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_tax END AS tax, CASE WHEN l_orderkey % 100 = 0 THEN CAST('inf' AS DOUBLE) ELSE l_quantity END AS qty, 1 AS one, l_returnflag AS flag FROM lineitem)"


def dirty(t):
    k = F.col("l_orderkey")
    return t.lineitem.select(
        "l_suppkey",
        F.when(k % 11 != 0, F.col("l_tax")).alias("tax"),
        F.when(k % 100 == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity")).alias("qty"),
        F.lit(1).alias("one"),
        F.col("l_returnflag").alias("flag"),
    )


@query(
    "f31_validate",
    f"""WITH v AS (SELECT count(*) AS n, count(*) - count(tax) AS gaps, count(*) FILTER (WHERE isinf(qty)) AS infs, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {VALID} d) u) AS dup FROM {VALID} x)
        SELECT 'no_missing_values' AS "check", gaps = 0 AS passed, gaps = 0 AS passed_after, gaps AS measure FROM v UNION ALL SELECT 'no_infinite_values', infs = 0, true, infs FROM v
        UNION ALL SELECT 'no_constant_columns', false, false, 1 FROM v UNION ALL SELECT 'no_duplicate_rows', dup = 0, dup = 0, dup FROM v UNION ALL SELECT 'text_columns', true, true, 1
        UNION ALL SELECT 'rows', true, true, n FROM v UNION ALL SELECT 'columns', true, true, 5
        UNION ALL SELECT 'overall', false, false, (gaps > 0)::INT + (infs > 0)::INT + 1 + (dup > 0)::INT FROM v""",
)
def f31_validate(t):
    checks, _ = validate.validate(dirty(t))
    return checks.select("check", "passed", "passed_after", "measure")


@query(
    "f31_repaired",
    f"""SELECT round(sum(CASE WHEN isinf(qty) THEN m ELSE qty END), 4) AS total, count(*) AS n FROM {VALID} x, (SELECT quantile_cont(qty, 0.5) AS m FROM {VALID} y WHERE NOT isinf(qty)) q""",
)
def f31_repaired(t):
    _, fixed = validate.validate(dirty(t))
    return fixed.agg(F.round(F.sum("qty"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


def _narrow_sql(table):
    parts = []
    for c, kind in COLUMNS[table]:
        if kind in ("int", "bigint"):
            rule = f"CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END"
        elif kind == "double":
            rule = "max('float')"
        elif kind == "string":
            rule = f"CASE WHEN count(DISTINCT {c}) * 1.0 / count(*) < 0.5 THEN 'dictionary' ELSE 'string' END"
        else:
            rule = f"max('{kind}')"
        parts.append(f"SELECT '{c}' AS \"column\", '{kind}' AS type, {rule} AS narrowed FROM {table}")
    return " UNION ALL ".join(parts)


@query("f32_narrowing_plan", _narrow_sql("lineitem"))
def f32_narrowing_plan(t):
    return validate.narrowing_plan(t.lineitem).select("column", "type", "narrowed")


def _least_type(column: str) -> str:
    sizes = (("tinyint", 7), ("smallint", 15), ("int", 31))
    cases = " ".join(f"WHEN min({column}) >= -{2**bits} AND max({column}) < {2**bits} THEN '{kind}'" for kind, bits in sizes)
    return f"(SELECT CASE {cases} ELSE 'bigint' END FROM part)"


@query(
    "f32_narrowed_part",
    f"""SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(p_size AS BIGINT) AS p_size, p_brand,
        {_least_type("p_partkey")} AS p_partkey_type, {_least_type("p_size")} AS p_size_type FROM part""",
)
def f32_narrowed_part(t):
    """Narrowed values and the types that the operator gave their columns."""
    out = validate.narrow_types(t.part.select("p_partkey", "p_size", "p_brand"))
    kinds = dict(out.dtypes)
    numbers = ("p_partkey", "p_size")
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in numbers], "p_brand", *[F.lit(kinds[c]).alias(f"{c}_type") for c in numbers])


@query("f39_auto_target", f"SELECT 'urgency' AS target, count(*) AS rows FROM {MESSY} m")
def f39_auto_target(t):
    df = messy(t)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(schema.auto_target(schema.infer_schema(df))).alias("target"), "rows")
