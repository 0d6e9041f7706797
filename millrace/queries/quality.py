"""Group F (second part): leakage, bias and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.clean import schema
from millrace.operators.quality import bias, drift, leakage
from millrace.queries.exploring import rounded
from millrace.queries.registry import query


def _leaky(t):
    return t.orders.select(
        F.col("o_totalprice").alias("amount"),
        (F.col("o_totalprice") * 1.1 + 5).alias("with_tax"),
        F.col("o_custkey").alias("cust"),
        F.col("o_orderdate").alias("placed"),
        F.col("o_orderstatus").alias("after_status"),
    )


@query(
    "f19_leakage",
    """SELECT 'with_tax' AS "column", round(abs(corr(o_totalprice, o_totalprice * 1.1 + 5)), 4) AS correlation, true AS corr_flag, false AS name_flag, false AS datetime_flag FROM orders
       UNION ALL SELECT 'placed', CAST(NULL AS DOUBLE), false, false, true UNION ALL SELECT 'after_status', CAST(NULL AS DOUBLE), false, true, false""",
)
def f19_leakage(t):
    df = _leaky(t)
    return leakage.detect_leakage(df, schema.infer_schema(df), "amount")


@query(
    "f33_group_means",
    """SELECT 'c_mktsegment' AS "column", c_mktsegment AS "group", count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std,
       round(abs(avg(c_acctbal) - (SELECT avg(c_acctbal) FROM customer)), 4) AS diff_from_overall FROM customer GROUP BY c_mktsegment HAVING count(*) >= 5""",
)
def f33_group_means(t):
    return bias.group_report(t.customer, "c_mktsegment", "c_acctbal")


@query(
    "f33_positive_rates",
    """SELECT 'o_orderpriority' AS "column", o_orderpriority AS "group", count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 4) AS positive_rate FROM orders GROUP BY o_orderpriority""",
)
def f33_positive_rates(t):
    df = t.orders.withColumn("closed", F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no"))
    return bias.positive_rates(df, "o_orderpriority", "closed", "yes")


F_STAT = """WITH g AS (SELECT {k} AS k, count(*) AS n, avg({y}) AS m, var_samp({y}) AS v FROM {t} GROUP BY {k}),
  a AS (SELECT avg({y}) AS gm, count(*) AS nn FROM {t})
  SELECT {r} FROM g CROSS JOIN a"""
F_VALUE = "(sum(n * power(m - gm, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (max(nn) - count(*)))"


@query(
    "f33_bias_report",
    """WITH g AS (SELECT c_mktsegment AS k, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY c_mktsegment), a AS (SELECT avg(c_acctbal) AS gm, count(*) AS nn FROM customer)
       SELECT 'c_mktsegment' AS "column", CAST(count(*) AS INT) AS groups, 'anova' AS test, round(max(round(m, 4)) - min(round(m, 4)), 4) AS disparity,
       max(round(m, 4)) - min(round(m, 4)) > 0.1 * abs(max(gm)) AS biased, round(""" + F_VALUE + """, 6) AS statistic FROM g CROSS JOIN a""",
)
def f33_bias_report(t):
    report = bias.bias_report(t.customer, {}, "c_acctbal", ["c_mktsegment"])
    return report.select("column", "groups", "test", "disparity", "biased", F.round("statistic", 6).alias("statistic"))


@query(
    "f34_anova",
    F_STAT.format(k="l_returnflag", y="l_extendedprice", t="lineitem", r=f"round({F_VALUE}, 6) AS f, count(*) - 1 AS df_between, max(nn) - count(*) AS df_within"),
)
def f34_anova(t):
    return rounded(bias.anova(t.lineitem, "l_returnflag", "l_extendedprice"), 6)


def _chi2_sql(source, a, b, yates=False):
    gap = "greatest(abs(coalesce(n, 0) - e) - 0.5, 0)" if yates else "(coalesce(n, 0) - e)"
    return f"""WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {source} GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS na FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY b),
      g AS (SELECT ra.a, rb.b, na * nb * 1.0 / (SELECT sum(n) FROM c) AS e FROM ra CROSS JOIN rb)
      SELECT round(sum(power({gap}, 2) / e), 6) AS chi2, (SELECT count(*) - 1 FROM ra) * (SELECT count(*) - 1 FROM rb) AS dof FROM g LEFT JOIN c ON c.a = g.a AND c.b = g.b"""


@query("f35_chi2", _chi2_sql("events", "event_type", "user_id"))
def f35_chi2(t):
    return rounded(bias.chi2_independence(t.events, "event_type", "user_id"), 6)


@query("f35_chi2_yates", _chi2_sql("labels", "quality", "toxic", yates=True))
def f35_chi2_yates(t):
    return rounded(bias.chi2_independence(t.labels, "quality", "toxic"), 6)


CUT = "TIMESTAMP '2024-01-16 00:00:00'"


def halves(t):
    early = F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return t.events.where(early), t.events.where(~early)


@query(
    "f36_drift_ks",
    f"""WITH u AS (SELECT value AS v, CASE WHEN ts < {CUT} THEN 1 ELSE 0 END AS r FROM events), g AS (SELECT v, sum(r) AS r, sum(1 - r) AS n FROM u GROUP BY v),
        c AS (SELECT sum(r) OVER (ORDER BY v) * 1.0 / sum(r) OVER () AS fr, sum(n) OVER (ORDER BY v) * 1.0 / sum(n) OVER () AS fn FROM g)
        SELECT round(CAST(max(abs(fr - fn)) AS DOUBLE), 6) AS ks, (SELECT count(*) FROM events WHERE ts < {CUT}) AS n_ref, (SELECT count(*) FROM events WHERE ts >= {CUT}) AS n_new FROM c""",
)
def f36_drift_ks(t):
    return rounded(drift.drift_ks(*halves(t), "value"), 6)


CHI2 = f"""WITH k AS (SELECT event_type AS c, sum(CASE WHEN ts < {CUT} THEN 1 ELSE 0 END) AS r, sum(CASE WHEN ts < {CUT} THEN 0 ELSE 1 END) AS w FROM events GROUP BY event_type),
  t AS (SELECT sum(r + 1) AS sr, sum(w + 1) AS sw, sum(w) AS m FROM k)"""
CHI2_VALUE = "sum(power((w + 1) * 1.0 * m / sw - (r + 1) * 1.0 * m / sr, 2) / ((r + 1) * 1.0 * m / sr))"


@query(
    "f37_drift_chi2",
    CHI2 + f" SELECT round(CAST({CHI2_VALUE} AS DOUBLE), 6) AS chi2, count(*) - 1 AS dof, CAST(sum(r) AS BIGINT) AS n_ref, CAST(sum(w) AS BIGINT) AS n_new FROM k CROSS JOIN t",
)
def f37_drift_chi2(t):
    return rounded(drift.drift_chi2(*halves(t), "event_type"), 6)


def _report(t):
    ref, new = (h.select("value", "event_type", "user_id") for h in halves(t))
    return drift.detect_drift(ref, new, schema.infer_schema(t.events.select("value", "event_type", "user_id")))


@query(
    "f38_drift_report",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", 'KS' AS test, (WITH u AS (SELECT {c} AS v, CASE WHEN ts < {CUT} THEN 1 ELSE 0 END AS r FROM events), g AS (SELECT v, sum(r) AS r, sum(1 - r) AS n FROM u GROUP BY v),
        x AS (SELECT sum(r) OVER (ORDER BY v) * 1.0 / sum(r) OVER () AS fr, sum(n) OVER (ORDER BY v) * 1.0 / sum(n) OVER () AS fn FROM g) SELECT round(CAST(max(abs(fr - fn)) AS DOUBLE), 5) FROM x) AS statistic,
        round(avg({c}) FILTER (WHERE ts < {CUT}), 4) AS ref_mean, round(avg({c}) FILTER (WHERE ts >= {CUT}), 4) AS new_mean FROM events"""
        for c in ("value", "user_id")
    ) + f" UNION ALL SELECT 'event_type', 'chi2', ({CHI2} SELECT round(CAST({CHI2_VALUE} AS DOUBLE), 5) FROM k CROSS JOIN t), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)",
)
def f38_drift_report(t):
    return _report(t).select("column", "test", "statistic", "ref_mean", "new_mean")


@query("f38_drift_summary", "SELECT CAST(3 AS BIGINT) AS tested, count(DISTINCT ts) - count(DISTINCT ts) AS drifted, CAST(0.0 AS DOUBLE) AS drift_rate FROM events")
def f38_drift_summary(t):
    return drift.drift_summary(_report(t))
