import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import catalog, explore, keys, profile
from millrace.operators.clean import schema
from millrace.operators.quality import bias, drift, leakage
from millrace.sources.catalog import Keys, catalog_frame, foreign_key_frame


def test_no_drift_against_itself(table):
    events = table("events")
    assert drift.drift_ks(events, events, "value").first()["ks"] == 0.0
    assert drift.drift_chi2(events, events, "event_type").first()["chi2"] == pytest.approx(0.0)


def test_drift_is_found_and_counted(spark):
    rng = np.random.default_rng(1)
    ref = spark.createDataFrame([(float(v), "a") for v in rng.normal(0, 1, 500)], "v double, c string")
    new = spark.createDataFrame([(float(v), "b" if i % 2 else "a") for i, v in enumerate(rng.normal(1, 1, 500))], "v double, c string")
    report = drift.detect_drift(ref, new, schema.infer_schema(ref.unionByName(new)))
    assert {r["column"]: r["drifted"] for r in report.collect()} == {"v": True, "c": True}
    assert drift.drift_summary(report).first().asDict() == {"tested": 2, "drifted": 2, "drift_rate": 1.0}


def test_new_category_is_smoothed(spark):
    ref = spark.createDataFrame([("a",)] * 20, "c string")
    new = spark.createDataFrame([("a",)] * 10 + [("z",)] * 10, "c string")
    chi2, dof, n_ref, n_new = drift.drift_chi2(ref, new, "c").first()
    expected = np.array([21, 1]) / 22 * 20
    observed = np.array([11, 11]) / 22 * 20
    assert chi2 == pytest.approx((((observed - expected) ** 2) / expected).sum()) and (dof, n_ref, n_new) == (1, 20, 20)


def test_leakage_boundary(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(0, 1, 2_000)
    df = spark.createDataFrame([(float(a), float(a * 2), float(a + b)) for a, b in zip(y, rng.normal(0, 1, 2_000))], "target double, copy double, noisy double")
    found = {r["column"]: r["corr_flag"] for r in leakage.detect_leakage(df, schema.infer_schema(df), "target").collect()}
    assert found == {"copy": True}


def test_text_target_leakage(spark):
    df = spark.createDataFrame([("no", 0), ("yes", 1)] * 20, "churn string, x int")
    assert leakage.detect_leakage(df, schema.infer_schema(df), "churn").first()["column"] == "x"


def test_bias_by_word(spark):
    rows = [("m", 9.0), ("m", 11.0), ("f", 19.0), ("f", 21.0)] * 15 + [("x", 5.0)] * 2
    df = spark.createDataFrame(rows, "gender string, pay double")
    r = bias.bias_report(df, schema.infer_schema(df), "pay").first()
    assert r["column"] == "gender" and r["biased"] and r["disparity"] == 10.0 and r["p_value"] < 0.01


def test_chi2_with_empty_cells(spark):
    rows = [("a", "x")] * 10 + [("b", "y")] * 12 + [("c", "x")] * 3
    df = spark.createDataFrame(rows, "p string, q string")
    n = np.array([[10, 0], [0, 12], [3, 0]], float)
    e = np.outer(n.sum(1), n.sum(0)) / n.sum()
    chi2, dof = bias.chi2_independence(df, "p", "q").first()
    assert chi2 == pytest.approx(((n - e) ** 2 / e).sum()) and dof == 2


def test_profile_of_empty_table(spark):
    p = profile.profile(spark.createDataFrame([], "a int, b string"), "t")
    assert profile.quality_scores(p).first()["score"] == 100.0


@pytest.mark.parametrize("nulls, severity", [(51, "High"), (50, "Medium"), (21, "Medium"), (20, None)])
def test_issue_bands(spark, nulls, severity):
    df = spark.createDataFrame([(None if i < nulls else i,) for i in range(100)], "a int")
    found = [r["severity"] for r in profile.quality_issues(profile.profile(df, "t")).collect()]
    assert found == ([severity] if severity else [])


@pytest.mark.parametrize("stored", [True, False])
def test_value_counts_agree(table, stored):
    df = table("orders")
    got = profile.value_counts(df, ["o_orderstatus", "o_custkey"], stored)
    assert got.groupBy("column").agg(F.sum("n").alias("n")).where("n <> 1500").count() == 0


def test_keys_and_dependencies_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, "a", None), (1, 2, "a", "x"), (2, 1, "b", None), (2, 2, "b", "y")], "p int, q int, r string, s string")
    assert {r["key"] for r in keys.candidate_keys(df).collect()} == {"p, q", "q, r", "p, s", "r, s"}
    deps = {(r["determinant"], r["dependent"]) for r in keys.functional_deps(df).collect()}
    assert ("p", "r") in deps and ("r", "p") in deps and ("q", "s") not in deps and ("s", "q") in deps


def test_schema_health_penalties(spark):
    tables = {"Bad_Name": spark.range(1), "ok": spark.range(1)}
    cat, fks = catalog_frame(spark, tables), foreign_key_frame(spark, Keys())
    valid = spark.createDataFrame([("ok",)], "table string")
    assert catalog.schema_health(cat, valid, fks).first().asDict() == {"score": 70, "findings": 3}
    advice = {r["kind"]: r["advice"] for r in catalog.schema_recommendations(cat, valid, fks).collect()}
    assert advice["naming"] == "rename to bad__name"


def test_category_needs_word_boundaries(spark):
    rows = [("width", "int"), ("user_id", "int"), ("hotel", "string"), ("unit_price", "double"), ("is_new", "boolean")]
    got = {r["column"]: r["category"] for r in catalog.classify_columns(spark.createDataFrame(rows, "column string, type string")).collect()}
    assert got == {"width": "numeric", "user_id": "identifier", "hotel": "text", "unit_price": "monetary", "is_new": "categorical"}


def test_histogram_of_one_value(spark):
    h = explore.histogram(spark.createDataFrame([(5.0,)] * 4, "v double"), "v", 5).collect()
    assert sum(r["n"] for r in h) == 4 and len(h) == 5


def test_corr_pairwise_and_complete_differ_on_gaps(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 1.0, 3.0), (3.0, 5.0, 4.0), (4.0, 4.0, 9.0)], "a double, b double, c double")
    pdf = df.toPandas()
    pick = lambda f: {(r["x"], r["y"]): r["r"] for r in f.collect()}
    loose, tight = pick(explore.corr_matrix(df, complete=False)), pick(explore.corr_matrix(df))
    assert loose[("a", "b")] == pytest.approx(pdf["a"].corr(pdf["b"]))
    assert tight[("a", "b")] == pytest.approx(pdf.dropna()["a"].corr(pdf.dropna()["b"]))
