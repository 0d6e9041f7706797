import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators.clean import encode, impute, outliers, run, scale, schema, select, validate
from millrace.operators.clean.log import log_summary, log_df


@pytest.fixture(scope="module")
def churn(spark):
    rng = np.random.default_rng(3)
    n = 600
    income = rng.normal(50_000, 9_000, n)
    income[::60] *= 10
    income = np.round(income, -3)  # distinct on fewer than 95 % of the rows, so not an identifier
    pdf = pd.DataFrame(
        {
            "customer_id": np.arange(n),
            "income": income,
            "age": rng.integers(18, 90, n).astype(float),
            "plan": rng.choice(["Gold", "silver ", "BRONZE"], n),
            "city": rng.choice([f"city{i}" for i in range(30)], n),
            "segment": rng.choice(["a", "b", "c"], n),
            "active": rng.choice(["Yes", "no"], n),
            "signup_date": pd.date_range("2020-01-01", periods=n).strftime("%d-%m-%Y"),
            "flat": 1.0,
            "churn": rng.integers(0, 2, n),
        }
    )
    pdf.loc[pdf.index % 9 == 0, "age"] = None
    pdf.loc[pdf.index % 7 == 0, "segment"] = None
    return spark.createDataFrame(pdf)


def kinds(df):
    return {c: p.inferred_type for c, p in schema.infer_schema(df).items()}


def test_types_of_messy_columns(churn):
    assert kinds(churn) == {
        "customer_id": "numeric", "income": "numeric", "age": "numeric", "plan": "ordinal", "city": "categorical",
        "segment": "categorical", "active": "boolean", "signup_date": "datetime", "flat": "boolean", "churn": "boolean",
    }


@pytest.mark.parametrize("good, kind", [(8, "numeric"), (7, "categorical")])
def test_conversion_rate_boundary(spark, good, kind):
    rows = [(f"1,{i:03d}",) for i in range(good)] + [("x",)] * (10 - good)
    assert kinds(spark.createDataFrame(rows, "c string"))["c"] == kind


def test_text_numbers_and_flags(spark):
    df = spark.createDataFrame([("0", "2020-01-31"), ("1", "2021-12-01"), (None, "bad")] * 10, "flag string, when_date string")
    found = schema.infer_schema(df)
    assert found["flag"].inferred_type == "boolean" and found["when_date"].inferred_type == "categorical"


def test_scale_order_is_by_meaning():
    assert schema.matching_scale({"high", "low"}) == {"low": 0, "medium": 1, "high": 2}
    assert schema.matching_scale({"high", "blue"}) is None


def test_name_flags(spark):
    df = spark.createDataFrame([(1, 1.5, 2.0, 3)], "user_id int, width double, future_sales double, fraud int")
    s = schema.infer_schema(df)
    assert s["user_id"].is_id_like and s["future_sales"].is_leakage_risk and not s["fraud"].is_leakage_risk
    assert schema.auto_target(s) == "fraud"


@pytest.mark.parametrize("missing, dropped", [(60, True), (59, False)])
def test_drop_rule_boundary(spark, missing, dropped):
    df = spark.createDataFrame([(i, None if i < missing else "v" + str(i % 9)) for i in range(100)], "k int, c string")
    out = impute.drop_sparse(df, schema.infer_schema(df))
    assert ("c" not in out.columns) == dropped


def test_numeric_fills(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (None, 1000.0), (2.0, None)], "a double, b double")
    out = impute.impute_numeric(df, ["a", "b"]).toPandas()
    assert out["a"].tolist()[3] == 2.0
    assert out["b"].isna().sum() == 0


def test_categorical_fill_at_half(spark):
    half = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "c string")
    below = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), (None,)], "c string")
    gone = spark.createDataFrame([(None,)], "c string")
    pick = lambda d: {r["c"] for r in impute.impute_categorical(d, ["c"]).collect()}
    assert "Missing" not in pick(half) and "Missing" in pick(below) and pick(gone) == {"Unknown"}


def test_iterative_imputation_recovers_a_line(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, 300)
    pdf = pd.DataFrame({"k": range(300), "x": x, "y": 3 * x + 2, "z": rng.normal(0, 1, 300)})
    truth = pdf["y"].copy()
    pdf.loc[::5, "y"] = None
    out = impute.impute_iterative(spark.createDataFrame(pdf), ["x", "y", "z"], rounds=2).toPandas().sort_values("k")
    assert np.allclose(out["y"].to_numpy(), truth.to_numpy(), atol=1e-6)
    assert np.allclose(out["z"].to_numpy(), pdf["z"].to_numpy())


def test_winsorize_replaces_by_next_value(spark):
    df = spark.createDataFrame([(float(i),) for i in range(200)], "v double").repartition(4)
    out = outliers.winsorize(df, "v").toPandas()["v"].sort_values().tolist()
    assert out[:3] == [2.0, 2.0, 2.0] and out[-3:] == [197.0, 197.0, 197.0] and len(out) == 200


def test_caps_keep_gaps_and_bounds(churn):
    plan = outliers.plan_outliers(churn, schema.infer_schema(churn), "churn")
    capped = outliers.apply_outliers(churn, plan)
    by = {p.column: p for p in plan}
    assert by["income"].method == "winsorize" and "customer_id" not in by
    assert capped.where("age IS NULL").count() == churn.where("age IS NULL").count()
    assert capped.agg(F.max("income")).first()[0] <= by["income"].upper


def test_onehot_rows_sum_to_at_most_one(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "k string")
    out = encode.encode_onehot(df, "k")
    assert out.columns == ["k_a", "k_b", "k_c"]  # "Missing" sorts first and is dropped
    assert sorted(sum(r) for r in out.collect()) == [0, 1, 1, 1]


def test_target_encoding_never_sees_its_own_fold(spark):
    df = spark.createDataFrame([(i, "only", float(i == 0)) for i in range(5)] + [(9, "once", 7.0)], "id int, c string, y double")
    out = encode.encode_target_kfold(df, "c", "y", F.col("id") % 5).toPandas().set_index("id")["c"]
    assert out[0] == 0.0 and out[1] == 0.25
    assert math.isclose(out[9], 8.0 / 6)


def test_scaler_choice(spark):
    rows = [(i / 100, float(i), float(2 ** (i / 8)), float(i % 2)) for i in range(100)]
    df = spark.createDataFrame(rows, "unit double, plain double, skewed double, bit double")
    plan = {s.column: s.method for s in scale.choose_scalers(df)}
    assert plan == {"unit": "minmax", "plain": "standard", "skewed": "robust"}
    out = scale.scale(df, scale.choose_scalers(df)).agg(F.min("unit"), F.max("unit"), F.stddev_pop("plain")).first()
    assert out[0] == 0 and out[1] == 1 and math.isclose(out[2], 1, abs_tol=1e-5)


def test_selection_drops_twin_and_flat(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1, 5.0, float(i % 7), i % 2) for i in range(100)], "a double, b double, c double, d double, y int")
    out, report = select.select_features(df, "y")
    assert report["removed_variance"] == ["c"] and report["removed_correlation"] == ["b"]
    assert set(out.columns) <= {"a", "d", "y"}


def test_validation_repairs_infinite(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (float("inf"), None), (5.0, None)], "a double, b string")
    checks, fixed = validate.validate(df)
    by = {r["check"]: r for r in checks.collect()}
    assert not by["no_infinite_values"]["passed"] and by["no_infinite_values"]["passed_after"]
    assert by["no_constant_columns"]["columns"] == ["b"]
    assert sorted(r["a"] for r in fixed.collect()) == [1.0, 3.0, 3.0, 5.0]


@pytest.mark.parametrize("high, kind", [(127, "tinyint"), (128, "smallint"), (32768, "int"), (2**31, "bigint")])
def test_narrowing_boundaries(spark, high, kind):
    df = spark.createDataFrame([(0,), (high,)], "v bigint")
    assert dict(validate.narrow_types(df).dtypes)["v"] == kind


@pytest.fixture(scope="module")
def cleaned(churn):
    return run.clean(churn, "churn", key=["customer_id"], order_by="customer_id")


def test_clean_has_no_gaps_and_only_numbers(cleaned, churn):
    data = cleaned.data.drop("signup_date")
    assert data.count() == churn.count()
    assert all(k in ("tinyint", "smallint", "int", "bigint", "float", "double") for _, k in data.dtypes)
    gaps = data.agg(*[F.count_if(F.col(c).isNull()) for c in data.columns]).first()
    assert sum(gaps) == 0
    assert {r["stage"] for r in log_summary(log_df(data.sparkSession, cleaned.log)).collect()} >= {"schema_inference", "missing_values", "encoding"}


def test_clean_is_stable_under_repartitioning(cleaned, churn):
    again = run.clean(churn.repartition(13), "churn", key=["customer_id"], order_by="customer_id").data
    a, b = (d.orderBy("customer_id").toPandas() for d in (cleaned.data, again))
    assert list(a.columns) == list(b.columns)
    numeric = [c for c in a.columns if c != "signup_date"]
    assert np.allclose(a[numeric].astype(float), b[numeric].astype(float), atol=1e-5)


def test_replay_equals_fit_outside_target_encoding(cleaned, churn):
    replayed = cleaned.apply(churn).orderBy("customer_id").toPandas()
    fitted = cleaned.data.orderBy("customer_id").toPandas()
    shared = [c for c in fitted.columns if c not in ("city", "signup_date")]
    assert set(shared) <= set(replayed.columns)
    assert np.allclose(fitted[shared].astype(float), replayed[shared].astype(float), atol=1e-4)


def test_saved_artifacts_read_back(cleaned, spark, tmp_path):
    run.save_result(cleaned, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "data")).count() == 600
    assert spark.read.parquet(str(tmp_path / "schema")).count() == 10
    assert spark.read.parquet(str(tmp_path / "encoding_table_city")).count() == 30


def test_iterative_imputation_stores_nothing_and_equals_plain(spark, monkeypatch):
    """Five rounds against numpy; the table is not written between rounds."""
    monkeypatch.setattr("millrace.plans.lineage.cut_lineage", None)
    monkeypatch.setattr(impute, "cut_lineage", None, raising=False)
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (300, 3)) @ rng.normal(0, 1, (3, 3)) + [1e6, 5.0, 0.0]
    gone = rng.random(x.shape) < 0.2
    rows = [(i, *[None if g else float(v) for v, g in zip(r, m)]) for i, (r, m) in enumerate(zip(x, gone))]
    got = impute.impute_iterative(spark.createDataFrame(rows, "id int, a double, b double, c double"), ["a", "b", "c"]).orderBy("id").toPandas()
    seen = np.where(gone, np.nan, x)
    state = np.where(gone, np.nanmean(seen, 0), x)
    for _ in range(5):
        fresh = state.copy()
        for c in range(3):
            others, known = [o for o in range(3) if o != c], ~gone[:, c]
            a = np.column_stack([np.ones(known.sum()), state[known][:, others]])
            beta = np.linalg.lstsq(a, state[known, c], rcond=None)[0]
            fresh[~known, c] = beta[0] + state[~known][:, others] @ beta[1:]
        state = fresh
    assert np.allclose(got[["a", "b", "c"]].to_numpy(), state, rtol=1e-7)


def test_mutual_information_is_counted_in_batches(spark):
    """Equal to counts in numpy; tasks send counts, not one row a value."""
    rng = np.random.default_rng(5)
    a, y = np.round(rng.normal(0, 1, 500), 2), rng.integers(0, 3, 500)
    df = spark.createDataFrame([(float(v), int(k)) for v, k in zip(a, y)], "a double, y int")
    found = select.mutual_information(df, "y", ["a"])
    x = np.searchsorted(np.unique(np.quantile(a, np.arange(1, 10) / 10)), a, side="right")
    p = np.histogram2d(x, y, bins=[np.arange(11), np.arange(4)])[0] / 500
    outer = np.outer(p.sum(1), p.sum(0))
    want = (p[p > 0] * np.log(p[p > 0] / outer[p > 0])).sum()
    assert found.first()["mi"] == pytest.approx(want, rel=1e-9)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
