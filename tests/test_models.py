from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import classification as mc
from pyspark.ml import regression as mr
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from millrace.operators.cluster.neighbors import knn_predict, pack_columns
from millrace.operators.ml import evaluate as ev
from millrace.operators.ml import bins, explain, models, prep
from millrace.operators.ml.baseline import baseline, baseline_task
from millrace.operators.ml.nearest import Nearest


@pytest.fixture(scope="module")
def loans(spark):
    rng = np.random.default_rng(11)
    n = 240
    income, debt = rng.normal(50, 12, n), rng.random(n)
    pdf = pd.DataFrame({"loan_id": range(n), "income": income, "debt_ratio": debt, "purpose": rng.choice(["car", "home"], n)})
    pdf["loan_approved"] = ((income - 50) / 12 - 2 * (debt - 0.5) + rng.normal(0, 0.3, n) > 0).astype(int)
    return spark.createDataFrame(pdf)


def test_tasks(spark):
    df = spark.createDataFrame([(i, i % 2, i % 5, str(i), float(i)) for i in range(50)], "id int, b int, m int, s string, r double")
    assert [prep.detect_task(df, c) for c in ("b", "m", "s", "r")] == ["binary", "multiclass", "multiclass", "regression"]
    assert baseline_task(df, "r") == "regression" and baseline_task(df, "m") == "multiclass"


def test_preprocessor_handles_gaps_and_new_classes(spark):
    train = spark.createDataFrame([(1.0, "a"), (None, "b"), (2.0, "a"), (3.0, None)], "x double, c string")
    model = prep.build_preprocessor(["x"], ["c"]).fit(train)
    new = spark.createDataFrame([(None, "zzz")], "x double, c string")
    features = model.transform(new).first()["features"]
    assert features[0] == pytest.approx(0.0) and features[1] == -1.0


def test_compare_ranks_and_reports_failures(loans):
    broken = mc.LogisticRegression(labelCol="nowhere")
    scores = models.run_cv(loans, "loan_approved", ["loan_id"], candidates={"good": mc.LogisticRegression(), "broken": broken}, folds=3)
    assert scores.where("model = 'broken' AND error IS NOT NULL").count() == 1
    good = scores.where("model = 'good'").toPandas()
    assert len(good) == 3 and good["val_score"].between(0.8, 1).all()
    board = ev.leaderboard(scores.where("error IS NULL")).first()
    assert board["rank"] == 1 and board["cv_mean"] == pytest.approx(good["val_score"].mean())


def test_folds_do_not_depend_on_partitioning(loans):
    f = lambda d: d.select("loan_id", models.fold_column(["loan_id"], 5).alias("f")).orderBy("loan_id").collect()
    assert f(loans) == f(loans.repartition(7))


def test_holdout_importance_and_explanation(loans, spark, tmp_path):
    model, held = models.train_final(loans, "loan_approved", ["loan_id"], mc.LogisticRegression())
    assert 20 < held.count() < 80 and held.where("score < 0 OR score > 1").count() == 0
    names = ["income", "debt_ratio", "purpose"]
    shares = explain.feature_importance(spark, model, names).toPandas()
    assert shares["share_pct"].sum() == pytest.approx(100) and shares["feature"].iloc[0] == "income"
    frame = loans.withColumn("label", F.col("loan_approved").cast("double"))
    effects = explain.explain_linear(model, frame, names).toPandas()
    assert set(effects["feature"]) == set(names) and (effects["mean_abs_effect"] >= 0).all()
    drops = explain.permutation_importance(model, frame, names, "binary", ["loan_id"]).toPandas().set_index("feature")["importance"]
    assert drops["income"] > drops["purpose"]
    models.save_model(model, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m")).transform(frame).select("prediction").collect()
    assert again == model.transform(frame).select("prediction").collect()


def test_tuning_samples_within_the_ranges(loans):
    best, trials = models.tune(loans, "loan_approved", ["loan_id"], "Logistic Regression", n_iter=2, folds=2)
    assert set(best) == {"regParam", "elasticNetParam"}
    assert trials.select("model").distinct().count() == 2


def test_paired_test(spark):
    rows = [("a", i, 0.9, 0.8 + i / 100) for i in range(4)] + [("b", i, 0.9, 0.7 + i / 200) for i in range(4)]
    scores = spark.createDataFrame(rows, "model string, fold int, train_score double, val_score double")
    t = ev.paired_ttest(scores, "a", "b")
    d = np.array([0.1 + i / 200 for i in range(4)])
    assert t["t"] == pytest.approx(d.mean() / (d.std(ddof=1) / 2)) and t["significant"]
    assert ev.paired_ttest(scores.where("fold < 2"), "a", "b") is None


def test_perfect_and_reversed_scores(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "label int, score double")
    assert ev.auc(df).first()[0] == 1.0 and ev.average_precision(df).first()[0] == 1.0
    assert ev.auc(df.withColumn("score", -F.col("score"))).first()[0] == 0.0
    assert ev.auc(df.withColumn("score", F.lit(1.0))).first()[0] == 0.5


def test_report_of_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 0)], "label int, prediction int")
    by = {r["class"]: r for r in ev.classification_report(df).collect()}
    assert by["1"]["precision"] == by["1"]["recall"] == by["1"]["f1"] == 0.0 and by["0"]["recall"] == 1.0


def test_baseline_needs_rows(loans):
    assert baseline(loans.limit(19), "loan_approved", ["loan_id"]) is None
    small = baseline(loans, "loan_approved", ["loan_id"], trees=3, folds=2)
    assert small.task == "binary" and small.importances.count() == 3


def test_knn_class_ties_go_to_the_smaller_label(spark):
    train = pack_columns(spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 2.0), (4, 3.0)], "id bigint, x double"), "id", ["x"])
    labels = spark.createDataFrame([(1, 7), (2, 5), (3, 5), (4, 7)], "lid bigint, label int")
    train = train.join(labels, F.col("id") == F.col("lid")).drop("lid")
    test = pack_columns(spark.createDataFrame([(9, 1.5)], "id bigint, x double"), "id", ["x"])
    assert knn_predict(train, test, 4).first()["prediction"] == 5.0
    assert knn_predict(train, test, 2, regression=True).first()["prediction"] == 5.0


def test_baseline_fits_only_what_is_asked_for(loans, monkeypatch):
    """Scores need no final fit and importances no folds."""
    from millrace.operators.ml import baseline as module

    def never(*args, **options):
        raise AssertionError("fitted without need")

    for unused, asked, n in (("run_cv", "importances", 3), ("train_final", "scores", 2)):
        with monkeypatch.context() as patch:
            patch.setattr(module, unused, never)
            assert getattr(baseline(loans, "loan_approved", ["loan_id"], trees=2, folds=2), asked).count() == n


def test_models_share_the_preprocessing_of_a_fold(loans, monkeypatch):
    """Two models, two folds: preprocessing is fitted twice, not four times."""
    made = []
    build = models.build_preprocessor
    monkeypatch.setattr(models, "build_preprocessor", lambda *a: made.append(a) or build(*a))
    candidates = {n: m for n, m in models.models("regression").items() if n in ("Ridge", "Lasso")}
    scores = models.run_cv(loans, "loan_approved", ["loan_id"], task="regression", candidates=candidates, folds=2)
    assert scores.where("error IS NULL").count() == 4 and len(made) == 2


def test_swapped_columns_are_scored_in_one_pass(spark, monkeypatch):
    """All forms of the rows go through the model together; an ignored column has no importance."""
    rows = [(i, float(i % 10), float(i % 7), float(i % 10) * 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, y double")
    model, _ = models.train_final(df, "y", ["id"], models.models("regression")["Decision Tree"], "regression")
    monkeypatch.setattr(explain, "score_of", None)
    found = {r["feature"]: r["importance"] for r in explain.permutation_importance(model, df.withColumn("label", F.col("y")), ["a", "b"], "regression", ["id"]).collect()}
    assert found["a"] > 0.5 and abs(found["b"]) < 1e-9


def test_merged_rows_fit_the_same_trees(spark, monkeypatch):
    """Trees and boosting by squared errors see one row for all rows of equal bins and score as on single rows."""
    rng = np.random.default_rng(4)
    n = 26_000  # more rows to fit than thresholds are drawn from
    pdf = pd.DataFrame({"id": range(n), "a": rng.normal(0, 1, n), "b": rng.integers(0, 40, n).astype(float), "c": rng.choice(["x", "y"], n)})
    pdf["y"] = np.sin(pdf["a"]) * pdf["b"] + (pdf["c"] == "x") * 5 + rng.random(n)
    df = spark.createDataFrame(pdf)
    # shallow: in nodes of a few rows splits of equal gain are told apart by rounding
    trees = {"tree": mr.DecisionTreeRegressor(maxDepth=4, seed=1), "boosted": mr.GBTRegressor(maxIter=4, maxDepth=3, seed=1)}
    found = []
    for merged in (bins.mergeable, lambda estimator: False):
        monkeypatch.setattr(models, "mergeable", merged)
        scores = models.run_cv(df, "y", ["id"], task="regression", candidates=trees, folds=2)
        found.append([(r.model, r.fold, r.train_score, r.val_score, r.error) for r in scores.orderBy("model", "fold").collect()])
    assert [r[:2] + r[4:] for r in found[0]] == [r[:2] + r[4:] for r in found[1]] and len(found[0]) == 4
    assert np.allclose([r[2:4] for r in found[0]], [r[2:4] for r in found[1]], rtol=1e-9, atol=0)


def test_boosting_passes_over_bins_not_rows(spark, monkeypatch):
    """What is fitted does not grow with the rows."""
    seen = []
    fit = mr.GBTRegressor.fit
    monkeypatch.setattr(mr.GBTRegressor, "fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    df = spark.range(2000).select("id", (F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("double").alias("y"))
    models.run_cv(df, "y", ["id"], task="regression", candidates={"boosted": mr.GBTRegressor(maxIter=2, maxDepth=2)}, folds=2)
    assert seen == [7, 7]


def test_nearest_rows_as_a_model(spark):
    """Mean and shares of the nearest rows against plain numpy; equal rows count as often as they come."""
    rng = np.random.default_rng(6)
    x, y, c = rng.normal(0, 1, (60, 2)), rng.normal(0, 1, 60), rng.integers(0, 3, 60)
    rows = [(i, x[i].tolist(), float(y[i]), float(c[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y double, c double").withColumn("features", array_to_vector("v"))
    near = np.argsort(((x[:, None] - x[None, :40]) ** 2).sum(2), axis=1)[:, :5]
    mean = {r.id: r.prediction for r in Nearest(labelCol="y").fit(df.where("id < 40")).transform(df).collect()}
    assert np.allclose([mean[i] for i in range(60)], y[near].mean(1))
    shares = {r.id: r for r in Nearest(labelCol="c", classes=True).fit(df.where("id < 40")).transform(df).collect()}
    want = np.stack([np.bincount(c[n], minlength=3) / 5 for n in near])
    assert np.allclose([shares[i].probability.toArray() for i in range(60)], want)
    assert [shares[i].prediction for i in range(60)] == want.argmax(1).tolist()
    copies = spark.createDataFrame([([0.0], 1.0)] * 3 + [([0.0], 3.0)] + [([9.0], 8.0)] * 4, "v array<double>, label double").select(array_to_vector("v").alias("features"), "label")
    assert [r.prediction for r in Nearest(k=5).fit(copies).transform(copies.limit(1)).collect()] == [pytest.approx((1 + 1 + 1 + 3 + 8) / 5)]


def test_registry_query_compares_every_model_on_all_folds(monkeypatch):
    from millrace.queries import supervised

    asked = []
    monkeypatch.setattr(supervised, "price_features", lambda t: None)
    monkeypatch.setattr(supervised.md, "run_cv", lambda *args, candidates, folds=5: asked.append((set(candidates), folds)) or SimpleNamespace(drop=lambda name: None))
    supervised.g8_model_registry(None)
    assert asked == [(set(models.models("regression")), 5)] and {"Random Forest", "Gradient Boosting", "KNN"} <= asked[0][0]


def test_every_regression_model_has_its_fold_scores(spark):
    df = spark.range(150).select("id", (F.col("id") % 11).cast("double").alias("a"), (F.col("id") % 5).cast("string").alias("b"), (F.col("id") % 11 * 2.0 + F.col("id") % 5).alias("y"))
    small = models.models("regression")
    small["Random Forest"].setNumTrees(3)
    small["Gradient Boosting"].setMaxIter(2)
    scores = models.run_cv(df, "y", ["id"], task="regression", candidates=small, folds=2).collect()
    assert {(r.model, r.fold) for r in scores} == {(m, f) for m in small for f in (0, 1)}
    assert all(r.error is None and r.val_score > 0.2 for r in scores)
