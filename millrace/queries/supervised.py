"""Group G: dataset profile, model comparison, evaluation."""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from millrace.operators.cluster.neighbors import as_points, knn_predict
from millrace.operators.ml import evaluate as ev
from millrace.operators.ml import explain as xp
from millrace.operators.ml import models as md
from millrace.operators.ml import prep
from millrace.operators.ml.baseline import baseline
from millrace.queries.exploring import rounded
from millrace.queries.profiling import HOLED, holed
from millrace.queries.registry import query
from millrace.queries.sources import _scratch
from millrace.sources.writers import export


@query(
    "g1_dataset_profile",
    f"""SELECT count(*) AS rows, 11 AS columns, 8 AS numeric, 2 AS categorical,
        round(100.0 * (count(*) * 3 - count(l_quantity) - count(l_tax) - count(l_returnflag)) / (count(*) * 11), 4) AS missing_pct, 'multiclass' AS task FROM {HOLED} h""",
)
def g1_dataset_profile(t):
    return prep.profile_dataset(holed(t), "l_returnflag")


@query(
    "g2_detect_task",
    """SELECT c AS "column", CASE WHEN k <= 2 THEN 'binary' WHEN txt OR k <= 20 THEN 'multiclass' ELSE 'regression' END AS task FROM (
       SELECT 'l_linestatus' AS c, count(DISTINCT l_linestatus) AS k, true AS txt FROM lineitem UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber), false FROM lineitem
       UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity), false FROM lineitem) x""",
)
def g2_detect_task(t):
    cols = ["l_linestatus", "l_linenumber", "l_quantity"]
    return t.spark.createDataFrame([(c, prep.detect_task(t.lineitem, c)) for c in cols], "column string, task string")


@query("g3_class_balance", "SELECT l_returnflag AS label, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY l_returnflag")
def g3_class_balance(t):
    return rounded(prep.class_balance(t.lineitem, "l_returnflag"), 6)


_LINE_NUMS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


@query(
    "g4_target_correlations",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(abs(corr({c}, l_extendedprice)), 6) AS corr FROM lineitem" for c in _LINE_NUMS),
)
def g4_target_correlations(t):
    return rounded(prep.target_correlations(t.lineitem, "l_extendedprice"), 6)


@query("g5_preprocess")
def g5_preprocess(t):
    frame, numeric, categorical = prep.model_frame(holed(t).drop("l_shipdate"), None, None)
    return prep.build_preprocessor(numeric, categorical).fit(frame).transform(frame).select("features")


@query("g6_label_encoding", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS code FROM orders")
def g6_label_encoding(t):
    return prep.label_encode(t.orders, "o_orderpriority", "code").select("o_orderkey", "code")


def doc_features(t):
    """Labelled documents with counted text features."""
    words = F.size(F.split("text", r"\s+"))
    return t.labels.join(t.documents, "doc_id").select(
        "doc_id", "quality", "n_chars", words.alias("words"),
        F.size(F.split("text", "\n")).alias("lines"),
        (F.length("text") - F.length(F.regexp_replace("text", "[0-9]", ""))).alias("digits"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[.,;:!?]", ""))).alias("marks"),
        "lang",
    )


def price_features(t):
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_id"),
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice",
    )


@query("g7_cross_validation")
def g7_cross_validation(t):
    candidates = {n: m for n, m in md.models("binary").items() if n in ("Logistic Regression", "Decision Tree")}
    return md.run_cv(doc_features(t), "quality", ["doc_id"], candidates=candidates, folds=3).drop("seconds")


@query("g8_model_registry")
def g8_model_registry(t):
    return md.run_cv(price_features(t), "l_extendedprice", ["line_id"], candidates=md.models("regression")).drop("seconds")


NEAR = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
  d AS (SELECT a.vec_id AS id, b.vec_id AS neighbor, b.label, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, neighbor) AS rank FROM d)"""


@query(
    "g9_knn_classify",
    NEAR + """, v AS (SELECT id, label, count(*) AS n FROM r WHERE rank <= 5 GROUP BY id, label)
       SELECT id, CAST(label AS DOUBLE) AS prediction FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS k FROM v) w WHERE k = 1""",
)
def g9_knn_classify(t):
    points = as_points(t.embeddings, "vec_id", "embedding")
    train = points.join(t.embeddings.select(F.col("vec_id").alias("_v"), "label"), F.col("id") == F.col("_v")).drop("_v")
    return knn_predict(train, points, 5, exclude_self=True, cells=8)


@query("g9_knn_regress", NEAR + " SELECT id, round(avg(label), 6) AS prediction FROM r WHERE rank <= 5 GROUP BY id")
def g9_knn_regress(t):
    points = as_points(t.embeddings, "vec_id", "embedding")
    train = points.join(t.embeddings.select(F.col("vec_id").alias("_v"), "label"), F.col("id") == F.col("_v")).drop("_v")
    return rounded(knn_predict(train, points, 5, regression=True, exclude_self=True), 6)


def line_fold_scores(t):
    """Fold scores of two one-feature price models, measured on the lines themselves."""
    fold = F.pmod(F.col("l_orderkey"), F.lit(5)).cast("int")
    parts = []
    for name, feature in (("by quantity", "l_quantity"), ("by discount", "l_discount")):
        fit = t.lineitem.groupBy(fold.alias("fold")).agg(
            F.regr_r2("l_extendedprice", feature).alias("val_score"), F.regr_r2("l_extendedprice", F.col(feature) + F.col("l_tax")).alias("train_score")
        )
        parts.append(fit.select(F.lit(name).alias("model"), "fold", "train_score", "val_score"))
    return parts[0].unionByName(parts[1])


FOLDS = "(" + " UNION ALL ".join(
    f"SELECT '{n}' AS model, CAST(l_orderkey % 5 AS INT) AS fold, regr_r2(l_extendedprice, {f} + l_tax) AS train_score, regr_r2(l_extendedprice, {f}) AS val_score FROM lineitem GROUP BY 2"
    for n, f in (("by quantity", "l_quantity"), ("by discount", "l_discount"))
) + ")"
BOARD = f"""(SELECT model, count(*) AS folds, avg(val_score) AS cv_mean, stddev_pop(val_score) AS cv_std, avg(train_score) AS train_score, abs(avg(train_score) - avg(val_score)) AS overfit_gap FROM {FOLDS} f GROUP BY model)"""


@query(
    "g10_leaderboard",
    f"""SELECT row_number() OVER (ORDER BY cv_mean - 0.3 * cv_std - 0.4 * overfit_gap DESC) AS rank, model, folds, round(cv_mean, 6) AS cv_mean, round(cv_std, 6) AS cv_std, round(train_score, 6) AS train_score,
        round(overfit_gap, 6) AS overfit_gap, round(cv_mean - 0.3 * cv_std - 0.4 * overfit_gap, 6) AS final_score, cv_std > 0.04 AS high_variance, overfit_gap > 0.1 AS overfitting FROM {BOARD} b""",
)
def g10_leaderboard(t):
    return rounded(ev.leaderboard(line_fold_scores(t)), 6)


@query("g11_parallel_models")
def g11_parallel_models(t):
    board, _, _ = md.compare(
        doc_features(t), "quality", ["doc_id"], folds=2, parallelism=4,
        candidates={n: m for n, m in md.models("binary").items() if n in ("Logistic Regression", "Linear SVC", "Decision Tree")},
    )
    return board


@query(
    "g12_paired_t",
    f"""SELECT count(*) AS folds, round(avg(a.val_score - b.val_score), 6) AS mean_diff, round(avg(a.val_score - b.val_score) / (stddev_samp(a.val_score - b.val_score) / sqrt(count(*))), 4) AS t
        FROM {FOLDS} a JOIN {FOLDS} b ON a.fold = b.fold WHERE a.model = 'by quantity' AND b.model = 'by discount'""",
)
def g12_paired_t(t):
    r = ev.paired_t(line_fold_scores(t), "by quantity", "by discount")
    return r.select("folds", F.round("mean_diff", 6).alias("mean_diff"), F.round("t", 4).alias("t"))


@query("g13_tuning")
def g13_tuning(t):
    _, trials = md.tune(doc_features(t), "quality", ["doc_id"], "Logistic Regression", n_iter=3, folds=2)
    return trials.drop("seconds")


@query("g14_holdout")
def g14_holdout(t):
    _, held = md.train_final(doc_features(t), "quality", ["doc_id"], md.models("binary")["Logistic Regression"])
    return held


@query("g15_feature_importance")
def g15_feature_importance(t):
    model, _ = md.train_final(price_features(t), "l_extendedprice", ["line_id"], md.models("regression")["Decision Tree"])
    return xp.feature_importance(t.spark, model, ["l_quantity", "l_discount", "l_tax", "l_returnflag"])


LINEAR = {"l_quantity": 1500.0, "l_discount": -2000.0, "l_tax": 10.0}


@query(
    "g16_linear_contributions",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(abs({w} * ({c} - m))), 4) AS mean_abs_effect FROM lineitem, (SELECT avg({c}) AS m FROM lineitem) q" for c, w in LINEAR.items()
    ),
)
def g16_linear_contributions(t):
    return rounded(xp.linear_contributions(t.lineitem, LINEAR))


@query("g16_permutation_importance")
def g16_permutation_importance(t):
    df = price_features(t)
    model, _ = md.train_final(df, "l_extendedprice", ["line_id"], md.models("regression")["Decision Tree"])
    frame = df.withColumn("label", F.col("l_extendedprice"))
    return xp.permutation_importance(model, frame, ["l_quantity", "l_discount", "l_tax", "l_returnflag"], "regression", ["line_id"])


# A deterministic score: big orders are guessed to be closed.
PRED = "(SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label, CAST(o_custkey % 3 AS INT) AS prediction FROM orders)"


def predictions(t):
    status = F.col("o_orderstatus")
    return t.orders.select(
        "o_orderkey", F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("label"), (F.col("o_custkey") % 3).cast("int").alias("prediction")
    )


@query(
    "g17_confusion_matrix",
    f"SELECT label, prediction, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY label), 6) AS row_share FROM {PRED} p GROUP BY label, prediction",
)
def g17_confusion_matrix(t):
    return rounded(ev.confusion_matrix(predictions(t)), 6)


@query(
    "g18_classification_report",
    f"""WITH p AS (SELECT * FROM {PRED} x), k AS (SELECT c, (SELECT count(*) FROM p WHERE label = c) AS support, (SELECT count(*) FROM p WHERE prediction = c) AS guessed, (SELECT count(*) FROM p WHERE label = c AND prediction = c) AS hit FROM (VALUES (0), (1), (2)) v(c)),
        m AS (SELECT CAST(c AS VARCHAR) AS class, hit * 1.0 / guessed AS precision, hit * 1.0 / support AS recall, 2.0 * hit / (guessed + support) AS f1, support, hit FROM k)
        SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
          SELECT class, precision, recall, f1, support FROM m UNION ALL SELECT 'accuracy', sum(hit) * 1.0 / sum(support), sum(hit) * 1.0 / sum(support), sum(hit) * 1.0 / sum(support), CAST(sum(support) AS BIGINT) FROM m
          UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM m
          UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM m) r""",
)
def g18_classification_report(t):
    return rounded(ev.classification_report(predictions(t)), 6)


def scores(t):
    return t.lineitem.select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"), F.col("l_quantity").alias("score"))


SCORED = "(SELECT l_quantity AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"
RANKED = f"""WITH g AS (SELECT s, sum(y) AS p, sum(1 - y) AS q FROM {SCORED} x GROUP BY s),
  c AS (SELECT s, p, q, sum(p) OVER (ORDER BY s DESC) AS tp, sum(q) OVER (ORDER BY s DESC) AS fp, sum(q) OVER (ORDER BY s) - q AS below, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM g)"""


@query("g19_roc", f"{RANKED} SELECT s AS score, round(fp * 1.0 / nq, 6) AS fpr, round(tp * 1.0 / np, 6) AS tpr FROM c")
def g19_roc(t):
    return rounded(ev.roc(scores(t)), 6)


@query("g19_auc", f"{RANKED} SELECT round(CAST(sum(p * (below + 0.5 * q)) / max(np * nq * 1.0) AS DOUBLE), 6) AS auc FROM c")
def g19_auc(t):
    return rounded(ev.auc(scores(t)), 6)


@query("g20_pr_curve", f"{RANKED} SELECT s AS score, round(tp * 1.0 / (tp + fp), 6) AS precision, round(tp * 1.0 / np, 6) AS recall, round(p * 1.0 / np, 6) AS step FROM c")
def g20_pr_curve(t):
    return rounded(ev.pr_curve(scores(t)), 6)


@query("g20_average_precision", f"{RANKED} SELECT round(CAST(sum(p * 1.0 / np * tp / (tp + fp)) AS DOUBLE), 6) AS average_precision FROM c")
def g20_average_precision(t):
    return rounded(ev.average_precision(scores(t)), 6)


def price_guess(t):
    return t.lineitem.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1900.0).alias("prediction"))


GUESS = "(SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 1900.0 AS e FROM lineitem)"


@query(
    "g21_regression_metrics",
    f"""SELECT count(*) AS n, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - avg(e * e) / var_pop(y), 4) AS r2, round(100 * avg(abs(e) / (abs(y) + 1e-9)), 4) AS mape FROM {GUESS} g""",
)
def g21_regression_metrics(t):
    return rounded(ev.regression_metrics(price_guess(t)))


@query("g21_residuals", f"SELECT round(avg(e), 4) AS mean_residual, round(stddev_samp(e), 4) AS spread FROM {GUESS} g")
def g21_residuals(t):
    r = ev.residuals(price_guess(t))
    return r.agg(F.round(F.avg("residual"), 4).alias("mean_residual"), F.round(F.stddev_samp("residual"), 4).alias("spread"))


@query(
    "g22_fold_table",
    "SELECT model, " + ", ".join(f"round(max(CASE WHEN fold = {i} THEN val_score END), 6) AS fold_{i + 1}" for i in range(5)) + f" FROM {FOLDS} f GROUP BY model",
)
def g22_fold_table(t):
    path = _scratch(t, "folds")
    export(ev.fold_table(line_fold_scores(t), 5), path, "json")
    names = ", ".join(f"fold_{i + 1} double" for i in range(5))
    return rounded(t.spark.read.schema(f"model string, {names}").json(path), 6)


@query(
    "g22_deployment_summary",
    f"""SELECT model, 'regression' AS task, 'r2' AS metric, round(cv_mean, 4) AS cv_mean, round(cv_std, 4) AS cv_std, round(overfit_gap, 4) AS overfit_gap, round(cv_mean - 0.3 * cv_std - 0.4 * overfit_gap, 4) AS final_score
        FROM {BOARD} b ORDER BY cv_mean - 0.3 * cv_std - 0.4 * overfit_gap DESC LIMIT 1""",
)
def g22_deployment_summary(t):
    return ev.deployment_summary(ev.leaderboard(line_fold_scores(t)), "regression", "r2")


@query("g23_saved_model")
def g23_saved_model(t):
    df = doc_features(t)
    frame, numeric, categorical = prep.model_frame(df.drop("doc_id"), "quality", "binary")
    model = prep.build_preprocessor(numeric, categorical).fit(frame)
    path = os.path.join(_scratch(t, "model"))
    md.save_model(model, path)
    again: PipelineModel = md.load_model(path)
    return again.transform(frame).select("features", "label")


@query("f40_baseline")
def f40_baseline(t):
    return baseline(price_features(t), "l_extendedprice", ["line_id"]).scores.drop("seconds")


@query("f41_importances")
def f41_importances(t):
    return baseline(doc_features(t), "quality", ["doc_id"]).importances
