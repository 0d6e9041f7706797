"""Evaluation of prediction frames by counts and running sums over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.pvalue import t_two_sided
from millrace.plans.frames import col, one_row
from millrace.plans.prefix import running_totals


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n, row_share)."""
    counts = pred.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy("label")))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and weighted averages."""
    cells = confusion_matrix(pred, label, prediction)
    actual = cells.groupBy(F.col("label").alias("c")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit")
    )
    guessed = cells.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("guessed"))
    both = actual.join(guessed, "c", "full").na.fill(0, ["support", "hit", "guessed"])
    p = F.coalesce(F.try_divide("hit", "guessed"), F.lit(0.0))
    r = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("guessed") + F.col("support")), F.lit(0.0))
    classes = both.select(F.col("c").cast("string").alias("class"), p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support", "hit")
    totals = classes.agg(
        F.sum("support").alias("n"), F.sum("hit").alias("hit"),
        *[F.avg(m).alias(f"a_{m}") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"w_{m}") for m in ("precision", "recall", "f1")],
    )
    accuracy = (F.col("hit") / F.col("n"))
    row = lambda name, a, b, c: F.struct(F.lit(name).alias("class"), a.alias("precision"), b.alias("recall"), c.alias("f1"), F.col("n").alias("support"))
    overall = totals.select(
        F.inline(
            F.array(
                row("accuracy", accuracy, accuracy, accuracy),
                row("macro avg", F.col("a_precision"), F.col("a_recall"), F.col("a_f1")),
                row("weighted avg", F.col("w_precision"), F.col("w_recall"), F.col("w_f1")),
            )
        )
    )
    return classes.drop("hit").unionByName(overall)


def _score_totals(pred: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score with running sums in ascending score order."""
    y = col(label).cast("bigint")
    rows = pred.select(col(score).cast("double").alias("score"), y.alias("p"), (1 - y).alias("q"))
    return running_totals(rows, "score", ["p", "q"])


def roc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, fpr, tpr): one point per distinct score, threshold at that score."""
    tp = F.col("all_p") - F.col("cum_p") + F.col("p")
    fp = F.col("all_q") - F.col("cum_q") + F.col("q")
    return _score_totals(pred, label, score).select(
        "score", F.try_divide(fp, F.col("all_q")).alias("fpr"), F.try_divide(tp, F.col("all_p")).alias("tpr")
    )


def auc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve by the rank statistic; ties count half."""
    below = F.col("cum_q") - F.col("q")
    return _score_totals(pred, label, score).agg(
        F.try_divide(
            F.sum(F.col("p") * (below + 0.5 * F.col("q"))), F.max(F.col("all_p").cast("double") * F.col("all_q"))
        ).alias("auc")
    )


def pr_curve(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    tp = F.col("all_p") - F.col("cum_p") + F.col("p")
    fp = F.col("all_q") - F.col("cum_q") + F.col("q")
    return _score_totals(pred, label, score).select(
        "score", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, F.col("all_p")).alias("recall"),
        F.try_divide(F.col("p"), F.col("all_p")).alias("step"),
    )


def average_precision(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Sum of recall steps times precision."""
    return pr_curve(pred, label, score).agg(F.sum(F.col("step") * F.col("precision")).alias("average_precision"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE, R2 and MAPE (percent) in one pass, for each value of ``by``."""
    y, e = col(label).cast("double"), col(label).cast("double") - col(prediction).cast("double")
    n = F.count(e)
    return pred.groupBy(*[col(c) for c in by]).agg(
        n.alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
        (100 * F.avg(F.abs(e) / (F.abs(y) + 1e-9))).alias("mape"),
    )


def residuals(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.withColumn("residual", col(label) - col(prediction))


def score_of(pred: DataFrame, task: str, label: str = "label", prediction: str = "prediction", score: str = "score") -> float:
    """Primary metric of a prediction frame as one number."""
    if task == "binary":
        value = auc(pred, label, score).first()[0]
    elif task == "multiclass":
        value = classification_report(pred, label, prediction).where("class = 'macro avg'").select("f1").first()[0]
    else:
        value = regression_metrics(pred, label, prediction).select("r2").first()[0]
    return float("nan") if value is None else float(value)


def regression_scores(pred: DataFrame, by: str) -> dict:
    """R2 by the values of ``by``, one pass over all of them."""
    return {r[by]: float("nan") if r["r2"] is None else float(r["r2"]) for r in regression_metrics(pred, by=[by]).collect()}


LAMBDA_SPREAD, LAMBDA_GAP = 0.30, 0.40
OVERFIT_GAP, HIGH_STD = 0.10, 0.04


def leaderboard(fold_scores: DataFrame, spread: float = LAMBDA_SPREAD, gap_weight: float = LAMBDA_GAP) -> DataFrame:
    """Rank models from (model, fold, train_score, val_score): mean minus spread and overfit penalties."""
    g = fold_scores.groupBy("model").agg(
        F.avg("val_score").alias("cv_mean"), F.stddev_pop("val_score").alias("cv_std"), F.avg("train_score").alias("train_score"),
        F.count("val_score").alias("folds"),
    )
    g = g.withColumn("overfit_gap", F.abs(F.col("train_score") - F.col("cv_mean")))
    final = F.col("cv_mean") - spread * F.col("cv_std") - gap_weight * F.col("overfit_gap")
    g = g.withColumn("final_score", final)
    # a handful of models: the unpartitioned rank runs over the leaderboard only
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("final_score"), "model"))
    return g.select(
        rank.alias("rank"), "model", "folds", "cv_mean", "cv_std", "train_score", "overfit_gap", "final_score",
        (F.col("cv_std") > HIGH_STD).alias("high_variance"), (F.col("overfit_gap") > OVERFIT_GAP).alias("overfitting"),
    )


def paired_t(fold_scores: DataFrame, a: str, b: str) -> DataFrame:
    """Paired t statistic of two models over shared folds: (folds, mean_diff, t)."""
    x = fold_scores.where(F.col("model") == a).select("fold", F.col("val_score").alias("a"))
    y = fold_scores.where(F.col("model") == b).select("fold", F.col("val_score").alias("b"))
    d = F.col("a") - F.col("b")
    stats = x.join(y, "fold").agg(F.count(d).alias("folds"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    return stats.select("folds", "mean_diff", F.try_divide(F.col("mean_diff"), F.col("sd") / F.sqrt("folds")).alias("t"))


def paired_ttest(fold_scores: DataFrame, a: str, b: str, alpha: float = 0.05) -> dict | None:
    """Test of the difference between two models; None with fewer than three folds."""
    folds, diff, t = paired_t(fold_scores, a, b).first()
    if folds < 3 or t is None:
        return None
    p = t_two_sided(t, folds - 1)
    return {"a": a, "b": b, "t": t, "p_value": p, "significant": p < alpha, "mean_diff": diff}


def fold_table(fold_scores: DataFrame, folds: int) -> DataFrame:
    """One row per model, one column per fold, for export."""
    wide = fold_scores.groupBy("model").pivot("fold", list(range(folds))).agg(F.first("val_score"))
    return wide.select("model", *[col(str(i)).alias(f"fold_{i + 1}") for i in range(folds)])


def deployment_summary(board: DataFrame, task: str, metric: str) -> DataFrame:
    """One row about the winning model."""
    return board.where("rank = 1").select(
        "model", F.lit(task).alias("task"), F.lit(metric).alias("metric"),
        *[F.round(c, 4).alias(c) for c in ("cv_mean", "cv_std", "overfit_gap", "final_score")],
    )
