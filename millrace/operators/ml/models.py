"""Model comparison: registry, cross-validation, tuning, final fit, persistence."""

from __future__ import annotations

import random
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as mc
from pyspark.ml import regression as mr
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ml.bins import merged_scores, mergeable
from millrace.operators.ml.evaluate import leaderboard, paired_ttest, regression_scores, score_of
from millrace.operators.ml.nearest import Nearest
from millrace.operators.ml.prep import BINARY, MULTICLASS, REGRESSION, build_preprocessor, detect_task, model_frame
from millrace.plans.frames import small_frame

FOLD_SCHEMA = "model string, fold int, train_score double, val_score double, seconds double, error string"
SEED = 42


def models(task: str, seed: int = SEED) -> dict[str, object]:
    """Estimators compared for a task, with default parameters."""
    if task == REGRESSION:
        linear = lambda reg, net: mr.LinearRegression(regParam=reg, elasticNetParam=net, maxIter=50)
        return {
            "Ridge": linear(0.1, 0.0),
            "Lasso": linear(0.1, 1.0),
            "Elastic Net": linear(0.1, 0.5),
            "Decision Tree": mr.DecisionTreeRegressor(maxDepth=8, seed=seed),
            "Random Forest": mr.RandomForestRegressor(numTrees=50, maxDepth=8, seed=seed),
            "Gradient Boosting": mr.GBTRegressor(maxIter=30, maxDepth=4, seed=seed),
            "KNN": Nearest(),
        }
    found = {
        "Logistic Regression": mc.LogisticRegression(maxIter=50),
        "Decision Tree": mc.DecisionTreeClassifier(maxDepth=8, seed=seed),
        "Random Forest": mc.RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed),
    }
    boosted, margin = mc.GBTClassifier(maxIter=30, maxDepth=4, seed=seed), mc.LinearSVC(maxIter=50, regParam=0.01)
    if task == MULTICLASS:
        boosted, margin = mc.OneVsRest(classifier=boosted), mc.OneVsRest(classifier=margin)
    found["Gradient Boosting"], found["Linear SVC"], found["KNN"] = boosted, margin, Nearest(classes=True)
    return found


# Sampling ranges of the random search.
SEARCH = {
    "Random Forest": {"numTrees": (50, 100, 200), "maxDepth": (5, 8, 12), "minInstancesPerNode": (1, 2, 5), "featureSubsetStrategy": ("sqrt", "log2", "0.5")},
    "Gradient Boosting": {"maxIter": (20, 50, 100), "maxDepth": (3, 5, 7), "stepSize": (0.05, 0.1, 0.2), "subsamplingRate": (0.7, 0.85, 1.0)},
    "Decision Tree": {"maxDepth": (4, 8, 12), "minInstancesPerNode": (1, 5, 20)},
    "Logistic Regression": {"regParam": (0.0, 0.01, 0.1, 1.0), "elasticNetParam": (0.0, 0.5, 1.0)},
    "KNN": {"k": (3, 5, 9, 15)},
    "Linear SVC": {"regParam": (0.001, 0.01, 0.1, 1.0)},
    "Ridge": {"regParam": (0.01, 0.1, 1.0, 10.0)},
    "Lasso": {"regParam": (0.001, 0.01, 0.1, 1.0)},
    "Elastic Net": {"regParam": (0.001, 0.01, 0.1, 1.0), "elasticNetParam": (0.2, 0.5, 0.8)},
}


def fold_column(key: Sequence[str], folds: int, seed: int = SEED) -> Column:
    """Fold from a hash of the row key: stable under repartitioning, stratified in expectation."""
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key], F.lit(seed)), F.lit(folds)).cast("int")


def scored(predictions: DataFrame, task: str) -> DataFrame:
    """label, prediction and, for binary tasks, the score of the positive class."""
    if task != BINARY:
        return predictions.select("label", "prediction")
    source = "probability" if "probability" in predictions.columns else "rawPrediction"
    return predictions.select("label", "prediction", vector_to_array(source)[1].alias("score"))


def score_fold(prepared: DataFrame, estimator, task: str, i: int, fold: str = "_fold") -> tuple[float, float, float]:
    """(train score, validation score, seconds) of fold ``i``; ``prepared`` went through the preprocessing fitted on its training rows."""
    start = time.perf_counter()
    held = F.col(fold) == i
    if task == REGRESSION and mergeable(estimator) and (merged := merged_scores(prepared, estimator, held)):
        return (*merged, time.perf_counter() - start)
    model = estimator.fit(prepared.where(~held))
    if task == REGRESSION:
        found = regression_scores(model.transform(prepared).select("label", "prediction", held.alias("_held")), "_held")
        scores = [found.get(part, float("nan")) for part in (False, True)]
    else:
        scores = [score_of(scored(model.transform(prepared.where(part)), task), task) for part in (~held, held)]
    return (*scores, time.perf_counter() - start)


def run_cv(
    df: DataFrame,
    target: str,
    key: Sequence[str],
    *,
    task: str | None = None,
    candidates: dict[str, object] | None = None,
    folds: int = 5,
    parallelism: int = 4,
    seed: int = SEED,
) -> DataFrame:
    """Fold scores of all candidates; driver threads only submit jobs.

    ``key`` columns identify rows for the fold hash and are no features. A failing model
    becomes one row with its error.
    """
    task = task or detect_task(df, target)
    candidates = candidates or models(task, seed)
    data, numeric, categorical = _prepared(df, target, key, task, fold_column(key, folds, seed))
    data.persist(StorageLevel.MEMORY_AND_DISK)

    def one_fold(i: int) -> list[tuple]:
        # trees and margins read the same scaled vector; linear coefficients stay comparable
        try:
            fitted = build_preprocessor(numeric, categorical).fit(data.where(F.col("_fold") != i))
        except Exception as error:  # noqa: BLE001 - reported with every model, as a failing fit is
            return [(name, i, None, None, None, str(error)[:500]) for name in candidates]
        prepared = fitted.transform(data).select("features", "label", "_fold")
        if task != REGRESSION or not all(map(mergeable, candidates.values())):  # merged rows are few and kept by themselves
            prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)

        def attempt(job):
            name, estimator = job
            try:
                return (name, i, *score_fold(prepared, estimator, task, i), None)
            except Exception as error:  # noqa: BLE001 - one bad model must not end the comparison
                return (name, i, None, None, None, str(error)[:500])

        try:
            with ThreadPoolExecutor(min(parallelism, len(candidates))) as pool:
                return list(pool.map(attempt, candidates.items()))
        finally:
            prepared.unpersist()

    try:
        # one prepared fold is held at a time, more only where the models are fewer than the threads
        with ThreadPoolExecutor(max(1, parallelism // max(1, len(candidates)))) as pool:
            rows = [row for found in pool.map(one_fold, range(folds)) for row in found]
    finally:
        data.unpersist()
    rows.sort(key=lambda r: list(candidates).index(r[0]))
    failed = {r[0]: r[5] for r in rows if r[5] is not None}
    rows = [r for r in rows if r[0] not in failed] + [(n, None, None, None, None, e) for n, e in failed.items()]
    return small_frame(df.sparkSession, rows, FOLD_SCHEMA)


def _prepared(df, target, key, task, marker):
    keyed = df.withColumn("_fold", marker)
    features = [c for c in df.columns if c not in key or c == target]
    frame, numeric, categorical = model_frame(keyed.select(*[F.col(f"`{c}`") for c in features], "_fold"), target, task)
    numeric = [c for c in numeric if c != "_fold"]
    return frame.withColumn("_fold", F.col("_fold").cast("int")), numeric, categorical


def train_final(df: DataFrame, target: str, key: Sequence[str], estimator, task: str | None = None, seed: int = SEED):
    """80/20 hash split, fit on the larger part: (model, scored hold-out frame)."""
    task = task or detect_task(df, target)
    data, numeric, categorical = _prepared(df, target, key, task, fold_column(key, 100, seed))
    model = Pipeline(stages=[build_preprocessor(numeric, categorical), estimator]).fit(data.where("_fold < 80"))
    return model, scored(model.transform(data.where("_fold >= 80")), task)


def compare(df: DataFrame, target: str, key: Sequence[str], folds: int = 5, **options):
    """(leaderboard, fold scores, test of the top two)."""
    scores = run_cv(df, target, key, folds=folds, **options)
    board = leaderboard(scores.where("error IS NULL"))
    top = [r["model"] for r in board.orderBy("rank").limit(2).collect()]
    test = paired_ttest(scores, *top) if len(top) == 2 else None
    return board, scores, test


def tune(
    df: DataFrame, target: str, key: Sequence[str], name: str, *, n_iter: int = 10, folds: int = 3, task: str | None = None,
    parallelism: int = 4, seed: int = SEED,
) -> tuple[dict, DataFrame]:
    """Random search over the ranges of a model: (best parameters, fold scores per trial)."""
    task = task or detect_task(df, target)
    space, rng = SEARCH[name], random.Random(seed)
    trials, seen = [], set()
    for _ in range(20 * n_iter):
        choice = {p: rng.choice(values) for p, values in space.items()}
        if (mark := tuple(choice.values())) not in seen:
            seen.add(mark)
            trials.append(choice)
        if len(trials) == n_iter:
            break
    candidates = {}
    for i, choice in enumerate(trials):
        base = models(task, seed)[name]
        target_estimator = base.getClassifier() if isinstance(base, mc.OneVsRest) else base
        for p, v in choice.items():
            target_estimator.set(target_estimator.getParam(p), v)
        candidates[f"{name} #{i}"] = base
    scores = run_cv(df, target, key, task=task, candidates=candidates, folds=folds, parallelism=parallelism, seed=seed)
    best = leaderboard(scores.where("error IS NULL")).orderBy("rank").first()
    return trials[int(best["model"].rsplit("#", 1)[1])], scores


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
