"""Quick baseline model with importances, on all rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import classification as mc
from pyspark.ml import regression as mr
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.operators.ml.explain import feature_importance
from millrace.operators.ml.models import SEED, run_cv, train_final
from millrace.operators.ml.prep import BINARY, MULTICLASS, REGRESSION, model_frame
from millrace.plans.frames import col

MIN_ROWS = 20
MAX_CLASSES = 15


@dataclass
class Baseline:
    """The chosen model; fold scores and importances are fitted when they are first asked for."""

    task: str
    model: str
    metric: str
    df: DataFrame
    target: str
    key: Sequence[str]
    estimator: object
    folds: int
    seed: int

    @cached_property
    def scores(self) -> DataFrame:
        """Scores of all folds; their trees are small jobs, so the folds run side by side."""
        return run_cv(
            self.df, self.target, self.key, task=self.task, candidates={self.model: self.estimator}, folds=self.folds, parallelism=self.folds, seed=self.seed
        )

    @cached_property
    def importances(self) -> DataFrame:
        model, _ = train_final(self.df, self.target, self.key, self.estimator, self.task, self.seed)
        _, numeric, categorical = model_frame(self.df.drop(*[k for k in self.key if k != self.target]), self.target, self.task)
        return feature_importance(self.df.sparkSession, model, [*numeric, *categorical])


def baseline_task(df: DataFrame, target: str) -> str:
    """Classification up to 15 distinct values of a non-float target."""
    values = df.select(target).where(col(target).isNotNull()).distinct().limit(MAX_CLASSES + 1).count()
    if isinstance(df.schema[target].dataType, (T.DoubleType, T.FloatType, T.DecimalType)) or values > MAX_CLASSES:
        return REGRESSION
    return BINARY if values <= 2 else MULTICLASS


def baseline(df: DataFrame, target: str, key: Sequence[str], trees: int = 100, folds: int = 3, seed: int = SEED) -> Baseline | None:
    """Boosted trees (depth 4), or a forest (depth 5) for several classes; None under 20 rows."""
    if df.where(col(target).isNotNull()).limit(MIN_ROWS).count() < MIN_ROWS:
        return None
    task = baseline_task(df, target)
    if task == REGRESSION:
        name, estimator, metric = "Gradient Boosting", mr.GBTRegressor(maxIter=trees, maxDepth=4, seed=seed), "r2"
    elif task == BINARY:
        name, estimator, metric = "Gradient Boosting", mc.GBTClassifier(maxIter=trees, maxDepth=4, seed=seed), "roc_auc"
    else:
        name, estimator, metric = "Random Forest", mc.RandomForestClassifier(numTrees=trees, maxDepth=5, seed=seed), "f1_macro"
    return Baseline(task, name, metric, df, target, key, estimator, folds, seed)
