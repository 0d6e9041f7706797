"""Feature importance and explanations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ml.evaluate import regression_scores, score_of
from millrace.operators.ml.models import scored
from millrace.operators.ml.prep import REGRESSION
from millrace.plans.frames import col, small_frame, stats_row
from millrace.plans.prefix import row_positions


def _weights(model) -> np.ndarray | None:
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "coefficientMatrix"):
        return np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    if hasattr(model, "coefficients"):
        return np.abs(model.coefficients.toArray())
    return None


def feature_importance(spark, model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """(feature, importance, share_pct) from tree importances or absolute coefficients."""
    weights = _weights(model.stages[-1])
    if weights is None:
        return small_frame(spark, [], "feature string, importance double, share_pct double")
    total = float(weights.sum()) or 1.0
    rows = sorted(zip(names, map(float, weights)), key=lambda r: (-r[1], r[0]))
    return small_frame(spark, [(n, w, 100.0 * w / total) for n, w in rows], "feature string, importance double, share_pct double")


def linear_contributions(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Mean abs(coefficient x (value - mean)) per feature: exact additive attributions of a linear model."""
    means = stats_row(df, {c: F.avg(col(c).cast("double")) for c in coefficients})
    effects = stats_row(
        df, {c: F.avg(F.abs(F.lit(float(w)) * (col(c).cast("double") - F.lit(means[c])))) for c, w in coefficients.items()}
    )
    rows = sorted(effects.items(), key=lambda r: (-(r[1] or 0.0), r[0]))
    return small_frame(df.sparkSession, rows, "feature string, mean_abs_effect double")


def explain_linear(model: PipelineModel, df: DataFrame, names: Sequence[str], features: str = "features") -> DataFrame:
    """Linear attributions in the scaled feature space of a fitted pipeline."""
    stage = model.stages[-1]
    weights = stage.coefficients.toArray() if hasattr(stage, "coefficients") else np.abs(stage.coefficientMatrix.toArray()).mean(axis=0)
    prepared = PipelineModel(model.stages[:-1]).transform(df).select(vector_to_array(features).alias("x"))
    wide = prepared.select(*[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    return linear_contributions(wide, dict(zip(names, map(float, weights))))


def permutation_importance(
    model: PipelineModel, df: DataFrame, cols: Sequence[str], task: str, key: Sequence[str], offset: int = 1
) -> DataFrame:
    """Drop of the primary metric when one column takes the value of another row.

    Rows are ordered by a key hash; each column in turn is read from the row ``offset`` places
    on. One positioned self-join serves all columns, and every row is used.
    """
    order = F.xxhash64(*[col(k) for k in key]).cast("double")
    placed = row_positions(df.withColumn("_hash", order), "_hash", tie=list(key)).drop("_hash", *key)
    other = placed.select(
        F.col("position").alias("_from"), *[col(c).alias(f"_other_{c}") for c in cols]
    )
    shifted = F.pmod(F.col("position") - 1 + offset, F.col("total")) + 1
    joined = placed.join(other, shifted == F.col("_from")).drop("_from", "position", "total")
    if task == REGRESSION:
        # the rows as they are and with each column swapped, all scored in one pass; nothing is stored
        kept = [c for c in joined.columns if not c.startswith("_other_")]
        forms = [
            F.struct(F.lit(i).alias("_form"), *[col(f"_other_{c}" if i and c == cols[i - 1] else c).alias(c) for c in kept])
            for i in range(len(cols) + 1)
        ]
        every = model.transform(joined.select(F.inline(F.array(*forms)))).select("_form", "label", "prediction")
        found = regression_scores(every, "_form")
        rows = [(c, found[0] - found[i + 1]) for i, c in enumerate(cols)] if found else [(c, float("nan")) for c in cols]
    else:
        joined = joined.persist()
        try:
            base = score_of(scored(model.transform(joined), task), task)
            rows = []
            for c in cols:
                swapped = joined.withColumn(c, col(f"_other_{c}"))
                rows.append((c, base - score_of(scored(model.transform(swapped), task), task)))
        finally:
            joined.unpersist()
    rows.sort(key=lambda r: (-r[1], r[0]))
    return small_frame(df.sparkSession, rows, "feature string, importance double")
