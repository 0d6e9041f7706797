"""Regression trees fitted on merged rows.

A tree tells rows apart by the bins of their features only, at most ``maxBins`` a feature. Rows of the same bins are one row with their
number as weight and their mean label: the sum of squares inside it is the same on both sides of any split, so trees and boosting
by squared errors choose the same splits and means. A fit then passes over the distinct bins instead of over all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import regression as mr
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows from which MLlib chooses its thresholds, at least; it takes maxBins squared where that is more.
THRESHOLD_ROWS = 10_000


def mergeable(estimator) -> bool:
    """A tree or boosted trees by squared errors, on all rows and features, without weights of its own."""
    if isinstance(estimator, mr.DecisionTreeRegressor):
        single = estimator.getImpurity() == "variance"
    elif isinstance(estimator, mr.GBTRegressor):
        single = estimator.getLossType() == "squared" and estimator.getSubsamplingRate() == 1.0 and not estimator.isSet("validationIndicatorCol")
    else:
        return False
    return single and not estimator.isSet("weightCol") and estimator.getMinInstancesPerNode() == 1 and estimator.getMinWeightFractionPerNode() == 0.0


def thresholds(values: np.ndarray, rows: float, splits: int) -> np.ndarray:
    """Places between neighbouring values: all of them, or about equally many rows apart. As in MLlib, zeros are what ``rows`` has beyond other values."""
    found, counts = np.unique(values[values != 0.0], return_counts=True)
    zeros = rows - counts.sum()
    if zeros > np.finfo(float).eps * rows * 100:
        at = np.searchsorted(found, 0.0)
        found, counts = np.insert(found, at, 0.0), np.insert(counts.astype(float), at, zeros)
    middles = (found[:-1] + found[1:]) / 2.0
    if len(middles) <= splits:
        return middles
    stride, out = rows / (splits + 1), []
    target, now = stride, counts[0]
    for i in range(1, len(found)):
        before, now = now, now + counts[i]
        if abs(before - target) < abs(now - target):
            out.append(middles[i - 1])
            target += stride
    return np.array(out)


def _drawn(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """The rows that MLlib draws for its thresholds: the same sampler and seed over the same partitions."""
    spark = rows.sparkSession
    draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    return DataFrame(spark._jsparkSession.createDataFrame(rows._jdf.toJavaRDD().sample(False, share, draw), rows._jdf.schema()), spark)


def bin_column(train: DataFrame, estimator, features: str = "features") -> tuple[Column, int] | None:
    """Bins of the feature vector as an array, by the thresholds MLlib takes from ``train``, and how many a feature has at most.

    None for no rows or categories known to the estimator. A drawn sample may be a little larger than expected and give one bin more than ``maxBins``.
    """
    attributes = train.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    if "nominal" in attributes or "binary" in attributes:
        return None
    bins = estimator.getMaxBins()
    n = train.count()
    share = min(1.0, max(bins * bins, THRESHOLD_ROWS) / max(n, 1))
    rows = train.select(features)
    rows = rows if share == 1.0 else _drawn(rows, share, estimator.getSeed())
    x = rows.select(vector_to_array(features).alias("x")).toPandas()["x"]
    if not len(x):
        return None
    x = np.stack(x.to_numpy())
    cuts = [thresholds(x[:, j], share * n, min(bins, n) - 1) for j in range(x.shape[1])]

    @F.pandas_udf("array<double>")
    def place(vectors: pd.Series) -> pd.Series:
        v = np.stack(vectors.to_numpy())
        return pd.Series(list(np.stack([np.searchsorted(c, v[:, j], "left") for j, c in enumerate(cuts)], 1).astype(float)))

    return place(vector_to_array(features)), max(len(c) for c in cuts) + 1


def merged_scores(prepared: DataFrame, estimator, held: Column) -> list[float] | None:
    """R2 on the rows that are not ``held``, which are fitted, and on those that are; None where rows cannot be merged."""
    found = bin_column(prepared.where(~held), estimator)
    if found is None:
        return None
    binned, most = found
    y, part = F.col("label"), held.alias("_held")
    groups = prepared.select(binned.alias("bins"), "label", part).groupBy("_held", "bins")
    merged = groups.agg(F.count(y).cast("double").alias("rows"), F.avg(y).alias("label"), F.var_pop(y).alias("spread"))
    merged = merged.withColumn("features", array_to_vector("bins")).drop("bins").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = estimator.copy({estimator.weightCol: "rows", estimator.maxBins: max(most, estimator.getMaxBins())}).fit(merged.where("NOT _held"))
        w, e = F.col("rows"), F.col("label") - F.col("prediction")
        sums = model.transform(merged).groupBy("_held").agg(
            F.sum(w).alias("n"), F.sum(w * (F.col("spread") + e * e)).alias("error"), F.sum(w * F.col("label")).alias("total"),
        )
        means = sums.select("_held", "n", "error", (F.col("total") / F.col("n")).alias("mean"))
        off = F.col("label") - F.col("mean")
        spread = merged.join(means, "_held").groupBy("_held", "error").agg(F.sum(w * (F.col("spread") + off * off)).alias("all"))
        scores = {r["_held"]: r["r2"] for r in spread.select("_held", (1 - F.try_divide("error", "all")).alias("r2")).collect()}
        return [float("nan") if scores.get(k) is None else float(scores[k]) for k in (False, True)]
    finally:
        merged.unpersist()
