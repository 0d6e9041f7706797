"""Clustering fits, the k sweep, projection and the whole unsupervised run."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA, VarianceThresholdSelector
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.cluster import quality
from millrace.operators.cluster.dbscan import dbscan_sweep
from millrace.operators.cluster.outliers import annotate, combine, isolation_forest, lof
from millrace.operators.ml.prep import build_preprocessor, model_frame
from millrace.plans.frames import col, numeric_columns, small_frame

MIN_VARIANCE = 0.01
SWEEP_SCHEMA = (
    "algorithm string, k int, silhouette double, davies_bouldin double, calinski_harabasz double, stability double, "
    "score double, error string"
)


def prepare_unsupervised(df: DataFrame, key: str, minimum: float = MIN_VARIANCE) -> tuple[DataFrame, list[str]]:
    """(key, features) on all other columns and the names that survive the variance filter."""
    frame, numeric, categorical = model_frame(df.drop(key), None, None)
    names = [*numeric, *categorical]
    keyed = df.select(
        col(key), *[col(c).cast("double").alias(c) for c in numeric], *[col(c).cast("string").alias(c) for c in categorical]
    )
    model = Pipeline(
        stages=[
            build_preprocessor(numeric, categorical, "_matrix"),
            VarianceThresholdSelector(featuresCol="_matrix", outputCol="features", varianceThreshold=minimum),
        ]
    ).fit(keyed)
    kept = [names[i] for i in model.stages[-1].selectedFeatures]
    return model.transform(keyed).select(key, "features"), kept


SEEDS = (0, 1, 2)


def kmeans_runs(df: DataFrame, k: int, seeds: Sequence[int] = SEEDS) -> list:
    """One k-means model per seed; driver threads submit the fits side by side."""
    fit = lambda s: KMeans(k=k, seed=s, maxIter=100, predictionCol=f"run{s}").fit(df)
    with ThreadPoolExecutor(len(seeds)) as pool:
        return list(pool.map(fit, seeds))


def fit_kmeans(df: DataFrame, k: int, seeds: Sequence[int] = SEEDS):
    """Best of several starts by training cost."""
    return _best(kmeans_runs(df, k, seeds))


def _best(runs: Sequence):
    return min(runs, key=lambda m: m.summary.trainingCost).copy().setPredictionCol("prediction")


def fit_bisecting(df: DataFrame, k: int, seed: int = 42):
    return BisectingKMeans(k=k, seed=seed).fit(df)


def fit_gmm(df: DataFrame, k: int, seed: int = 42):
    return GaussianMixture(k=k, seed=seed).fit(df)


ALGORITHMS = {"KMeans": fit_kmeans, "Bisecting KMeans": fit_bisecting, "Gaussian Mixture": fit_gmm}


def stability(df: DataFrame, runs: Sequence) -> float:
    """Mean adjusted Rand index between k-means runs of different seeds."""
    for model in runs:
        df = model.transform(df)
    return quality.mean_ari(df, [m.getPredictionCol() for m in runs])


#: Fits of a sweep that run side by side; their iterations are small jobs.
SIDE_BY_SIDE = 4
#: Clusters up to which a sweep goes by itself.
K_MAX = 10


def _sweep(df: DataFrame, k_min: int, k_max: int | None, algorithms: Sequence[str] | None) -> tuple[list[tuple], dict]:
    """Rows of SWEEP_SCHEMA and the models by (algorithm, k)."""
    n = df.count()
    k_max = min(K_MAX, n - 1) if k_max is None else k_max
    if not 2 <= k_min <= k_max < n:
        raise ValueError("k must lie between 2 and the number of rows less one")
    models = {}

    def attempt(job):
        name, k = job
        try:
            runs = kmeans_runs(df, k) if name == "KMeans" else []
            model = models[job] = _best(runs) if runs else ALGORITHMS[name](df, k)
            sil, db, ch = quality.few_clusters_quality(model.transform(df))
            return (name, k, sil, db, ch, stability(df, runs) if runs else None, quality.cluster_score(sil, db), None)
        except Exception as error:  # noqa: BLE001 - one bad fit must not end the sweep
            return (name, k, None, None, None, None, None, str(error)[:500])

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return list(pool.map(attempt, [(name, k) for name in algorithms or ALGORITHMS for k in range(k_min, k_max + 1)])), models


def _sweep_frame(spark, rows: list[tuple]) -> DataFrame:
    return small_frame(spark, rows, SWEEP_SCHEMA).orderBy(F.desc_nulls_last("score"), "algorithm", "k")


def k_sweep(df: DataFrame, k_min: int = 2, k_max: int | None = None, algorithms: Sequence[str] | None = None) -> DataFrame:
    """Every algorithm and k, best score first. ``df`` holds ``features`` and should be cached; ``k_max`` is K_MAX or the rows less one."""
    return _sweep_frame(df.sparkSession, _sweep(df, k_min, k_max, algorithms)[0])


def sweep_curves(sweep: DataFrame) -> DataFrame:
    """Quality by k for each algorithm; density methods have no k axis."""
    return sweep.where(~F.col("algorithm").isin("DBSCAN", "OPTICS") & F.col("score").isNotNull()).select(
        "algorithm", "k", "silhouette", "davies_bouldin", "calinski_harabasz",
        F.when(F.col("algorithm") == "KMeans", F.col("stability")).alias("stability"),
    ).orderBy("algorithm", "k")


def pca(df: DataFrame, n: int = 2, features: str = "features", out: str = "pca") -> tuple[DataFrame, DataFrame]:
    """(frame with the projection, (component, explained, cumulative))."""
    model = PCA(k=n, inputCol=features, outputCol=out).fit(df)
    explained = [float(v) for v in model.explainedVariance.toArray()]
    rows = [(i + 1, v, sum(explained[: i + 1])) for i, v in enumerate(explained)]
    return model.transform(df), small_frame(df.sparkSession, rows, "component int, explained double, cumulative double")


@dataclass
class UnsupervisedResult:
    sweep: DataFrame
    best: tuple[str, int]
    explained: DataFrame
    clusters: DataFrame
    profiles: DataFrame
    flags: DataFrame
    annotated: DataFrame


def run_unsupervised(
    df: DataFrame, key: str, k_min: int = 2, k_max: int = 6, algorithms: Sequence[str] | None = None, density: bool = False,
    trees: int = 100, neighbors: int = 20,
) -> UnsupervisedResult:
    """Prepare, project, sweep, pick the best clustering, profile, flag anomalies, annotate."""
    matrix, _ = prepare_unsupervised(df, key)
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if matrix.rdd.getNumPartitions() < tasks:
        # narrow tables come in few partitions; the order inside one decides the starts of k-means
        matrix = matrix.repartition(tasks, key).sortWithinPartitions(key)
    matrix = matrix.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        width = len(matrix.first()["features"])
        _, explained = pca(matrix, min(2, width))
        rows, models = _sweep(matrix, k_min, k_max, algorithms)
        sweep = _sweep_frame(df.sparkSession, rows)
        top = sweep.where("score IS NOT NULL").first()
        name, k, score = top["algorithm"], top["k"], top["score"]
        labels = models[(name, k)].transform(matrix).select(col(key).alias("id"), F.col("prediction").cast("bigint").alias("cluster"))
        points = matrix.select(col(key).cast("bigint").alias("id"), vector_to_array("features").alias("vec"))
        if density:
            found = dbscan_sweep(points)
            if found is not None and found.score > score:
                name, k, labels = "DBSCAN", found.clusters, found.labels
        flags = combine(isolation_forest(points, trees), lof(points, neighbors))
        annotated = annotate(df, key, labels, flags)
        numeric = [c for c in numeric_columns(df) if c != key]
        profiles = quality.cluster_profiles(annotated, "Cluster", numeric)
        return UnsupervisedResult(sweep, (name, k), explained, labels, profiles, flags, annotated)
    finally:
        matrix.unpersist()
