"""Cluster quality over all rows: silhouette, Davies-Bouldin, Calinski-Harabasz, ARI, profiles."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.cluster.neighbors import block_pairs
from millrace.operators.quality.leakage import class_places
from millrace.plans.frames import col

NOISE = -1
SILHOUETTE_WEIGHT, DB_WEIGHT, DB_SCALE = 0.6, 0.4, 10.0


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two array<double> columns."""
    return F.sqrt(squared_distance(a, b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def _labelled(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(vec, cluster) without noise rows."""
    kind = df.schema[vector].dataType.typeName()
    v = vector_to_array(vector) if kind == "vectorudt" or "vector" in kind else col(vector).cast("array<double>")
    return df.select(v.alias("vec"), col(label).cast("bigint").alias("cluster")).where(F.col("cluster") != NOISE)


def centroids(points: DataFrame) -> DataFrame:
    """(cluster, centroid, size) of (vec, cluster) rows."""
    return points.groupBy("cluster").agg(
        vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("centroid"), F.count(F.lit(1)).alias("size")
    )


def silhouette(df: DataFrame, vector: str = "features", label: str = "prediction") -> float:
    """Mean silhouette with squared Euclidean distance (closed form over cluster sums)."""
    points = _labelled(df, vector, label)
    # The evaluator wants small whole numbers; cluster ids may be any long.
    places = class_places(points.select("cluster"), "cluster")
    points = points.join(places, F.col("cluster") == F.col("_class")).select(
        array_to_vector("vec").alias("features"), F.col("_place").cast("double").alias("prediction")
    )
    return ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(points)


def davies_bouldin(df: DataFrame, vector: str = "features", label: str = "prediction") -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / centroid distance."""
    points = _labelled(df, vector, label)
    middle = centroids(points)
    spread = points.join(middle, "cluster").groupBy("cluster").agg(
        F.avg(distance(F.col("vec"), F.col("centroid"))).alias("spread"), F.first("centroid").alias("vec")
    )
    nodes = spread.select(F.col("cluster").cast("bigint").alias("id"), "vec", "spread", F.lit(0).alias("cell"))
    pairs = block_pairs(nodes, nodes, ["spread"], ["spread"])

    def worst(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, others = np.asarray(row.ids), np.asarray(row.r_ids)
                x = np.asarray(row.vecs, dtype=float).reshape(len(ids), -1)
                y = np.asarray(row.r_vecs, dtype=float).reshape(len(others), -1)
                s, r = np.asarray(row.spread, dtype=float), np.asarray(row.r_spread, dtype=float)
                for i in range(len(ids)):
                    d = np.sqrt(((y - x[i]) ** 2).sum(1))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        ratio = np.where(d > 0, (s[i] + r) / d, 0.0)
                    ratio[others == ids[i]] = 0.0
                    yield pd.DataFrame({"id": [ids[i]], "ratio": [ratio.max()]})

    ratios = pairs.select("ids", "vecs", "spread", "r_ids", "r_vecs", "r_spread").mapInPandas(worst, "id bigint, ratio double")
    return ratios.groupBy("id").agg(F.max("ratio").alias("ratio")).agg(F.avg("ratio").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, vector: str = "features", label: str = "prediction") -> DataFrame:
    """Between over within dispersion, each divided by its degrees of freedom.

    Dispersions are per-dimension variances times their degrees of freedom, and between is
    total minus within: two aggregates, no join.
    """
    points = _labelled(df, vector, label).select("cluster", array_to_vector("vec").alias("v"))
    spread = F.aggregate(vector_to_array("var"), F.lit(0.0), lambda acc, x: acc + x) * (F.col("n") - 1)
    stats = [Summarizer.variance(F.col("v")).alias("var"), F.count(F.lit(1)).alias("n")]
    total = points.agg(*stats).select(spread).scalar()
    within = points.groupBy("cluster").agg(*stats).select(spread.alias("w"), "n")
    return within.agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).select(
        F.try_divide((total - F.col("w")) / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k"))).alias("calinski_harabasz")
    )


def few_clusters_quality(df: DataFrame, vector: str = "features", label: str = "prediction") -> tuple[float, float, float | None]:
    """(silhouette, Davies-Bouldin, Calinski-Harabasz) of a labelling without noise whose clusters are few: two passes over the rows.

    Means and variances of the clusters are known to all tasks, and a point's mean squared distance to a cluster is that to its mean plus the
    cluster's variance.
    """
    rows = df.select(col(vector).alias("v"), col(label).cast("bigint").alias("cluster"))
    found = rows.groupBy("cluster").agg(Summarizer.mean(F.col("v")).alias("m"), Summarizer.variance(F.col("v")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    if len(found) < 2:
        raise ValueError("quality needs two clusters")
    names = np.array([r["cluster"] for r in found])
    size, middle = np.array([r["n"] for r in found], dtype=float), np.stack([r["m"].toArray() for r in found])
    squares = np.array([r["s"].toArray().sum() * (r["n"] - 1) for r in found])
    order = names.argsort()
    names, size, middle, squares = names[order], size[order], middle[order], squares[order]

    def sums(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.searchsorted(names, batch.column(1).to_numpy())
            x = batch.column(0).flatten().to_numpy().reshape(len(own), -1)
            at = np.arange(len(own))
            d = ((x[:, None, :] - middle[None]) ** 2).sum(2) if x.shape[1] <= 8 else np.stack([((x - m) ** 2).sum(1) for m in middle], 1)
            mean = d + (squares / size)[None]
            inside = mean[at, own] * size[own] / np.maximum(size[own] - 1, 1)
            mean[at, own] = np.inf
            outside = mean.min(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                value = np.where(inside < outside, 1 - inside / outside, np.where(inside > outside, outside / inside - 1, 0.0))
            value[size[own] == 1] = 0.0
            spread = np.bincount(own, np.sqrt(d[at, own]), len(names))
            yield pa.RecordBatch.from_pydict({"cluster": names, "value": np.bincount(own, value, len(names)), "spread": spread})

    totals = rows.select(vector_to_array("v").alias("v"), "cluster").mapInArrow(sums, "cluster bigint, value double, spread double")
    by = {r["cluster"]: r for r in totals.groupBy("cluster").agg(F.sum("value").alias("value"), F.sum("spread").alias("spread")).collect()}
    n, k = size.sum(), len(names)
    spread = np.array([by[c]["spread"] for c in names.tolist()]) / size
    apart = np.sqrt(((middle[:, None] - middle[None]) ** 2).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(apart > 0, (spread[:, None] + spread[None]) / apart, 0.0)
    between = (size * ((middle - (size[:, None] * middle).sum(0) / n) ** 2).sum(1)).sum()
    within = squares.sum()
    ch = float(between / (k - 1) / (within / (n - k))) if n > k and within > 0 else None
    return float(sum(r["value"] for r in by.values()) / n), float(ratio.max(1).mean()), ch


def mean_ari(df: DataFrame, labels: Sequence[str]) -> float:
    """Mean adjusted Rand index over all pairs of label columns, their contingency counts from one pass."""
    pairs = list(combinations(labels, 2))
    records = [F.struct(F.lit(i).alias("pair"), col(a).alias("a"), col(b).alias("b")) for i, (a, b) in enumerate(pairs)]
    cells = df.select(F.inline(F.array(*records))).groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("n")).toPandas()
    values, choose = [], lambda n: (n * (n - 1) / 2.0).sum()
    for _, c in cells.groupby("pair"):
        both, total = choose(c["n"]), c["n"].sum()
        one, other = choose(c.groupby("a")["n"].sum()), choose(c.groupby("b")["n"].sum())
        expected = one * other / max(total * (total - 1) / 2.0, 1.0)
        most = (one + other) / 2.0
        values.append((both - expected) / (most - expected) if most != expected else 1.0)
    return float(sum(values) / len(pairs))


def cluster_score(sil: float | Column, db: float | Column):
    return SILHOUETTE_WEIGHT * sil - DB_WEIGHT * (db / DB_SCALE)


def ari(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency counts."""
    cells = df.groupBy(col(a).alias("a"), col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: n * (n - 1) / 2.0
    s = cells.agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("total"))
    sa = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n")))).scalar()
    sb = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n")))).scalar()
    expected = sa * sb / pairs(F.col("total"))
    # identical one-cluster labelings leave 0 / 0: they agree
    value = F.coalesce(F.try_divide(F.col("both") - expected, (sa + sb) / 2.0 - expected), F.lit(1.0))
    return s.select(value.alias("ari"))


def cluster_profiles(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """(cluster, feature, mean, std, count, size, size_pct); noise removed, size share of all rows."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    aggs = [F.count(F.lit(1)).alias("_size")]
    records = []
    for i, c in enumerate(cols):
        x = col(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"), F.count(x).alias(f"c{i}")]
        records.append(F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"c{i}").alias("count")))
    wide = df.where(col(label) != NOISE).groupBy(col(label).alias("cluster")).agg(*aggs)
    long = wide.select("cluster", F.col("_size").alias("size"), F.inline(F.array(*records)))
    return long.select("cluster", "feature", "mean", "std", "count", "size", (100.0 * F.col("size") / rows).alias("size_pct"))


def profile_zscores(profiles: DataFrame) -> DataFrame:
    """Cluster means normalised per feature across clusters; a flat feature scores 0."""
    w = Window.partitionBy("feature")
    z = F.try_divide(F.col("mean") - F.avg("mean").over(w), F.stddev_pop("mean").over(w))
    return profiles.select("cluster", "feature", F.coalesce(z, F.lit(0.0)).alias("z"))


def top_feature(zscores: DataFrame) -> DataFrame:
    """Feature with the largest abs(z) of each cluster."""
    best = F.max_by(F.struct("feature", "z"), F.struct(F.abs("z"), "feature")).alias("t")
    return zscores.groupBy("cluster").agg(best).select("cluster", "t.feature", "t.z")
