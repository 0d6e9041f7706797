"""Anomaly detectors on points: isolation forest and local outlier factor."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.cluster.neighbors import knn_join
from millrace.plans.frames import col
from millrace.plans.lineage import cut_lineage
from millrace.plans.quantiles import quantiles

CONTAMINATION = 0.1
LOF_NEIGHBORS = 20
EULER = 0.5772156649015329


def _average_path(n):
    """Mean depth of an unsuccessful search in a random tree of n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    value = 2.0 * (np.log(big - 1.0) + EULER) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def _samples(points: DataFrame, trees: int, psi: int, seed: int) -> DataFrame:
    """(tree, vec): psi rows per tree with the smallest hash of (id, tree).

    A first threshold on the hash keeps about twice the wanted rows, so the per-tree rank runs
    over a bounded set however large the table is.
    """
    n = points.count()
    share = min(1.0, (2.0 * psi + 50.0) / max(n, 1))
    bar = int(share * 2**62)
    draw = lambda t: F.shiftrightunsigned(F.xxhash64("id", t, F.lit(seed)), 2)
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < F.lit(bar))
    rows = points.select("id", "vec", F.explode(chosen).alias("tree")).withColumn("_draw", draw(F.col("tree")))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("_draw", "id"))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= psi).select("tree", "id", "vec")


def grow_forest(points: DataFrame, trees: int = 100, psi: int = 256, seed: int = 42) -> pd.DataFrame:
    """Nodes of all trees, at most 2 x psi per tree: the model, small enough for the driver."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack(pdf["vec"].to_numpy())
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(psi, 2)))
        feature, cut, left, right, size = [], [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            me = len(feature)
            feature.append(-1)
            cut.append(0.0)
            left.append(-1)
            right.append(-1)
            size.append(len(rows))
            if depth >= limit or len(rows) <= 1:
                return me
            low, high = x[rows].min(0), x[rows].max(0)
            open_dims = np.flatnonzero(high > low)
            if not len(open_dims):
                return me
            f = int(rng.choice(open_dims))
            at = rng.uniform(low[f], high[f])
            goes = x[rows, f] < at
            feature[me], cut[me] = f, at
            left[me] = node(rows[goes], depth + 1)
            right[me] = node(rows[~goes], depth + 1)
            return me

        node(np.arange(len(x)), 0)
        return pd.DataFrame(
            {"tree": tree, "node": range(len(feature)), "feature": feature, "cut": cut, "left": left, "right": right, "size": size}
        )

    schema = "tree int, node int, feature int, cut double, left int, right int, size int"
    nodes = _samples(points, trees, psi, seed).groupBy("tree").applyInPandas(grow, schema)
    return nodes.toPandas().sort_values(["tree", "node"])


def isolation_forest(
    points: DataFrame, trees: int = 100, psi: int = 256, contamination: float = CONTAMINATION, seed: int = 42
) -> DataFrame:
    """(id, score, anomaly): higher scores are more anomalous, the top share is flagged."""
    forest = grow_forest(points, trees, psi, seed)
    scale = float(_average_path(min(psi, int(forest[forest["node"] == 0]["size"].max()))))
    packed = [
        tuple(g[c].to_numpy() for c in ("feature", "cut", "left", "right", "size")) for _, g in forest.groupby("tree")
    ]
    model = points.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("double")
    def score(vec: pd.Series) -> pd.Series:
        x = np.stack(vec.to_numpy())
        depth = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, right, size in model.value:
            at, level = np.zeros(len(x), dtype=int), np.zeros(len(x))
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                i = rows[inner]
                here = at[i]
                at[i] = np.where(x[i, feature[here]] < cut[here], left[here], right[here])
                level[i] += 1
            depth += level + _average_path(size[at])
        return pd.Series(2.0 ** (-depth / len(model.value) / max(scale, 1e-12)))

    scored = cut_lineage(points.select("id", score("vec").alias("score")))
    return flag_top(scored, contamination)


def flag_top(scored: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """Mark scores above the (1 - contamination) quantile."""
    bar = quantiles(scored, ["score"], [1.0 - contamination])["score"][0]
    return scored.withColumn("anomaly", F.coalesce(col("score") > F.lit(bar), F.lit(False)))


def lof_scores(points: DataFrame, k: int = LOF_NEIGHBORS, cells: int | None = None) -> DataFrame:
    """(id, score): local outlier factor from exact neighbours of all rows."""
    near = cut_lineage(knn_join(points, points, k, exclude_self=True, cells=cells).select("id", "neighbor", "distance"))
    reach = near.groupBy("id").agg(F.max("distance").alias("k_distance"))
    widened = near.join(reach.select(F.col("id").alias("neighbor"), "k_distance"), "neighbor")
    density = cut_lineage(
        widened.groupBy("id").agg((1.0 / (F.avg(F.greatest("distance", "k_distance")) + 1e-10)).alias("density"))
    )
    around = near.join(density.select(F.col("id").alias("neighbor"), F.col("density").alias("d")), "neighbor").groupBy("id").agg(F.avg("d").alias("around"))
    return around.join(density, "id").select("id", (F.col("around") / F.col("density")).alias("score"))


def lof(points: DataFrame, k: int = LOF_NEIGHBORS, contamination: float = CONTAMINATION, cells: int | None = None) -> DataFrame:
    """(id, score, anomaly)."""
    return flag_top(cut_lineage(lof_scores(points, k, cells)), contamination)


def combine(iso: DataFrame, local: DataFrame) -> DataFrame:
    """(id, iso_score, iso_anomaly, lof_score, lof_anomaly, both)."""
    a = iso.select("id", F.col("score").alias("iso_score"), F.col("anomaly").alias("iso_anomaly"))
    b = local.select("id", F.col("score").alias("lof_score"), F.col("anomaly").alias("lof_anomaly"))
    return a.join(b, "id").withColumn("both", F.col("iso_anomaly") & F.col("lof_anomaly"))


def anomaly_summary(flags: DataFrame) -> DataFrame:
    """Counts and percentages of both detectors and of their agreement."""
    n = F.count(F.lit(1))
    pct = lambda c: F.round(100.0 * F.count_if(c) / n, 4)
    return flags.agg(
        n.alias("rows"),
        F.count_if("iso_anomaly").alias("iso"), F.count_if("lof_anomaly").alias("lof"), F.count_if("both").alias("both"),
        pct("iso_anomaly").alias("iso_pct"), pct("lof_anomaly").alias("lof_pct"), pct("both").alias("both_pct"),
    )


def top_anomalies(flags: DataFrame, n: int = 20, score: str = "iso_score") -> DataFrame:
    return flags.orderBy(F.desc(score), "id").limit(n)


def score_histogram(flags: DataFrame, score: str = "iso_score", decision: str = "iso_anomaly", bins: int = 40) -> DataFrame:
    """(bin, decision, n): scores of flagged and normal rows over shared bins."""
    lo, hi = flags.agg(F.min(score), F.max(score)).first()
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    place = F.least(F.floor((col(score) - lo) / ((hi - lo) / bins)) + 1, F.lit(bins)).cast("int")
    return flags.groupBy(place.alias("bin"), col(decision).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


def annotate(df: DataFrame, key: str, clusters: DataFrame, flags: DataFrame) -> DataFrame:
    """Input rows with Cluster, Anomaly_ISO, Anomaly_LOF and Anomaly_Score, joined on the row key."""
    c = clusters.select(F.col("id").alias("_c"), F.col("cluster").alias("Cluster"))
    f = flags.select(
        F.col("id").alias("_f"), F.col("iso_anomaly").alias("Anomaly_ISO"), F.col("lof_anomaly").alias("Anomaly_LOF"),
        F.col("iso_score").alias("Anomaly_Score"),
    )
    return df.join(c, col(key) == F.col("_c"), "left").join(f, col(key) == F.col("_f"), "left").drop("_c", "_f")
