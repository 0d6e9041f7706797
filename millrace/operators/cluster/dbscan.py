"""Exact DBSCAN in any dimension by cells and block pairs.

No list of neighbour pairs is ever built: blocks return neighbour counts, a spanning forest
of their core points, and the nearest core of border points.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.cluster import quality
from millrace.operators.cluster.neighbors import block_pairs, block_size, build_cells, distances, knn_join, route, slices
from millrace.plans.components import connected_components
from millrace.plans.lineage import cut_lineage
from millrace.plans.quantiles import quantiles

EPS_PERCENTILES = (0.25, 0.50, 0.75, 0.90)
EPS_NEIGHBORS = 5
MAX_NOISE = 0.5
FIELDS = ("ids", "vecs", "r_ids", "r_vecs")


def _matrix(row):
    q_ids, r_ids = np.asarray(row.ids), np.asarray(row.r_ids)
    q = np.asarray(row.vecs, dtype=float).reshape(len(q_ids), -1)
    r = np.asarray(row.r_vecs, dtype=float).reshape(len(r_ids), -1)
    return q_ids, r_ids, q, r


def _within(q, r, eps):
    """Exact eps-neighbourhood: the fast distances decide, near-ties are recomputed."""
    d = distances(q, r)
    hit = d <= eps
    qi, ri = np.nonzero(np.abs(d - eps) <= 1e-6 * (1.0 + eps))
    if len(qi):
        hit[qi, ri] = np.sqrt(((q[qi] - r[ri]) ** 2).sum(1)) <= eps
    return d, hit


def _forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """Edges (query row, reference row) spanning the bipartite neighbour graph of a block pair."""
    fresh_q, fresh_r = np.ones(hit.shape[0], bool), np.ones(hit.shape[1], bool)
    edges = []
    for start in range(hit.shape[0]):
        if not fresh_q[start]:
            continue
        fresh_q[start] = False
        stack = [start]
        while stack:
            i = stack.pop()
            new_r = np.flatnonzero(hit[i] & fresh_r)
            fresh_r[new_r] = False
            edges.extend((i, j) for j in new_r)
            for j in new_r:
                new_q = np.flatnonzero(hit[:, j] & fresh_q)
                fresh_q[new_q] = False
                edges.extend((k, j) for k in new_q)
                stack.extend(new_q.tolist())
    return edges


def neighbor_counts(points: DataFrame, eps: float, cells: int | None = None) -> DataFrame:
    """(id, neighbors): points within eps, the point itself included."""
    shape = build_cells(points, cells)
    return _counts(shape.placed, shape, eps)


def _counts(placed, shape, eps):
    def count(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                q_ids, _, q, r = _matrix(row)
                found = [_within(q[part], r, eps)[1].sum(1) for part in slices(len(q), len(r))]
                yield pd.DataFrame({"id": q_ids, "n": np.concatenate(found)})

    pairs = block_pairs(route(placed, shape, F.lit(float(eps))), placed, size=block_size(shape.count.sum()))
    return pairs.select(*FIELDS).mapInPandas(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("neighbors"))


def dbscan(points: DataFrame, eps: float, min_pts: int, cells: int | None = None) -> DataFrame:
    """(id, cluster) of (id, vec) points: clusters are named by their smallest core id, noise is -1.

    A border point joins the cluster of its nearest core (ties: smaller id).
    """
    shape = build_cells(points, cells)
    placed = shape.placed
    counts = _counts(placed, shape, eps)
    flagged = cut_lineage(
        placed.join(counts.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).select(
            "id", "vec", "cell", (F.col("neighbors") >= min_pts).alias("core")
        )
    )
    core, rest = flagged.where("core"), flagged.where("NOT core")
    reach, size = F.lit(float(eps)), block_size(shape.count.sum())

    def link(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                q_ids, r_ids, q, r = _matrix(row)
                for part in slices(len(q), len(r)):
                    edges = _forest(_within(q[part], r, eps)[1])
                    if edges:
                        i, j = np.array(edges).T
                        src, dst = q_ids[part][i], r_ids[j]
                        yield pd.DataFrame({"src": src[src != dst], "dst": dst[src != dst]})

    def attach(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                q_ids, r_ids, q, r = _matrix(row)
                for part in slices(len(q), len(r)):
                    own, x = q_ids[part], q[part]
                    i, j = np.nonzero(_within(x, r, eps)[1])
                    exact = np.sqrt(((x[i] - r[j]) ** 2).sum(1))
                    order = np.lexsort((r_ids[j], exact, i))
                    i, j, exact = i[order], j[order], exact[order]
                    first = np.unique(i, return_index=True)[1]
                    yield pd.DataFrame({"id": own[i[first]], "core_id": r_ids[j[first]], "distance": exact[first]})

    edges = block_pairs(route(core, shape, reach), core, size=size).select(*FIELDS).mapInPandas(link, "src bigint, dst bigint")
    clusters = connected_components(core.select("id"), edges)
    near = block_pairs(route(rest, shape, reach), core, size=size).select(*FIELDS).mapInPandas(attach, "id bigint, core_id bigint, distance double")
    nearest = near.groupBy("id").agg(F.min(F.struct("distance", "core_id")).alias("best"))
    named = clusters.select(F.col("id").alias("_core"), F.col("component").alias("cluster"))
    border = nearest.join(named, F.col("best.core_id") == F.col("_core")).select("id", "cluster")
    found = clusters.select("id", F.col("component").alias("cluster")).unionByName(border)
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", F.lit(quality.NOISE).cast("bigint")).alias("cluster"))


def eps_candidates(points: DataFrame, cells: int | None = None) -> list[float]:
    """Percentiles of the distance to the fifth neighbour, the point itself counted as the first."""
    reach = knn_join(points, points, EPS_NEIGHBORS, cells=cells).groupBy("id").agg(F.max("distance").alias("d"))
    return quantiles(reach, ["d"], list(EPS_PERCENTILES))["d"]


@dataclass(frozen=True)
class DensityResult:
    eps: float
    min_pts: int
    clusters: int
    noise_share: float
    silhouette: float
    davies_bouldin: float
    calinski_harabasz: float
    score: float
    labels: DataFrame


def dbscan_sweep(
    points: DataFrame, eps_values: Sequence[float] | None = None, min_pts_values: Sequence[int] | None = None, cells: int | None = None
) -> DensityResult | None:
    """Best setting by cluster score; fewer than 2 clusters or over 50 % noise is rejected."""
    eps_values = list(eps_values) if eps_values is not None else eps_candidates(points, cells)
    if min_pts_values is None:
        dim = len(points.first()["vec"])
        min_pts_values = (max(2, dim), max(4, 2 * dim), max(8, 3 * dim))
    best = None
    for eps in eps_values:
        for min_pts in min_pts_values:
            labels = cut_lineage(dbscan(points, eps, min_pts, cells))
            noise, clusters, n = labels.agg(
                F.count_if(F.col("cluster") == quality.NOISE), F.count_distinct(F.when(F.col("cluster") != quality.NOISE, F.col("cluster"))), F.count(F.lit(1))
            ).first()
            if clusters < 2 or noise > MAX_NOISE * n:
                continue
            data = points.join(labels, "id").select(array_to_vector("vec").alias("features"), F.col("cluster"))
            result = _rate(data, eps, min_pts, clusters, noise / n, labels)
            if best is None or result.score > best.score:
                best = result
    return best


def _rate(data, eps, min_pts, clusters, noise, labels):
    sil = quality.silhouette(data, "features", "cluster")
    db = quality.davies_bouldin(data, "features", "cluster").first()[0]
    ch = quality.calinski_harabasz(data, "features", "cluster").first()[0]
    return DensityResult(eps, min_pts, clusters, noise, sil, db, ch, quality.cluster_score(sil, db), labels)
