from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from millrace.operators.cluster import neighbors as nb
from millrace.operators.cluster import outliers, quality, sweep
from millrace.operators.cluster.dbscan import dbscan, dbscan_sweep, neighbor_counts
from millrace.queries.clusters import h10_k_sweep


def blobs(seed=0, dims=2, noise=12):
    rng = np.random.default_rng(seed)
    centers = np.array([[0.0] * dims, [8.0] * dims, [0.0] * (dims - 1) + [9.0]])
    # one blob holds more than half of the points, some of them equal
    x = np.vstack([centers[0] + rng.normal(0, 0.6, (150, dims)), centers[1] + rng.normal(0, 0.6, (60, dims)), centers[2] + rng.normal(0, 0.6, (50, dims)), rng.uniform(-4, 14, (noise, dims))])
    x[5:25] = x[4]
    return x


@pytest.fixture(scope="module", params=[2, 5])
def cloud(spark, request):
    x = blobs(dims=request.param)
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(x.shape[1])])
    pdf["id"] = np.arange(len(x)) * 3
    return x, pdf["id"].to_numpy(), nb.pack_columns(spark.createDataFrame(pdf), "id", [c for c in pdf if c != "id"])


@pytest.fixture
def tiny_blocks(monkeypatch):
    """Blocks of 16 rows, so that every cell is cut into several."""
    monkeypatch.setattr(nb, "BLOCK", 16)


@pytest.mark.parametrize("cells, own", [(1, False), (9, True), (40, True)])
def test_knn_join_against_brute_force(cloud, tiny_blocks, cells, own):
    x, ids, points = cloud
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    if own:
        np.fill_diagonal(d, np.inf)
    k = 6
    got = nb.knn_join(points, points, k, exclude_self=own, cells=cells).toPandas()
    assert len(got) == k * len(x)
    for i, part in got.sort_values("rank").groupby("id"):
        row = np.flatnonzero(ids == i)[0]
        want = np.lexsort((ids, d[row]))[:k]
        assert np.allclose(part["distance"], d[row][want])
        assert part["neighbor"].tolist() == ids[want].tolist()


@pytest.fixture(params=[False, True])
def levels(request, monkeypatch):
    """One level of pivots, or two; tasks of two levels meet 30 points at a time."""
    if request.param:
        monkeypatch.setattr(nb, "FLAT", 1)
        monkeypatch.setattr(nb, "MEET", 30)


@pytest.mark.parametrize("cells, own", [(20, True), (60, False)])
def test_knn_join_over_two_levels(cloud, tiny_blocks, levels, cells, own):
    x, ids, points = cloud
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    if own:
        np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :30]
    got = nb.knn_join(points, points, 30, exclude_self=own, cells=cells).toPandas().sort_values(["id", "rank"])
    assert np.allclose(got["distance"].to_numpy().reshape(len(x), 30), want[np.argsort(ids)])


def test_compared_pairs_grow_with_the_points(spark, monkeypatch):
    """Twice the points in twice the clusters: about twice the comparisons, cells keep their size."""
    monkeypatch.setattr(nb, "FLAT", 1)
    compared = []
    for clusters in (20, 40):
        rng = np.random.default_rng(1)
        centers = rng.uniform(0, 1000, (clusters, 3))
        x = np.repeat(centers, 100, axis=0) + rng.normal(0, 1, (100 * clusters, 3))
        points = nb.pack_columns(spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=range(len(x)))), "id", list("abc"))
        shape = nb.build_cells(points, len(x) // 25)
        sizes = shape.placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        asked = nb.route(shape.placed, shape, F.lit(1.0)).groupBy("cell").agg(F.count(F.lit(1)).alias("q")).join(sizes, "cell")
        total, most = asked.agg(F.sum(F.col("q") * F.col("n")), F.max("n")).first()
        assert most <= 200 and len(shape.pivots) <= 2 * np.sqrt(len(x) // 25)
        compared.append(total)
    assert compared[1] < 2.6 * compared[0]


def brute_dbscan(x, ids, eps, min_pts):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = d <= eps
    core = near.sum(1) >= min_pts
    label = np.full(len(x), -1)
    for s in np.flatnonzero(core):
        if label[s] >= 0:
            continue
        todo, group = [s], {s}
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(near[i] & core):
                if j not in group:
                    group.add(j)
                    todo.append(j)
        label[list(group)] = min(ids[list(group)])
    for i in np.flatnonzero(~core):
        mates = np.flatnonzero(near[i] & core)
        if len(mates):
            label[i] = label[mates[np.lexsort((ids[mates], d[i][mates]))[0]]]
    return label


@pytest.mark.parametrize("cells", [1, 12])
def test_dbscan_against_brute_force(cloud, tiny_blocks, levels, cells):
    x, ids, points = cloud
    eps = 0.5 * np.sqrt(x.shape[1])
    got = dbscan(points, eps, 5, cells=cells).toPandas().set_index("id")["cluster"]
    assert got[ids].tolist() == brute_dbscan(x, ids, eps, 5).tolist()


def test_dbscan_sweep_finds_the_blobs(spark):
    x = blobs(1, 2, 0)
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(id=range(len(x)))
    best = dbscan_sweep(nb.pack_columns(spark.createDataFrame(pdf), "id", ["a", "b"]), [0.7, 1.0], [4])
    assert best.clusters == 3 and best.noise_share < 0.1 and best.silhouette > 0.7


def test_sweep_rejects_one_cluster(spark):
    df = nb.pack_columns(spark.createDataFrame([(i, float(i) / 10) for i in range(30)], "id bigint, x double"), "id", ["x"])
    assert dbscan_sweep(df, [1.0], [3]) is None


def test_lof_against_brute_force(cloud, tiny_blocks):
    x, ids, points = cloud
    k = 10
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.array([np.lexsort((ids, row))[:k] for row in d])
    kd = np.take_along_axis(d, near, 1)
    reach = np.maximum(kd, kd.max(1)[near])
    density = 1 / (reach.mean(1) + 1e-10)
    want = density[near].mean(1) / density
    got = outliers.lof_scores(points, k, cells=7).toPandas().set_index("id")["score"]
    assert np.allclose(got[ids], want, rtol=1e-6)


def test_forest_flags_the_far_points(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (400, 3)), rng.normal(12, 1, (8, 3))])
    pdf = pd.DataFrame(x, columns=list("abc")).assign(id=range(len(x)))
    points = nb.pack_columns(spark.createDataFrame(pdf), "id", list("abc"))
    found = outliers.isolation_forest(points, trees=40, psi=128, contamination=0.02).toPandas().set_index("id")
    assert found.loc[range(400, 408), "anomaly"].all()
    assert found["score"].between(0, 1).all()
    again = outliers.isolation_forest(points.repartition(5), trees=40, psi=128, contamination=0.02).toPandas().set_index("id")
    assert np.allclose(found["score"].sort_index(), again["score"].sort_index())


def test_quality_of_the_right_and_a_wrong_split(spark):
    x = blobs(3, 2, 0)
    right = np.repeat([0, 1, 2], [150, 60, 50])
    pdf = pd.DataFrame({"v": list(x), "right": right, "wrong": np.arange(len(x)) % 3})
    df = spark.createDataFrame(pdf.assign(v=pdf["v"].map(list))).withColumn("features", array_to_vector("v"))
    assert quality.silhouette(df, "features", "right") > 0.8 > quality.silhouette(df, "features", "wrong")
    assert quality.davies_bouldin(df, "features", "right").first()[0] < 0.5
    assert quality.calinski_harabasz(df, "features", "right").first()[0] > quality.calinski_harabasz(df, "features", "wrong").first()[0]
    assert quality.ari(df, "right", "right").first()[0] == 1.0


def test_noise_is_left_out_of_profiles(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0), (-1, 99.0)], "c int, x double")
    rows = {r["cluster"]: (r["mean"], r["size"], r["size_pct"]) for r in quality.cluster_profiles(df, "c", ["x"]).collect()}
    assert rows == {0: (2.0, 2, 50.0), 1: (5.0, 1, 25.0)}


def test_unsupervised_run_annotates_every_row(spark):
    x = blobs(4, 3, 6)
    pdf = pd.DataFrame(x, columns=["f1", "f2", "f3"]).assign(row_id=range(len(x)), flat=1.0)
    result = sweep.run_unsupervised(spark.createDataFrame(pdf), "row_id", 2, 3, ["KMeans"], trees=20, neighbors=8)
    out = result.annotated
    assert {"Cluster", "Anomaly_ISO", "Anomaly_LOF", "Anomaly_Score"} <= set(out.columns)
    assert out.count() == len(x) and out.where("Cluster IS NULL").count() == 0
    assert result.best == ("KMeans", 3)
    top = outliers.top_anomalies(result.flags, 5)
    assert top.count() == 5
    assert result.explained.agg(F.max("cumulative")).first()[0] <= 1.0 + 1e-9


def test_feature_matrix_drops_flat_columns(spark):
    df = spark.createDataFrame([(i, float(i), 1.0) for i in range(30)], "id int, x double, flat double")
    matrix, kept = sweep.prepare_unsupervised(df, "id")
    assert kept == ["x"] and len(matrix.first()["features"]) == 1
    projected, _ = sweep.pca(matrix, 1)
    assert projected.count() == 30


def test_points_are_not_sent_more_often_in_larger_tables(spark):
    """Points without clusters meet every block, so blocks must widen with the table."""
    each = []
    for n in (40_000, 160_000):
        placed = spark.range(n).select("id", F.array(F.lit(0.0)).alias("vec"), F.lit(0).cast("bigint").alias("cell"))
        refs = nb._parts(placed, nb.block_size(n)).first()["parts"]
        each.append(refs)
    assert each[1] <= 1.1 * each[0] <= 1.1 * (nb.BLOCKS + 1)
    assert nb.block_size(10**9) == nb.WIDE and nb.block_size(10) == nb.BLOCK


def test_sliced_blocks_find_the_same_neighbours(spark, monkeypatch):
    monkeypatch.setattr(nb, "SLICE", 150)
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(0, 1, (120, 2)), 1)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(i, int(j), r + 1) for i in range(120) for r, j in enumerate(np.lexsort((np.arange(120), np.where(np.arange(120) == i, np.inf, d[i])))[:4])}
    got = {(r["id"], r["neighbor"], r["rank"]) for r in nb.knn_join(points, points, 4, exclude_self=True, cells=3).collect()}
    assert got == want
    counts = {r["id"]: r["neighbors"] for r in neighbor_counts(points, 0.5, cells=3).collect()}
    assert counts == {i: int(n) for i, n in enumerate((d <= 0.5).sum(1))}


def test_points_of_few_coordinates_are_compared_with_few(spark):
    """A point of few coordinates meets small cells near it, not one that holds all the points."""
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (12_000, 3))
    points = nb.pack_columns(spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=range(len(x)))), "id", list("abc"))
    shape = nb.build_cells(points)
    sizes = shape.placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    asked = nb.route(shape.placed, shape, F.lit(0.02)).groupBy("cell").agg(F.count(F.lit(1)).alias("q")).join(sizes, "cell")
    assert asked.agg(F.sum(F.col("q") * F.col("n"))).first()[0] < 3_000 * len(x)


@pytest.mark.parametrize("flat", [1, 256])
def test_equal_points_meet_one_cell(spark, monkeypatch, flat):
    """Copies that lie at distance 0 are looked for in the own cell only, however far the cells reach."""
    monkeypatch.setattr(nb, "FLAT", flat)
    x = np.repeat(np.random.default_rng(4).uniform(0, 1, (200, 3)), 10, axis=0)
    points = nb.pack_columns(spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=range(len(x)))), "id", list("abc"))
    shape = nb.build_cells(points, 20)
    assert nb.route(shape.placed, shape, F.lit(0.0)).count() < 1.02 * len(x)


def test_sweep_scores_equal_the_single_measures(spark):
    x = blobs(5, 2, 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>").select("id", array_to_vector("v").alias("features")).persist()
    rows = {(r["algorithm"], r["k"]): r for r in sweep.k_sweep(df, 2, 3, ["KMeans", "Bisecting KMeans"]).collect()}
    for (name, k), row in rows.items():
        labelled = sweep.ALGORITHMS[name](df, k).transform(df)
        assert row["silhouette"] == pytest.approx(quality.silhouette(labelled), rel=1e-9)
        assert row["davies_bouldin"] == pytest.approx(quality.davies_bouldin(labelled).first()[0], rel=1e-9)
        assert row["calinski_harabasz"] == pytest.approx(quality.calinski_harabasz(labelled).first()[0], rel=1e-9)
    both = df.withColumn("a", F.col("id") % 3).withColumn("b", F.col("id") % 5 % 3).withColumn("c", F.col("id") % 2)
    want = [quality.ari(both, *pair).first()[0] for pair in ("ab", "ac", "bc")]
    assert quality.mean_ari(both, ["a", "b", "c"]) == pytest.approx(sum(want) / 3, rel=1e-9)


def test_sweep_starts_few_jobs(spark):
    """The measures of a clustering take a few passes, not dozens of small jobs."""
    x = blobs(6, 2, 2)
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id bigint, v array<double>, prediction int").select("prediction", array_to_vector("v").alias("features")).persist()
    df.count()
    spark.sparkContext.setJobGroup("measures", "measures")
    try:
        quality.few_clusters_quality(df)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("measures")) <= 5
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_registered_sweep_tries_every_algorithm_and_k(spark, monkeypatch):
    """The query leaves out no algorithm and no k; with few rows it goes as far as they allow."""
    monkeypatch.setattr(sweep.quality, "few_clusters_quality", lambda df: (0.5, 1.0, 2.0))
    monkeypatch.setattr(sweep, "stability", lambda df, runs: 1.0)
    monkeypatch.setattr(sweep, "kmeans_runs", lambda df, k: [])
    monkeypatch.setattr(sweep, "ALGORITHMS", {name: lambda df, k: type("Fit", (), {"transform": lambda self, df: df})() for name in sweep.ALGORITHMS})
    for n, most in ((30, 10), (6, 5)):
        rows = spark.createDataFrame([(i, [float(i), 1.0], i % 3) for i in range(n)], "vec_id bigint, embedding array<double>, label int")
        found = h10_k_sweep(SimpleNamespace(embeddings=rows)).collect()
        assert {(r["algorithm"], r["k"]) for r in found} == {(name, k) for name in ("KMeans", "Bisecting KMeans", "Gaussian Mixture") for k in range(2, most + 1)}
        assert all(r["error"] is None for r in found)
