import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators.cluster import neighbors as nb
from millrace.operators.cluster import tree as tr
from millrace.operators.cluster.dbscan import dbscan


def cloud(seed=3):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(0, 0.5, (70, 3)), rng.normal(6, 0.5, (40, 3)), rng.uniform(-3, 9, (10, 3))])
    x[5:12] = x[4]  # equal points: many equal weights
    return np.arange(len(x)) * 7 + 1, x


def frame(spark, ids, x):
    return spark.createDataFrame(pd.DataFrame({"id": ids, "vec": [v.tolist() for v in x]}), "id bigint, vec array<double>")


def brute_tree(ids, w):
    """Edges by Kruskal over all pairs, ties by ids."""
    pairs = sorted((w[i, j], int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in range(i + 1, len(ids)))
    name = {int(i): int(i) for i in ids}
    out = []
    for weight, a, b in pairs:
        if name[a] != name[b]:
            low, high = sorted((name[a], name[b]))
            name = {k: low if v == high else v for k, v in name.items()}
            out.append((a, b, weight))
    return out


def brute_labels(ids, edges):
    name = {int(i): int(i) for i in ids}
    for a, b, _ in edges:
        low, high = sorted((name[a], name[b]))
        name = {k: low if v == high else v for k, v in name.items()}
    return name


def rows(tree):
    return sorted((r.src, r.dst, r.weight) for r in tree.collect())


@pytest.mark.parametrize("cells, flat, merge", [(1, 256, 10**6), (9, 256, 10**6), (25, 4, 60)])
def test_spanning_tree_and_linkage_against_brute_force(spark, monkeypatch, cells, flat, merge):
    monkeypatch.setattr(nb, "BLOCK", 16)
    monkeypatch.setattr(nb, "FLAT", flat)
    monkeypatch.setattr(nb, "MEET", 30)
    monkeypatch.setattr(tr, "MERGE", merge)
    ids, x = cloud()
    w = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = brute_tree(ids, w)
    points = frame(spark, ids, x)
    tree = tr.spanning_tree(points, cells=cells).persist()
    got = rows(tree)
    assert [e[:2] for e in got] == sorted(e[:2] for e in want)
    assert np.allclose([e[2] for e in got], [e[2] for e in sorted(want)])
    heaviest = sorted(want, key=lambda e: (e[2], e[0], e[1]))
    by_k = {r.id: r.cluster for r in tr.single_linkage(points, tree, k=4).collect()}
    assert by_k == brute_labels(ids, heaviest[:-3])
    by_height = {r.id: r.cluster for r in tr.single_linkage(points, tree, height=0.6).collect()}
    assert by_height == brute_labels(ids, [e for e in want if e[2] <= 0.6])


def test_density_labels_at_any_radius_equal_dbscan(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 32)
    ids, x = cloud(5)
    points = frame(spark, ids, x)
    core, tree = tr.density_tree(points, 5, cells=6)
    w = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    reach = np.sort(w, axis=1)[:, 4]
    labels = tr.density_labels(core, tree, [0.9, 0.4, 2.5]).toPandas()
    assert len(labels) == 3 * len(ids)
    for eps, part in labels.groupby("eps"):
        got = dict(zip(part["id"], part["cluster"]))
        full = {r.id: r.cluster for r in dbscan(points, eps, 5, cells=6).collect()}
        cores = set(ids[reach <= eps].tolist())
        assert got == {i: full[i] if i in cores else -1 for i in ids.tolist()}


def test_trees_of_missing_repeated_and_no_points(spark):
    schema = "id bigint, vec array<double>"
    none = spark.createDataFrame([], schema)
    assert tr.spanning_tree(none).count() == 0
    assert tr.single_linkage(none, tr.spanning_tree(none), k=3).count() == 0
    one = spark.createDataFrame([(4, [1.0, 2.0])], schema)
    assert tr.spanning_tree(one).count() == 0
    assert [tuple(r) for r in tr.single_linkage(one, tr.spanning_tree(one), k=3).collect()] == [(4, 4)]
    core, tree = tr.density_tree(one, 3)
    assert core.count() == 0 and tree.count() == 0
    odd = spark.createDataFrame([(1, [0.0]), (1, [0.0]), (2, [3.0]), (None, [1.0]), (3, None), (5, [3.0])], schema)
    assert rows(tr.spanning_tree(odd)) == [(1, 2, 3.0), (2, 5, 0.0)]
    with pytest.raises(ValueError):
        tr.single_linkage(odd, tr.spanning_tree(odd))


def test_spanning_forest_of_a_graph_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 60, (200, 2)).tolist() if p[0] != p[1]}
    edges = [(a, b, float(rng.integers(1, 6))) for a, b in sorted(pairs)] + [(100, 101, 1.0), (7, 7, 0.0)]
    monkeypatch.setattr(tr, "MERGE", 0)
    got = rows(tr.spanning_forest(spark.createDataFrame(edges, tr.EDGE)))
    name = {v: v for e in edges for v in e[:2]}
    want = []
    for a, b, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if name[a] != name[b]:
            low, high = sorted((name[a], name[b]))
            name = {k: low if v == high else v for k, v in name.items()}
            want.append((a, b, w))
    assert got == sorted(want)


def test_density_labels_at_many_radii_keep_their_size_estimate(spark, capsys):
    ids, x = cloud()
    core, tree = tr.density_tree(frame(spark, ids, x), 4)
    tr.density_labels(core, tree, [0.2, 0.4, 0.9]).explain("cost")
    powers = [int(p) for p in re.findall(r"sizeInBytes=[0-9.]+E\+(\d+)", capsys.readouterr().out)]
    assert max(powers, default=0) < 1_000


def test_points_without_clusters_join_by_their_nearest_lists(spark, monkeypatch):
    """No pair of points is met beyond the search for neighbours, the lists alone give the tree."""
    monkeypatch.setattr(tr, "_searched", None)
    rng = np.random.default_rng(8)
    ids, x = np.arange(300), rng.normal(0, 1, (300, 8))
    w = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert [e[:2] for e in rows(tr.spanning_tree(frame(spark, ids, x)))] == sorted(e[:2] for e in brute_tree(ids, w))


def test_groups_beyond_the_lists_far_from_the_origin(spark, monkeypatch):
    """Groups of more points than a list holds, copies among them, find their links; weights are exact."""
    monkeypatch.setattr(nb, "BLOCK", 16)
    monkeypatch.setattr(tr, "NEAR", 3)
    rng = np.random.default_rng(9)
    x = 1e5 + np.vstack([rng.normal(40 * g, 0.01, (12, 3)) for g in range(5)])
    x[3:9] = x[2]
    ids = np.arange(len(x)) * 3
    w = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert rows(tr.spanning_tree(frame(spark, ids, x), cells=5)) == sorted(brute_tree(ids, w))
