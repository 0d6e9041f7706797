"""Group H: clustering, anomaly detectors and their evaluation on the embeddings."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from millrace.operators.cluster import dbscan as db
from millrace.operators.cluster import outliers as ou
from millrace.operators.cluster import quality as qu
from millrace.operators.cluster import sweep as sw
from millrace.operators.cluster import tree as tr
from millrace.operators.cluster.neighbors import as_points
from millrace.queries.exploring import rounded
from millrace.queries.registry import query
from millrace.queries.supervised import NEAR


def vectors(t):
    return t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").alias("prediction"))


def points(t):
    return as_points(t.embeddings, "vec_id", "embedding")


def customers(t):
    return t.customer.select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")


@query("h1_feature_matrix")
def h1_feature_matrix(t):
    return sw.prepare_unsupervised(customers(t), "c_custkey")[0]


@query("h2_kmeans")
def h2_kmeans(t):
    v = vectors(t).select("vec_id", "features")
    return sw.fit_kmeans(v, 4).transform(v).select("vec_id", "prediction")


@query("h3_bisecting")
def h3_bisecting(t):
    v = vectors(t).select("vec_id", "features")
    return sw.fit_bisecting(v, 4).transform(v).select("vec_id", "prediction")


LINK = 1.13


@query(
    "h3_single_linkage",
    f"""WITH RECURSIVE e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        d AS (SELECT a.id, b.id AS other FROM e a JOIN e b ON list_distance(a.v, b.v) <= {LINK}),
        r(id, label) AS (SELECT id, id FROM e UNION SELECT d.other, r.label FROM r JOIN d ON d.id = r.id)
        SELECT id, min(label) AS cluster FROM r GROUP BY id""",
)
def h3_single_linkage(t):
    p = points(t)
    return tr.single_linkage(p, tr.spanning_tree(p), height=LINK)


@query("h4_gaussian_mixture")
def h4_gaussian_mixture(t):
    v = vectors(t).select("vec_id", "features")
    projected, _ = sw.pca(v, 4)
    flat = projected.select("vec_id", F.col("pca").alias("features"))
    return sw.fit_gmm(flat, 3).transform(flat).select("vec_id", "prediction")


def quality_ctes(label: str = "label") -> str:
    return f"""e AS (SELECT vec_id, {label} AS c, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
      x AS (SELECT vec_id, c, i, v[i] AS xv FROM e, (SELECT unnest(generate_series(1, 64)) AS i) g),
      m AS (SELECT c, i, avg(xv) AS mv FROM x GROUP BY c, i), z AS (SELECT c, count(*) AS n FROM e GROUP BY c),
      w AS (SELECT x.vec_id, x.c, sum((xv - mv) * (xv - mv)) AS d2 FROM x JOIN m ON m.c = x.c AND m.i = x.i GROUP BY x.vec_id, x.c),
      s AS (SELECT c, avg(sqrt(d2)) AS s FROM w GROUP BY c),
      p AS (SELECT a.c, b.c AS c2, sqrt(sum((a.mv - b.mv) * (a.mv - b.mv))) AS d FROM m a JOIN m b ON a.i = b.i AND a.c <> b.c GROUP BY a.c, b.c),
      dbi AS (SELECT avg(r) AS db FROM (SELECT p.c, max((s1.s + s2.s) / p.d) AS r FROM p JOIN s s1 ON s1.c = p.c JOIN s s2 ON s2.c = p.c2 GROUP BY p.c) q),
      bt AS (SELECT sum(z.n * (mv - gv) * (mv - gv)) AS b FROM m JOIN z ON z.c = m.c JOIN (SELECT i, avg(xv) AS gv FROM x GROUP BY i) g ON g.i = m.i),
      chi AS (SELECT (b / ((SELECT count(*) FROM z) - 1)) / ((SELECT sum(d2) FROM w) / ((SELECT count(*) FROM e) - (SELECT count(*) FROM z))) AS ch FROM bt),
      dd AS (SELECT a.vec_id, a.c, b.c AS c2, sum(power(list_distance(a.v, b.v), 2)) AS sd, count(*) AS n FROM e a JOIN e b ON true GROUP BY a.vec_id, a.c, b.c),
      si AS (SELECT vec_id, max(CASE WHEN c = c2 THEN CASE WHEN n > 1 THEN sd / (n - 1) END END) AS a, min(CASE WHEN c <> c2 THEN sd / n END) AS b FROM dd GROUP BY vec_id),
      sil AS (SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS sil FROM si)"""


@query("h5_silhouette", f"WITH {quality_ctes()} SELECT round(sil, 6) AS silhouette, (SELECT count(*) FROM e) AS n FROM sil")
def h5_silhouette(t):
    v = vectors(t)
    return v.agg(F.count(F.lit(1)).alias("n")).select(F.lit(round(qu.silhouette(v), 6)).alias("silhouette"), "n")


@query("h6_davies_bouldin", f"WITH {quality_ctes()} SELECT round(db, 6) AS davies_bouldin FROM dbi")
def h6_davies_bouldin(t):
    return rounded(qu.davies_bouldin(vectors(t)), 6)


@query("h7_calinski_harabasz", f"WITH {quality_ctes()} SELECT round(ch, 6) AS calinski_harabasz FROM chi")
def h7_calinski_harabasz(t):
    return rounded(qu.calinski_harabasz(vectors(t)), 6)


@query("h8_cluster_score", f"WITH {quality_ctes()} SELECT round(0.6 * sil - 0.4 * db / 10, 6) AS score FROM sil, dbi")
def h8_cluster_score(t):
    v = vectors(t)
    sil = F.lit(qu.silhouette(v))
    return qu.davies_bouldin(v).select(F.round(qu.cluster_score(sil, F.col("davies_bouldin")), 6).alias("score"))


@query(
    "h9_ari",
    """WITH c AS (SELECT event_type AS a, user_id % 4 AS b, count(*) AS n FROM events GROUP BY event_type, user_id % 4), s AS (SELECT sum(n * (n - 1) / 2.0) AS sij, sum(n) AS nn FROM c),
       r AS (SELECT sum(t * (t - 1) / 2.0) AS sa FROM (SELECT sum(n) AS t FROM c GROUP BY a) x), q AS (SELECT sum(t * (t - 1) / 2.0) AS sb FROM (SELECT sum(n) AS t FROM c GROUP BY b) y)
       SELECT round(CAST((sij - sa * sb / (nn * (nn - 1) / 2.0)) / ((sa + sb) / 2.0 - sa * sb / (nn * (nn - 1) / 2.0)) AS DOUBLE), 6) AS ari FROM s CROSS JOIN r CROSS JOIN q""",
)
def h9_ari(t):
    return rounded(qu.ari(t.events.withColumn("b", F.col("user_id") % 4), "event_type", "b"), 6)


@query("h10_k_sweep")
def h10_k_sweep(t):
    v = vectors(t).select("vec_id", "features").persist()
    try:
        return sw.k_sweep(v)
    finally:
        v.unpersist()


EPS = 0.9


@query(
    "h11_neighbor_counts",
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
        SELECT a.vec_id AS id, count(*) AS neighbors FROM e a JOIN e b ON list_distance(a.v, b.v) <= {EPS} GROUP BY a.vec_id""",
)
def h11_neighbor_counts(t):
    return db.neighbor_counts(points(t), EPS, cells=8)


@query(
    "h11_dbscan",
    f"""WITH RECURSIVE e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        d AS (SELECT a.id, b.id AS other, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON list_distance(a.v, b.v) <= {EPS}),
        core AS (SELECT id FROM d GROUP BY id HAVING count(*) >= 6),
        cc AS (SELECT d.id, d.other FROM d JOIN core a ON a.id = d.id JOIN core b ON b.id = d.other),
        r(id, label) AS (SELECT id, id FROM core UNION SELECT cc.other, r.label FROM r JOIN cc ON cc.id = r.id),
        k AS (SELECT id, min(label) AS cluster FROM r GROUP BY id),
        b AS (SELECT d.id, d.other, row_number() OVER (PARTITION BY d.id ORDER BY dist, d.other) AS n FROM d JOIN core c ON c.id = d.other WHERE d.id NOT IN (SELECT id FROM core))
        SELECT e.id, coalesce(k.cluster, kb.cluster, -1) AS cluster FROM e LEFT JOIN k ON k.id = e.id LEFT JOIN b ON b.id = e.id AND b.n = 1 LEFT JOIN k kb ON kb.id = b.other""",
)
def h11_dbscan(t):
    return db.dbscan(points(t), EPS, 6, cells=8)


RADII = (1.16, 1.18)


@query(
    "h11_density_labels",
    " UNION ALL ".join(
        f"""SELECT * FROM (WITH RECURSIVE e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        d AS (SELECT a.id, b.id AS other FROM e a JOIN e b ON list_distance(a.v, b.v) <= {eps}),
        core AS (SELECT id FROM d GROUP BY id HAVING count(*) >= 6),
        cc AS (SELECT d.id, d.other FROM d JOIN core a ON a.id = d.id JOIN core b ON b.id = d.other),
        r(id, label) AS (SELECT id, id FROM core UNION SELECT cc.other, r.label FROM r JOIN cc ON cc.id = r.id)
        SELECT CAST({eps} AS DOUBLE) AS eps, e.id, coalesce(min(label), -1) AS cluster FROM e LEFT JOIN r ON r.id = e.id GROUP BY e.id) q{i}"""
        for i, eps in enumerate(RADII)
    ),
)
def h11_density_labels(t):
    return tr.density_labels(*tr.density_tree(points(t), 6, cells=8), RADII)


@query("h12_isolation_forest")
def h12_isolation_forest(t):
    return ou.isolation_forest(points(t))


LOF = NEAR + """, n AS (SELECT id, neighbor, dist FROM r WHERE rank <= 20), k AS (SELECT id, max(dist) AS kd FROM n GROUP BY id),
  l AS (SELECT n.id, 1.0 / (avg(greatest(n.dist, k.kd)) + 1e-10) AS lrd FROM n JOIN k ON k.id = n.neighbor GROUP BY n.id),
  f AS (SELECT n.id, avg(o.lrd) / max(l.lrd) AS score FROM n JOIN l o ON o.id = n.neighbor JOIN l ON l.id = n.id GROUP BY n.id)"""


@query("h13_lof", LOF + " SELECT id, round(score, 6) AS score, score > (SELECT quantile_cont(score, 0.9) FROM f) AS anomaly FROM f")
def h13_lof(t):
    return rounded(ou.lof(points(t), 20, cells=4), 6)


def event_flags(t):
    """Two simple detectors over events: large values, values large for their type."""
    mean = t.events.groupBy("event_type").agg(F.avg("value").alias("m"))
    return t.events.join(mean, "event_type").select(
        F.col("event_id").alias("id"), F.col("value").alias("iso_score"), (F.col("value") > 150).alias("iso_anomaly"),
        (F.col("value") / F.col("m")).alias("lof_score"), (F.col("value") > 3 * F.col("m")).alias("lof_anomaly"),
    ).withColumn("both", F.col("iso_anomaly") & F.col("lof_anomaly"))


FLAGS = "(SELECT event_id AS id, value AS iso_score, value > 150 AS iso, value > 3 * m AS lof FROM events JOIN (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type) q USING (event_type))"


@query(
    "h14_anomaly_summary",
    f"""SELECT count(*) AS rows, count(*) FILTER (WHERE iso) AS iso, count(*) FILTER (WHERE lof) AS lof, count(*) FILTER (WHERE iso AND lof) AS both,
        round(100.0 * count(*) FILTER (WHERE iso) / count(*), 4) AS iso_pct, round(100.0 * count(*) FILTER (WHERE lof) / count(*), 4) AS lof_pct, round(100.0 * count(*) FILTER (WHERE iso AND lof) / count(*), 4) AS both_pct FROM {FLAGS} f""",
)
def h14_anomaly_summary(t):
    return ou.anomaly_summary(event_flags(t))


@query("h15_pca")
def h15_pca(t):
    return sw.pca(vectors(t).select("vec_id", "features"), 4)[1]


PROFILE_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
PROFILE = "(" + " UNION ALL ".join(
    f"""SELECT l_linenumber AS cluster, '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, count({c}) AS count, count(*) AS size, 100.0 * count(*) / (SELECT count(*) FROM lineitem) AS size_pct FROM lineitem GROUP BY l_linenumber"""
    for c in PROFILE_COLS
) + ")"


@query("h16_cluster_profiles", f"SELECT cluster, feature, round(mean, 4) AS mean, round(std, 4) AS std, count, size, round(size_pct, 4) AS size_pct FROM {PROFILE} p")
def h16_cluster_profiles(t):
    return rounded(qu.cluster_profiles(t.lineitem, "l_linenumber", PROFILE_COLS))


Z = f"(SELECT cluster, feature, (mean - avg(mean) OVER (PARTITION BY feature)) / stddev_pop(mean) OVER (PARTITION BY feature) AS z FROM {PROFILE} p)"


@query("h17_profile_zscores", f"SELECT cluster, feature, round(z, 4) AS z FROM {Z} z")
def h17_profile_zscores(t):
    return rounded(qu.profile_zscores(qu.cluster_profiles(t.lineitem, "l_linenumber", PROFILE_COLS)))


@query("h17_top_feature", f"SELECT cluster, feature, round(z, 4) AS z FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, feature DESC) AS n FROM {Z} z) q WHERE n = 1")
def h17_top_feature(t):
    return rounded(qu.top_feature(qu.profile_zscores(qu.cluster_profiles(t.lineitem, "l_linenumber", PROFILE_COLS))))


@query("h18_annotate")
def h18_annotate(t):
    p = points(t)
    clusters = p.select("id").join(t.embeddings.select(F.col("vec_id").alias("_v"), F.col("label").alias("cluster")), F.col("id") == F.col("_v")).drop("_v")
    flags = ou.combine(ou.isolation_forest(p), ou.lof(p, 20))
    return ou.annotate(t.embeddings.select("vec_id", "label"), "vec_id", clusters, flags)


@query("h19_top_anomalies", f"SELECT id, iso_score FROM {FLAGS} f ORDER BY iso_score DESC, id LIMIT 20")
def h19_top_anomalies(t):
    return ou.top_anomalies(event_flags(t)).select("id", "iso_score")


@query(
    "h19_score_histogram",
    f"""WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
        SELECT CAST(least(floor((iso_score - lo) / ((hi - lo) / 40)) + 1, 40) AS INT) AS bin, iso AS decision, count(*) AS n FROM {FLAGS} f, b GROUP BY 1, 2""",
)
def h19_score_histogram(t):
    return ou.score_histogram(event_flags(t))


@query("h20_unsupervised_run")
def h20_unsupervised_run(t):
    return sw.run_unsupervised(customers(t), "c_custkey", 2, 3, ["KMeans"], trees=20, neighbors=10).annotated


SWEEP_KS = (2, 3, 5)


@query(
    "h21_sweep_curves",
    " UNION ALL ".join(
        f"""SELECT * FROM (WITH {quality_ctes(f'label % {k}')} SELECT 'Label rest' AS algorithm, {k} AS k, round(sil, 6) AS silhouette, round(db, 6) AS davies_bouldin, round(ch, 6) AS calinski_harabasz, CAST(NULL AS DOUBLE) AS stability FROM sil, dbi, chi) q{k}"""
        for k in SWEEP_KS
    ),
)
def h21_sweep_curves(t):
    rows = []
    for k in SWEEP_KS:
        v = vectors(t).withColumn("prediction", F.col("prediction") % k)
        sil, d, c = qu.silhouette(v), qu.davies_bouldin(v).first()[0], qu.calinski_harabasz(v).first()[0]
        rows.append(("Label rest", k, sil, d, c, None, qu.cluster_score(sil, d), None))
    return rounded(sw.sweep_curves(t.spark.createDataFrame(rows, sw.SWEEP_SCHEMA)), 6)
