"""Inputs beyond what once were caps: every row, column and class counts."""

import pytest
from pyspark.sql import functions as F

from millrace.operators.keys import multivalued_columns
from millrace.operators import explore, logs, profile
from millrace.operators.clean import encode, schema, select
from millrace.operators.cluster import quality as cluster_quality
from millrace.operators.cluster.sweep import k_sweep
from millrace.operators.quality.bias import bias_report
from millrace.operators.quality.leakage import class_places, detect_leakage


def test_lineage_follows_any_depth(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(20)], "src string, dst string")
    found = {r.node: r.depth for r in logs.lineage_closure(edges, "n0").collect()}
    assert found == {f"n{i}": i for i in range(1, 21)}


def test_onehot_keeps_every_category(spark):
    df = spark.createDataFrame([(f"c{i:02d}",) for i in range(20)] * 2, "c string")
    out = encode.encode_onehot(df, "c")
    assert len(out.columns) == 19
    assert out.select(sum(F.col(c).cast("int") for c in out.columns).alias("s")).agg(F.sum("s")).first()[0] == 38
    with pytest.raises(ValueError):
        encode.encode_onehot(df, "c", most=10)


def test_text_targets_stay_classes(spark):
    df = spark.createDataFrame([(float(i % 40), f"t{i % 20}") for i in range(400)], "x double, y string")
    assert select.mutual_information(df, "y", ["x"]).first().mi > 1.0


def test_every_column_is_reported(spark):
    df = spark.range(50).select(*[F.when(F.col("id") % 7 != i % 7, F.col("id") % 3).cast("string").alias(f"c{i}") for i in range(34)])
    assert explore.missing_map(df).where("a = b").count() == 34
    pair = explore.histogram_pair(*[df.select(*[F.col(c).cast("double").alias(c) for c in df.columns[:8]])] * 2, df.columns[:8], bins=3)
    assert pair.select("column").distinct().count() == 8
    assert explore.histogram(df.select(F.col("c0").cast("double").alias("x")), "x", 1500).count() == 1500
    assert profile.column_report(df.select(*df.columns[:9]), "t").where("frequent is not null").count() == 9


def test_spellings_of_known_words(spark):
    """More spellings than any cap would list still are yes and no."""
    words = [f"{' ' * k}{w}" for k in range(12) for w in ("yes", "NO", "Yes", "no")]
    found = schema.infer_schema(spark.createDataFrame([(w,) for w in words] * 3, "flag string"))
    assert found["flag"].inferred_type == schema.BOOLEAN
    mixed = schema.infer_schema(spark.createDataFrame([(w,) for w in [*words, "maybe"]] * 3, "flag string"))
    assert mixed["flag"].inferred_type != schema.BOOLEAN


def test_class_places_and_leakage(spark):
    rows = [(f"k{i:05d}", float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "y string, x double").repartition(7)
    places = {r["_class"]: r["_place"] for r in class_places(df, "y").collect()}
    assert places == {k: int(x) for k, x in rows}
    assert [r.column for r in detect_leakage(df, {}, "y").collect()] == ["x"]


def test_cluster_ids_beyond_an_int(spark):
    rows = [([float(i % 2 * 9 + i % 5), float(i % 3)], (1 << 40) + i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "features array<double>, prediction long")
    small = df.withColumn("prediction", (F.col("prediction") % 2).cast("int"))
    assert cluster_quality.silhouette(df) == pytest.approx(cluster_quality.silhouette(small))
    for measure in (cluster_quality.davies_bouldin, cluster_quality.calinski_harabasz):
        assert measure(df).first()[0] == pytest.approx(measure(small).first()[0])


def test_impossible_k_is_refused(spark):
    df = spark.createDataFrame([([1.0],), ([2.0],), ([3.0],)], "features array<double>")
    with pytest.raises(ValueError):
        k_sweep(df, 2, 5)


def test_spread_around_a_mean_of_zero_is_a_disparity(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -1.0)] * 30, "grp string, y double")
    assert bias_report(df, {}, "y", ["grp"]).first().biased


def test_recursion_has_no_level_limit(spark):
    text = "WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 300) SELECT count(*) AS c FROM n"
    from millrace.operators.sql import run_sql

    assert run_sql(spark, {}, text).first().c == 300


def test_lists_in_long_texts(spark):
    """A group repeated for every separator overflowed the matcher's stack, which ends an executor."""
    texts = ["a,b", "a|b;c", "a,b,\n", "a\n,b", ",a,b", "a,b,", "a,,b", "a", " a,b ", "x," * 200_000 + "x", "x," * 200_000, None, ""]
    got = multivalued_columns(spark.createDataFrame([(t,) for t in texts], "t string")).first()
    assert (got["values"], got["json_share"], got["list_share"]) == (12, 0.0, 0.5)
