"""Prefix sums, exact quantiles, rolling blocks and components against pandas and numpy."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import anomalies
from millrace.operators.clean.impute import fill_ordered
from millrace.plans.components import connected_components
from millrace.plans.prefix import range_boundaries, row_positions, running_totals
from millrace.plans.quantiles import group_quantiles, quantiles
from millrace.plans.rolling import blocks_with_halo, finish


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame(
        {
            "id": np.arange(4_000),
            "g": np.where(rng.random(4_000) < 0.6, "hot", rng.choice(list("abcde"), 4_000)),
            "v": np.round(rng.exponential(20, 4_000), 1),
            "w": rng.integers(0, 5, 4_000),
            "t": rng.permutation(4_000).astype(float),
        }
    )
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("buckets", [1, 7, 100])
def test_running_totals_by_group(skewed, buckets):
    pdf, df = skewed
    got = running_totals(df.withColumn("n", F.lit(1)), "v", ["n", "w"], by=["g"], buckets=buckets).toPandas()
    want = pdf.assign(n=1).groupby(["g", "v"], as_index=False)[["n", "w"]].sum().sort_values(["g", "v"])
    want["cum_n"], want["cum_w"] = want.groupby("g")["n"].cumsum(), want.groupby("g")["w"].cumsum()
    want["all_n"] = want.groupby("g")["n"].transform("sum")
    got = got.sort_values(["g", "v"]).reset_index(drop=True)
    for c in ("n", "w", "cum_n", "cum_w", "all_n"):
        assert got[c].tolist() == want[c].tolist(), c


@pytest.mark.parametrize("limit", [0, 10**9])
def test_quantiles_exact_on_both_paths(skewed, limit):
    pdf, df = skewed
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(df, ["v", "w", "t"], probs, direct_rows=limit)
    for c in ("v", "w", "t"):
        assert np.allclose(got[c], np.quantile(pdf[c], probs)), c


def test_quantiles_of_empty_and_constant(spark):
    df = spark.createDataFrame([(None, 3.0), (None, 3.0)], "a double, b double")
    for limit in (0, 10):
        assert quantiles(df, ["a", "b"], [0.5], direct_rows=limit) == {"a": [None], "b": [3.0]}


def test_group_quantiles(skewed):
    pdf, df = skewed
    got = group_quantiles(df, ["g"], "v", {"q": 0.3}).toPandas().set_index("g")["q"]
    assert np.allclose(got.sort_index(), pdf.groupby("g")["v"].quantile(0.3).sort_index())


def test_positions_with_many_buckets(skewed):
    pdf, df = skewed
    cuts = range_boundaries(df, "t", 13)
    assert len(cuts) == 12
    got = row_positions(df, "t", by=["g"], cuts=cuts).toPandas().set_index("id")["position"].sort_index()
    want = pdf.groupby("g")["t"].rank().astype(int)
    assert got.tolist() == want.tolist()


@pytest.mark.parametrize("block", [10, 64, 10_000])
def test_blocks_keep_trailing_windows_whole(skewed, block):
    pdf, df = skewed
    spread, window = blocks_with_halo(df, "t", 6, by=["g"], block_rows=block)
    got = finish(spread.withColumn("m", F.avg("v").over(window.rowsBetween(-6, 0)))).toPandas()
    assert len(got) == len(pdf)
    want = pdf.sort_values("t").groupby("g")["v"].rolling(7, min_periods=1).mean().droplevel(0).sort_index()
    assert np.allclose(got.set_index("id")["m"].sort_index(), want)


def test_moving_anomalies_drop_partial_windows(spark):
    rows = [(i, 10.0 + (i % 2)) for i in range(20)] + [(20, 99.0)]
    found = anomalies.anomalies_moving(spark.createDataFrame(rows, "i int, v double"), "v", "i", w=7).collect()
    assert [r["i"] for r in found] == [20]


def test_fill_ordered_like_pandas(skewed):
    pdf, df = skewed
    holed = pdf.assign(v=pdf["v"].where(pdf["id"] % 4 == 0))
    frame = df.withColumn("v", F.when(F.col("id") % 4 == 0, F.col("v")))
    got = fill_ordered(frame, ["v"], "t", ["g"]).toPandas().set_index("id")["v"].sort_index()
    want = holed.sort_values("t").groupby("g")["v"].transform(lambda s: s.ffill().bfill()).sort_index()
    assert got.tolist() == want.tolist()


def test_components_of_chain_star_and_pair(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 501), (501, 500)]
    ids = sorted({v for e in edges for v in e} | {900})
    got = connected_components(
        spark.createDataFrame([(i,) for i in ids], "id bigint"), spark.createDataFrame(edges, "src bigint, dst bigint")
    ).toPandas().set_index("id")["component"]
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
    assert got[500] == got[501] == 500 and got[900] == 900


def test_size_estimates_do_not_compound_over_rounds(spark, capsys):
    """A path in shuffled order takes many rounds; each used to multiply the digits of the estimate by four."""
    ids = np.random.default_rng(5).permutation(120).tolist()
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "src bigint, dst bigint")
    got = connected_components(spark.createDataFrame([(i,) for i in ids], "id bigint"), edges)
    got.explain("cost")
    powers = [int(p) for p in re.findall(r"sizeInBytes=[0-9.]+E\+(\d+)", capsys.readouterr().out)]
    assert max(powers, default=0) < 10_000
    assert got.where("component <> 0").count() == 0


def test_rounds_of_components_leave_no_empty_files(spark):
    """Small graphs run in about a task a core, whatever the number of shuffle partitions."""
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.range(400).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).where("src % 20 <> 19")
        found = connected_components(spark.range(400), edges)
        assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert found.where("component <> id - id % 20").count() == 0
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
