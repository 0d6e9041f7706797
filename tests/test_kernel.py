"""Random Fourier features."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from millrace.operators.ml.kernel import RandomFourier


def test_products_approximate_the_kernel(spark):
    x = np.random.default_rng(1).normal(0, 1, (30, 3))
    df = spark.createDataFrame([(Vectors.dense(v),) for v in x], ["features"]).coalesce(1)
    out = [r[0].toArray() for r in RandomFourier(size=4096, gamma=0.5).transform(df).select("kernel_features").collect()]
    want = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(np.array(out) @ np.array(out).T - want).max() < 0.1


def test_gaps_empty_and_partitions(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 0.0]), (4, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>").select("id", F.when(F.col("v").isNotNull(), array_to_vector("v")).alias("features"))
    got = {r.id: r.kernel_features for r in RandomFourier(size=8).transform(df.repartition(3)).collect()}
    assert got[2] is None and np.isnan(got[3].toArray()).all() and got[1] == got[4]
    assert RandomFourier(size=8).transform(df.where("id > 9")).count() == 0
