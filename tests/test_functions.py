import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import pvalue
from millrace.functions.moments import clean_corr, kurtosis_of, skew_of


# Published table values.
@pytest.mark.parametrize(
    "got, want",
    [
        (pvalue.chi2_sf(3.841459, 1), 0.05),
        (pvalue.chi2_sf(18.307038, 10), 0.05),
        (pvalue.f_sf(4.102821, 2, 10), 0.05),
        (pvalue.f_sf(3.098391, 3, 20), 0.05),
        (pvalue.t_two_sided(2.776445, 4), 0.05),
        (pvalue.t_two_sided(2.228139, 10), 0.05),
        (pvalue.kolmogorov_sf(1.358102 / math.sqrt(50), 100, 100), 0.05),
    ],
)
def test_tails(got, want):
    assert abs(got - want) < 2e-5


def test_limits():
    assert pvalue.chi2_sf(0, 3) == 1 and pvalue.kolmogorov_sf(0.0, 10, 10) == 1
    assert pvalue.f_sf(0, 2, 2) == 1 and pvalue.beta_cdf(2, 3, 1.0) == 1


def test_sample_moments_match_pandas(spark):
    values = [1.0, 2.0, 2.0, 3.0, 10.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    skew, kurt = df.agg(skew_of(F.col("v")), kurtosis_of(F.col("v"))).first()
    s = pd.Series(values)
    assert abs(skew - s.skew()) < 1e-9 and abs(kurt - s.kurt()) < 1e-9
    assert df.limit(2).agg(skew_of(F.col("v"))).first()[0] is None


def test_corr_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "a double, b double")
    assert df.agg(clean_corr(F.col("a"), F.col("b"))).first()[0] is None
