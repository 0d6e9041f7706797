"""Exponential means against pandas, with gaps shorter and longer than the reach of their weights."""

import numpy as np
import pandas as pd
import pytest

from millrace.operators import forecast


@pytest.mark.parametrize("alpha", [0.3, 0.9, 0.01])
def test_exponential_mean_with_gaps(spark, alpha):
    draw = np.random.default_rng(5)
    values = pd.Series(draw.normal(10, 3, 1200))
    values[:7] = np.nan
    values[draw.random(1200) < 0.2] = np.nan
    values[300:620] = np.nan
    values[1190:] = np.nan
    rows = [(i, None if np.isnan(v) else float(v)) for i, v in enumerate(values)]
    series = spark.createDataFrame(rows, "t long, v double").repartition(4)
    exact = values.ewm(alpha=alpha).mean()
    got = forecast.smoothed(series, "t", "v", alpha=alpha).toPandas().sort_values("t").exp_smooth
    assert np.allclose(got.to_numpy(float), exact.to_numpy(float), equal_nan=True)
    level = forecast.forecast_ewm(series, "t", "v", alpha, 3).toPandas().forecast
    assert np.allclose(level, exact.iloc[-1])
