"""Random Fourier features of a Gaussian kernel, a stage before linear models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.frames import col


def fourier_weights(inputs: int, outputs: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (inputs, outputs) and phases whose cosines approximate exp(-gamma * squared distance)."""
    rng = np.random.default_rng([seed, inputs, outputs])
    return rng.normal(0.0, np.sqrt(2.0 * gamma), (inputs, outputs)), rng.uniform(0.0, 2.0 * np.pi, outputs)


class RandomFourier(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Vector column to ``size`` random Fourier features; products of two rows approximate the Gaussian kernel.

    Frequencies follow from seed, size and the vectors' length, so nothing is fitted and every task draws the same ones.
    ``gamma`` 0 stands for one over the number of inputs. A missing vector stays missing, one with NaN gives NaN only.
    """

    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel, 0 for 1 / inputs", TypeConverters.toFloat)

    @keyword_only
    def __init__(
        self, *, inputCol: str = "features", outputCol: str = "kernel_features", size: int = 256, gamma: float = 0.0, seed: int = 42
    ) -> None:
        super().__init__()
        self._setDefault(inputCol="features", outputCol="kernel_features", size=256, gamma=0.0, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        size, gamma, seed = self.getOrDefault(self.size), self.getOrDefault(self.gamma), self.getSeed()

        @F.pandas_udf("array<double>")
        def features(vectors: pd.Series) -> pd.Series:
            out = pd.Series([np.zeros(0)] * len(vectors), dtype=object)
            there = np.flatnonzero(vectors.map(len).to_numpy())
            if len(there):
                x = np.stack(vectors.iloc[there].to_list())
                weights, phases = fourier_weights(x.shape[1], size, gamma or 1.0 / max(x.shape[1], 1), seed)
                z = np.sqrt(2.0 / size) * np.cos(x @ weights + phases)
                for i, row in zip(there.tolist(), z):
                    out.iat[i] = row
            return out

        given = col(self.getInputCol())
        full = F.coalesce(given, array_to_vector(F.array().cast("array<double>")))
        # NaN comes back from Python as null.
        found = F.transform(features(vector_to_array(full)), lambda x: F.coalesce(x, F.lit(float("nan"))))
        return df.withColumn(self.getOutputCol(), F.when(given.isNotNull(), array_to_vector(found)))
