"""Nearest rows as a model: mean label, or shares of the classes, of the nearest training rows."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.cluster.neighbors import knn_join
from millrace.plans.frames import col
from millrace.plans.lineage import cut_lineage


class _Nearest(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    k = Param(Params._dummy(), "k", "rows that have a say", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "shares of classes instead of a mean", TypeConverters.toBoolean)


class Nearest(Estimator, _Nearest):
    """The ``k`` nearest training rows by Euclidean distance, exactly.

    Equal training rows are one point with their number and labels, so repeated rows cost nothing. Of equal rows of which only some are among the ``k``
    the mean counts. Points at the same distance go by a hash of their place. A class is the one with the largest share, ties to the smaller.
    """

    @keyword_only
    def __init__(self, *, k: int = 5, classes: bool = False, featuresCol: str = "features", labelCol: str = "label") -> None:
        super().__init__()
        self._setDefault(k=5, classes=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> NearestModel:
        label = col(self.getLabelCol())
        rows = df.select(vector_to_array(self.getFeaturesCol()).alias("vec"), label.alias("label"))
        sums = [F.sum("label")]
        if self.getOrDefault(self.classes):
            top = rows.agg(F.max("label")).first()[0]
            sums = [F.sum((F.col("label") == c).cast("double")) for c in range(int(top or 0) + 1)]
        points = rows.groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("sums")).withColumn("id", F.xxhash64("vec"))
        return self._copyValues(NearestModel(cut_lineage(points), len(sums)))


class NearestModel(Model, _Nearest):
    """Training points (id, vec, n, sums) of a :class:`Nearest`."""

    def __init__(self, points: DataFrame | None = None, width: int = 1) -> None:
        super().__init__()
        self._setDefault(k=5, classes=False)
        self.points, self.width = points, width

    def _transform(self, df: DataFrame) -> DataFrame:
        k = self.getOrDefault(self.k)
        places = df.select(vector_to_array(self.getFeaturesCol()).alias("vec")).distinct().withColumn("id", F.xxhash64("vec"))
        places = cut_lineage(places)
        near = knn_join(places.select("id", "vec"), self.points.select("id", "vec"), k)
        said = near.join(self.points.select(F.col("id").alias("neighbor"), "n", "sums"), "neighbor")
        before = F.coalesce(F.sum("n").over(Window.partitionBy("id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        said = said.withColumn("take", F.greatest(F.lit(0), F.least(F.col("n"), k - before)))
        shares = [(F.sum(F.col("sums")[i] * F.col("take") / F.col("n")) / F.sum("take")).alias(f"s{i}") for i in range(self.width)]
        found = said.groupBy("id").agg(*shares).select(F.col("id").alias("_id"), F.array(*[f"s{i}" for i in range(self.width)]).alias("_shares"))
        found = places.join(found, F.col("id") == F.col("_id")).select(F.col("vec").alias("_vec"), "_shares")
        out = df.withColumn("_place", vector_to_array(self.getFeaturesCol())).join(found, F.col("_place") == F.col("_vec"), "left")
        if not self.getOrDefault(self.classes):
            return out.withColumn(self.getPredictionCol(), F.col("_shares")[0]).drop("_place", "_vec", "_shares")
        best = (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double")
        return out.withColumn(self.getProbabilityCol(), array_to_vector("_shares")).withColumn(self.getPredictionCol(), best).drop("_place", "_vec", "_shares")
