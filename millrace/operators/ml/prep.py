"""Dataset profile, task detection and preprocessing for MLlib."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.moments import clean_corr
from millrace.plans.frames import col, is_numeric, numeric_columns, small_frame, stats_row

BINARY, MULTICLASS, REGRESSION = "binary", "multiclass", "regression"
MAX_CLASSES = 20
PRIMARY_METRIC = {BINARY: "roc_auc", MULTICLASS: "f1_macro", REGRESSION: "r2"}


def detect_task(df: DataFrame, target: str) -> str:
    """Up to 2 values binary; text or up to 20 values multiclass; else regression."""
    values = df.select(target).where(col(target).isNotNull()).distinct().limit(MAX_CLASSES + 1).count()
    if values <= 2:
        return BINARY
    text = not is_numeric(df.schema[target].dataType)
    return MULTICLASS if text or values <= MAX_CLASSES else REGRESSION


def profile_dataset(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: size, numeric / categorical split without the target, mean missing share, task."""
    features = [c for c in df.columns if c != target]
    numeric = [c for c in numeric_columns(df) if c != target]
    gaps = sum((F.count_if(col(c).isNull()) for c in df.columns), F.lit(0))
    task = detect_task(df, target) if target else None
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.lit(len(numeric)).alias("numeric"),
        F.lit(len(features) - len(numeric)).alias("categorical"),
        F.round(100.0 * F.try_divide(gaps, F.count(F.lit(1)) * len(df.columns)), 4).alias("missing_pct"),
        F.lit(task).alias("task"),
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    present = df.where(col(target).isNotNull())
    total = present.agg(F.count(F.lit(1))).scalar()
    return present.groupBy(col(target).alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)


def target_correlations(df: DataFrame, target: str, k: int = 15) -> DataFrame:
    """Top ``k`` abs(correlation) of numeric features with the target, one aggregate pass."""
    cols = [c for c in numeric_columns(df) if c != target]
    y = col(target).cast("double")
    r = stats_row(df, {c: clean_corr(col(c).cast("double"), y) for c in cols})
    rows = sorted(((c, abs(v)) for c, v in r.items() if v is not None), key=lambda p: (-p[1], p[0]))[:k]
    return small_frame(df.sparkSession, rows, "column string, corr double")


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Alphabetical class index (0-based)."""
    model = StringIndexer(inputCol=column, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="keep").fit(
        df.select(col(column).cast("string").alias(column))
    )
    return model.transform(df.withColumn(column, col(column).cast("string"))).withColumn(out, col(out).cast("int"))


class UnknownClasses(Transformer, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Class indexes in which the place kept for unseen and missing classes, the last one, is -1."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = []
        for source, name in zip(self.getInputCols(), self.getOutputCols()):
            last = len(df.schema[source].metadata["ml_attr"]["vals"]) - 1
            out.append(F.when(col(source) == last, -1.0).otherwise(col(source)).alias(name))
        return df.select("*", *out)


def build_preprocessor(
    numeric: Sequence[str], categorical: Sequence[str], output: str = "features", standardize: bool = True
) -> Pipeline:
    """Median imputation, class indexes (-1 for unseen and missing classes), scaling.

    Stages keep their working columns behind ``_p_`` names. Scaling divides by the sample
    deviation, MLlib's choice.
    """
    stages, inputs = [], []
    if numeric:
        filled = [f"_p_{c}" for c in numeric]
        stages.append(Imputer(strategy="median", inputCols=list(numeric), outputCols=filled))
        stages.append(VectorAssembler(inputCols=filled, outputCol="_p_numeric", handleInvalid="keep"))
        if standardize:
            stages.append(StandardScaler(inputCol="_p_numeric", outputCol="_p_scaled", withMean=True, withStd=True))
        inputs.append("_p_scaled" if standardize else "_p_numeric")
    if categorical:
        indexed, placed = [f"_i_{c}" for c in categorical], [f"_p_{c}" for c in categorical]
        stages.append(
            StringIndexer(inputCols=list(categorical), outputCols=indexed, stringOrderType="alphabetAsc", handleInvalid="keep")
        )
        stages.append(UnknownClasses(inputCols=indexed, outputCols=placed))
        inputs += placed
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="keep"))
    return Pipeline(stages=stages)


def model_frame(df: DataFrame, target: str | None, task: str | None) -> tuple[DataFrame, list[str], list[str]]:
    """Numeric features as double, text features as string, target as double ``label``."""
    features = [c for c in df.columns if c != target]
    numeric = [c for c in features if is_numeric(df.schema[c].dataType) or isinstance(df.schema[c].dataType, T.BooleanType)]
    categorical = [c for c in features if c not in numeric]
    out = [col(c).cast("double").alias(c) if c in numeric else col(c).cast("string").alias(c) for c in features]
    if target is None:
        return df.select(*out), numeric, categorical
    if task in (BINARY, MULTICLASS):
        indexed = label_encode(df.where(col(target).isNotNull()), target, "_label")
        return indexed.select(*out, F.col("_label").cast("double").alias("label")), numeric, categorical
    return df.where(col(target).isNotNull()).select(*out, col(target).cast("double").alias("label")), numeric, categorical
