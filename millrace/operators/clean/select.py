"""Feature selection: variance, correlation and mutual information with the target."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.clean.log import TransformationLog
from millrace.operators.explore import corr_matrix
from millrace.plans.frames import col, is_numeric, numeric_columns, stats_row
from millrace.plans.quantiles import quantiles

MIN_VARIANCE = 0.001
MAX_CORR = 0.95
MAX_CLASSES = 15


def low_variance(df: DataFrame, cols: Sequence[str], threshold: float = MIN_VARIANCE) -> list[str]:
    """Columns whose population variance, gaps as 0, is at most the threshold."""
    s = stats_row(df, {c: F.var_pop(F.coalesce(col(c).cast("double"), F.lit(0.0))) for c in cols})
    return [c for c in cols if (s[c] or 0.0) <= threshold]


def select_variance(df: DataFrame, cols: Sequence[str], threshold: float = MIN_VARIANCE) -> DataFrame:
    return df.drop(*low_variance(df, cols, threshold))


def correlated(df: DataFrame, cols: Sequence[str], threshold: float = MAX_CORR) -> list[str]:
    """The later column of every pair with abs(r) above the threshold."""
    found = corr_matrix(df, cols, complete=False).where(F.abs("r") > threshold).select("y").distinct().collect()
    later = {r["y"] for r in found}
    return [c for c in cols if c in later]


def select_correlation(df: DataFrame, cols: Sequence[str], threshold: float = MAX_CORR) -> DataFrame:
    return df.drop(*correlated(df, cols, threshold))


def _edges(values: Sequence[float]) -> list[float]:
    return sorted({v for v in values if v is not None})


def mutual_information(df: DataFrame, target: str, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """(column, mi): mutual information in nats between quantile-binned columns and the target.

    A numeric target is used as classes up to 15 distinct values and binned above; a text target is
    always classes. Tasks count their batches; joint counts are at most columns x bins x classes rows.
    """
    probs = [i / bins for i in range(1, bins)]
    rows = df.where(col(target).isNotNull())
    binned = is_numeric(df.schema[target].dataType) and rows.select(target).distinct().limit(MAX_CLASSES + 1).count() > MAX_CLASSES
    cuts = quantiles(rows.select(*[F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols]), cols, probs)
    marks = np.array(_edges(quantiles(rows, [target], probs)[target])) if binned else None
    edges = [np.array(_edges(cuts[c])) for c in cols]
    y = col(target).cast("double" if binned else "string")

    def counts(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            if binned:
                code = np.searchsorted(marks, batch.column(0).to_numpy(zero_copy_only=False), side="right")
                names = np.arange(len(marks) + 1).astype(str)
            else:
                found = batch.column(0).dictionary_encode()
                code, names = found.indices.to_numpy(zero_copy_only=False), np.array(found.dictionary.to_pylist(), dtype=object)
            for i, c in enumerate(cols):
                # number of edges at or below the value
                x = np.searchsorted(edges[i], batch.column(i + 1).to_numpy(zero_copy_only=False), side="right")
                cell, n = np.unique(x * len(names) + code, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c] * len(cell)), pa.array((cell // len(names)).astype(np.int32)), pa.array(names[cell % len(names)].tolist(), pa.string()), pa.array(n.astype(np.int64))],
                    names=["column", "x", "y", "n"],
                )

    values = rows.select(y.alias("_y"), *[F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(cols)])
    joint = values.mapInArrow(counts, "column string, x int, y string, n bigint").groupBy("column", "x", "y").agg(F.sum("n").alias("n"))
    per = lambda *keys: F.sum("n").over(Window.partitionBy("column", *keys))
    p = joint.select("column", "n", per("x").alias("nx"), per("y").alias("ny"), per().alias("nt"))
    term = F.col("n") / F.col("nt") * F.log(F.col("n") * F.col("nt") / (F.col("nx") * F.col("ny")))
    return p.groupBy("column").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))


def select_features(
    df: DataFrame, target: str | None, cols: Sequence[str] | None = None, log: TransformationLog | None = None
) -> tuple[DataFrame, dict]:
    """The three filters in order; returns the reduced frame and a report."""
    log = log or TransformationLog()
    cols = [c for c in (cols or numeric_columns(df)) if c != target]
    flat = low_variance(df, cols)
    cols = [c for c in cols if c not in flat]
    twins = correlated(df, cols) if len(cols) > 1 else []
    cols = [c for c in cols if c not in twins]
    report = {"removed_variance": flat, "removed_correlation": twins, "mi_scores": {}}
    for c in flat:
        log.add("feature_selection", "remove_low_variance", column=c)
    for c in twins:
        log.warn("feature_selection", "remove_high_correlation", column=c)
    useless = []
    if target and cols:
        scores = {r["column"]: r["mi"] for r in mutual_information(df, target, cols).collect()}
        report["mi_scores"] = {c: round(scores[c], 5) for c in sorted(scores, key=lambda k: -scores[k])}
        zero = [c for c in cols if scores.get(c, 0.0) <= 0.0]
        if zero and len(zero) < len(cols) * 0.5:
            useless = zero
            for c in zero:
                log.add("feature_selection", "remove_zero_mi", column=c)
    out = df.drop(*flat, *twins, *useless)
    report["kept"] = [c for c in out.columns if c != target]
    return out, report
