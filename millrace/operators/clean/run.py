"""The cleaning steps in order, with everything needed to replay them on new data."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.clean import encode, impute, outliers, scale, schema, select, validate
from millrace.operators.clean.log import TransformationLog, log_df
from millrace.operators.ml.baseline import Baseline, baseline
from millrace.operators.quality.bias import bias_report
from millrace.operators.quality.drift import detect_drift
from millrace.operators.quality.leakage import detect_leakage
from millrace.plans.frames import col, is_numeric, is_temporal, nan_to_null, small_frame


@dataclass
class CleanResult:
    data: DataFrame
    schema: schema.Schema
    target: str | None
    log: TransformationLog
    reports: dict[str, DataFrame] = field(default_factory=dict)
    fills: list = field(default_factory=list)
    caps: list = field(default_factory=list)
    encoding: encode.EncodingPlan = field(default_factory=encode.EncodingPlan)
    scalers: list = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)
    repairs: dict[str, float] = field(default_factory=dict)
    baseline: Baseline | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        """Replay the fitted steps on new data; nothing is fitted again."""
        df = schema.apply_types(nan_to_null(df), self.schema)
        df = impute.apply_missing(df, self.fills, *self.order[:1], tie=self.order[1:])
        df = outliers.apply_outliers(df, self.caps)
        df = self.encoding.apply(df)
        df = scale.scale(df, self.scalers)
        df = validate.narrow_like(df.drop(*self.dropped), self.types)
        return validate.repair_infinite(df, self.repairs)


def clean(
    df: DataFrame,
    target: str | None = None,
    *,
    key: Sequence[str],
    order_by: str | None = None,
    drift: DataFrame | None = None,
    with_baseline: bool = False,
) -> CleanResult:
    """Infer, report bias, fill, cap, check leakage, encode, scale, select, narrow, validate.

    ``key`` identifies rows for out-of-fold encoding. Ordered fills follow ``order_by``, else the first
    key column that is a number or a time, and break ties by the key. Each step is one or two statistics jobs
    and a projection; the typed input is cached once, everything else stays lazy. Call
    ``result.data.write`` to materialise.
    """
    log = TransformationLog()
    found = schema.infer_schema(nan_to_null(df))
    target = target or schema.auto_target(found)
    for p in found.values():
        log.add("schema_inference", f"inferred {p.inferred_type}", column=p.name, reason=f"missing={p.missing_rate:.2%}")
    typed = schema.apply_types(nan_to_null(df), found).persist(StorageLevel.MEMORY_AND_DISK)
    held = [typed]
    try:
        result = CleanResult(typed, found, target, log)
        if target:
            result.reports["bias"] = bias_report(typed, found, target)

        ranked = [c for c in ([order_by] if order_by else key) if is_numeric(typed.schema[c].dataType) or is_temporal(typed.schema[c].dataType)]
        result.order = [*ranked[:1], *[k for k in key if k not in ranked[:1]]] if ranked else []
        result.fills = impute.fit_regressions(typed, impute.plan_missing(typed, found, target, log, order_by=order_by))
        filled = impute.apply_missing(typed, result.fills, *result.order[:1], tie=result.order[1:])
        kept = {c: p for c, p in found.items() if c in filled.columns}

        result.caps = outliers.plan_outliers(filled, kept, target, log)
        result.reports["outliers"] = outliers.outlier_report(filled, result.caps)
        capped = outliers.apply_outliers(filled, result.caps)
        if target:
            result.reports["leakage"] = detect_leakage(capped, kept, target)

        features = {c: p for c, p in kept.items() if c not in key}
        result.encoding = encode.fit_encoding(capped, features, target, log)
        fold = encode.fold_of(F.struct(*[col(k) for k in key]))
        # encoding joins category tables; scaling and selection read the outcome several times
        encoded = encode.encode_training(capped, result.encoding, target, fold).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(encoded)
        binary = {n for c in result.encoding.methods for n in result.encoding.new_columns(c) if result.encoding.methods[c]["method"] in ("onehot", "boolean", "ordinal", "frequency", "target_kfold")}
        skip = {*key, *binary, *([target] if target else [])}
        numeric = [c for c in encoded.columns if c not in skip and encoded.schema[c].dataType.simpleString() in ("double", "float", "int", "bigint", "smallint")]
        result.scalers = scale.choose_scalers(encoded, numeric, log=log)
        scaled = scale.scale(encoded, result.scalers)

        chosen = [c for c, t in scaled.dtypes if t not in ("string", "boolean") and c not in key and c != target and not is_temporal(scaled.schema[c].dataType) and not t.startswith(("array", "map", "struct"))]
        selected, report = select.select_features(scaled, target, chosen, log)
        result.dropped = [c for c in scaled.columns if c not in selected.columns]
        result.reports["mutual_information"] = small_frame(
            df.sparkSession, list(report["mi_scores"].items()), "column string, mi double"
        )
        plan = validate.narrowing_plan(selected)
        result.reports["narrowing"] = plan
        narrowed = validate.narrow_types(selected, plan)
        result.types = {n: t for n, t in narrowed.dtypes if not t.startswith(("array", "map", "struct"))}
        result.repairs = validate.finite_medians(narrowed, validate.infinite_columns(narrowed))
        result.reports["validation"], fixed = validate.validate(narrowed)
        result.data = fixed
        log.add("validation", "validation_complete")
        if with_baseline and target:
            result.baseline = baseline(fixed, target, key, trees=20)
            if result.baseline is not None:
                result.baseline.scores, result.baseline.importances  # fitted while the frames are held
        if drift is not None:
            fresh = schema.apply_types(nan_to_null(drift), found)
            result.reports["drift"] = detect_drift(typed, fresh, found)
        return result
    finally:
        for frame in held:
            frame.unpersist()


def _plans(spark, plans: Sequence) -> DataFrame:
    """Decisions as JSON, one row each."""
    return small_frame(spark, [(json.dumps(asdict(p), default=str),) for p in plans], "plan string")


def save_result(result: CleanResult, path: str) -> None:
    """Data, log, schema, plans and reports as parquet folders; category tables included."""
    spark = result.data.sparkSession
    frames = {
        "data": result.data,
        "log": log_df(spark, result.log),
        "schema": schema.schema_frame(spark, result.schema),
        "encoding": result.encoding.frame(spark),
        "scaling": scale.scaler_frame(spark, result.scalers),
        "fills": _plans(spark, result.fills),
        "caps": _plans(spark, result.caps),
        "finish": small_frame(
            spark, [(c, t, result.repairs.get(c)) for c, t in result.types.items()], "column string, type string, infinite_as double"
        ),
        **{f"report_{n}": r for n, r in result.reports.items()},
        **{f"encoding_table_{c}": t for c, t in result.encoding.tables.items()},
    }
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
