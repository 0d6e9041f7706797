"""Type inference for messy tables: one statistics pass per column set, then ordered rules."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.profile import value_counts
from millrace.plans.frames import col, is_numeric, is_temporal, small_frame, stats_row

# Name patterns, word sets and ordinal scales (low to high).
ID_NAME = re.compile(r"^id$|_id$|^id_|\bidentif|\bkey$|\bindex$|\buuid|\bguid", re.IGNORECASE)
DATE_NAME = re.compile(r"date|time|timestamp|created|updated|modified|year|month|day|hour|dt$", re.IGNORECASE)
TARGET_NAME = re.compile(
    r"target|label|y$|outcome|output|result|class$|churn|fraud|default|survived|response", re.IGNORECASE
)
LEAK_NAME = re.compile(r"future|post|after|result|outcome|label|target|score_final|leak", re.IGNORECASE)
BOOLEAN_PAIRS = (("true", "false"), ("yes", "no"), ("y", "n"), ("1", "0"), ("t", "f"), ("on", "off"))
ORDINAL_SCALES = (
    ("low", "medium", "high"),
    ("low", "med", "high"),
    ("small", "medium", "large"),
    ("small", "med", "large"),
    ("very low", "low", "medium", "high", "very high"),
    ("poor", "fair", "good", "very good", "excellent"),
    ("never", "rarely", "sometimes", "often", "always"),
    ("strongly disagree", "disagree", "neutral", "agree", "strongly agree"),
    ("none", "low", "moderate", "high", "critical"),
    ("bronze", "silver", "gold", "platinum"),
    ("beginner", "intermediate", "advanced", "expert"),
    ("junior", "mid", "senior", "lead", "principal"),
    ("cold", "warm", "hot"),
    ("mild", "moderate", "severe"),
)
TRUE_WORDS = tuple(true for true, _ in BOOLEAN_PAIRS)
KNOWN_WORDS = sorted({w for words in (*BOOLEAN_PAIRS, *ORDINAL_SCALES) for w in words})
# Each format with the shape a text must have before it is parsed.
DATETIME_FORMATS = (
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
    ("yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"),
    ("yyyy-MM-dd HH:mm:ss.SSSSSS", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{6}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
    ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("dd-MM-yyyy", r"^\d{2}-\d{2}-\d{4}$"),
    ("dd.MM.yyyy", r"^\d{2}\.\d{2}\.\d{4}$"),
)
NUMBER_SHAPE = r"(?i)^\s*[-+]?((\d+\.?\d*|\.\d+)(e[-+]?\d+)?|inf|infinity)\s*$"
CONVERSION_RATE = 0.80
TEXT_LENGTH = 50
TEXT_RATIO = 0.5
ID_RATIO = 0.95

NUMERIC, BOOLEAN, DATETIME, CATEGORICAL, ORDINAL, TEXT = (
    "numeric", "boolean", "datetime", "categorical", "ordinal", "text",
)


@dataclass(frozen=True)
class ColumnProfile:
    name: str
    inferred_type: str
    original_dtype: str
    cardinality: int
    cardinality_ratio: float
    missing_rate: float
    entropy: float
    is_id_like: bool
    is_leakage_risk: bool
    is_potential_target: bool
    ordinal_map: dict[str, int] | None
    numeric_conversion_rate: float
    avg_str_len: float


Schema = dict[str, ColumnProfile]


def as_number(text: Column) -> Column:
    """Double behind a text such as ``1,234.5``; NULL when it is none.

    A failed cast costs a Java exception inside the task, so the shape is tested first.
    """
    plain = F.translate(text, ",", "")
    return F.when(plain.rlike(NUMBER_SHAPE), plain.try_cast("double"))


def as_timestamp(text: Column) -> Column:
    """First format that fits. A failed parse costs a Java exception, so the shape is tested first."""
    return F.coalesce(*[F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(f))) for f, shape in DATETIME_FORMATS])


def conversion_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of the non-null values of text columns that read as numbers and as times."""
    aggs, records = [], []
    for i, c in enumerate(cols):
        aggs += [
            F.count(col(c)).alias(f"n{i}"),
            F.count(as_number(col(c))).alias(f"x{i}"),
            F.count(as_timestamp(col(c))).alias(f"t{i}"),
        ]
        records.append(
            F.struct(
                F.lit(c).alias("column"),
                F.round(F.try_divide(f"x{i}", f"n{i}"), 4).alias("numeric_rate"),
                F.round(F.try_divide(f"t{i}", f"n{i}"), 4).alias("datetime_rate"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*records)))


def entropy(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, cardinality, entropy): Shannon entropy over value frequencies, scaled to [0, 1].

    H = ln N - sum(n ln n) / N needs only sums over the value counts.
    """
    counts = value_counts(df, cols)
    grouped = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("cardinality"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.log(F.col("n"))).alias("weighted"),
    )
    raw = (F.log("total") - F.col("weighted") / F.col("total")) / F.log(F.col("cardinality"))
    return grouped.select(
        "column", "cardinality", F.when(F.col("cardinality") > 1, F.round(raw, 4)).otherwise(F.lit(0.0)).alias("entropy")
    )


def matches_boolean(words: set[str]) -> bool:
    return any(words <= set(pair) for pair in BOOLEAN_PAIRS)


def matching_scale(words: set[str]) -> dict[str, int] | None:
    for scale in ORDINAL_SCALES:
        if words <= set(scale):
            return {word: i for i, word in enumerate(scale)}
    return None


def infer_schema(df: DataFrame) -> Schema:
    """Ordered rules over three aggregate jobs; only per-column statistics reach the driver."""
    n, fields = df.count(), df.schema.fields
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    numeric = [f.name for f in fields if is_numeric(f.dataType)]
    exprs: dict = {}
    for f in fields:
        c = f.name
        exprs[(c, "n")] = F.count(col(c))
        exprs[(c, "len")] = F.avg(F.length(col(c).cast("string")))
        number = as_number(col(c)) if c in text else col(c).cast("double")
        if c in text:
            exprs[(c, "num")] = F.count(number)
            word = F.lower(F.trim(col(c)))
            exprs[(c, "words")] = F.collect_set(F.when(word.isin(KNOWN_WORDS), word))
            exprs[(c, "others")] = F.count_if(~word.isin(KNOWN_WORDS))
            if DATE_NAME.search(c):
                exprs[(c, "time")] = F.count(as_timestamp(col(c)))
        if c in text or c in numeric:
            exprs[(c, "lo")], exprs[(c, "hi")] = F.min(number), F.max(number)
    stats = stats_row(df, exprs)
    spread = {r["column"]: (r["cardinality"], r["entropy"]) for r in entropy(df, df.columns).collect()}  # row per column
    # The known words of a column, none if it holds any other, in whatever spellings they come.
    words = {c: set(stats[(c, "words")]) for c in text if not stats[(c, "others")]}
    return {f.name: _infer(f, n, stats, spread.get(f.name, (0, 0.0)), words.get(f.name)) for f in fields}


def _infer(field: T.StructField, n: int, stats: dict, spread: tuple[int, float], words: set[str] | None) -> ColumnProfile:
    name, dtype = field.name, field.dataType
    present = stats[(name, "n")]
    cardinality, ent = spread
    ratio = cardinality / max(n, 1)
    length = stats[(name, "len")] or 0.0
    rate, scale = 0.0, None
    if isinstance(dtype, T.BooleanType):
        kind = BOOLEAN
    elif is_temporal(dtype):
        kind = DATETIME
    elif is_numeric(dtype):
        kind = NUMERIC
    else:
        kind = CATEGORICAL
        if (name, "num") in stats:
            rate = stats[(name, "num")] / present if present else 0.0
            if present and rate >= CONVERSION_RATE:
                kind = NUMERIC
    if kind == CATEGORICAL and present and stats.get((name, "time"), 0) / present >= CONVERSION_RATE:
        kind = DATETIME
    if kind == CATEGORICAL and words and matches_boolean(words):
        kind = BOOLEAN
    if kind == CATEGORICAL and words:
        scale = matching_scale(words)
        kind = ORDINAL if scale else kind
    if kind == CATEGORICAL and length > TEXT_LENGTH and ratio > TEXT_RATIO:
        kind = TEXT
    if kind == NUMERIC and present and cardinality <= 2 and {stats[(name, "lo")], stats[(name, "hi")]} <= {0.0, 1.0}:
        kind = BOOLEAN
    target = bool(TARGET_NAME.search(name))
    return ColumnProfile(
        name=name,
        inferred_type=kind,
        original_dtype=dtype.simpleString(),
        cardinality=cardinality,
        cardinality_ratio=ratio,
        missing_rate=(n - present) / n if n else 0.0,
        entropy=0.0 if kind == NUMERIC else ent,
        is_id_like=bool(ID_NAME.search(name)) or (ratio > ID_RATIO and kind in (CATEGORICAL, NUMERIC, TEXT)),
        is_leakage_risk=bool(LEAK_NAME.search(name)) and not target,
        is_potential_target=target,
        ordinal_map=scale,
        numeric_conversion_rate=round(rate, 4),
        avg_str_len=round(length, 2),
    )


def schema_frame(spark: SparkSession, schema: Schema) -> DataFrame:
    rows = [
        (
            i, p.name, p.inferred_type, p.original_dtype, p.cardinality, p.cardinality_ratio, p.missing_rate, p.entropy,
            p.is_id_like, p.is_leakage_risk, p.is_potential_target,
            json.dumps(p.ordinal_map) if p.ordinal_map else None, p.numeric_conversion_rate, p.avg_str_len,
        )
        for i, p in enumerate(schema.values())
    ]
    return small_frame(
        spark,
        rows,
        "ordinal int, column string, inferred_type string, original_dtype string, cardinality bigint, cardinality_ratio double, "
        "missing_rate double, entropy double, is_id_like boolean, is_leakage_risk boolean, is_potential_target boolean, "
        "ordinal_map string, numeric_conversion_rate double, avg_str_len double",
    )


def auto_target(schema: Schema) -> str | None:
    """First column whose name looks like a target."""
    return next((p.name for p in schema.values() if p.is_potential_target), None)


def of_type(schema: Schema, df: DataFrame, *kinds: str) -> list[str]:
    return [c for c in df.columns if c in schema and schema[c].inferred_type in kinds]


def apply_types(df: DataFrame, schema: Schema) -> DataFrame:
    """Cast text columns inferred as numeric or datetime; numbers as double, times as timestamp."""
    out = []
    for c in df.columns:
        kind, dtype = schema[c].inferred_type if c in schema else None, df.schema[c].dataType
        if kind == NUMERIC and isinstance(dtype, T.StringType):
            out.append(as_number(col(c)).alias(c))
        elif kind == DATETIME and isinstance(dtype, T.StringType):
            out.append(as_timestamp(col(c)).alias(c))
        elif isinstance(dtype, (T.DoubleType, T.FloatType)):
            out.append(F.when(~F.isnan(col(c)), col(c)).alias(c))
        else:
            out.append(col(c))
    return df.select(*out)
