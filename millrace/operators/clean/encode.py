"""Categorical encoding as a plan that replays on new data.

Word maps and one-hot columns are plain expressions. Frequency and target encoding keep
their category table as a DataFrame, because the number of categories is not bounded; it is
joined without a broadcast hint, so Spark picks the strategy from the measured size.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.clean.log import TransformationLog
from millrace.operators.clean.schema import BOOLEAN, CATEGORICAL, ORDINAL, TEXT, TRUE_WORDS, Schema
from millrace.plans.frames import col, is_numeric, small_frame

LOW_CARDINALITY = 6
MAX_INDICATORS = 1_000
HIGH_CARDINALITY = 20
FOLDS = 5
MISSING = "Missing"


def _word(c: str) -> Column:
    return F.lower(F.trim(col(c).cast("string")))


def _category(c: str) -> Column:
    return F.coalesce(F.trim(col(c).cast("string")), F.lit(MISSING))


def boolean_code(c: str) -> Column:
    """1 for the true words, 0 for everything else, gaps and unknown words included."""
    numeric_true = _word(c).isin("1.0")
    return F.when(_word(c).isin(*TRUE_WORDS) | numeric_true, 1).otherwise(0).cast("byte")


def ordinal_code(c: str, scale: dict[str, int]) -> Column:
    """Place on the scale, -1 for words outside it."""
    table = F.create_map(*[F.lit(x) for pair in scale.items() for x in pair])
    return F.coalesce(F.try_element_at(table, _word(c)), F.lit(-1)).cast("byte")


def encode_boolean(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, boolean_code(c))


def encode_ordinal(df: DataFrame, c: str, scale: dict[str, int]) -> DataFrame:
    return df.withColumn(c, ordinal_code(c, scale))


def onehot_columns(c: str, categories: Sequence[str]) -> dict[str, Column]:
    """Indicator columns of all but the first category in sort order."""
    kept = sorted(categories)[1:] if len(categories) > 1 else sorted(categories)
    return {f"{c}_{v}": F.when(_category(c) == F.lit(v), 1).otherwise(0).cast("byte") for v in kept}


def encode_onehot(df: DataFrame, c: str, categories: Sequence[str] | None = None, most: int = MAX_INDICATORS) -> DataFrame:
    """One indicator per category but the first; every category of the column unless they are given.

    More than ``most`` categories are refused: a wide column is for frequency or target encoding.
    """
    if categories is None:
        categories = [r[0] for r in df.select(_category(c)).distinct().limit(most + 1).collect()]
        if len(categories) > most:
            raise ValueError(f"{c} has more than {most} categories; use frequency or target encoding")
    new = onehot_columns(c, categories)
    return df.select(*[col(o) for o in df.columns if o != c], *[e.alias(n) for n, e in new.items()])


def frequency_table(df: DataFrame, c: str) -> DataFrame:
    """(category, code): relative frequency of each category."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(_category(c).alias("category")).agg(F.count(F.lit(1)).alias("n")).select(
        "category", (F.col("n") / total).alias("code")
    )


def _lookup(df: DataFrame, c: str, table: DataFrame, default: Column) -> DataFrame:
    key = df.withColumn("_category", _category(c))
    joined = key.join(table.select(F.col("category").alias("_key"), F.col("code").alias("_code")), F.col("_category") == F.col("_key"), "left")
    return joined.select(*[F.coalesce("_code", default).alias(c) if o == c else col(o) for o in df.columns])


def encode_frequency(df: DataFrame, c: str, table: DataFrame | None = None) -> DataFrame:
    return _lookup(df, c, table if table is not None else frequency_table(df, c), F.lit(0.0))


def fold_of(key: Column, folds: int = FOLDS) -> Column:
    """Deterministic fold of a row key."""
    return F.pmod(F.xxhash64(key), F.lit(folds))


def encode_target_kfold(df: DataFrame, c: str, target: str, fold: Column) -> DataFrame:
    """Out-of-fold target mean per category; the global mean for categories seen in one fold only.

    Category totals minus the row's own fold: one aggregate at (category, fold) grain feeds
    both sides, so a hot category shuffles one partial row per task and fold.
    """
    y = col(target).cast("double")
    mean = df.agg(F.avg(y)).scalar()
    cells = df.groupBy(_category(c).alias("_c"), fold.alias("_f")).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    totals = cells.groupBy("_c").agg(F.sum("s").alias("cs"), F.sum("n").alias("cn"))
    table = (
        cells.join(totals, "_c")
        .select(
            F.col("_c").alias("_tc"), F.col("_f").alias("_tf"),
            F.try_divide(F.col("cs") - F.coalesce("s", F.lit(0.0)), F.col("cn") - F.col("n")).alias("_code"),
        )
    )
    keyed = df.withColumn("_category", _category(c)).withColumn("_fold", fold)
    joined = keyed.join(table, (F.col("_category") == F.col("_tc")) & (F.col("_fold") == F.col("_tf")), "left")
    return joined.select(*[F.coalesce("_code", mean).alias(c) if o == c else col(o) for o in df.columns])


def target_table(df: DataFrame, c: str, target: str) -> DataFrame:
    """(category, code): full target mean per category, for new data."""
    return df.groupBy(_category(c).alias("category")).agg(F.avg(col(target).cast("double")).alias("code"))


@dataclass
class EncodingPlan:
    """Methods per column; unbounded category tables live in ``tables``."""

    methods: dict[str, dict] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        """Encode new data with the stored categories and full category means."""
        for c, m in self.methods.items():
            if c not in df.columns:
                continue
            method = m["method"]
            if method == "boolean":
                df = encode_boolean(df, c)
            elif method == "ordinal":
                df = encode_ordinal(df, c, m["scale"])
            elif method == "onehot":
                df = encode_onehot(df, c, m["categories"])
            else:
                df = _lookup(df, c, self.tables[c], F.lit(m["default"]))
        return df

    def new_columns(self, c: str) -> list[str]:
        m = self.methods.get(c, {})
        return list(onehot_columns(c, m["categories"])) if m.get("method") == "onehot" else [c]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c, m["method"], json.dumps({k: v for k, v in m.items() if k != "method"})) for c, m in self.methods.items()]
        return small_frame(spark, rows, "column string, method string, details string")


def fit_encoding(df: DataFrame, schema: Schema, target: str | None, log: TransformationLog | None = None) -> EncodingPlan:
    """Choose a method per column from its inferred type and cardinality."""
    log = log or TransformationLog()
    plan = EncodingPlan()
    numeric_target = bool(target) and target in df.columns and is_numeric(df.schema[target].dataType)
    mean = df.agg(F.avg(col(target).cast("double"))).first()[0] if numeric_target else None
    for c in df.columns:
        if c not in schema or c == target:
            continue
        p = schema[c]
        if p.inferred_type == BOOLEAN:
            plan.methods[c] = {"method": "boolean"}
        elif p.inferred_type == ORDINAL and p.ordinal_map:
            plan.methods[c] = {"method": "ordinal", "scale": p.ordinal_map}
        elif p.inferred_type in (CATEGORICAL, ORDINAL, TEXT):
            if p.cardinality <= LOW_CARDINALITY:
                # the fill step can add one category ("Missing")
                found = [r[0] for r in df.select(_category(c)).distinct().limit(LOW_CARDINALITY + 2).collect()]
                plan.methods[c] = {"method": "onehot", "categories": sorted(found)}
            elif p.cardinality >= HIGH_CARDINALITY and numeric_target:
                plan.methods[c] = {"method": "target_kfold", "default": mean}
                plan.tables[c] = target_table(df, c, target)
            else:
                plan.methods[c] = {"method": "frequency", "default": 0.0}
                plan.tables[c] = frequency_table(df, c)
        else:
            continue
        log.add("encoding", plan.methods[c]["method"], column=c, reason=f"cardinality={p.cardinality}")
    return plan


def encode_training(df: DataFrame, plan: EncodingPlan, target: str | None, fold: Column) -> DataFrame:
    """Encode the data the plan was fitted on; target encoding is out of fold."""
    kfold = [c for c, m in plan.methods.items() if m["method"] == "target_kfold"]
    if kfold:
        df = df.withColumn("_fold_id", fold)
        for c in kfold:
            df = encode_target_kfold(df, c, target, F.col("_fold_id"))
        df = df.drop("_fold_id")
    rest = EncodingPlan({c: m for c, m in plan.methods.items() if c not in kfold}, plan.tables)
    return rest.apply(df)
