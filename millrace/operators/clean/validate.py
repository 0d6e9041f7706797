"""Final checks on a cleaned frame and type narrowing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.profile import value_counts
from millrace.plans.frames import col, long_values, small_frame, stats_row
from millrace.plans.quantiles import quantiles

CHECK_SCHEMA = "check string, passed boolean, passed_after boolean, measure bigint, columns array<string>"


def _float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def _infinite(c: str):
    x = col(c).cast("double")
    return (x == F.lit(float("inf"))) | (x == F.lit(float("-inf")))


def duplicate_count(df: DataFrame) -> int:
    """Rows beyond the first of each set of equal rows."""
    row = F.struct(*[col(c) for c in df.columns])
    counted = df.groupBy(row.alias("_row")).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]


def finite_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Median of the finite values of each column."""
    finite = df.select(*[F.when(~_infinite(c), col(c)).alias(c) for c in cols])
    return {c: v[0] for c, v in quantiles(finite, list(cols), [0.5]).items()} if cols else {}


def repair_infinite(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Infinite values become the given medians."""
    return df.select(
        *[
            F.when(_infinite(c), F.lit(medians[c])).otherwise(col(c)).cast(df.schema[c].dataType).alias(c) if c in medians else col(c)
            for c in df.columns
        ]
    )


def infinite_columns(df: DataFrame) -> list[str]:
    floats = _float_columns(df)
    found = stats_row(df, {c: F.count_if(_infinite(c)) for c in floats})
    return [c for c in floats if found[c]]


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checks, repaired frame). Infinite values are repaired; the rest is only reported.

    ``passed`` judges the frame as given, ``passed_after`` the repaired one.
    """
    floats = _float_columns(df)
    exprs = {("n",): F.count(F.lit(1))}
    for c in df.columns:
        exprs[("null", c)] = F.count_if(col(c).isNull())
        kind = df.schema[c].dataType
        if not isinstance(kind, (T.MapType, T.VariantType)):
            # min = max and no gap mixed with values: one distinct value, NULL counted as one
            exprs[("flat", c)] = (F.min(col(c)).eqNullSafe(F.max(col(c)))) & (
                (F.count(col(c)) == 0) | (F.count(col(c)) == F.count(F.lit(1)))
            )
    for c in floats:
        exprs[("inf", c)] = F.count_if(_infinite(c))
    s = stats_row(df, exprs)
    rows = s[("n",)]
    missing = [c for c in df.columns if s[("null", c)]]
    infinite = [c for c in floats if s[("inf", c)]]
    constant = [c for c in df.columns if s.get(("flat", c))]
    copies = duplicate_count(df)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    fixed = repair_infinite(df, finite_medians(df, infinite)) if infinite else df
    checks = [
        ("no_missing_values", not missing, not missing, sum(s[("null", c)] for c in missing), missing),
        ("no_infinite_values", not infinite, True, sum(s[("inf", c)] for c in infinite), infinite),
        ("no_constant_columns", not constant, not constant, len(constant), constant),
        ("no_duplicate_rows", copies == 0, copies == 0, copies, []),
        ("text_columns", True, True, len(text), text),
        ("rows", True, True, rows, []),
        ("columns", True, True, len(df.columns), []),
    ]
    checks.append(("overall", all(c[1] for c in checks), all(c[2] for c in checks), sum(not c[1] for c in checks), []))
    return small_frame(df.sparkSession, checks, CHECK_SCHEMA), fixed


INTEGER_SIZES = (("tinyint", -(2**7), 2**7 - 1), ("smallint", -(2**15), 2**15 - 1), ("int", -(2**31), 2**31 - 1))
DICTIONARY_RATIO = 0.50
BYTES = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1}


def narrowing_plan(df: DataFrame) -> DataFrame:
    """(column, type, narrowed, bytes_before, bytes_after): smallest type that holds every value.

    Text columns with few distinct values are marked for dictionary encoding, which parquet
    applies by itself; their narrowed size counts one 4-byte code per row plus the dictionary.
    """
    fields = df.schema.fields
    ints = [f.name for f in fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    exprs = {("n",): F.count(F.lit(1))}
    for c in ints:
        exprs[("lo", c)], exprs[("hi", c)] = F.min(col(c)), F.max(col(c))
    for c in text:
        exprs[("bytes", c)] = F.coalesce(F.sum(F.octet_length(col(c))), F.lit(0))
    s = stats_row(df, exprs)
    words = {}
    if text:
        found = value_counts(df, text).groupBy("column").agg(
            F.count(F.lit(1)).alias("k"), F.sum(F.octet_length("value")).alias("b")
        ).collect()  # one row per text column
        words = {r["column"]: (r["k"], r["b"]) for r in found}
    n, rows = s[("n",)], []
    for f in fields:
        c, kind = f.name, f.dataType.simpleString()
        if c in text:
            k, b = words.get(c, (0, 0))
            before = s[("bytes", c)] + 4 * n
            small = k / max(n, 1) < DICTIONARY_RATIO
            rows.append((c, kind, "dictionary" if small else kind, before, (4 * n + b) if small else before))
            continue
        target = kind
        if c in ints and s[("lo", c)] is not None:
            target = next((t for t, lo, hi in INTEGER_SIZES if lo <= s[("lo", c)] and s[("hi", c)] <= hi), "bigint")
        elif kind == "double":
            target = "float"
        rows.append((c, kind, target, n * BYTES.get(kind, 8), n * BYTES.get(target, 8)))
    return small_frame(
        df.sparkSession, rows, "column string, type string, narrowed string, bytes_before bigint, bytes_after bigint"
    )


def narrow_like(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast to the types fitted before; a whole-number column of new data that does not fit takes the smallest that does."""
    sizes = {name: (lo, hi) for name, lo, hi in INTEGER_SIZES}
    ints = [c for c in df.columns if types.get(c) in sizes]
    s = stats_row(df, {(k, c): f(col(c)) for c in ints for k, f in (("lo", F.min), ("hi", F.max))})
    out = []
    for c in df.columns:
        target = types.get(c, "dictionary")
        if c in ints and s[("lo", c)] is not None:
            fits = lambda lo, hi: lo <= s[("lo", c)] and s[("hi", c)] <= hi  # noqa: E731, B023
            if not fits(*sizes[target]):
                target = next((t for t, lo, hi in INTEGER_SIZES if fits(lo, hi)), "bigint")
        out.append(col(c) if target in ("dictionary", "string") else col(c).cast(target).alias(c))
    return df.select(*out)


def narrow_types(df: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    plan = plan if plan is not None else narrowing_plan(df)
    target = {r["column"]: r["narrowed"] for r in plan.collect()}  # one row per column
    return df.select(
        *[
            col(c).cast(target[c]).alias(c) if target.get(c, "dictionary") not in ("dictionary", df.schema[c].dataType.simpleString()) else col(c)
            for c in df.columns
        ]
    )


def narrowing_report(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.sum("bytes_before").alias("bytes_before"),
        F.sum("bytes_after").alias("bytes_after"),
        F.round(100.0 * (1 - F.try_divide(F.sum("bytes_after"), F.sum("bytes_before"))), 2).alias("reduction_pct"),
    )
