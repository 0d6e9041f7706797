"""Missing values: drop rules, indicators and fills decided from one statistics pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.moments import adjust_skew, clean_corr
from millrace.operators.clean.log import TransformationLog
from millrace.operators.clean.schema import DATETIME, NUMERIC, Schema
from millrace.operators.profile import top_values
from millrace.plans.frames import col, is_numeric, is_temporal, one_row, stats_row
from millrace.plans.prefix import range_boundaries, with_bucket
from millrace.plans.quantiles import quantiles

DROP_RATE = 0.60
SIGNAL_CORR = 0.15
REGRESSION_CORR = 0.50
SKEW_LIMIT = 2.0
MODE_SHARE = 0.50
MIN_GAPS = 5
INDICATOR = "__was_missing"


def missingness_corr(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> dict[str, float]:
    """abs(correlation) of "is missing" with a numeric target, for columns with more than 5 gaps."""
    cols = [c for c in (cols or df.columns)]
    y = col(target).cast("double")
    exprs = {}
    for c in cols:
        gap = col(c).isNull().cast("double")
        exprs[(c, "n")] = F.sum(gap)
        # rows without a target take no part; a column missing its own target has no variance
        exprs[(c, "r")] = clean_corr(gap, y)
    stats = stats_row(df, exprs)
    return {c: abs(stats[(c, "r")]) for c in cols if (stats[(c, "n")] or 0) > MIN_GAPS and stats[(c, "r")] is not None}


@dataclass(frozen=True)
class Fill:
    """Decision for one column with gaps."""

    column: str
    action: str  # drop or fill
    strategy: str = ""
    value: object = None
    feature: str | None = None
    slope: float | None = None
    intercept: float | None = None
    indicator: bool = False


def plan_missing(
    df: DataFrame, schema: Schema, target: str | None, log: TransformationLog | None = None, *, regression: bool = True,
    order_by: str | None = None,
) -> list[Fill]:
    """Decide every column from the raw statistics before anything is filled.

    In a table ordered by time numbers are filled in that order; times always are.
    """
    log = log or TransformationLog()
    n = df.count()
    gaps = stats_row(df, {c: F.count_if(col(c).isNull()) for c in df.columns})
    holed = [c for c in df.columns if gaps[c] and c in schema]
    if not holed:
        return []
    signal = missingness_corr(df, target, holed) if target and is_numeric(df.schema[target].dataType) else {}
    numeric = [c for c in holed if schema[c].inferred_type == NUMERIC]
    features = [c for c in df.columns if c in schema and schema[c].inferred_type == NUMERIC and c != target]
    moments = stats_row(
        df,
        {
            k: v
            for c in numeric
            for k, v in (
                ((c, "n"), F.count(col(c))), ((c, "var"), F.var_samp(col(c).cast("double"))),
                ((c, "mean"), F.avg(col(c).cast("double"))), ((c, "g1"), F.skewness(col(c).cast("double"))),
            )
        },
    )
    corr = stats_row(
        df,
        {
            (c, f): clean_corr(col(c).cast("double"), col(f).cast("double"))
            for c in numeric for f in features if f != c
        },
    ) if regression else {}
    skewed = [c for c in numeric if abs(adjust_skew(moments[(c, "n")], moments[(c, "g1")]) or 0.0) > SKEW_LIMIT]
    medians = {c: v[0] for c, v in quantiles(df, skewed, [0.5]).items()} if skewed else {}
    words = [c for c in holed if schema[c].inferred_type not in (NUMERIC, DATETIME)]
    modes = {r["column"]: (r["value"], r["n"]) for r in top_values(df, 1, words).collect()} if words else {}

    plan = []
    for c in holed:
        rate = gaps[c] / n
        kind = schema[c].inferred_type
        mark = signal.get(c, 0.0) > SIGNAL_CORR
        if rate >= DROP_RATE:
            if kind == NUMERIC and ((moments[(c, "var")] or 0.0) < 1e-6 or schema[c].cardinality <= 2):
                plan.append(Fill(c, "drop", "low variance"))
                log.warn("missing_values", "drop_column", column=c, reason=f"missing={rate:.1%}")
                continue
            if kind != NUMERIC and signal.get(c, 0.0) < SIGNAL_CORR:
                plan.append(Fill(c, "drop", "no target signal"))
                log.warn("missing_values", "drop_column", column=c, reason=f"missing={rate:.1%}")
                continue
        if kind == NUMERIC and order_by is not None and is_temporal(df.schema[order_by].dataType):
            fill = Fill(c, "fill", "ordered", indicator=mark)
        elif kind == NUMERIC:
            fill = _numeric_fill(c, moments, corr, medians, features, mark)
        elif kind == DATETIME:
            fill = Fill(c, "fill", "ordered", indicator=mark)
        else:
            value, count = modes.get(c, (None, 0))
            present = n - gaps[c]
            if not present:
                fill = Fill(c, "fill", "unknown", "Unknown", indicator=mark)
            elif count / present >= MODE_SHARE:
                fill = Fill(c, "fill", "mode", value, indicator=mark)
            else:
                fill = Fill(c, "fill", "missing_category", "Missing", indicator=mark)
        plan.append(fill)
        # A column without any value has nothing to carry forward or back.
        left = "100%" if fill.strategy == "ordered" and gaps[c] == n else "0%"
        log.add("missing_values", f"impute_{fill.strategy}", column=c, before=f"missing={rate:.2%}", after=left)
        if mark:
            log.add("missing_values", "add_missing_indicator", column=c, reason=f"corr={signal[c]:.3f}")
    return plan


def _numeric_fill(c, moments, corr, medians, features, mark) -> Fill:
    if not moments[(c, "n")]:
        return Fill(c, "fill", "zero", 0.0, indicator=mark)
    fallback, name = (medians[c], "median") if c in medians else (moments[(c, "mean")], "mean")
    best = max(
        ((abs(corr[(c, f)]), f) for f in features if (c, f) in corr and corr[(c, f)] is not None), default=(0.0, None)
    )
    if best[0] >= REGRESSION_CORR:
        return Fill(c, "fill", f"regression_{name}", fallback, feature=best[1], indicator=mark)
    return Fill(c, "fill", name, fallback, indicator=mark)


def fit_regressions(df: DataFrame, plan: Sequence[Fill]) -> list[Fill]:
    """Add the least-squares line on the best-correlated feature to regression fills."""
    wanted = [f for f in plan if f.feature]
    stats = stats_row(
        df,
        {
            k: v
            for f in wanted
            for k, v in (
                ((f.column, "b"), F.regr_slope(col(f.column).cast("double"), col(f.feature).cast("double"))),
                ((f.column, "a"), F.regr_intercept(col(f.column).cast("double"), col(f.feature).cast("double"))),
            )
        },
    )
    return [
        Fill(f.column, f.action, f.strategy, f.value, f.feature, stats[(f.column, "b")], stats[(f.column, "a")], f.indicator)
        if f.feature else f
        for f in plan
    ]


def apply_missing(
    df: DataFrame, plan: Sequence[Fill], order_by: str | None = None, by: Sequence[str] = (), tie: Sequence[str] = ()
) -> DataFrame:
    """Projection that drops, marks and fills; a plan with ordered fills is refused without ``order_by``."""
    fills = {f.column: f for f in plan}
    out, marks = [], []
    for c in df.columns:
        f = fills.get(c)
        if f is None:
            out.append(col(c))
            continue
        if f.indicator and f.action == "fill":
            marks.append(col(c).isNull().cast("byte").alias(c + INDICATOR))
        if f.action == "drop":
            continue
        value = col(c)
        dtype = df.schema[c].dataType
        if f.slope is not None:
            # features come from the same input row, so all columns are filled at once
            value = F.coalesce(value, (F.lit(f.intercept) + F.lit(f.slope) * col(f.feature)))
        if f.value is not None:
            if is_numeric(dtype):
                value = F.coalesce(value.cast("double"), F.lit(f.value).try_cast("double"))
            else:
                value = F.coalesce(value.cast("string"), F.lit(str(f.value)))
        out.append(value.alias(c))
    filled = df.select(*out, *marks)
    ordered = [f.column for f in plan if f.strategy == "ordered" and f.action == "fill"]
    if ordered and not order_by:
        raise ValueError(f"{', '.join(ordered)}: an ordered fill needs order_by")
    if ordered:
        filled = fill_ordered(filled, [c for c in ordered if c != order_by], order_by, by, tie)
    return filled


def drop_sparse(df: DataFrame, schema: Schema, target: str | None = None) -> DataFrame:
    dropped = [f.column for f in plan_missing(df, schema, target, regression=False) if f.action == "drop"]
    return df.drop(*dropped)


def add_missing_indicators(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    signal = missingness_corr(df, target, cols)
    marks = [col(c).isNull().cast("byte").alias(c + INDICATOR) for c in signal if signal[c] > SIGNAL_CORR]
    return df.select("*", *marks)


def impute_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Median where abs(skew) > 2, mean otherwise, 0 where nothing is known."""
    exprs = {}
    for c in cols:
        x = col(c).cast("double")
        exprs.update({(c, "n"): F.count(x), (c, "m"): F.avg(x), (c, "g"): F.skewness(x)})
    stats = stats_row(df, exprs)
    skewed = [c for c in cols if abs(adjust_skew(stats[(c, "n")], stats[(c, "g")]) or 0.0) > SKEW_LIMIT]
    medians = quantiles(df, skewed, [0.5]) if skewed else {}
    value = {c: medians[c][0] if c in medians else (stats[(c, "m")] if stats[(c, "n")] else 0.0) for c in cols}
    return df.select(*[F.coalesce(col(c).cast("double"), F.lit(value[c])).alias(c) if c in value else col(c) for c in df.columns])


def impute_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent value when it covers half of the present rows, else "Missing"; "Unknown" when all are gone."""
    present = stats_row(df, {c: F.count(col(c)) for c in cols})
    modes = {r["column"]: (r["value"], r["n"]) for r in top_values(df, 1, cols).collect()}
    value = {}
    for c in cols:
        word, n = modes.get(c, (None, 0))
        value[c] = "Unknown" if not present[c] else word if n / present[c] >= MODE_SHARE else "Missing"
    return df.select(*[F.coalesce(col(c).cast("string"), F.lit(value[c])).alias(c) if c in value else col(c) for c in df.columns])


def impute_regression(df: DataFrame, cols: Sequence[str], features: Sequence[str], minimum: float = REGRESSION_CORR) -> DataFrame:
    """Fill each column from the line on its best-correlated feature, falling back to the mean.

    Correlations, slopes and intercepts of all pairs come from one aggregate pass.
    """
    exprs = {}
    for c in cols:
        y = col(c).cast("double")
        exprs[(c, "mean")] = F.avg(y)
        for f in features:
            if f != c:
                x = col(f).cast("double")
                exprs[(c, f)] = F.struct(clean_corr(y, x).alias("r"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    stats = stats_row(df, exprs)
    out = []
    for c in df.columns:
        if c not in cols:
            out.append(col(c))
            continue
        fits = [(abs(stats[(c, f)]["r"]), f) for f in features if f != c and stats[(c, f)]["r"] is not None]
        best = max(fits, default=(0.0, None))
        value = col(c).cast("double")
        if best[1] and best[0] >= minimum:
            fit = stats[(c, best[1])]
            value = F.coalesce(value, F.lit(fit["a"]) + F.lit(fit["b"]) * col(best[1]).cast("double"))
        out.append(F.coalesce(value, F.lit(stats[(c, "mean")] if stats[(c, "mean")] is not None else 0.0)).alias(c))
    return df.select(*out)


def _replay(batch: pa.RecordBatch, means: Sequence[float], steps: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(values less their means, missing) of a batch of double columns after the fitted rounds."""
    x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(float) if batch.num_rows else np.zeros((0, len(means)))
    gone = np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns], 1) if batch.num_rows else x.astype(bool)
    x = np.where(gone, 0.0, x - np.asarray(means))
    open_rows = gone.any(1)
    part, holes = x[open_rows], gone[open_rows]
    for base, weights in steps:
        part = np.where(holes, base + part @ weights, part)
    x[open_rows] = part
    return x, gone


def impute_iterative(df: DataFrame, cols: Sequence[str], rounds: int = 5, nearest: int = 5) -> DataFrame:
    """Round-robin linear imputation on up to ``nearest`` correlated columns, over all rows.

    Each round is one pass that sums the cross products of all columns, about their means, and a k x k solve on the driver. A row's fills follow
    from its own values and the rounds fitted so far, so nothing is stored between rounds: each pass replays them.
    """
    cols = list(cols)
    width = len(cols)
    means = stats_row(df, {c: F.avg(col(c).cast("double")) for c in cols})
    means = [means[c] if means[c] is not None else 0.0 for c in cols]
    numbers = df.select(*[col(c).cast("double").alias(c) for c in cols])
    steps: list[tuple[np.ndarray, np.ndarray]] = []

    def sums(batches):
        total = np.zeros((width, width + 1, width + 1))
        for batch in batches:
            x, gone = _replay(batch, means, steps)
            x = np.concatenate([np.ones((len(x), 1)), x], 1)
            everywhere = x.T @ x
            for i in range(width):
                # rows where the column itself was observed
                missed = x[gone[:, i]]
                total[i] += everywhere - missed.T @ missed
        yield pa.RecordBatch.from_pydict({"place": np.arange(total.size), "total": total.ravel()})

    for _ in range(rounds):
        found = numbers.mapInArrow(sums, "place bigint, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
        moments = np.zeros(width * (width + 1) ** 2)
        for r in found:
            moments[r["place"]] = r["total"]
        moments = moments.reshape(width, width + 1, width + 1)
        base, weights = np.zeros(width), np.eye(width)
        for i, m in enumerate(moments):
            if m[0, 0] < 1:
                continue
            mean = m[0, 1:] / m[0, 0]
            cov = m[1:, 1:] / m[0, 0] - np.outer(mean, mean)
            var = cov.diagonal()
            ranked = sorted((o for o in range(width) if o != i and var[o] > 0 and var[i] > 0), key=lambda o: -abs(cov[i, o]) / (var[o] * var[i]) ** 0.5)[:nearest]  # noqa: B023
            if not ranked:
                continue
            beta = np.linalg.lstsq(cov[np.ix_(ranked, ranked)], cov[ranked, i], rcond=None)[0]
            weights[:, i] = 0.0
            weights[ranked, i] = beta
            base[i] = mean[i] - beta @ mean[ranked]
        steps = [*steps, (base, weights)]

    place = {c: i for i, c in enumerate(cols)}
    out = df.select(*[col(c).cast("double").alias(c) if c in place else col(c) for c in df.columns])
    where = [df.columns.index(c) for c in cols]

    def fill(batches):
        for batch in batches:
            x, gone = _replay(batch.select(where), means, steps)
            columns = list(batch.columns)
            for i, at in enumerate(where):
                # observed values stay as they are, to the last digit
                guess = pa.array(x[:, i] + means[i])
                columns[at] = pc.if_else(pc.is_null(columns[at]), guess, columns[at])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return out.mapInArrow(fill, out.schema)


def fill_ordered(df: DataFrame, cols: Sequence[str], order_by: str, by: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Forward then backward fill in ``order_by`` order within ``by``.

    Groups are cut into range buckets; each bucket fills itself and takes the last (first)
    known value of the buckets before (after) it from a small per-bucket frame. Rows without
    an order value keep their gaps.
    """
    by, cols = list(by), list(cols)
    if not cols:
        return df
    known = df.where(col(order_by).isNotNull())
    cut = with_bucket(known, order_by, range_boundaries(known, order_by), "_bucket")
    inside = Window.partitionBy(*by, "_bucket").orderBy(order_by, *tie)
    # A frame up to the current row is a running one; one from it to the end would be read again for every row.
    back = Window.partitionBy(*by, "_bucket").orderBy(F.desc(order_by), *[F.desc(c) for c in tie])
    up, down = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (inside, back))
    place = F.struct(col(order_by), *[col(c) for c in tie])
    ends = cut.groupBy(*by, "_bucket").agg(
        *[F.max_by(col(c), F.when(col(c).isNotNull(), place)).alias(f"_last_{i}") for i, c in enumerate(cols)],
        *[F.min_by(col(c), F.when(col(c).isNotNull(), place)).alias(f"_first_{i}") for i, c in enumerate(cols)],
    )
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before, after = (group.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("_bucket", F.desc("_bucket")))
    carry = ends.select(
        *[col(b).alias(f"_by_{b}") for b in by],
        F.col("_bucket").alias("_carry_bucket"),
        *[F.last(f"_last_{i}", ignorenulls=True).over(before).alias(f"_before_{i}") for i in range(len(cols))],
        *[F.last(f"_first_{i}", ignorenulls=True).over(after).alias(f"_after_{i}") for i in range(len(cols))],
    )
    same = F.col("_bucket") == F.col("_carry_bucket")
    for b in by:
        same = same & col(b).eqNullSafe(col(f"_by_{b}"))
    local = cut.select(
        "*",
        *[F.last(col(c), ignorenulls=True).over(up).alias(f"_up_{i}") for i, c in enumerate(cols)],
        *[F.last(col(c), ignorenulls=True).over(down).alias(f"_down_{i}") for i, c in enumerate(cols)],
    )
    filled = local.join(carry, same).select(
        *[
            F.coalesce(*[F.col(f"{p}_{cols.index(c)}") for p in ("_up", "_before", "_down", "_after")]).alias(c)
            if c in cols else col(c)
            for c in df.columns
        ]
    )
    return filled.unionByName(df.where(col(order_by).isNull()))
