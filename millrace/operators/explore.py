"""Exploration: column statistics, histograms, correlation, seasonality, shares, filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.moments import clean_corr
from millrace.plans.frames import col, is_temporal, numeric_columns, one_row, small_frame, stats_row, to_long
from millrace.plans.quantiles import quantiles
from millrace.operators.profile import value_counts

WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, min, max, mean, sample standard deviation, distinct and missing per numeric column."""
    aggs = [F.count(F.lit(1)).alias("n")]
    records = []
    for i, c in enumerate(cols):
        x = col(c).cast("double")
        aggs += [
            F.count(x).alias(f"c{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
            F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
        ]
        records.append(
            F.struct(
                F.lit(c).alias("column"), F.col(f"c{i}").alias("count"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
                F.round(f"m{i}", 4).alias("avg"), F.round(f"s{i}", 4).alias("std"),
                (F.col("n") - F.col(f"c{i}")).alias("missing"),
                F.round(F.try_divide(100.0 * (F.col("n") - F.col(f"c{i}")), F.col("n")), 2).alias("missing_pct"),
            )
        )
    stats = to_long(df.agg(*aggs), records)
    distinct = value_counts(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    return stats.join(F.broadcast(distinct), "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed, empty bins kept: (bin, low, high, n)."""
    if bins < 1:
        raise ValueError("bins must be at least 1")
    x = col(column).cast("double")
    return _binned(df.select(x.alias("x")), df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")), bins)


def _binned(values: DataFrame, bounds: DataFrame, bins: int) -> DataFrame:
    """Bin ``x`` over the one-row ``bounds`` (lo, hi); a single-valued column gets one unit of width."""
    flat = bounds.select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    edge = one_row(flat)
    width = (edge["hi"] - edge["lo"]) / bins
    place = F.least(F.floor((F.col("x") - edge["lo"]) / width) + 1, F.lit(bins)).cast("int")
    counts = values.where("x IS NOT NULL").groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = flat.where("lo IS NOT NULL").select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / bins
    return grid.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.col("lo") + (F.col("bin") - 1) * step).alias("low"),
        (F.col("lo") + F.col("bin") * step).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def histogram_pair(before: DataFrame, after: DataFrame, cols: Sequence[str], bins: int = 40) -> DataFrame:
    """Before / after distribution of the columns on shared bins."""
    out = None
    for c in cols:
        b = before.select(col(c).cast("double").alias("x"))
        a = after.select(col(c).cast("double").alias("x"))
        bounds = b.unionByName(a).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        left = _binned(b, bounds, bins).select("bin", "low", "high", F.col("n").alias("n_before"))
        right = _binned(a, bounds, bins).select("bin", F.col("n").alias("n_after"))
        part = left.join(F.broadcast(right), "bin").select(F.lit(c).alias("column"), "bin", "low", "high", "n_before", "n_after")
        out = part if out is None else out.unionByName(part)
    return out


def describe_all(df: DataFrame, approx: bool = False) -> DataFrame:
    """Count, mean, std, min, quartiles, max of numeric and unique, top, freq of text columns."""
    numeric = numeric_columns(df)
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    quarts = quantiles(df, numeric, [0.25, 0.5, 0.75], approx=approx)
    schema = (
        "column string, count bigint, mean double, std double, min double, q25 double, q50 double, q75 double, max double, "
        "unique bigint, top string, freq bigint"
    )
    exprs = {}
    for c in numeric:
        x = col(c).cast("double")
        exprs.update({(c, "n"): F.count(x), (c, "m"): F.avg(x), (c, "s"): F.stddev_samp(x), (c, "lo"): F.min(x), (c, "hi"): F.max(x)})
    stats = stats_row(df, exprs)
    rows = [
        (c, stats[(c, "n")], stats[(c, "m")], stats[(c, "s")], stats[(c, "lo")], *quarts[c], stats[(c, "hi")], None, None, None)
        for c in numeric
    ]
    out = small_frame(df.sparkSession, rows, schema)
    if text:
        tops = (
            value_counts(df, text)
            .groupBy("column")
            .agg(
                F.sum("n").alias("count"),
                F.count(F.lit(1)).alias("unique"),
                F.min(F.struct((-F.col("n")).alias("k"), F.col("value"))).alias("t"),
            )
            .select("column", "count", "unique", F.col("t.value").alias("top"), (-F.col("t.k")).alias("freq"))
        )
        empty = F.lit(None).cast("double")
        names = ["mean", "std", "min", "q25", "q50", "q75", "max"]
        out = out.unionByName(tops.select("column", "count", *[empty.alias(n) for n in names], "unique", "top", "freq"))
    return out


def box_stats(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Quartiles, fences and the number of rows outside them."""
    q1, q2, q3 = quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    low, high = fences(q1, q3, factor)
    x = col(column)
    return df.agg(
        F.count(x).alias("n"),
        F.lit(q1).alias("q1"), F.lit(q2).alias("median"), F.lit(q3).alias("q3"),
        F.lit(low).alias("lower_fence"), F.lit(high).alias("upper_fence"),
        F.count_if((x < low) | (x > high)).alias("outliers"),
    )


def fences(q1: float | None, q3: float | None, factor: float) -> tuple[float | None, float | None]:
    if q1 is None:
        return None, None
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)


def daily_counts(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(col(ts).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("day IS NOT NULL")


def seasonality(daily: DataFrame, day: str = "day", value: str = "n", minimum: int = 30) -> DataFrame:
    """Mean daily value by weekday and by month in calendar order; empty under ``minimum`` days."""
    points = daily.agg(F.count(F.lit(1))).scalar()
    d = daily.where(points >= minimum)
    weekday = d.groupBy(((F.dayofweek(col(day)) + 5) % 7 + 1).alias("position")).agg(F.avg(col(value)).alias("mean"))
    month = d.groupBy(F.month(col(day)).alias("position")).agg(F.avg(col(value)).alias("mean"))
    return weekday.select(F.lit("weekday").alias("cycle"), "position", F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.col("position")).alias("label"), "mean").unionByName(
        month.select(F.lit("month").alias("cycle"), "position", F.date_format(F.make_date(F.lit(2000), F.col("position"), F.lit(1)), "MMM").alias("label"), "mean")
    )


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None, complete: bool = True) -> DataFrame:
    """Pearson correlation of every column pair (x before y), long form.

    ``complete`` uses only rows without gaps in any chosen column, otherwise each pair uses the
    rows it is complete on. All pairs come from aggregate scans in chunks; nothing is shuffled
    but the partial sums.
    """
    cols = list(cols or numeric_columns(df))
    data = df.select(*[col(c).cast("double").alias(c) for c in cols])
    pairs = list(combinations(cols, 2))
    if not pairs:
        return small_frame(df.sparkSession, [], "x string, y string, r double")
    if complete:
        data, holed = data.na.drop("any", subset=[f"`{c}`" for c in cols]), set()
    else:
        gaps = stats_row(data, {c: F.count_if(col(c).isNull()) for c in cols})
        holed = {c for c in cols if gaps[c]}
    out = None
    for start in range(0, len(pairs), 50):
        chunk = pairs[start : start + 50]
        whole = sorted({c for p in chunk for c in p if not holed & set(p)})
        # columns without gaps share one deviation each; a pair then costs one covariance
        spread = {c: f"s{i}" for i, c in enumerate(whole)}
        aggs = [F.stddev_pop(col(c)).alias(s) for c, s in spread.items()]
        records = []
        for i, (a, b) in enumerate(chunk):
            if holed & {a, b}:
                aggs.append(clean_corr(col(a), col(b)).alias(f"r{i}"))
                value = F.col(f"r{i}")
            else:
                aggs.append(F.covar_pop(col(a), col(b)).alias(f"r{i}"))
                value = F.try_divide(F.col(f"r{i}"), F.col(spread[a]) * F.col(spread[b]))
                value = F.when(~F.isnan(value), value)
            records.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), value.alias("r")))
        part = to_long(data.agg(*aggs), records)
        out = part if out is None else out.unionByName(part)
    return out


def strong_corrs(corr: DataFrame, threshold: float = 0.5) -> DataFrame:
    return corr.where(F.abs("r") > threshold).orderBy(F.desc(F.abs("r")), "x", "y")


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Degree-1 least squares of ``y`` on ``x``."""
    a, b = col(x).cast("double"), col(y).cast("double")
    return df.agg(
        F.lit(x).alias("x"), F.lit(y).alias("y"),
        F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"),
    )


def top_trends(df: DataFrame, corr: DataFrame, k: int = 3) -> DataFrame:
    """Trend lines of the ``k`` most correlated pairs."""
    best = [(r["x"], r["y"]) for r in corr.where("r IS NOT NULL").orderBy(F.desc(F.abs("r")), "x", "y").limit(k).collect()]
    out = None
    for x, y in best:
        part = trend_line(df, x, y)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else small_frame(df.sparkSession, [], "x string, y string, slope double, intercept double")


def pivot_mean(df: DataFrame, x: str, y: str, value: str, x_values: Sequence | None = None) -> DataFrame:
    """Rows ``y``, one column per ``x`` value, mean of ``value``; pass ``x_values`` to skip a scan."""
    pivoted = df.groupBy(y).pivot(x, list(x_values)) if x_values is not None else df.groupBy(y).pivot(x)
    return pivoted.agg(F.avg(col(value)))


def share(df: DataFrame, label: str, value: str) -> DataFrame:
    """Sum per label and its share of the total."""
    grouped = df.groupBy(label).agg(F.sum(col(value)).alias("total"))
    everything = df.agg(F.sum(col(value))).scalar()
    return grouped.withColumn("share", F.try_divide(F.col("total"), everything))


def scalar(df: DataFrame, expression: str, name: str = "value") -> DataFrame:
    """One number for a card."""
    return df.agg(F.expr(expression).alias(name))


@dataclass(frozen=True)
class Filter:
    """``kind``: range (low, high), equals (value), among (values), at_most (value)."""

    column: str
    kind: str
    value: object = None
    high: object = None

    def predicate(self, df: DataFrame) -> Column:
        c, kind = col(self.column), df.schema[self.column].dataType

        def typed(value: object) -> Column:
            # times go through text: a Python datetime would be read in the driver's zone
            if is_temporal(kind) and isinstance(value, date):
                return F.lit(str(value)).cast(kind)
            return F.lit(value)

        if self.kind == "range":
            return c.between(typed(self.value), typed(self.high))
        if self.kind == "equals":
            return c == typed(self.value)
        if self.kind == "among":
            return c.isin([typed(v) for v in self.value])
        if self.kind == "at_most":
            return c <= typed(self.value)
        raise ValueError(f"unknown filter kind {self.kind!r}")


def apply_filters(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    for f in filters:
        df = df.where(f.predicate(df))
    return df


def filter_options(df: DataFrame, column: str) -> DataFrame:
    return df.select(col(column).alias("option")).where("option IS NOT NULL").distinct()


def missing_map(df: DataFrame) -> DataFrame:
    """(a, b, n): missing cells per column with gaps (a = b) and rows missing both."""
    counts = stats_row(df, {c: F.count_if(col(c).isNull()) for c in df.columns})
    gaps = [c for c in df.columns if counts[c]]
    rows = [(c, c, counts[c]) for c in gaps]
    pairs = list(combinations(gaps, 2))
    both = stats_row(df, {p: F.count_if(col(p[0]).isNull() & col(p[1]).isNull()) for p in pairs})
    rows += [(a, b, both[(a, b)]) for a, b in pairs]
    return small_frame(df.sparkSession, rows, "a string, b string, n bigint")


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows of one frame."""
    missing = sum((col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    # rows are compared as a whole; copies collapse on the map side before the shuffle
    counted = df.select(missing.alias("_missing"), F.struct(*[col(c) for c in df.columns]).alias("_row")).groupBy("_row", "_missing").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.coalesce(F.sum(F.col("n") * F.col("_missing")), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def overview_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Overview of both frames and the deltas, one row per measure."""
    b, a = one_row(overview(before)), one_row(overview(after))
    names = ("rows", "columns", "missing_cells", "duplicate_rows")
    records = [
        F.struct(
            F.lit(n).alias("measure"), b[n].cast("bigint").alias("before"), a[n].cast("bigint").alias("after"),
            (a[n] - b[n]).cast("bigint").alias("delta"),
        )
        for n in names
    ]
    return before.sparkSession.range(1).select(F.inline(F.array(*records)))
