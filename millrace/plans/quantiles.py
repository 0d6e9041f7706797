"""Exact quantiles (linear interpolation) that stay cheap on very large columns.

The built-in ``percentile`` keeps every distinct value of a group in one map. That is fine
up to a checked row count. Above it, an approximate pass first brackets every wanted rank;
a second pass counts the rows below each bracket and looks only at the values inside it, a
few ten-thousandths of the column. The bracket is verified, so the answer is exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.frames import AGG_CHUNK, col
from millrace.plans.prefix import running_totals

DIRECT_ROWS = 50_000
ACCURACY = 10_000


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    *,
    approx: bool = False,
    direct_rows: int = DIRECT_ROWS,
) -> dict[str, list[float | None]]:
    """Quantiles of each column as driver scalars: {column: [value per prob]}."""
    out: dict[str, list[float | None]] = {}
    cols = list(cols)
    for start in range(0, len(cols), AGG_CHUNK // 4):
        out.update(_chunk(df, cols[start : start + AGG_CHUNK // 4], list(probs), approx, direct_rows))
    return out


def _place(prob: float, size: int) -> float:
    """0-based fractional rank, snapped to a whole rank when rounding noise is all that is left."""
    place = prob * (size - 1)
    return float(round(place)) if abs(place - round(place)) < 1e-6 else place


def _chunk(df, cols, probs, approx, direct_rows):
    margin = 2.0 / ACCURACY
    brackets = [b for p in probs for b in (max(0.0, p - margin), min(1.0, p + margin))]
    wanted = brackets + list(probs)
    exprs = []
    for i, c in enumerate(cols):
        x = col(c).cast("double")
        exprs += [F.count(x).alias(f"n{i}"), F.percentile_approx(x, wanted, ACCURACY).alias(f"q{i}")]
    row = df.agg(*exprs).first()
    sizes = {c: row[f"n{i}"] for i, c in enumerate(cols)}
    found = {c: row[f"q{i}"] for i, c in enumerate(cols)}
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols if not sizes[c]}
    if approx:
        out.update({c: list(found[c][len(brackets) :]) for c in cols if sizes[c]})
        return out

    small = [c for c in cols if 0 < sizes[c] <= direct_rows]
    if small:
        exact = df.agg(*[F.percentile(col(c).cast("double"), F.lit(list(probs))).alias(f"p{i}") for i, c in enumerate(small)]).first()
        out.update({c: list(exact[i]) for i, c in enumerate(small)})
    large = [c for c in cols if sizes[c] > direct_rows]
    if large:
        out.update(_refine(df, large, probs, sizes, found))
    return out


def _merge(brackets: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Disjoint intervals covering the brackets, in order."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(brackets):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _refine(df, cols, probs, sizes, found):
    """Second pass: values inside the brackets by value, everything between them as plain counts.

    A column with intervals 0..m-1 gets the codes 0..2m: even codes are the gaps, odd ones the
    intervals. Gap rows lose their value, so the map side folds them into one row each.
    """
    span = 2 * len(probs) + 1
    intervals = {c: _merge([(found[c][2 * j], found[c][2 * j + 1]) for j in range(len(probs))]) for c in cols}
    records = []
    for i, c in enumerate(cols):
        x, base = col(c).cast("double"), i * span
        code = None
        for m, (lo, hi) in enumerate(intervals[c]):
            code = F.when(x < F.lit(lo), base + 2 * m) if code is None else code.when(x < F.lit(lo), base + 2 * m)
            code = code.when(x <= F.lit(hi), base + 2 * m + 1)
        code = F.when(x.isNotNull(), code.otherwise(base + 2 * len(intervals[c])))
        records.append(F.struct(code.alias("code"), x.alias("v")))
    inside = F.col("code") % span % 2 == 1
    tagged = df.select(F.inline(F.array(*records))).where("code IS NOT NULL")
    counted = (
        tagged.select("code", F.when(inside, F.col("v")).alias("v")).groupBy("code", "v").agg(F.count(F.lit(1)).alias("n"))
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        totals = {r["code"]: r["n"] for r in counted.groupBy("code").agg(F.sum("n").alias("n")).collect()}  # row per interval
        ranked = running_totals(counted.where(inside), "v", ["n"], by=["code"])
        first = F.col("cum_n") - F.col("n")  # 0-based rank of the first copy inside the interval
        wanted = []
        for i, c in enumerate(cols):
            for j, p in enumerate(probs):
                place = _place(p, sizes[c])
                for side, rank in (("lo", math.floor(place)), ("hi", math.ceil(place))):
                    below = 0
                    for m in range(len(intervals[c])):
                        below += totals.get(i * span + 2 * m, 0)
                        here = totals.get(i * span + 2 * m + 1, 0)
                        if below <= rank < below + here:
                            wanted.append((i, j, side, i * span + 2 * m + 1, rank - below))
                            break
                        below += here
        hits = [
            F.max(F.when((F.col("code") == code) & (first <= rank) & (rank < F.col("cum_n")), F.col("v"))).alias(f"h{k}")
            for k, (_, _, _, code, rank) in enumerate(wanted)
        ]
        row = ranked.agg(*hits).first() if hits else []
    finally:
        counted.unpersist()
    values = {w[:3]: row[k] for k, w in enumerate(wanted)}
    out = {}
    for i, c in enumerate(cols):
        ends = [(values.get((i, j, "lo")), values.get((i, j, "hi")), _place(p, sizes[c])) for j, p in enumerate(probs)]
        if any(lo is None or hi is None for lo, hi, _ in ends):  # a bracket missed its rank
            out[c] = _full(df, c, probs, sizes[c])
        else:
            out[c] = [lo + (hi - lo) * (place - math.floor(place)) for lo, hi, place in ends]
    return out


def _full(df, c, probs, size):
    frame = df.select(col(c).cast("double").alias("v"), F.lit(1).cast("bigint").alias("n"))
    ranked = running_totals(frame, "v", ["n"])
    first = F.col("cum_n") - F.col("n")
    out = []
    for p in probs:
        place = _place(p, size)
        lo, hi = math.floor(place), math.ceil(place)
        row = ranked.agg(
            F.max(F.when((first <= lo) & (lo < F.col("cum_n")), F.col("v"))),
            F.max(F.when((first <= hi) & (hi < F.col("cum_n")), F.col("v"))),
        ).first()
        out.append(row[0] + (row[1] - row[0]) * (place - lo))
    return out


def group_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles per group, one column per entry of ``probs``.

    Each group is ranked through range buckets, so a group holding a third of all rows is
    spread over many tasks.
    """
    by = list(by)
    frame = df.select(
        *[col(b) for b in by], col(value).cast("double").alias("v"), F.lit(1).cast("bigint").alias("n")
    )
    ranked = running_totals(frame, "v", ["n"], by=by)
    first = F.col("cum_n") - F.col("n")
    aggs = []
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("all_n") - 1)
        for tag, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            aggs.append(F.max(F.when((first <= rank) & (rank < F.col("cum_n")), F.col("v"))).alias(f"{name}_{tag}"))
        aggs.append(F.max(place - F.floor(place)).alias(f"{name}_f"))
    picked = ranked.groupBy(*by).agg(*aggs)
    return picked.select(
        *by,
        *[
            (col(f"{n}_lo") + (col(f"{n}_hi") - col(f"{n}_lo")) * col(f"{n}_f")).alias(n)
            for n in probs
        ],
    )
