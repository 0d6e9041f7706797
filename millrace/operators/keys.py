"""Keys and dependencies discovered from the data."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.frames import col, small_frame, stats_row, string_columns

# Relative standard error of the sketches; groups further off than six errors are ruled out
# (a dependency compares two sketches, hence the wider bar). Small sketches keep the
# aggregate buffer of many groups short.
SKETCH_ERROR = 0.05
KEY_SLACK = 0.30
PAIR_SLACK = 0.45


def distinct_counts(df: DataFrame, groups: Sequence[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """Exact distinct counts (NULL is a value) of several column groups in one shuffle.

    Grouping sets keep the columns typed and drop repeated keys on the map side.
    """
    if not groups:
        return {}
    cols = sorted({c for g in groups for c in g})
    place = {c: len(cols) - 1 - i for i, c in enumerate(cols)}
    # grouping_id sets the bit of every column that a set leaves out
    mask = {sum(1 << place[c] for c in cols if c not in g): g for g in groups}
    sets = [[col(c) for c in g] for g in groups]
    rows = (
        df.select(*[col(c) for c in cols])
        .groupingSets(sets, *[col(c) for c in cols])
        .agg(F.grouping_id().alias("_set"))
        .groupBy("_set")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()  # one row per column group
    )
    found = {mask[r["_set"]]: r["n"] for r in rows}
    return {g: found.get(g, 0) for g in groups}


def _sketches(df: DataFrame, groups: Sequence[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    return stats_row(df, {g: F.approx_count_distinct(F.struct(*[col(c) for c in g]), SKETCH_ERROR) for g in groups})


def candidate_keys(df: DataFrame, max_width: int = 2, cols: Sequence[str] | None = None) -> DataFrame:
    """Minimal column sets without duplicate values.

    Sketches rule out most sets in one scan; only the survivors are counted exactly.
    """
    cols = list(cols or df.columns)
    rows = df.count()
    keys: list[tuple[str, ...]] = []
    for width in range(1, max_width + 1):
        groups = [g for g in combinations(cols, width) if not any(set(k) <= set(g) for k in keys)]
        if not groups:
            break
        rough = _sketches(df, groups)
        likely = [g for g in groups if rough[g] >= (1 - KEY_SLACK) * rows]
        exact = distinct_counts(df, likely)
        keys += [g for g in likely if exact[g] == rows]
    return small_frame(
        df.sparkSession, [(", ".join(k), len(k), rows) for k in keys], "key string, width int, row_count bigint"
    )


def functional_deps(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Single-column dependencies ``determinant -> dependent`` that hold on every row.

    Determinants that are keys of the table are left out (they determine everything).
    """
    cols = list(cols or df.columns)
    rows = df.count()
    singles = [(c,) for c in cols]
    pairs = list(permutations(cols, 2))
    ordered = sorted({tuple(sorted(p)) for p in pairs})
    rough = _sketches(df, singles + ordered)
    likely = [
        (a, b) for a, b in pairs
        if rough[tuple(sorted((a, b)))] <= (1 + PAIR_SLACK) * rough[(a,)]
    ]
    wanted = sorted({(a,) for a, _ in likely} | {tuple(sorted(p)) for p in likely})
    exact = distinct_counts(df, wanted)
    found = [
        (a, b, exact[(a,)])
        for a, b in likely
        if exact[(a,)] < rows and exact[(a,)] == exact[tuple(sorted((a, b)))]
    ]
    return small_frame(df.sparkSession, found, "determinant string, dependent string, determinant_values bigint")


def inclusion_deps(tables: dict[str, DataFrame], pairs: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Share of the distinct child values found in the parent column, per column pair."""
    out = None
    for child, child_col, parent, parent_col in pairs:
        left = tables[child].select(col(child_col).alias("v")).where("v IS NOT NULL").distinct()
        right = tables[parent].select(col(parent_col).alias("v")).distinct().withColumn("hit", F.lit(1))
        part = (
            left.join(right, "v", "left")
            .agg(F.count(F.lit(1)).alias("child_values"), F.count("hit").alias("contained"))
            .select(
                F.lit(f"{child}.{child_col}").alias("child"),
                F.lit(f"{parent}.{parent_col}").alias("parent"),
                "child_values",
                "contained",
                F.round(F.try_divide("contained", "child_values"), 6).alias("containment"),
            )
        )
        out = part if out is None else out.unionByName(part)
    return out


def multivalued_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of the values of each text column that hold JSON or a delimited list."""
    cols = list(cols or string_columns(df))
    records = []
    for c in cols:
        records.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n_{c}").alias("values"),
                F.round(F.try_divide(f"j_{c}", f"n_{c}"), 4).alias("json_share"),
                F.round(F.try_divide(f"d_{c}", f"n_{c}"), 4).alias("list_share"),
            )
        )
    aggs = []
    for c in cols:
        text = F.trim(col(c))
        bracketed = text.rlike(r"(?s)^(\{.*\}|\[.*\])$")
        is_json = bracketed & F.try_parse_json(F.when(bracketed, text)).isNotNull()
        aggs += [
            F.count(col(c)).alias(f"n_{c}"),
            F.count_if(is_json).alias(f"j_{c}"),
            # no repeated group: Java's matcher calls itself for each repetition, and a long text overflows the stack
            F.count_if(~is_json & text.rlike("[,;|]") & ~text.rlike(r"\A[,;|]|[,;|]{2}|[,;|]\z")).alias(f"d_{c}"),
        ]
    return df.agg(*aggs).select(F.inline(F.array(*records)))
