"""Keys, dependencies and inclusions over all columns, of any width.

Column sets form a lattice that is searched level by level. A bounded sample of rows is held against each candidate first, of which
ALIKE rows a column share values of that column, so that they agree on more than one: two
rows of it can only refute, never accept, so the result does not depend on which rows were drawn. What the sample leaves open is
counted over all rows: each row gives a 128-bit fingerprint for each open set, and distinct fingerprints are added up,
CHUNK sets a job. Supersets of keys, of determinants and of redundant sets are never looked at.

NULL is a value. An empty table has no keys and no dependencies.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.frames import col, data_type, is_orderable, small_frame

SAMPLE = 1_000
#: Rows drawn for each column among those with its smallest hashes: in a large table rows drawn at large hardly ever agree.
ALIKE = 4_000
CHUNK = 64
#: Texts longer than this meet by their digest.
LONG_TEXT = 64


def _print(i: int, c: str) -> Column:
    # a missing value leaves a hash as it was, so say that it is missing
    return F.xxhash64(F.lit(i), col(c).isNull(), col(c))


def set_counts(df: DataFrame, sets: Sequence[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """Distinct value combinations of each column set, any number of columns and sets."""
    found = {}
    for start in range(0, len(sets), CHUNK):
        part = sets[start : start + CHUNK]
        used = sorted({c for s in part for c in s})
        name = {c: i for i, c in enumerate(used)}
        coded = df.select(*[_print(k, c).alias(f"{h}{name[c]}") for c in used for k, h in enumerate("ab")])
        prints = [F.struct(F.lit(i).alias("set"), *[F.xxhash64(*[F.col(f"{h}{name[c]}") for c in s]).alias(h) for h in "ab"]) for i, s in enumerate(part)]
        rows = coded.select(F.inline(F.array(*prints))).distinct().groupBy("set").count().collect()  # one row a set
        held = {r["set"]: r["count"] for r in rows}
        found.update({s: held.get(i, 0) for i, s in enumerate(part)})
    return found


class _Sample:
    """Value codes of a few rows, to refute keys and dependencies."""

    def __init__(self, df: DataFrame, cols: Sequence[str], n: int) -> None:
        coded = df.select(*[_print(0, c).alias(f"c{i}") for i, c in enumerate(cols)])
        alike = [coded.orderBy(f"c{i}").limit(ALIKE) for i in range(len(cols))] if n else []
        rows = reduce(DataFrame.union, alike, coded.limit(n)).collect()  # at most SAMPLE rows and ALIKE a column
        self.place = {c: i for i, c in enumerate(cols)}
        codes = np.array([list(r) for r in rows], dtype=np.int64).reshape(len(rows), len(cols))
        # one row may be drawn for several columns; only rows that differ somewhere are surely two
        codes = np.unique(codes, axis=0) if codes.size else codes
        self.codes = np.column_stack([np.unique(codes[:, i], return_inverse=True)[1] for i in range(len(cols))]) if len(cols) else codes

    def open(self, group: tuple[str, ...], others: Sequence[str]) -> tuple[bool, list[str]]:
        """(may be a key, columns that ``group`` may determine)."""
        if len(self.codes) < 2:
            return True, list(others)
        own = self.codes[:, [self.place[c] for c in group]]
        order = np.lexsort(own.T) if group else np.arange(len(own))
        same = (own[order][1:] == own[order][:-1]).all(axis=1)
        if not same.any():
            return True, list(others)
        rest = self.codes[np.ix_(order, [self.place[c] for c in others])]
        broken = (rest[1:][same] != rest[:-1][same]).any(axis=0)
        return False, [c for c, b in zip(others, broken) if not b]


@dataclass(frozen=True)
class Lattice:
    """Minimal keys and minimal dependencies (determinant, dependent, values of the determinant)."""

    rows: int
    keys: list[tuple[str, ...]]
    deps: list[tuple[tuple[str, ...], str, int]]


def search(df: DataFrame, max_width: int = 3, cols: Sequence[str] | None = None, sample: int = SAMPLE) -> Lattice:
    """All minimal keys and dependencies up to ``max_width`` columns.

    Determinants that hold a key are left out (they determine everything); a column with one value
    depends on no column at all.
    """
    cols = [c for c in (cols if cols is not None else df.columns) if is_orderable(data_type(df, c))]
    rows = df.count()
    if not rows or not cols:
        return Lattice(rows, [], [])
    drawn = _Sample(df, cols, sample)
    singles = set_counts(df, [(c,) for c in cols])
    keys: list[tuple[str, ...]] = []
    deps = [((), c, 1) for c in cols if singles[(c,)] == 1]
    steady = {c for _, c, _ in deps}
    by: dict[str, list[frozenset[str]]] = {c: [] for c in cols}
    free = [c for c in cols if c not in steady]
    if rows == 1:
        return Lattice(rows, [], deps)
    for width in range(1, max_width + 1):
        asked: dict[tuple[str, ...], list[str]] = {}
        for group in combinations(free, width):
            held = set(group)
            if any(held.issuperset(k) for k in keys) or any(d < held for c in group for d in by[c]):
                continue
            open_ = [c for c in free if c not in held and not any(d <= held for d in by[c])]
            may, left = drawn.open(group, open_)
            if may or left:
                asked[group] = left
        order = {c: i for i, c in enumerate(cols)}
        join = lambda g, c: tuple(sorted((*g, c), key=order.get))
        counts = dict(singles)
        counts.update(set_counts(df, [g for g in asked if g not in counts]))
        fresh = [g for g in asked if counts[g] == rows]
        keys += fresh
        wide = sorted({join(g, c) for g, left in asked.items() if counts[g] < rows for c in left})
        counts.update(set_counts(df, wide))
        for group, left in asked.items():
            if counts[group] == rows:
                continue
            for c in left:
                if counts[join(group, c)] == counts[group]:
                    deps.append((group, c, counts[group]))
                    by[c].append(frozenset(group))
    return Lattice(rows, keys, deps)


def minimal_keys(df: DataFrame, max_width: int = 3, cols: Sequence[str] | None = None) -> DataFrame:
    """(key, width, row_count) of the minimal column sets without repeated values."""
    found = search(df, max_width, cols)
    return small_frame(df.sparkSession, [(", ".join(k), len(k), found.rows) for k in found.keys], "key string, width int, row_count bigint")


def dependencies(df: DataFrame, max_width: int = 3, cols: Sequence[str] | None = None) -> DataFrame:
    """(determinant, dependent, width, determinant_values) of the minimal dependencies that hold on every row."""
    found = search(df, max_width, cols)
    rows = [(", ".join(g), c, len(g), n) for g, c, n in found.deps]
    return small_frame(df.sparkSession, rows, "determinant string, dependent string, width int, determinant_values bigint")


def _family(dtype: T.DataType) -> str | None:
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return "float"
    if isinstance(dtype, T.StringType):
        return "text"
    if isinstance(dtype, (T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)):
        return dtype.simpleString()
    return None


def _value(df: DataFrame, c: str) -> Column:
    kind = data_type(df, c)
    v = col(c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        v = v.cast("double")
        return F.when(v == 0, "0.0").otherwise(v.cast("string"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(v).cast("string")
    text = F.hex(v) if isinstance(kind, T.BinaryType) else v.cast("string")
    return F.when(F.octet_length(text) > LONG_TEXT, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text) if _family(kind) in ("text", "binary") else text


def inclusions(tables: dict[str, DataFrame], least: float = 1.0) -> DataFrame:
    """Column pairs whose child values lie in the parent to a share of ``least`` or more: all pairs of all tables in one job.

    Every value is sent once a column and task, meets its other columns and leaves as the set of them; sets are few,
    so pairs are counted from sets. Only columns of one family are compared: integers of any width, floats, texts, and equal other
    types; arrays, maps, structs and booleans are left out. NULL is no value; a column without values is in no pair.
    ``least`` must be above 0, as pairs that share no value never meet.
    """
    if not 0 < least <= 1:
        raise ValueError("least must lie in (0, 1]")
    names, values = [], None
    for table, df in tables.items():
        records = []
        for f in df.schema.fields:
            family = _family(f.dataType)
            if family is not None:
                records.append(F.struct(F.lit(len(names)).alias("place"), F.lit(family).alias("family"), _value(df, f.name).alias("value")))
                names.append(f"{table}.{f.name}")
        if records:
            part = df.select(F.inline(F.array(*records))).where("value IS NOT NULL")
            values = part if values is None else values.unionByName(part)
    if values is None:
        raise ValueError("no column to compare")
    # collect_set: at most one entry a column
    sets = values.distinct().groupBy("family", "value").agg(F.sort_array(F.collect_set("place")).alias("places")).groupBy("places").agg(F.count(F.lit(1)).alias("n"))
    pairs = sets.select("n", "places", F.explode("places").alias("child")).select("n", "child", F.explode("places").alias("parent"))
    counts = pairs.groupBy("child", "parent").agg(F.sum("n").alias("contained"))
    own = counts.where("child = parent").select(F.col("child").alias("_c"), F.col("contained").alias("child_values"))
    named = F.array(*[F.lit(n) for n in names])
    share = F.col("contained") / F.col("child_values")
    both = counts.where("child <> parent").join(own, F.col("child") == F.col("_c")).where(share >= least)
    return both.select(named[F.col("child")].alias("child"), named[F.col("parent")].alias("parent"), "child_values", "contained", F.round(share, 6).alias("containment"))
