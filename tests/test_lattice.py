from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import lattice as la


def brute(rows, names, width):
    """Minimal keys and dependencies by counting every set."""
    places = range(len(names))
    count = lambda g: len({tuple(r[i] for i in g) for r in rows})
    keys, deps = [], []
    for w in range(width + 1):
        for g in combinations(places, w):
            if any(set(k) <= set(g) for k in keys):
                continue
            if w and count(g) == len(rows):
                keys.append(g)
                continue
            for a in places:
                if a not in g and not any(b == a and set(d) <= set(g) for d, b in deps) and count(g) == count((*g, a)):
                    deps.append((g, a))
    say = lambda g: ", ".join(names[i] for i in g)
    return sorted(say(k) for k in keys), sorted((say(g), names[a]) for g, a in deps)


@pytest.mark.parametrize("sample", [0, 20, 1_000])
def test_lattice_against_brute_force(spark, sample):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        a, b, c = (int(v) for v in rng.integers(0, 5, 3))
        rows.append((a, b, (a + b) % 5, None if c == 0 else f"x{c}", (a * b * c) % 7, 9, i // 2 if a else None, i % 2))
    names = list("abcdefgh")
    df = spark.createDataFrame(rows, "a int, b int, c int, d string, e int, f int, g int, h int")
    found = la.search(df, 3, sample=sample)
    keys, deps = brute(rows, names, 3)
    assert deps and sorted(", ".join(k) for k in found.keys) == keys
    assert sorted((", ".join(g), c) for g, c, _ in found.deps) == deps


def test_eighty_columns(spark):
    rng = np.random.default_rng(6)
    names = [f"c{i}" for i in range(80)]
    base = rng.integers(0, 2, (300, 80))
    base[:, 79] = base[:, 3] ^ base[:, 11]
    df = spark.createDataFrame([tuple(int(v) for v in r) for r in base], ", ".join(f"{c} int" for c in names))
    got = {tuple(r)[:2] for r in la.dependencies(df, 2).collect()}
    assert got == {("c3, c11", "c79"), ("c3, c79", "c11"), ("c11, c79", "c3")}


def test_missing_values_swap_places(spark):
    # (NULL, 'x') and ('x', NULL) are different combinations
    df = spark.createDataFrame([(None, "x"), ("x", None), (None, None)], "a string, b string")
    assert la.set_counts(df, [("a", "b"), ("a",)]) == {("a", "b"): 3, ("a",): 2}


def test_lattice_of_empty_and_single_rows(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert la.minimal_keys(empty).count() == 0 and la.dependencies(empty).count() == 0
    one = spark.createDataFrame([(1, "x")], "a int, b string")
    assert {tuple(r)[:2] for r in la.dependencies(one).collect()} == {("", "a"), ("", "b")}


def test_inclusions_with_nulls_long_texts_and_families(spark):
    long = "y" * 500
    left = spark.createDataFrame([(1, 1.0, "a", [1]), (2, -0.0, long, [2]), (2, 0.0, None, None), (None, 3.0, "b", None)], "i int, f double, s string, l array<int>")
    right = spark.createDataFrame([(1, 0.0, long), (2, 1.0, "a"), (3, 3.0, "c"), (3, 3.0, "1")], "i bigint, f float, s string")
    none = spark.createDataFrame([], "i int, s string")
    tables = {"left": left, "right": right, "none": none}
    got = {tuple(r) for r in la.inclusions(tables, 0.5).collect()}
    assert got == {
        ("left.i", "right.i", 2, 2, 1.0), ("right.i", "left.i", 3, 2, 0.666667), ("left.f", "right.f", 3, 3, 1.0), ("right.f", "left.f", 3, 3, 1.0),
        ("left.s", "right.s", 3, 2, 0.666667), ("right.s", "left.s", 4, 2, 0.5),
    }
    assert {r.child for r in la.inclusions(tables).collect()} == {"left.i", "left.f", "right.f"}
    with pytest.raises(ValueError):
        la.inclusions(tables, 0.0)


def test_rows_that_agree_are_drawn(spark, monkeypatch):
    """Of 20 000 rows with few repeats, only single columns and true keys are counted over all rows."""
    df = spark.range(20_000, numPartitions=4).select((F.col("id") % 5_000).alias("a"), *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(n)).alias(c) for i, (c, n) in enumerate([("b", 4_000), ("c", 30), ("d", 2)])])
    asked, count = [], la.set_counts
    monkeypatch.setattr(la, "set_counts", lambda frame, sets: asked.extend(sets) or count(frame, sets))
    found = la.search(df, 2)
    assert not found.deps and set(asked) - {("a", "b")} == {("a",), ("b",), ("c",), ("d",)}


def test_a_key_of_all_columns_is_found_though_rows_are_drawn_twice(spark):
    df = spark.createDataFrame([(i % 7, i // 7) for i in range(49)], "a int, b int")
    assert la.search(df, 2).keys == [("a", "b")]
