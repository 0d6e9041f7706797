"""Source divergence audit: how far each source's use of words lies from the others' and from its language's.

``bytes.translate`` lowers A-Z and blanks every other ASCII character in one pass, ``bytes.split`` yields the terms,
and one Counter a document yields its frequencies and its share in the document counts. Tasks merge
Counters and hand over (language, source, term) rows, which Spark sums; terms kept are those in at least
``least_docs`` documents of their language. Only terms that occur are ever stored: a share of an absent term is a constant
of its group, so sums over all kept terms need the terms a group holds and a correction where two groups hold one.

Pairs of sources are summed in tasks of a slice of the terms and two blocks of sources each; a task returns one
number a pair of sources, never a row a term and pair. All arithmetic is on integers.

Defined cases. A missing text has no term; a missing language or source is the empty string. Rows are documents: repeated
rows count again, with an id or without. Texts are tokenised about SLICE bytes at a time, cut at separators, so a very long one
costs no more memory than that and its Counter. A group without terms is compared like the others; a language that keeps no term
has distance 0 everywhere. Ties go to the smaller item in UTF-8 order. Only three columns are read, whatever the others are called. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.text import slices
from millrace.plans.lineage import cut_lineage

LEAST_DOCS = 10
TOP = 10
UNIT = 1_000_000_000
SLICE = 1 << 20
HELD = 400_000
ENTRIES = 200_000
SOURCES = 256
PAIRS = 1 << 20

LETTERS = set(range(ord("A"), ord("Z") + 1)) | set(range(ord("a"), ord("z") + 1))
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in LETTERS or b >= 128 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """Terms of one text and how often it holds them."""
    found, start = Counter(), 0
    while start < len(text):
        end = start + SLICE
        # A cut moves right to the next separator, so that no term is parted.
        while end < len(text) and TABLE[text[end]] != 32:
            end += 1
        found.update(text[start:end].translate(TABLE).split())
        start = end
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0
    for batch in batches:
        for part, texts in slices([batch], "text"):
            names = zip(part.column(0).to_pylist(), part.column(1).to_pylist())
            for name, text in zip(names, texts):
                if not text:
                    continue
                n, docs = groups.setdefault(name, (Counter(), Counter()))
                before = len(docs)
                found = term_counts(text)
                n.update(found)
                docs.update(found.keys())
                held += len(docs) - before
                if held > HELD:
                    yield from _rows(groups)
                    groups, held = {}, 0
    yield from _rows(groups)


def _rows(groups: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in groups.items():
        size = len(n)
        if size:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size),
                    pa.array([source] * size),
                    pa.array(n.keys(), pa.binary()).cast(pa.string()),
                    pa.array(n.values(), pa.int64()),
                    pa.array([docs[t] for t in n], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exactly, also where the product passes 64 bits."""
    whole = "decimal(38,0)"
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast(whole) * (count + 2).cast("decimal(20,0)"), (total + 2 * terms).cast(whole))


def spread(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most UNIT + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _spread(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _pair_sums(table: pa.Table) -> pa.Table:
    """Corrections for the terms of this slice that two sources both hold, summed by pair of sources."""
    names = ("term", "place", "side", "p", "none")
    term, place, side, p, none = (table[c].to_numpy() for c in names)
    order = np.argsort(term, kind="stable")
    term, place, side, p, none = term[order], place[order], side[order], p[order], none[order]
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    first, last = (np.searchsorted(term[right], term[left], s) for s in ("left", "right"))
    low, high = np.unique(place[left]), np.unique(place[right])
    sums = np.zeros(len(low) * len(high), np.int64)
    ends = np.cumsum(last - first)
    begin = 0
    while begin < len(left):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS)))
        width = (last - first)[begin:end]
        a = np.repeat(left[begin:end], width)
        b = right[np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first[begin:end], width)]
        use = place[a] < place[b]
        a, b = a[use], b[use]
        value = _spread(p[a], p[b]) - _spread(p[a], none[b]) - _spread(none[a], p[b]) + _spread(none[a], none[b])
        np.add.at(sums, np.searchsorted(low, place[a]) * len(high) + np.searchsorted(high, place[b]), value)
        begin = end
    i, j = np.divmod(np.flatnonzero(sums), len(high)) if len(high) else (np.zeros(0, int), np.zeros(0, int))
    lang = pa.array([table["lang"][0].as_py()] * len(i), pa.string())
    return pa.table({"lang": lang, "a": pa.array(low[i], pa.int32()), "b": pa.array(high[j], pa.int32()), "both": sums[sums != 0]})


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = SOURCES, entries: int = ENTRIES) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by distance, and terms a source uses above its language's share."""
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    counts = named.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = cut_lineage(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = cut_lineage(kept.select("lang", "term", "lang_n"))
    held = counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"])

    # One row a language and one a group, also those without terms; places number a language's sources.
    groups = named.select("lang", "source").distinct()
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = groups.withColumn("place", place).withColumn("none", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))))
    groups = cut_lineage(groups)

    known = groups.where("terms > 0").select("lang", "source", "place", "none", "total", "terms", "lang_total")
    held = held.join(known, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    held = held.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
    held = cut_lineage(held.select("lang", "source", "place", "none", "term", "p", "q"))

    own = held.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), spread(F.col("p"), F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = own.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    pairs = _pairs(held, groups, block, entries)
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(own).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _pairs(held: DataFrame, groups: DataFrame, block: int, entries: int) -> DataFrame:
    """(lang, source, part, item, value) of every ordered pair of sources of a language.

    With h the share of a term and o that of an absent one, the sum over all terms is that over the terms of one source against o of the
    other, both ways, that of the terms neither holds, and the corrections of ``_pair_sums`` for those both hold.
    """
    size, most = held.agg(F.count("*"), F.max("place")).first()
    n_slices, n_blocks = max(1, math.ceil((size or 0) / entries)), (most or 0) // block + 1
    tile = held.withColumn("part", F.pmod(F.xxhash64("lang", "term"), F.lit(n_slices))).withColumn("own", F.floor(F.col("place") / block))
    tile = tile.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    tile = tile.select(
        "lang", "part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.xxhash64("term").alias("term"), "place",
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "p", "none",
    )
    both = tile.groupBy("lang", "part", "low", "high").applyInArrow(_pair_sums, "lang string, a int, b int, both long")
    both = both.groupBy("lang", "a", "b").agg(F.sum("both").alias("both"))

    # A source's terms against the constants of the others: few distinct shares, so shares with their frequencies are paired.
    shares = held.groupBy("lang", "place", "p").agg(F.count("*").alias("times"))
    absent = groups.select("lang", "place", "none")
    other = absent.select("lang", F.col("place").alias("b"), F.col("none").alias("other_none"))
    alone = shares.join(other, "lang").where("place <> b").groupBy("lang", F.col("place").alias("a"), "b")
    alone = alone.agg(F.sum(spread(F.col("p"), F.col("other_none")) * F.col("times")).alias("alone"))
    sizes = held.groupBy("lang", "place").agg(F.count("*").alias("size"))

    left = groups.join(sizes, ["lang", "place"], "left").na.fill(0, ["size"]).select(
        "lang", "source", F.col("place").alias("a"), F.col("none").alias("none_a"), F.col("size").alias("size_a"), "terms"
    )
    right = left.select("lang", F.col("source").alias("item"), F.col("a").alias("b"), F.col("none_a").alias("none_b"), F.col("size_a").alias("size_b"))
    pairs = left.join(right, "lang").where("a < b")
    back = alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("alone").alias("back"))
    pairs = pairs.join(alone, ["lang", "a", "b"], "left").join(back, ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left")
    neither = spread(F.col("none_a"), F.col("none_b")) * (F.col("terms") - F.col("size_a") - F.col("size_b"))
    none = F.lit(0).cast("long")
    value = sum((F.coalesce(c, none) for c in (F.col("alone"), F.col("back"), F.col("both"))), F.coalesce(neither, none))
    pairs = pairs.select("lang", "source", "item", value.alias("value"))
    back = pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return pairs.unionByName(back).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
