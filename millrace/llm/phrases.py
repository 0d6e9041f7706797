"""Phrase collocation mining: contiguous phrases whose parts meet more often than chance, by language.

Words and their counts come first. Then, level by level, a pass over the texts lists the Apriori-safe
phrases - those whose first words and whose last words are frequent phrases of the level below - and sums their
fingerprints' counts: an upper bound, since fingerprints can only run together. What reaches ``least`` is a candidate. At the end the
candidates of all lengths go into double-array tries of at most TRIE phrases, each built in a task of its own. Each trie is
broadcast, numpy moves all text positions through it at once, a word a level, counts of accepting states are added up over
the texts' shards, and these exact counts decide.

What is broadcast is bounded: KEYS fingerprints of frequent phrases and of words, or one trie at a time; where there are more, there are more
passes. Scores are floor(1000 * a * n / (l * r)) in 38 digits.

Defined cases. A missing text is empty, a missing language is ``und``. Rows are documents, repeated rows count again, with an id
or without. A very long text is a batch of its own; its words are cut half a megabyte at a time only where texts meet, so one text of b
bytes takes a few times b. Phrases never cross ``.,;:!?`` nor line ends. Ties are broken as the ranking says; only text and language are
read, whatever other columns there are. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import double_array
from millrace.llm.blocks import from_planes, planes
from millrace.llm.text import column_bytes, mix, slices, words_of
from millrace.plans.lineage import cut_lineage

LEAST = 100
LONGEST = 5
TOP = 2000
KEYS = 4_000_000
TRIE = 250_000
HELD = 400_000
#: Phrases in a row of counts, and shards whose rows are added up in one task before the folds are.
RANGE = 4096
FOLD = 1024

BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
_GAP, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_GAP[list(BREAKS + BLANKS)] = True
_TABLE = bytes(32 if _GAP[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _lang_hash(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def word_keys(texts: list[bytes | None], langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of every word within its language, number of the piece it lies in), in order."""
    words = words_of(texts, lower=True, gaps=_GAP)
    salt = np.array([_lang_hash(la) for la in langs], np.uint64)
    return mix(words.hashes + salt[words.owner]), np.cumsum(_BREAK[words.buffer])[words.starts]


def joined(left: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Fingerprints of phrases, from those of all but their last word and of that word."""
    return mix(left * _STEP + last)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, Counter] = {}
    for part, texts in slices(batches, "text"):
        for lang, text in zip(part.column(0).to_pylist(), texts):
            if text:
                found.setdefault(lang, Counter()).update(text.translate(_TABLE).split())
        if sum(map(len, found.values())) > HELD:
            yield from _counted(found)
            found = {}
    yield from _counted(found)


def _counted(found: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, words in found.items():
        if words:
            columns = [pa.array([lang] * len(words)), pa.array(words.keys(), pa.binary()).cast(pa.string()), pa.array(words.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])


def _keyed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, _ = word_keys(column_bytes(batch, "phrase"), batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *batch.columns], ["key", "lang", "phrase", "n"])


def _places(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Places of ``keys`` among the sorted ones, -1 for others."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _summed(rows: list[np.ndarray]) -> np.ndarray:
    """(place, last, n) rows with one row a pair, in order."""
    all_rows = np.concatenate(rows, axis=1)
    order = np.lexsort((all_rows[1], all_rows[0]))
    all_rows = all_rows[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (all_rows[:2, 1:] != all_rows[:2, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    n = np.add.reduceat(all_rows[2], first) if len(first) else all_rows[2]
    return np.stack([all_rows[0, first], all_rows[1, first], n])


def _extensions(level: int, shared):
    """Phrases of ``level`` words whose first words are among the shared keys; where all keys are shared, also their last words must be.

    The first words travel as their place among the keys. So does the last word if all words are shared too, in the low half of the same number;
    otherwise it travels as its fingerprint.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, words, whole = shared.value
        rows, size = [], 0
        for part, texts in slices(batches, "text"):
            last, piece = word_keys(texts, part.column(0).to_pylist())
            left = last
            for k in range(1, level - 1):
                left = joined(left[:-1], last[k:]) if len(left) > 1 else left[:0]
            total = len(last) - level + 1
            if total <= 0:
                continue
            place = _places(left, frequent)
            good = (place[:total] >= 0) & (place[1 : total + 1] >= 0 if whole else True) & (piece[:total] == piece[level - 1 :])
            at = np.flatnonzero(good)
            ends, first = last[at + level - 1].view(np.int64), place[at]
            if words is not None:
                code = _places(ends.view(np.uint64), words)
                first, ends = (first << 32 | code)[code >= 0], np.zeros((code >= 0).sum(), np.int64)
            rows.append(_summed([np.stack([first, ends, np.ones(len(first), np.int64)])]))
            size += rows[-1].shape[1]
            if size > HELD:
                rows = [_summed(rows)]
                size = rows[0].shape[1]
                if size > HELD // 2:
                    yield _pairs(rows[0])
                    rows, size = [], 0
        if rows:
            yield _pairs(_summed(rows))

    return run


def _pairs(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["place", "last", "n"])


def _named_pairs(shared):
    """Places as fingerprints again, and the fingerprint of the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, words, _ = shared.value
        for batch in batches:
            place, last = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if words is not None:
                place, last = place >> 32, words[place & 0xFFFFFFFF]
            left = frequent[place]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (joined(left, last), left, last)], ["key", "left", "last"])

    return run


def _trie(table: pa.Table) -> pa.Table:
    """One trie of the phrases of this group, with their keys in the order of its counts."""
    langs, phrases, keys = (table[c].to_pylist() for c in ("lang", "phrase", "key"))
    parts = word_keys([p.encode() for p in phrases], langs)[0]
    sizes = [p.count(" ") + 1 for p in phrases]
    blob = double_array.build(np.split(parts, np.cumsum(sizes)[:-1])).pack()
    return pa.table({"keys": pa.array([np.array(keys, "<i8").tobytes()], pa.binary()), "trie": pa.array([blob], pa.binary())})


def _matches(shared, longest: int):
    """Counts of this shard's texts, a row for each range of phrases; shards of neighbouring numbers share a fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = double_array.DoubleArray.unpack(shared.value[0])
        total = np.zeros(trie.n_phrases, np.int64)
        for part, texts in slices(batches, "text"):
            total += trie.counts(*word_keys(texts, part.column(0).to_pylist()), longest)
        fold = TaskContext.get().partitionId() // FOLD
        ranges = [r for r in range(0, len(total), RANGE) if total[r : r + RANGE].any()]
        blobs = [planes(total[r : r + RANGE]) for r in ranges]
        yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array([fold] * len(ranges), pa.int64()), pa.array(blobs, pa.binary())], ["first", "fold", "counts"])

    return run


def _added(key: tuple, table: pa.Table) -> pa.Table:
    total = reduce(np.add, (from_planes(blob) for blob in table["counts"].to_pylist()))
    return pa.table({"first": table["first"][:1], "counts": pa.array([planes(total)], pa.binary())})


def _named(shared):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Counts of all shards with the keys of their phrases."""
        total = reduce(np.add, (from_planes(blob) for blob in table["counts"].to_pylist()))
        first = key[0].as_py()
        names = np.frombuffer(shared.value[1], "<i8")[first : first + RANGE]
        return pa.table({"key": names[total > 0], "a": total[total > 0].astype(np.int64)})

    return run


def _sorted_keys(frame: DataFrame) -> np.ndarray:
    return np.sort(frame.select("key").toArrow()["key"].to_numpy().view(np.uint64))


def candidates(texts: DataFrame, words: DataFrame, least: int, longest: int, most_keys: int) -> DataFrame | None:
    """(key, lang, phrase) of the phrases of 2 to ``longest`` words that may occur ``least`` times; None if there are none."""
    context = texts.sparkSession.sparkContext
    below, levels = words.select("key", "lang", "phrase"), []
    all_words = _sorted_keys(words) if words.count() <= most_keys else None
    last_words = words.select(F.col("key").alias("last"), F.col("phrase").alias("word"))
    for level in range(2, longest + 1):
        n = below.count()
        if not n:
            break
        chunks, found = math.ceil(n / most_keys), []
        for chunk in range(chunks):
            keys = _sorted_keys(below.where(F.pmod(F.xxhash64("key"), F.lit(chunks)) == chunk))
            shared = context.broadcast((keys, all_words, chunks == 1))
            rows = texts.mapInArrow(_extensions(level, shared), "place long, last long, n long")
            rows = rows.groupBy("place", "last").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("place", "last")
            found.append(cut_lineage(rows.mapInArrow(_named_pairs(shared), "key long, left long, last long")))
            shared.destroy()
        grown = reduce(DataFrame.unionByName, found).join(below.withColumnRenamed("key", "left"), "left").join(last_words, "last")
        below = cut_lineage(grown.select("key", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase")))
        levels.append(below)
    return reduce(DataFrame.unionByName, levels) if levels else None


def phrase_counts(texts: DataFrame, phrases: DataFrame, longest: int, most: int) -> DataFrame:
    """(key, a): occurrences of every phrase, a trie at a time."""
    context, n = texts.sparkSession.sparkContext, phrases.count()
    chunks = max(1, math.ceil(n / most))
    grouped = phrases.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks))).groupBy("chunk")
    tries = cut_lineage(grouped.applyInArrow(lambda key, table: _trie(table).append_column("chunk", pa.array([key[0].as_py()], pa.int64())), "keys binary, trie binary, chunk long"))
    found = []
    for chunk in range(chunks):
        row = tries.where(F.col("chunk") == chunk).first()
        if row is None:
            continue
        shared = context.broadcast((bytes(row["trie"]), bytes(row["keys"])))
        rows = texts.mapInArrow(_matches(shared, longest), "first long, fold long, counts binary")
        rows = rows.groupBy("first", "fold").applyInArrow(_added, "first long, counts binary")
        found.append(cut_lineage(rows.groupBy("first").applyInArrow(_named(shared), "key long, a long")))
        shared.destroy()
    return reduce(DataFrame.unionByName, found)


def _floor_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) without leaving whole numbers; factors of up to 19 digits."""
    wide, one = "decimal(38,0)", "decimal(19,0)"
    return F.call_function("div", ((a * 1000).cast(one) * n.cast(one)).cast(wide), (left.cast(one) * right.cast(one)).cast(wide))


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, most_keys: int = KEYS, most_phrases: int = TRIE
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = texts.mapInArrow(_word_counts, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    words = cut_lineage(counted.where(F.col("n") >= least).mapInArrow(_keyed_words, "key long, lang string, phrase string, n long"))
    named = candidates(texts, words, least, longest, most_keys)
    if named is None:
        none = F.lit(None).cast("long")
        return words.limit(0).select("lang", none.alias("rank"), "phrase", *[none.alias(c) for c in ("a", "l", "r", "n", "score")])
    found = named.join(phrase_counts(texts, named, longest, most_phrases), "key").where(F.col("a") >= least)
    found = cut_lineage(found.select("lang", "phrase", F.split("phrase", " ").alias("parts"), "a"))

    # Inside a longer candidate as often as at all: then also inside one that is a single word longer.
    size = F.size("parts")
    ends = F.array(*[F.array_join(F.slice("parts", F.lit(begin), size - 1), " ") for begin in (1, 2)])
    covered = found.where(size > 2).select("lang", F.explode(ends).alias("phrase"), "a").distinct()
    alone = found.join(covered, ["lang", "phrase", "a"], "left_anti")

    freq = words.select("lang", F.col("phrase").alias("piece"), F.col("n").alias("times"))
    freq = freq.unionByName(found.select("lang", F.col("phrase").alias("piece"), F.col("a").alias("times")))
    cuts = alone.withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumn("first", F.array_join(F.slice("parts", F.lit(1), F.col("cut")), " "))
    cuts = cuts.withColumn("rest", F.array_join(F.slice("parts", F.col("cut") + 1, size - F.col("cut")), " "))
    cuts = cuts.join(freq.withColumnsRenamed({"piece": "first", "times": "l"}), ["lang", "first"])
    cuts = cuts.join(freq.withColumnsRenamed({"piece": "rest", "times": "r"}), ["lang", "rest"]).join(totals, "lang")
    score = _floor_score(F.col("a"), F.col("total"), F.col("l"), F.col("r"))
    best = cuts.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low"))
    ranked = best.select("lang", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), F.col("total").alias("n"), F.col("low.score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
