"""Language-model scoring by a weighted backoff automaton.

States are histories: the empty one, and every word (and the start of a text) seen in training. A state
has an arc for each word seen after it; any other word takes its failure arc to the empty history and goes on
from there. With c the training counts and p1 the smoothed unigram probability,

    arc u -> v       (c(u v) + PRIOR * p1(v)) / (c(u) + PRIOR)
    failure of u     PRIOR / (c(u) + PRIOR)            p1(v) = (c(v) + 0.1) / (N + 0.1 (V + 1))

which sums to one over the vocabulary and one unknown word. A text is one left-to-right traversal that
carries the state and adds logarithms.

The automaton grows with the corpus and is never in one place: each block of documents asks for the counts of
its own distinct words and word pairs (``blocks``), builds the part of the automaton that its texts can
reach, and traverses that. Shuffled: texts once, each block's distinct keys once, one small number per key back.

Defined cases. A missing or empty text is the end token alone. Without training text all counts are zero and
each token has probability one (base and model alike). Repeated rows each count and are scored alike. A missing
id is read as an empty text by the fold. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.blocks import BLOCK_BYTES, blocked, by_range, from_planes, from_sorted_keys, planes, sorted_keys
from millrace.llm.frames import LAST_ID
from millrace.llm.text import column_bytes, mix, slices, words_of

PRIOR = 20.0
UNIGRAM_PRIOR = 0.1
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
PENDING = 1 << 20


def held_out(column: str = "doc_id") -> Column:
    """Every tenth document by crc32 of its id as text; a missing id reads as empty."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def tokens_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of lower-cased words with one END after each text, bounds by text)."""
    words = words_of(texts, lower=True)
    n = len(texts)
    bounds = words.bounds + np.arange(n + 1)
    out = np.full(int(bounds[-1]), END, np.uint64)
    place = np.arange(len(words.hashes)) + np.repeat(np.arange(n), words.counts)
    out[place] = words.hashes
    return out, bounds


def pairs_of(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(history of each token, fingerprint of history and token)."""
    history = np.concatenate(([START], tokens[:-1])) if len(tokens) else tokens
    history[bounds[:-1]] = START
    return history, mix(mix(history * _LEFT) + tokens * _RIGHT)


@dataclass
class Automaton:
    """The part of the automaton that one block reaches; all arrays are sorted by their keys."""

    words: np.ndarray
    word_counts: np.ndarray
    arcs: np.ndarray
    arc_counts: np.ndarray
    total: float
    distinct: float
    prior: float = PRIOR

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + UNIGRAM_PRIOR) / (self.total + UNIGRAM_PRIOR * (self.distinct + 1))

    def traverse(self, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(training count, log10 unigram probability, log10 model probability) of each token in its place.

        The state before a token is its history; ``seen`` says whether the arc exists or the failure arc is taken.
        """
        history, pair = pairs_of(tokens, bounds)
        count = self.word_counts[np.searchsorted(self.words, tokens)].astype(float)
        first = self.word_counts[np.searchsorted(self.words, END)] if len(tokens) else 0
        state = np.empty(len(tokens))
        state[1:] = count[:-1]
        state[bounds[:-1]] = first
        seen = self.arc_counts[np.searchsorted(self.arcs, pair)].astype(float)
        base = self.unigram(count)
        failure = np.log10(self.prior) - np.log10(state + self.prior)
        arc = np.log10(np.maximum(seen, 1) + self.prior * base) - np.log10(state + self.prior)
        return count, np.log10(base), np.where(seen > 0, arc, failure + np.log10(base))


def vocabulary_size(docs: DataFrame) -> tuple[int, int]:
    """(N, V): training tokens and distinct ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def summed():
            code, found = pd.factorize(np.concatenate([p[0] for p in parts]))
            return found, np.bincount(code, np.concatenate([p[1] for p in parts]).astype(float)).astype(np.int64)

        def out(words, times):
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(times)], ["word", "n"])

        for _, texts in slices(batches, "text"):
            code, found = pd.factorize(tokens_of(texts)[0])
            parts.append((found, np.bincount(code).astype(np.int64)))
            if sum(len(p[0]) for p in parts) > PENDING:
                parts = [summed()]
                if len(parts[0][0]) > PENDING // 2:
                    yield out(*parts.pop())
        if parts:
            yield out(*summed())

    words = docs.where(~held_out()).select("text").mapInArrow(count, "word long, n long")
    row = words.groupBy("word").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).first()
    return int(row.total or 0), int(row.distinct)


def _sums(keys: np.ndarray, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, how many of their places teach)."""
    found, code = np.unique(keys, return_inverse=True)
    return found, np.bincount(code, taught, len(found)).astype(np.uint64)


def _ask(ranges: int):
    """Each block's distinct words (kind 0) and word pairs (kind 1) with its own counts, by range."""

    def run(table: pa.Table) -> pa.Table:
        rows = []
        tokens, bounds = tokens_of(column_bytes(table, "text"))
        taught = np.repeat(~np.array(table["held"].to_pylist(), bool), np.diff(bounds)).astype(float)
        block = table["block"][0].as_py()
        for kind, keys in enumerate((tokens, pairs_of(tokens, bounds)[1])):
            found, times = _sums(keys, taught)
            rows += [(r, kind, block, sorted_keys(found[a:b]), planes(times[a:b])) for r, a, b in by_range(found, ranges)]
        return pa.table(dict(zip(("range", "kind", "block", "keys", "counts"), map(list, zip(*rows)))), schema=_ASKED)

    return run


_ASKED = pa.schema([("range", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("range", pa.int64()), ("kind", pa.int32()), ("counts", pa.binary())])


def _answer(table: pa.Table) -> pa.Table:
    """The corpus counts of all keys of one range and kind, for each block in the order of its keys."""
    keys = [from_sorted_keys(k) for k in table["keys"].to_pylist()]
    counts = np.concatenate([from_planes(c) for c in table["counts"].to_pylist()]).astype(float)
    found, code = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(code, counts, len(found)).astype(np.uint64)[code]
    edge = np.cumsum([0, *map(len, keys)])
    blobs = [planes(totals[a:b]) for a, b in zip(edge[:-1], edge[1:])]
    return pa.table([table["block"], table["range"], table["kind"], pa.array(blobs, pa.binary())], schema=_ANSWER)


def score(docs: DataFrame, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each document."""
    total, distinct = vocabulary_size(docs)
    rows, n = blocked(docs, block_bytes)
    # held_out() reads the id as text, so it is taken from the true id.
    own = F.when(F.col("id") == LAST_ID, F.lit(None)).otherwise(F.col("id"))
    rows = rows.withColumn("doc_id", own).withColumn("held", held_out()).select("block", "id", "held", "text")
    asked = rows.groupBy("block").applyInArrow(_ask(n), "range long, kind int, block long, keys binary, counts binary")
    answers = asked.groupBy("range", "kind").applyInArrow(_answer, "block long, range long, kind int, counts binary")

    def walk(texts: pa.Table, told: pa.Table) -> pa.Table:
        tokens, bounds = tokens_of(column_bytes(texts, "text"))
        parts = sorted(zip(told["kind"].to_pylist(), told["range"].to_pylist(), told["counts"].to_pylist()), key=lambda x: x[:2])
        counts = [np.concatenate([from_planes(c) for k, _, c in parts if k == kind]) for kind in (0, 1)]
        machine = Automaton(np.unique(tokens), counts[0], np.unique(pairs_of(tokens, bounds)[1]), counts[1], total, distinct, prior)
        count, base, model = machine.traverse(tokens, bounds)
        known = np.add.reduceat((count > 0).astype(np.int64), bounds[:-1])
        return pa.table(
            {
                "id": texts["id"],
                "held_out": texts["held"],
                "n_tokens": np.diff(bounds),
                "n_known": known,
                "base_score": np.add.reduceat(base, bounds[:-1]),
                "score": np.add.reduceat(model, bounds[:-1]),
            }
        )

    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        walk, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    doc_id = F.when(F.col("id") == LAST_ID, F.lit(None)).otherwise(F.col("id")).alias("doc_id")
    return scored.select(doc_id, "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
