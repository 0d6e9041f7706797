"""Language identification by prediction with partial matching.

Every language has a byte context tree of up to ORDER bytes. A symbol is coded in the longest known
context; where the context has not seen it, an escape (distinct symbols over total plus distinct) leads to the
next shorter one and at last to 8 bits. Statistics are frozen after learning, so a text's code
length is a sum over its positions and exact: no sampling, no prefix. The shortest code names the language.

Learning: tasks count grams of ORDER + 1 bytes, one shuffle adds them, shorter contexts are their marginals.
A gram must hold FLOOR of its language's bytes, so a tree has at most 1 / FLOOR grams of each order
whatever the corpus; that bound makes the model fit a broadcast. Scoring is one pass without shuffle.

``score`` only weighs the learned languages against each other, so the filter also looks at the code length a byte:
a text far above what its language's own training texts need (FAR times their COMMON quantile, taken over
all of them) is in none of the languages. Training text is coded with its own counts in the model, so junk
that carries a learned language's label lowers its own code length and may stay.

Defined cases. A missing text, or one without a letter, is ``und`` with score 0, as is every text if nothing could be
learned; the filter then leaves the table as it is. Rows without a language or text teach nothing. Equal code lengths go to the first language by
name. Repeated rows each count and get equal results. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import packed, unpacked
from millrace.llm.text import slices
from millrace.plans.lineage import cut_lineage

ORDER = 3
FLOOR = 2.0**-20
#: Distinct languages that may be learned; with FLOOR this bounds the model.
MAX_LANGUAGES = 200
UNKNOWN = "und"
MIN_SCORE = 0.5
#: A text is foreign above FAR times the rate that this share of its language's training texts keeps.
COMMON, FAR = 0.99, 2.0
#: Bits that the first bytes of a text may cost without counting; they lack their contexts.
START_BITS = 8.0 * (ORDER + 1)
PENDING = 1 << 18
LETTER = re.compile(r"[^\W\d_]")


def grams_of(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(gram of ``order`` + 1 bytes ending at each byte, starts by text); texts begin after zero bytes."""
    pad = b"\0" * order
    buffer = np.frombuffer(pad + pad.join(texts) + pad, np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    edge = np.concatenate(([0], np.cumsum(sizes)))
    total = int(edge[-1])
    place = np.arange(total) + order * np.repeat(np.arange(1, len(texts) + 1), sizes)
    gram = np.zeros(len(buffer), np.uint64)
    for k in range(order + 1):
        gram[k:] |= buffer[: len(buffer) - k] << np.uint64(8 * k)
    return gram[place], edge


@dataclass
class Tree:
    """Code lengths of one language: sorted grams with their bits, sorted contexts with their escape, by order."""

    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    @classmethod
    def of(cls, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> Tree:
        """``counts``: order -> (grams of order + 1 bytes, times)."""
        tree = cls([], [], [], [])
        for order in sorted(counts):
            grams, times = counts[order]
            by = np.argsort(grams)
            grams, times = grams[by], times[by].astype(float)
            contexts, start, distinct = np.unique(grams >> np.uint64(8), return_index=True, return_counts=True)
            total = np.add.reduceat(times, start) if len(times) else np.zeros(0)
            weight = total + distinct
            tree.grams.append(grams)
            tree.bits.append(np.log2(np.repeat(weight, distinct)) - np.log2(times))
            tree.contexts.append(contexts)
            tree.escapes.append(np.log2(weight) - np.log2(distinct))
        return tree

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram after the bytes before it."""
        cost = np.full(len(grams), 8.0)
        for order in range(len(self.grams)):
            own = grams & np.uint64((1 << (8 * (order + 1))) - 1)
            seen, known = _find(self.contexts[order], own >> np.uint64(8))
            cost[known] += self.escapes[order][seen[known]]
            at, hit = _find(self.grams[order], own)
            cost[hit] = self.bits[order][at[hit]]
        return cost


def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(where):
        return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
    at = np.minimum(np.searchsorted(where, what), len(where) - 1)
    return at, where[at] == what


def learn(docs: DataFrame, order: int = ORDER, floor: float = FLOOR, most: int = MAX_LANGUAGES) -> dict[str, Tree]:
    """Context trees by language from columns text and lang; of bounded size, see FLOOR."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        pending = 0

        def summed(parts):
            grams = np.concatenate([p[0] for p in parts])
            code, found = pd.factorize(grams)
            return found, np.bincount(code, np.concatenate([p[1] for p in parts]).astype(float), len(found)).astype(np.int64)

        def out():
            for lang, parts in held.items():
                grams, times = summed(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(times)], ["lang", "gram", "n"]
                )

        for batch, texts in slices(batches, "text"):
            named: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(1).to_pylist(), texts):
                named.setdefault(lang, []).append(text)
            for lang, own in named.items():
                code, grams = pd.factorize(grams_of(own, order)[0])
                parts = held.setdefault(lang, [])
                parts.append((grams, np.bincount(code, minlength=len(grams)).astype(np.int64)))
                pending += len(grams)
                if len(parts) > 16:
                    before = sum(len(p[0]) for p in parts)
                    parts[:] = [summed(parts)]
                    pending -= before - len(parts[0][0])
            if pending > 4 * PENDING:
                yield from out()
                held, pending = {}, 0
        yield from out()

    known = docs.where("text is not null and lang is not null").select("text", "lang")
    top = cut_lineage(known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = top.groupBy("lang").agg(F.sum("n").alias("bytes"))
    by_order = F.explode(F.array(*[F.struct(F.lit(k).alias("order"), F.col("gram").bitwiseAND((1 << (8 * (k + 1))) - 1).alias("part")) for k in range(order + 1)]))
    counts = top.select("lang", "n", by_order.alias("x")).groupBy("lang", "x.order", "x.part").agg(F.sum("n").alias("n"))
    languages = totals.limit(most + 1).toPandas()
    if len(languages) > most:
        raise ValueError(f"more than {most} languages")
    kept = counts.join(F.broadcast(totals.limit(most)), "lang").where(F.col("n") >= F.col("bytes") * floor)
    table = kept.select("lang", "order", "part", "n").toPandas()
    return {
        lang: Tree.of({int(k): (g["part"].to_numpy().astype(np.uint64), g["n"].to_numpy()) for k, g in own.groupby("order")})
        for lang, own in table.groupby("lang")
    }


class Scorer:
    """Languages and scores of texts; costs of grams met before are remembered up to a bound."""

    def __init__(self, trees: dict[str, Tree], order: int = ORDER) -> None:
        self.names = sorted(trees)
        self.trees, self.order = trees, order
        self._forget()

    def _forget(self) -> None:
        self.grams, self.costs = np.zeros(0, np.uint64), np.zeros((0, len(self.names)))

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages) code lengths in bits."""
        grams, edge = grams_of(texts, self.order)
        code, found = pd.factorize(grams)
        at, known = _find(self.grams, found)
        fresh = np.sort(found[~known])
        if len(fresh):
            if len(self.grams) > 2 * PENDING:
                self._forget()
                fresh = np.sort(found)
            costs = np.column_stack([self.trees[name].cost(fresh) for name in self.names])
            merged = np.concatenate([self.grams, fresh])
            by = np.argsort(merged, kind="stable")
            self.grams, self.costs = merged[by], np.concatenate([self.costs, costs])[by]
            at, _ = _find(self.grams, found)
        each = self.costs[at]
        out = np.zeros((len(texts), len(self.names)))
        for k in range(len(self.names)):
            run = np.concatenate(([0.0], np.cumsum(each[:, k][code])))
            out[:, k] = run[edge[1:]] - run[edge[:-1]]
        return out

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its posterior probability (equal priors) and bits a byte beyond START_BITS of each text."""
        names, scores, rates = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        able = [i for i, t in enumerate(texts) if t and LETTER.search(t.decode("utf-8", "replace"))]
        if not able or not self.names:
            return names, scores, rates
        bits = self.lengths([texts[i] for i in able])
        best = bits.argmin(axis=1)
        gap = bits - bits[np.arange(len(able)), best][:, None]
        scores[able] = 1.0 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
        rates[able] = np.maximum(bits.min(axis=1) - START_BITS, 0) / [len(texts[i]) for i in able]
        for i, k in zip(able, best):
            names[i] = self.names[k]
        return names, scores, rates


def classify(rows: DataFrame, trees: dict[str, Tree], order: int = ORDER) -> DataFrame:
    """``rows`` (row or id columns and text) with lang_pred, score and rate for text."""
    shared = rows.sparkSession.sparkContext.broadcast({k: (t.grams, t.bits, t.contexts, t.escapes) for k, t in trees.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer({k: Tree(*parts) for k, parts in shared.value.items()}, order)
        for batch, texts in slices(batches, "text"):
            names, scores, rates = scorer.predict(texts)
            rest = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())],
                [*rest.schema.names, "lang_pred", "score", "rate"],
            )

    from pyspark.sql import types as T

    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"])
    return rows.mapInArrow(run, schema.add("lang_pred", "string").add("score", "double").add("rate", "double"))


def held_out(column: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether a document is set aside: crc32 of its id as text, modulo ``folds``; a missing id reads as empty."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds == fold


def language_report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from those not held out."""
    trees = learn(docs.where(~held_out()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return classify(rows, trees).drop("rate")


def language_filter(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` in one of the learned languages for certain, with ``lang`` set to it; learned from all of them.

    That is to ``min_score`` among the languages, and at a code length near that of the language's own texts.
    """
    trees = learn(docs)
    if not trees:
        return docs
    own = classify(docs.where("text is not null and lang is not null").select("lang", "text"), trees).where("lang = lang_pred")
    rates = own.groupBy("lang").agg(F.percentile_approx("rate", COMMON, 10_000).alias("rate")).collect()
    rows = classify(packed(docs, text=F.col("text")), trees)
    limit = F.lit(None).cast("double")
    if rates:
        limit = F.create_map(*[F.lit(x) for r in rates for x in (r.lang, FAR * r.rate)])[F.col("lang_pred")]
    near = F.coalesce(F.col("rate") <= limit, F.lit(True))
    return unpacked(rows.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score) & near), docs, lang=F.col("lang_pred"))
