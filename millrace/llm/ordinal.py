"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector w, shared by all grades, and ordered thresholds t: P(grade <= k) = sigmoid(t_k - w.x). Features
are the distinct lower-cased words (1 / sqrt of their number each) and the byte trigrams (square roots of their
shares), hashed into one table of DIMENSIONS weights. The expected grade and the probability of a grade at or above the wanted
one follow from the same score and select documents.

Fitting takes a bounded sample of labelled rows: at most FIT_ROWS of each grade, the first ones in a hash order of their
ids, weighted back to the grades' true counts. It runs as one task whose input that parameter bounds; the
model has DIMENSIONS + grades - 1 numbers. Scoring is one pass over all documents without shuffle.

Defined cases. A text that is missing or has no word gets expected grade 0 and tail probability 0. Labels without a
grade or document teach nothing; repeated ones each count. With fewer than two grades in the sample every text with words gets the
grade seen, or 0 without any. Equal rows get equal results. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import packed, unpacked
from millrace.llm.text import column_bytes, mix, slices, words_of

DIMENSIONS = 1 << 18
FIT_ROWS = 4_000
STEPS = 1_000
RATE = 0.5
DECAY = 1e-6
BATCH = 128
#: Sampled rows that must hold a feature for it to get a weight; rarer ones would be learned by heart.
MIN_ROWS = 20
SELECT = 0.5


@dataclass
class Features:
    """Sparse rows: ``index`` and ``value`` by ``bounds``; ``words`` is the number of words of each text."""

    index: np.ndarray
    value: np.ndarray
    bounds: np.ndarray
    words: np.ndarray

    def score(self, weights: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0.0], np.cumsum(weights[self.index] * self.value)))
        return run[self.bounds[1:]] - run[self.bounds[:-1]]


def features(texts: list[bytes | None]) -> Features:
    found = words_of(texts, lower=True)
    n = len(texts)
    owner = found.owner.astype(np.uint64)
    salted = found.hashes ^ mix(owner + np.uint64(1))
    distinct = np.unique(salted, return_index=True)[1]
    word_owner = owner[distinct].astype(np.int64)
    held = np.bincount(word_owner, minlength=n)
    buffer = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8).astype(np.uint64)
    gram = buffer[:-2] | (buffer[1:-1] << np.uint64(8)) | (buffer[2:] << np.uint64(16))
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, n)
    byte_owner = np.repeat(np.arange(n), sizes)
    # Trigrams stay within their text and the line end after it, whatever text comes next.
    whole = byte_owner[:-2] == byte_owner[2:]
    code, times = np.unique((byte_owner[:-2][whole].astype(np.uint64) << np.uint64(24)) | gram[whole], return_counts=True)
    code_owner = (code >> np.uint64(24)).astype(np.int64)
    mask = np.uint64(DIMENSIONS - 1)
    index = np.concatenate([found.hashes[distinct] & mask, mix((code & np.uint64(0xFFFFFF)) + np.uint64(0xA5A5A5A5A5)) & mask]).astype(np.int64)
    value = np.concatenate([1 / np.sqrt(held[word_owner]), np.sqrt(times / sizes[code_owner])])
    row = np.concatenate([word_owner, code_owner])
    order = np.lexsort((value, index, row))
    return Features(index[order], value[order], np.searchsorted(row[order], np.arange(n + 1)), found.counts)


def features_by_slices(texts: list[bytes | None], most: int = 1 << 19) -> Features:
    """The same for many texts, about ``most`` bytes at a time, in numbers of half the size."""
    parts, start, size = [], 0, 0

    def add(end: int) -> None:
        part = features(texts[start:end])
        parts.append(Features(part.index.astype(np.int32), part.value.astype(np.float32), part.bounds, part.words))

    for i, text in enumerate(texts):
        if size and size + len(text or b"") > most:
            add(i)
            start, size = i, 0
        size += len(text or b"")
    add(len(texts))
    edge = np.cumsum([0, *[len(p.index) for p in parts]])
    bounds = np.concatenate([[0], *[p.bounds[1:] + e for p, e in zip(parts, edge)]])
    return Features(np.concatenate([p.index for p in parts]), np.concatenate([p.value for p in parts]), bounds, np.concatenate([p.words for p in parts]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: Features, grade: np.ndarray, weight: np.ndarray, grades: int, steps: int = STEPS, min_rows: int = MIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thresholds) by adaptive stochastic gradient on the weighted log-likelihood."""
    w, g2 = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-8)
    share = np.cumsum(np.bincount(grade, weight, grades))[:-1] / weight.sum()
    share = np.clip(share, 1e-4, 1 - 1e-4)
    t = np.log(share / (1 - share))
    t = np.maximum.accumulate(t + 1e-3 * np.arange(grades - 1))
    t2 = np.full(grades - 1, 1e-8)
    held = np.bincount(rows.index, minlength=DIMENSIONS)
    rows = Features(rows.index, np.where(held[rows.index] >= min_rows, rows.value, rows.value.dtype.type(0)), rows.bounds, rows.words)
    draw = np.random.default_rng(1)
    parts = max(1, len(grade) // BATCH)
    for _ in range(-(-steps // parts)):
        for rows_now in np.array_split(draw.permutation(len(grade)), parts):
            size = np.diff(rows.bounds)[rows_now]
            at = np.repeat(rows.bounds[rows_now] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            index, value = rows.index[at], rows.value[at]
            f = np.bincount(np.repeat(np.arange(len(rows_now)), size), w[index] * value, len(rows_now))
            y, c = grade[rows_now], weight[rows_now]
            high = np.where(y < grades - 1, _sigmoid(t[np.minimum(y, grades - 2)] - f), 1.0)
            low = np.where(y > 0, _sigmoid(t[np.maximum(y - 1, 0)] - f), 0.0)
            p = np.maximum(high - low, 1e-9)
            d_high, d_low = high * (1 - high), low * (1 - low)
            push = c * (d_high - d_low) / p  # minus the derivative of log p by f
            grad = np.bincount(index, np.repeat(push, size) * value, DIMENSIONS) / len(rows_now)
            used = np.flatnonzero(grad)
            g2[used] += grad[used] ** 2
            w[used] -= RATE * (grad[used] / np.sqrt(g2[used]) + DECAY * w[used])
            pull = np.bincount(np.minimum(y, grades - 2), np.where(y < grades - 1, -c * d_high / p, 0), grades - 1)
            pull += np.bincount(np.maximum(y - 1, 0), np.where(y > 0, c * d_low / p, 0), grades - 1)
            pull /= len(rows_now)
            t2 += pull**2
            t = np.maximum.accumulate(t - 0.1 * pull / np.sqrt(t2) + 1e-9 * np.arange(grades - 1))
    return w, t


def grade_of(quality: str = "quality", toxic: str = "toxic"):
    """Grade from two binary labels: 0 toxic, 1 poor, 2 good; null where a label is missing."""
    return F.when(F.col(toxic).isNull() | F.col(quality).isNull(), None).when(F.col(toxic) > 0, 0).when(F.col(quality) > 0, 2).otherwise(1)


def learn(docs: DataFrame, rated: DataFrame, fit_rows: int = FIT_ROWS, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, int]:
    """(weights, thresholds, grades) from ``rated`` (doc_id, grade 0, 1, ...) and the texts of ``docs``.

    With a single grade there are no thresholds and ``grades`` - 1 is that grade.
    """
    rated = rated.select(F.col("doc_id").alias("rated_id"), F.col("grade").cast("int").alias("grade")).where("grade >= 0 and rated_id is not null")
    counts = {r.grade: r["count"] for r in rated.groupBy("grade").count().collect()}
    if not counts:
        return np.zeros(1), np.zeros(0), 1
    grades = max(counts) + 1
    sample = None
    for grade in sorted(counts):
        part = rated.where(F.col("grade") == grade).orderBy(F.xxhash64(F.lit(7), "rated_id"), "rated_id").limit(fit_rows)
        sample = part if sample is None else sample.union(part)
    rows = docs.select(F.col("doc_id").alias("rated_id"), "text").where("text is not null")
    # The sample's rows are bounded by a parameter, a few bytes each.
    texts = rows.join(F.broadcast(sample), "rated_id").select("rated_id", "text", "grade")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rated_id", "ascending"), ("grade", "ascending")])
        grade = table["grade"].to_numpy().astype(np.int64)
        took = np.bincount(grade, minlength=grades)
        weight = np.array([counts.get(k, 0) / max(took[k], 1) for k in range(grades)])[grade]
        w, t = fit(features_by_slices(column_bytes(table, "text")), grade, weight / weight.mean(), grades, steps)
        return pa.table({"weights": [w.astype("<f4").tobytes()], "thresholds": [t.astype("<f8").tobytes()]})

    if len(counts) < 2:
        return np.zeros(1), np.zeros(0), grades
    row = texts.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: run(t.drop_columns(["all"]) if "all" in t.column_names else t), "weights binary, thresholds binary").first()
    if row is None:
        return np.zeros(1), np.zeros(0), 1
    return np.frombuffer(row.weights, "<f4").astype(float), np.frombuffer(row.thresholds, "<f8"), grades


def rate(rows: DataFrame, model: tuple[np.ndarray, np.ndarray, int], wanted: int = 2) -> DataFrame:
    """``rows`` (some columns and text) with expected_grade and tail = P(grade >= ``wanted``) for text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds, grades = shared.value
        for batch, texts in slices(batches, "text"):
            rest = batch.drop_columns(["text"])
            if len(thresholds):
                x = features(texts)
                above = 1 - _sigmoid(thresholds[None, :] - x.score(weights)[:, None])
                some = x.words > 0
                expected, tail = above.sum(axis=1) * some, (above[:, wanted - 1] if wanted <= len(thresholds) else np.zeros(len(some))) * some
            else:
                some = np.array([bool((t or b"").split()) for t in texts])
                expected, tail = some * float(grades - 1), some * float(grades - 1 >= wanted)
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], [*rest.schema.names, "expected_grade", "tail"])

    from pyspark.sql import types as T

    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"])
    return rows.mapInArrow(run, schema.add("expected_grade", "double").add("tail", "double"))


def held_out(column: str = "doc_id"):
    """Every fifth document by crc32 of its id as text takes no part in fitting."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def quality_grades(docs: DataFrame, labels: DataFrame, select: float = SELECT) -> DataFrame:
    """(doc_id, held_out, expected_grade, tail, kept) of every document; ``tail`` is the probability of the best grade."""
    model = learn(docs, labels.where(~held_out()).select("doc_id", grade_of().alias("grade")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rate(rows, model).withColumn("kept", F.col("tail") >= select)


def select_quality(docs: DataFrame, rated: DataFrame, select: float = SELECT) -> DataFrame:
    """The rows of ``docs`` that reach grade 2 with probability ``select``, columns unchanged."""
    rows = rate(packed(docs, text=F.col("text")), learn(docs, rated))
    return unpacked(rows.where(F.col("tail") >= select), docs)
