"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks.

Prose compresses within a narrow band that widens with length. A ratio above the band means
repetition (templates, loops, symbol runs), one below it means noise (keys, encoded data). The whole text
is judged against limits for its length, each chunk against one pair of limits, both wider where characters take several bytes, so that a loop in part of a
long document shows although the whole stays within its band. Every byte lies in a chunk: the last one ends
with the text and may overlap the one before.

Upper limits come from the table: robust quantiles of each class of length and bytes a character, within fixed margins.
So there are two passes over the rows, with a shuffle of one small row a class and task; memory is one slice of texts.

Defined cases. A missing text has no words and fails the base rule, as an empty one does. Equal texts get equal
results. A very long text is a slice of its own and is cut into chunks like any other. Further columns are carried. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import packed, unpacked
from millrace.llm.text import SLICE_BYTES, slices, windows_of, words_of

LEVEL = 3
CHUNK = 1024
#: (bytes at least, lowest ratio, highest ratio that is never rejected, highest ratio that is ever kept) of whole texts in
#: one-byte characters. Between the last two the table decides. Long prose that takes up its own phrases again (licences,
#: contracts) reaches 3.0; what is repeated in a loop lies far above.
BANDS = (
    (0, 0.0, 2.2, 2.2),
    (128, 0.9, 2.2, 2.2),
    (512, 1.15, 2.2, 2.3),
    (1024, 1.3, 2.35, 2.6),
    (2048, 1.4, 2.4, 2.9),
    (4096, 1.5, 2.5, 3.2),
    (8192, 1.6, 2.6, 3.4),
    (16384, 1.7, 2.7, 3.6),
    (65536, 1.8, 3.0, 4.0),
)
#: The same of chunks.
CHUNK_BAND = (1.4, 2.05, 2.6)
#: A limit found in the table lies this many deviations (from the upper quartile) above the median, and counts against the
#: widest limit as the class's documents against PRIOR.
DEVIATIONS, PRIOR = 5.0, 50.0
#: How far limits move for each byte that the text's characters take on average beyond one: alphabets of two bytes
#: compress better, since the first byte tells little; scripts of many signs compress less.
HIGHER, LOWER = 0.3, 0.15
#: Share of chunks outside their band from which a text is rejected.
CHUNK_SHARE = 0.1
MIN_WORDS = 50
REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, chunks long, chunks_out long, kept boolean"
)


def duplicate_lines(text: bytes) -> int:
    """Lines that hold a word and equal an earlier line of the text."""
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def ratios(text: bytes, pack: zstandard.ZstdCompressor, chunk: int = CHUNK) -> tuple[float, list[float]]:
    """Ratio of the whole text and of its chunks; texts shorter than a chunk have none."""
    if not text:
        return 0.0, []
    whole = len(text) / len(pack.compress(text))
    if len(text) < chunk:
        return whole, []
    starts = [*range(0, len(text) - chunk + 1, chunk)]
    if len(text) % chunk:
        starts.append(len(text) - chunk)
    return whole, [chunk / len(pack.compress(text[s : s + chunk])) for s in starts]


def class_of(size: int, width: float) -> tuple[int, int]:
    """(half octave of the size, half bytes a character): at most some hundred classes."""
    return int(2 * np.log2(max(size, 1))), int(2 * width)


@dataclass(frozen=True)
class Bands:
    """Limits by length and bytes a character; ``tops`` and ``chunk_tops`` are those that the table gives.

    Without them the widest limits hold.
    """

    tops: dict[tuple[int, int], float] = field(default_factory=dict)
    chunk_tops: dict[int, float] = field(default_factory=dict)

    @staticmethod
    def _widened(low: float, safe: float, top: float, width: float, found: float | None) -> tuple[float, float]:
        more = 1 + HIGHER * (width - 1)
        high = top * more if found is None else min(max(found, safe * more), top * more)
        return low / (1 + LOWER * (width - 1)), high

    def whole(self, size: int, width: float) -> tuple[float, float]:
        band = next(b[1:] for b in reversed(BANDS) if size >= b[0])
        return self._widened(*band, width, self.tops.get(class_of(size, width)))

    def chunk(self, width: float) -> tuple[float, float]:
        return self._widened(*CHUNK_BAND, width, self.chunk_tops.get(class_of(1, width)[1]))


WIDEST = Bands()


def in_bands(size: int, whole: float, outside: int, chunks: int, bands: Bands = WIDEST, share: float = CHUNK_SHARE, width: float = 1.0) -> bool:
    """The verdict on a text of ``size`` bytes, ``width`` of them a character."""
    low, high = bands.whole(size, width)
    return low <= whole <= high and (not chunks or outside < share * chunks)


def measure(texts: list[bytes | None], bands: Bands = WIDEST, share: float = CHUNK_SHARE, chunk: int = CHUNK) -> dict[str, np.ndarray | list]:
    """The columns of SCHEMA for several texts, bytes a character and the ratio of each chunk."""
    texts = [t or b"" for t in texts]
    n = len(texts)
    words = words_of(texts)
    n_words = words.counts
    # Code points: bytes that do not continue a character.
    lead = np.concatenate(([0], np.cumsum((words.buffer & 0xC0) != 0x80)))
    chars = np.concatenate(([0], np.cumsum(lead[words.ends] - lead[words.starts])))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[words.buffer])))
    edge = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    hashes, owner = windows_of(words, 3)
    mine = hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, inverse, times = np.unique(mine, return_inverse=True, return_counts=True)
    repeated = np.zeros(len(words.hashes) + 1, np.int64)
    # A window's place among all words: whole windows leave out the last two words of each text.
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    place = words.bounds[owner] + rank
    hit = place[times[inverse] > 1]
    cover = np.zeros(len(words.hashes) + 4, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 3, -1)
    repeated[1:] = np.cumsum(np.cumsum(cover)[: len(words.hashes)] > 0)
    n_repeat = repeated[words.bounds[1:]] - repeated[words.bounds[:-1]]
    pack = zstandard.ZstdCompressor(level=LEVEL)
    whole, chunks, outside = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    verdict, widths, all_chunks = np.zeros(n, bool), np.ones(n), []
    for i, text in enumerate(texts):
        whole[i], each = ratios(text, pack, chunk)
        chunks[i] = len(each)
        width = len(text) / max(1, lead[edge[i] + len(text)] - lead[edge[i]])
        low, high = bands.chunk(width)
        widths[i] = width
        all_chunks.append(each)
        outside[i] = sum(not low <= r <= high for r in each)
        verdict[i] = in_bands(len(text), whole[i], outside[i], chunks[i], bands, share, width)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": chars[words.bounds[1:]] - chars[words.bounds[:-1]],
        "n_symbols": symbols[edge[1:]] - symbols[edge[:-1]],
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "ratio": whole,
        "chunks": chunks,
        "chunks_out": outside,
        "kept": verdict & ~failed,
        "width": widths,
        "chunk_ratios": all_chunks,
    }


def learn_bands(docs: DataFrame) -> Bands:
    """Upper limits from all texts that pass the base rule: one aggregate over a row for each text and chunk.

    A class's limit moves from the widest to the found one with its number of documents; copies of one junk text can
    neither lower it below the safe limit nor lift it above the widest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, "text", SLICE_BYTES):
            out = measure(texts)
            length, wide, ratio = [], [], []
            for text, failed, whole, width, each in zip(texts, out["base_failed"], out["ratio"], out["width"], out["chunk_ratios"]):
                if not failed:
                    own = class_of(len(text), width)
                    length += [own[0], *[-1] * len(each)]
                    wide += [own[1]] * (len(each) + 1)
                    ratio += [whole, *each]
            yield pa.RecordBatch.from_arrays([pa.array(length, pa.int32()), pa.array(wide, pa.int32()), pa.array(ratio, pa.float64())], ["length", "wide", "ratio"])

    seen = docs.where("text IS NOT NULL").select("text").mapInArrow(run, "length int, wide int, ratio double")
    rows = seen.groupBy("length", "wide").agg(F.count("*").alias("n"), F.percentile_approx("ratio", [0.5, 0.75], 1_000).alias("q")).collect()  # a row a class
    tops, chunk_tops = {}, {}
    for r in rows:
        middle, upper = r["q"]
        found = middle + DEVIATIONS * (upper - middle) / 0.6745
        if r["length"] < 0:
            widest = WIDEST.chunk(r["wide"] / 2 + 0.25)[1]
            chunk_tops[r["wide"]] = (r["n"] * found + PRIOR * widest) / (r["n"] + PRIOR)
        else:
            widest = WIDEST.whole(int(2 ** (r["length"] / 2)), r["wide"] / 2 + 0.25)[1]
            tops[(r["length"], r["wide"])] = (r["n"] * found + PRIOR * widest) / (r["n"] + PRIOR)
    return Bands(tops, chunk_tops)


def compression_rules(docs: DataFrame, bands: Bands | None = None, share: float = CHUNK_SHARE) -> DataFrame:
    """(id, measures and verdict) for each row of ``docs``; bands are found in ``docs`` when not given."""
    bands = bands if bands is not None else learn_bands(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", SLICE_BYTES):
            out = measure(texts, bands, share)
            del out["width"], out["chunk_ratios"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out.values())], ["id", *out])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, f"id long, {SCHEMA}")


def quality_report(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, counts, ratios, base_failed, kept), a row for each document."""
    return compression_rules(docs, **limits).withColumnRenamed("id", "doc_id")


def quality_filter(docs: DataFrame, bands: Bands | None = None, share: float = CHUNK_SHARE) -> DataFrame:
    """The rows of ``docs`` whose text passes the rules, columns unchanged."""
    bands = bands if bands is not None else learn_bands(docs)

    @F.pandas_udf("boolean")
    def passes(text):
        import pandas as pd

        out = np.zeros(len(text), bool)
        raw = [None if t is None else t.encode() for t in text]
        at = 0
        while at < len(raw):
            end, size = at, 0
            while end < len(raw) and (end == at or size + len(raw[end] or b"") <= SLICE_BYTES):
                size += len(raw[end] or b"") + 16
                end += 1
            out[at:end] = measure(raw[at:end], bands, share)["kept"]
            at = end
        return pd.Series(out)

    return unpacked(packed(docs, text=F.col("text")).where(passes("text")), docs)
