"""Words of whole texts as arrays: shared by the operators that run numpy inside tasks.

A word is a maximal run of bytes other than the six ASCII white-space characters. Texts are UTF-8
bytes, so lower-casing A-Z is a table over bytes and never touches other letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = " \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 21
PART_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[list(WHITE.encode())] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0xD1342543DE82EF95)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of several texts in order; ``bounds[i]:bounds[i + 1]`` are those of text i."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    buffer: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words_of(texts: list[bytes | None], lower: bool = False, gaps: np.ndarray = _SPACE) -> Words:
    """Positions and 64-bit fingerprints of all words of ``texts`` (None has none); ``gaps`` marks the bytes between words.

    The fingerprint is a polynomial in an odd base over the word's bytes, and mixed; equal words have equal
    fingerprints wherever they stand. Texts are taken PART_BYTES at a time, since the work needs several
    numbers a byte.
    """
    parts, start, size = [], 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text or b"") > PART_BYTES:
            parts.append(_words_of(texts[start:i], lower, gaps))
            start, size = i, 0
        size += len(text or b"") + 1
    parts.append(_words_of(texts[start:], lower, gaps))
    if len(parts) == 1:
        return parts[0]
    words = np.cumsum([0, *[len(p.hashes) for p in parts]])
    place = np.cumsum([0, *[len(p.buffer) for p in parts]])
    return Words(
        np.concatenate([p.hashes for p in parts]),
        np.concatenate([[0], *[p.bounds[1:] + w for p, w in zip(parts, words)]]),
        np.concatenate([p.starts + b for p, b in zip(parts, place)]),
        np.concatenate([p.ends + b for p, b in zip(parts, place)]),
        np.concatenate([p.buffer for p in parts]),
    )


def _words_of(texts: list[bytes | None], lower: bool = False, gaps: np.ndarray = _SPACE) -> Words:
    texts = [t or b"" for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        buffer = _LOWER[buffer]
    gap = gaps[buffer]
    inside = ~gap
    starts = np.flatnonzero(inside & np.concatenate(([True], gap[:-1])))
    ends = np.flatnonzero(gap & np.concatenate(([False], inside[:-1])))
    # Powers restart at every word: the position within it, so that no inverse is needed.
    length = ends - starts
    hashes = np.zeros(len(starts), np.uint64)
    if len(starts):
        owner = np.cumsum(inside & np.concatenate(([True], gap[:-1])))[inside] - 1
        place = np.flatnonzero(inside) - starts[owner]
        power = _powers(int(length.max()), _BASE)
        terms = (buffer[inside].astype(np.uint64) + np.uint64(1)) * power[place]
        hashes = np.add.reduceat(terms, np.cumsum(length) - length)
        hashes = mix(hashes + length.astype(np.uint64) * _MIX)
    edge = np.concatenate(([0], np.cumsum(sizes)))
    return Words(hashes, np.searchsorted(starts, edge), starts, ends, buffer)


def windows_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of the ``n`` words from each position, text it lies in), whole windows only, in order."""
    total = len(words.hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(total, np.uint64)
    for k in range(n):
        h = (h + words.hashes[k : k + total]) * _MIX
        h ^= h >> np.uint64(29)
    owner = words.owner
    whole = owner[:total] == owner[n - 1 :]
    return mix(h[whole]), owner[:total][whole]


def column_bytes(batch: pa.RecordBatch | pa.Table, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Record batches cut so that each holds about ``most`` bytes of text, one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_pylist()
        start, size = 0, 0
        for i, length in enumerate([*lengths, None]):
            if i > start and (length is None or size + length > most):
                part = batch.slice(start, i - start)
                yield part, column_bytes(part, name)
                start, size = i, 0
            size += (length or 0) + 16
    # The worker lives on: what this task freed goes back to the system.
    pa.default_memory_pool().release_unused()
