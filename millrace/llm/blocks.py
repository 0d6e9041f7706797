"""Exchange between blocks of documents and ranges of a key space.

Operators that need corpus-wide facts about every n-gram of every text cut the table into blocks of
about equal bytes by a hash of id and text. A block sends each of its distinct keys once to the range that
the key lies in, as sorted keys with numbers; the range answers every block with one number per key in
the same order. A hot key costs one entry a block, and a range holds its share of the key space whatever
the keys' frequencies. Sorted keys travel as byte planes of their gaps, so the empty high bytes vanish in
the shuffle's compression; answers travel without keys, because the block can list its keys again.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import ordered_id

BLOCK_BYTES = 8 << 20


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, id, text) of every row, and the number of blocks; a missing id comes last, a missing text is empty."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    rows = docs.select(ordered_id().alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(n)).alias("block"), "id", "text"), n


def planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes: the lowest bytes of all, then the next ones, as many as are needed."""
    values = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(blob: bytes) -> np.ndarray:
    width = blob[0]
    body = np.frombuffer(blob, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((body.shape[1], 8), np.uint8)
    out[:, :width] = body.T
    return out.reshape(-1).view(np.uint64)


def sorted_keys(keys: np.ndarray) -> bytes:
    """Ascending unsigned keys by their gaps."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def from_sorted_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(from_planes(blob), dtype=np.uint64)


def range_edges(n: int) -> np.ndarray:
    """First keys of ``n`` equal ranges of the 64-bit key space."""
    return np.array([(r << 64) // n for r in range(n)], np.uint64)


def by_range(keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(range, first, end) of the non-empty ranges of ascending ``keys``."""
    edges = np.append(np.searchsorted(keys, range_edges(n)), len(keys))
    return [(r, int(a), int(b)) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
