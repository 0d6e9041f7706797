"""Substring dedup by prefix-partitioned suffix trees.

A repeat of ``window`` words is a node of that depth in the corpus's suffix tree with leaves in several
documents. The tree is never in one place: its suffixes are split by prefixes into groups of bounded size, and
each group builds its subtree, as a sorted suffix array with common-prefix lengths cut at ``window`` words.

Which suffixes are worth a subtree is settled by prefix counts. Of the GRAM-word prefixes inside a window the one
with the smallest fingerprint is its anchor, so equal windows have equal anchors at equal offsets. Blocks of
documents send their distinct anchors to ranges (``blocks``) and learn which ones occur in several documents; all
other suffixes have no cross-document repeat and are done. The rest go, with the words that their windows
cover, to the group of their prefix: the anchor, or, for anchors met in more than GROUP places, the whole
window, a longer prefix that splits the heavy group. A block sends equal content once, with its smallest
document id, so a passage that a third of all documents share costs one entry a block.

Each group answers, for every window it was sent, the smallest document id that holds it; the blocks mark covered
words and rebuild their texts. Shuffled: texts once, distinct anchors once, repeated windows once.

Defined cases. A missing or empty text has no words. A missing id comes after all others; rows without an id, like
repeated rows of one id, count as one document, whose windows are not repeats of each other. Windows do not
cross texts. A text without removals keeps its words, joined by one space. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.blocks import BLOCK_BYTES, blocked, by_range, from_planes, from_sorted_keys, planes, sorted_keys
from millrace.llm.frames import LAST_ID
from millrace.llm.text import Words, column_bytes, mix, windows_of, words_of

WINDOW = 13
GRAM = 4
#: Places of an anchor beyond which its group is split by whole windows.
GROUP = 50_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def anchors_of(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window: its first word, its offset to the anchor, and the anchor's fingerprint."""
    total = len(words.hashes) - window + 1
    if total <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    h = np.zeros(len(words.hashes) - gram + 1, np.uint64)
    for k in range(gram):
        h = (h + words.hashes[k : k + len(h)]) * _ODD
        h ^= h >> np.uint64(29)
    h = mix(h)
    best, offset = h[:total].copy(), np.zeros(total, np.int8)
    for k in range(1, window - gram + 1):
        other = h[k : k + total]
        less = other < best
        best[less] = other[less]
        offset[less] = k
    owner = words.owner
    starts = np.flatnonzero(owner[:total] == owner[window - 1 :])
    return starts, offset[starts].astype(np.int64), best[starts]


def deep_nodes(suffixes: np.ndarray) -> np.ndarray:
    """Node of each suffix at the depth of the array's width: suffixes with a common prefix that long share one.

    The rows are sorted into a suffix array; where the common prefix of neighbours is shorter than the
    width, a new node begins.
    """
    order = np.lexsort(suffixes.T[::-1])
    ranked = suffixes[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(fresh) - 1
    return node


class _Runs:
    """The windows of one block whose anchor is shared, as runs of neighbours with one anchor place."""

    def __init__(self, words: Words, ids: np.ndarray, window: int, gram: int, flags: tuple[np.ndarray, np.ndarray]) -> None:
        starts, offset, anchor = anchors_of(words, window, gram)
        keys, state = flags
        code = state[np.searchsorted(keys, anchor)] if len(anchor) else np.zeros(0, np.uint64)
        use = code > 0
        starts, offset, anchor, heavy = starts[use], offset[use], anchor[use], code[use] > 1
        place = starts + offset
        # Neighbouring windows with one anchor place make a run; windows of heavy anchors stand alone.
        first = np.ones(len(starts), bool)
        first[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1) | heavy[1:]
        self.at = np.flatnonzero(first)
        self.sizes = np.diff(np.append(self.at, len(starts)))
        self.starts, self.window = starts, window
        self.begin, self.lead = starts[self.at], offset[self.at]
        self.anchor, self.heavy = anchor[self.at], heavy[self.at]
        self.ids = ids[words.owner[self.begin]] if len(self.begin) else np.zeros(0, np.int64)
        self._identify(words)

    def _identify(self, words: Words) -> None:
        """Fingerprint of each run's content and place of its anchor; the smallest id stands for equal ones."""
        length = self.sizes + self.window - 1
        owner = np.repeat(np.arange(len(length)), length)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
        self.flat = np.repeat(self.begin, length) + within
        terms = mix(words.hashes[self.flat] + (within.astype(np.uint64) + np.uint64(1)) * _ODD) if len(owner) else np.zeros(0, np.uint64)
        content = np.add.reduceat(terms, np.cumsum(length) - length) if len(length) else np.zeros(0, np.uint64)
        content = mix(content + self.lead.astype(np.uint64) * _ODD + length.astype(np.uint64))
        key = np.where(self.heavy, content, self.anchor)
        order = np.lexsort((self.ids, content, key))
        self.key, self.order = key, order
        k, c = key[order], content[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        self.group = np.cumsum(fresh) - 1
        self.sent = order[fresh]
        self.length = length


def _flags(told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the shared anchors of a block and their state."""
    parts = [(from_sorted_keys(k), from_planes(s)) for k, s, kind in zip(told["keys"].to_pylist(), told["state"].to_pylist(), told["kind"].to_pylist()) if kind == 0]
    keys = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)])
    state = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.uint64)])
    order = np.argsort(keys)
    return keys[order], state[order]


def _states(flags: tuple[np.ndarray, np.ndarray], anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All anchors of a block and their states; those not told have state 0."""
    found = np.unique(anchors)
    keys, state = flags
    out = np.zeros(len(found), np.uint64)
    if len(keys) and len(found):
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        hit = keys[at] == found
        out[hit] = state[at[hit]]
    return found, out


_ASKED = "range long, block long, keys binary, places binary"
_TOLD = "block long, range long, kind int, keys binary, state binary"
_SENT = "range long, block long, runs long, ids binary, heavy binary, leads binary, sizes binary, words binary"


def substring_report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, text): the words not covered by a repeat of a smaller document, joined by a space."""
    rows, n = blocked(docs, block_bytes)

    def ask(table: pa.Table) -> pa.Table:
        """Distinct anchors of a block; places counts them twice, plus one if several documents hold the anchor."""
        words = words_of(column_bytes(table, "text"))
        ids = table["id"].to_numpy()
        starts, offset, anchor = anchors_of(words, window, gram)
        place = starts + offset
        once = np.ones(len(place), bool)
        once[1:] = place[1:] != place[:-1]
        anchor, owner = anchor[once], ids[words.owner[place[once]]] if len(place) else ids[:0]
        order = np.argsort(anchor, kind="stable")
        anchor, owner = anchor[order], owner[order]
        fresh = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, np.int64)
        keys = anchor[fresh]
        if len(keys):
            times = np.diff(np.append(fresh, len(anchor)))
            several = np.minimum.reduceat(owner, fresh) < np.maximum.reduceat(owner, fresh)
            places = (2 * times + several).astype(np.uint64)
        else:
            places = np.zeros(0, np.uint64)
        block = table["block"][0].as_py()
        out = [(r, block, sorted_keys(keys[a:b]), planes(places[a:b])) for r, a, b in by_range(keys, n)]
        return _table(("range", "block", "keys", "places"), out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))

    def tell(table: pa.Table) -> pa.Table:
        """For each block its anchors that lie in several documents; state 2 marks those met too often."""
        keys = [from_sorted_keys(k) for k in table["keys"].to_pylist()]
        places = np.concatenate([from_planes(p) for p in table["places"].to_pylist()])
        found, code, blocks = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        times = np.bincount(code, (places >> np.uint64(1)).astype(float), len(found))
        several = (blocks > 1) | (np.bincount(code, (places & np.uint64(1)).astype(float), len(found)) > 0)
        state = (several * (1 + (times > group))).astype(np.uint64)[code]
        edge, out = np.cumsum([0, *map(len, keys)]), []
        for block, part, own, a, b in zip(table["block"].to_pylist(), table["range"].to_pylist(), keys, edge[:-1], edge[1:]):
            use = state[a:b] > 0
            if use.any():
                out.append((block, part, 0, sorted_keys(own[use]), planes(state[a:b][use])))
        return _told(out)

    def runs_of(texts: pa.Table, told: pa.Table) -> tuple[Words, _Runs]:
        words = words_of(column_bytes(texts, "text"))
        states = _states(_flags(told), anchors_of(words, window, gram)[2])
        return words, _Runs(words, texts["id"].to_numpy(), window, gram, states)

    def send(texts: pa.Table, told: pa.Table) -> pa.Table:
        """The distinct runs of a block, by the range of their prefix."""
        out = []
        if len(texts):
            words, runs = runs_of(texts, told)
            block = texts["block"][0].as_py()
            edge = np.cumsum(runs.length) - runs.length
            for r, a, b in by_range(runs.key[runs.sent], n):
                use = runs.sent[a:b]
                flat = np.concatenate([runs.flat[edge[i] : edge[i] + runs.length[i]] for i in use])
                out.append(
                    (r, block, b - a, runs.ids[use].astype("<i8").tobytes(), runs.heavy[use].astype(np.uint8).tobytes(),
                     runs.lead[use].astype(np.uint8).tobytes(), planes(runs.sizes[use]), words.hashes[flat].tobytes())
                )
        kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5)
        return _table(("range", "block", "runs", "ids", "heavy", "leads", "sizes", "words"), out, kinds)

    def grow(table: pa.Table) -> pa.Table:
        """Subtrees of one range; for each window sent, whether a smaller document holds it."""
        ids = np.concatenate([np.frombuffer(x, "<i8") for x in table["ids"].to_pylist()])
        leads = np.concatenate([np.frombuffer(x, np.uint8) for x in table["leads"].to_pylist()]).astype(np.int64)
        sizes = [from_planes(x).astype(np.int64) for x in table["sizes"].to_pylist()]
        hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in table["words"].to_pylist()])
        per_block = [int(s.sum()) for s in sizes]
        size = np.concatenate(sizes)
        length = size + window - 1
        first = np.repeat(np.cumsum(length) - length, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        own = np.repeat(ids, size)
        # The offset to the anchor is part of the window, so equal words always have equal offsets.
        smallest = _smallest(hashes, first, own, window)
        hit = smallest < own
        edge, out = np.cumsum([0, *per_block]), []
        for block, part, a, b in zip(table["block"].to_pylist(), table["range"].to_pylist(), edge[:-1], edge[1:]):
            out.append((block, part, 1, b"", planes(hit[a:b].astype(np.uint64))))
        return _told(out)

    def cut(texts: pa.Table, told: pa.Table) -> pa.Table:
        """The texts of a block without the words that the answers cover."""
        if not len(texts):
            return pa.table({"id": texts["id"], "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
        words, runs = runs_of(texts, told)
        hit = np.zeros(len(runs.starts), bool)
        parts = sorted(zip(told["range"].to_pylist(), told["state"].to_pylist(), told["kind"].to_pylist()), key=lambda x: x[0])
        answers = [from_planes(s) for _, s, kind in parts if kind == 1]
        if answers and len(runs.sent):
            answer = np.concatenate(answers) > 0
            size = runs.sizes[runs.sent]
            begin = np.cumsum(size) - size
            # Runs of equal content take the answer of the one that was sent; all windows of later documents go.
            for_run = np.empty(len(runs.order), np.int64)
            for_run[runs.order] = runs.group
            within = np.arange(len(runs.starts)) - np.repeat(runs.at, runs.sizes)
            group_of = np.repeat(for_run, runs.sizes)
            later = np.repeat(runs.ids, runs.sizes) > runs.ids[runs.sent][group_of]
            hit = answer[begin[group_of] + within] | later
        cover = np.zeros(len(words.hashes) + window + 1, np.int64)
        np.add.at(cover, runs.starts[hit], 1)
        np.add.at(cover, runs.starts[hit] + window, -1)
        gone = np.cumsum(cover)[: len(words.hashes)] > 0
        sums = np.concatenate(([0], np.cumsum(gone)))
        removed = sums[words.bounds[1:]] - sums[words.bounds[:-1]]
        kept = []
        for i, text in enumerate(column_bytes(texts, "text")):
            own = text.split()
            if removed[i]:
                own = compress(own, (~gone[words.bounds[i] : words.bounds[i + 1]]).tolist())
            kept.append(b" ".join(own))
        text = pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
        return pa.table({"id": texts["id"], "n_words": words.counts, "n_removed": removed, "text": text})

    told = rows.groupBy("block").applyInArrow(ask, _ASKED).groupBy("range").applyInArrow(tell, _TOLD)
    sent = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(send, _SENT)
    grown = sent.groupBy("range").applyInArrow(grow, _TOLD)
    done = rows.groupBy("block").cogroup(told.union(grown).groupBy("block")).applyInArrow(cut, "id long, n_words long, n_removed long, text string")
    return done.select(F.when(F.col("id") == LAST_ID, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), "n_words", "n_removed", "text")


def _smallest(hashes: np.ndarray, first: np.ndarray, ids: np.ndarray, window: int, most: int = 1 << 19) -> np.ndarray:
    """Smallest id of each window's node; windows are sorted in parts of equal leading words, about ``most`` at a time."""
    out = np.empty(len(first), np.int64)
    lead = hashes[first]
    order = np.argsort(lead, kind="stable")
    begin = 0
    while begin < len(order):
        end = min(begin + most, len(order))
        if end < len(order):
            end = int(np.searchsorted(lead[order], lead[order[end - 1]], "right"))
        part = order[begin:end]
        node = deep_nodes(hashes[first[part][:, None] + np.arange(window)])
        least = np.full(int(node.max()) + 1, LAST_ID)
        np.minimum.at(least, node, ids[part])
        out[part] = least[node]
        begin = end
    return out


def _table(names: tuple, rows: list[tuple], kinds: tuple) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=list(names))


def _told(rows: list[tuple]) -> pa.Table:
    return _table(("block", "range", "kind", "keys", "state"), rows, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))
