"""A double-array trie over word codes, built and walked with numpy.

Every word has a code, written in a fixed number of base-256 digits; a phrase is the digits of its words. A state is a
slot; its child by digit d is slot ``base[state] + d`` if ``check`` there names the state. States with many children
get windows of their own, the others are placed in rounds of random bases, all at once, wherever their slots are free.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

WIDE = 32
ROUNDS = 24


@dataclass
class DoubleArray:
    """``words`` are the ascending fingerprints of the words that occur; ``accept`` is a slot's phrase or -1."""

    words: np.ndarray
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray
    n_phrases: int

    def codes(self, fingerprints: np.ndarray) -> np.ndarray:
        """Codes of words, -1 for those that no phrase holds."""
        if not len(self.words):
            return np.full(len(fingerprints), -1)
        at = np.minimum(np.searchsorted(self.words, fingerprints), len(self.words) - 1)
        return np.where(self.words[at] == fingerprints, at, -1)

    def counts(self, fingerprints: np.ndarray, piece: np.ndarray, longest: int) -> np.ndarray:
        """Occurrences of every phrase among the words, within pieces; all positions advance together, a word a level."""
        codes, found = self.codes(fingerprints), np.zeros(self.n_phrases, np.int64)
        start = np.flatnonzero(codes >= 0)
        state = np.zeros(len(start), np.int64)
        for level in range(longest):
            at = start + level
            live = at < len(codes)
            start, state, at = start[live], state[live], at[live]
            live = (codes[at] >= 0) & (piece[at] == piece[start])
            start, state, code = start[live], state[live], codes[at[live]]
            for shift in shifts(len(self.words)):
                slot = self.base[state] + ((code >> shift) & 255)
                live = self.check[slot] == state
                start, state, code = start[live], slot[live], code[live]
            if not len(start):
                break
            done = self.accept[state]
            found += np.bincount(done[done >= 0], minlength=self.n_phrases)
        return found

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, words=self.words, base=self.base, check=self.check, accept=self.accept, n_phrases=self.n_phrases)
        return out.getvalue()

    @staticmethod
    def unpack(blob: bytes) -> DoubleArray:
        with np.load(io.BytesIO(blob)) as parts:
            return DoubleArray(parts["words"], parts["base"], parts["check"], parts["accept"], int(parts["n_phrases"]))


def shifts(n_words: int) -> list[int]:
    """Shifts that give a code's base-256 digits, the highest first."""
    n_digits = max(1, (max(n_words - 1, 0).bit_length() + 7) // 8)
    return [8 * k for k in reversed(range(n_digits))]


def build(phrases: list[np.ndarray]) -> DoubleArray:
    """Trie of distinct phrases, each an array of word fingerprints."""
    sizes = np.array([len(p) for p in phrases], np.int64)
    words, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *phrases]), return_inverse=True)
    first = np.cumsum(sizes) - sizes
    state = np.zeros(len(phrases), np.int64)
    parents, kinds, n_states = [], [], 1
    for word in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > word)
        code = flat[first[live] + word]
        for shift in shifts(len(words)):
            edges, child = np.unique(state[live] * 256 + ((code >> shift) & 255), return_inverse=True)
            parents.append(edges >> 8)
            kinds.append(edges & 255)
            state[live] = n_states + child
            n_states += len(edges)
    parent = np.concatenate([np.zeros(0, np.int64), *parents])
    kind = np.concatenate([np.zeros(0, np.int64), *kinds])
    base_of, slot_of, size = _placed(parent, kind, n_states)
    base, check, accept = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    base[slot_of] = base_of
    check[slot_of[1:]] = slot_of[parent]
    accept[slot_of[state]] = np.arange(len(phrases))
    return DoubleArray(words, base, check, accept, len(phrases))


def _placed(parent: np.ndarray, kind: np.ndarray, n_states: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(base of every state, slot of every state, slots); edge e leads to state e + 1, the root has slot 0."""
    order = np.argsort(parent, kind="stable")
    states, begin, count = np.unique(parent[order], return_index=True, return_counts=True)
    draw = np.random.default_rng(len(parent))
    used = np.zeros(3 * len(parent) + 512, bool)
    used[0] = True
    base_of, slot_of = np.zeros(n_states, np.int64), np.zeros(n_states, np.int64)

    def put(i: int, base: int) -> None:
        edges = order[begin[i] : begin[i] + count[i]]
        base_of[states[i]] = base
        slot_of[edges + 1] = base + kind[edges]
        used[base + kind[edges]] = True

    # Wide states: the window after the last one, moved on while a slot is taken.
    cursor = 1
    for i in np.flatnonzero(count > WIDE)[np.argsort(-count[count > WIDE], kind="stable")]:
        mine = kind[order[begin[i] : begin[i] + count[i]]]
        for base in (*range(cursor, cursor + 64), cursor + 256):
            if base + 256 > len(used):
                used = np.append(used, np.zeros(len(used) // 2 + 512, bool))
            if not used[base + mine].any():
                put(i, base)
                cursor = base
                break
    left = np.flatnonzero(count <= WIDE)
    low = 1
    while len(left):
        for _ in range(ROUNDS):
            width = count[left]
            base = draw.integers(low, len(used) - 256, len(left))
            owner = np.repeat(np.arange(len(left)), width)
            edges = order[np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(begin[left], width)]
            slot = base[owner] + kind[edges]
            claim = np.full(len(used), -1, np.int64)
            claim[slot] = owner
            good = (claim[slot] == owner) & ~used[slot]
            fits = np.logical_and.reduceat(good, np.cumsum(width) - width)
            mine = fits[owner]
            used[slot[mine]] = True
            slot_of[edges[mine] + 1] = slot[mine]
            base_of[states[left[fits]]] = base[fits]
            left = left[~fits]
            if not len(left):
                break
        else:
            low = len(used) - 256
            used = np.append(used, np.zeros(4 * int(count[left].sum()) + 512, bool))
    return base_of, slot_of, len(used) + 256
