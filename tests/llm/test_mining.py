"""Audit, search and phrase operators against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import divergence, double_array, nn_descent, phrases
from tests.llm import cases

ROWS = cases.odd_rows()
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audit(rows, least, top=10):
    per, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = TERM.findall(cases.lower(text or ""))
        per[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for la, s in per if la == lang)
        counts = {s: per[lang, s] for s in sources}
        whole = sum(counts.values(), Counter())

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)

        def far(a, b, t):
            return (a[t] - b[t]) ** 2 // (a[t] + b[t])

        for s in sources:
            pair = [(-sum(far(p[s], p[o], t) for t in kept), o) for o in sources if o != s]
            term = [(-far(p[s], q, t), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out, key=repr)


def test_divergence(spark):
    columns = ("lang", "source", "part", "item", "value", "rank")
    for least, block, entries in ((1, 256, 200_000), (2, 2, 60), (50, 256, 100)):
        found = divergence.divergence(cases.frame(spark, ROWS), least_docs=least, block=block, entries=entries)
        assert cases.collected(found, *columns) == audit(ROWS, least)
    assert divergence.divergence(cases.frame(spark, ROWS[:0]), least_docs=1).count() == 0


def test_terms_of_a_long_text_are_cut_at_separators(monkeypatch):
    text = ("Äé,Z" + "x" * 90 + "\n7 ü_b " * 40).encode()
    whole = Counter(t.encode() for t in TERM.findall(cases.lower(text.decode())))
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(divergence, "SLICE", size)
        assert divergence.term_counts(text) == whole


def phrase_table(rows, least, top, longest=5):
    freq, total = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", cases.lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            freq[lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in freq.items():
        good = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        held = defaultdict(int)
        for p, a in good.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i : i + k]] = max(held[p[i : i + k]], a)
        rows_of = []
        for p, a in good.items():
            if held[p] < a:
                score, cut = min((1000 * a * total[lang] // (f[p[:c]] * f[p[c:]]), c) for c in range(1, len(p)))
                rows_of.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out, key=repr)


SPOKEN = [
    *ROWS,
    (30, "New York, new york! NEW\tYORK city; new york city\nnew\x0byork " * 9, "en", "a"),
    (31, "a a a a a a a. a a: b a b a b a b", None, "a"),
    (32, "a a a b a b a b # a", "und", "a"),
    (33, "\x1cwo\x1cr ü  ö\u3000ä x " * 30, "de", "a"),
]


def test_phrases(spark):
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    short = [r for r in SPOKEN if len(r[1] or "") < 5_000]
    for rows, least, top, keys, trie in ((SPOKEN, 3, 2000, 4_000_000, 250_000), (short, 3, 5, 200, 400), (short, 10**6, 5, 10, 10)):
        found = phrases.collocations(cases.frame(spark, rows), least, top=top, most_keys=keys, most_phrases=trie)
        assert cases.collected(found, *columns) == phrase_table(rows, least, top)
    assert phrases.collocations(cases.frame(spark, ROWS[:0]), 1).count() == 0


def test_double_array_counts():
    draw = np.random.default_rng(0)
    for n_words, n_text, n_phrases in ((1, 9, 3), (5, 400, 60), (300, 20_000, 4_000), (70_000, 5_000, 30_000)):
        vocabulary = np.unique(draw.integers(1, 2**63, n_words).astype(np.uint64))

        def some(n, vocabulary=vocabulary):
            return vocabulary[(draw.random(n) ** 3 * len(vocabulary)).astype(int)]

        text, piece = some(n_text), np.cumsum(draw.random(n_text) < 0.1)
        wanted = [np.array(p, np.uint64) for p in {tuple(some(draw.integers(1, 6))) for _ in range(n_phrases)}]
        trie = double_array.DoubleArray.unpack(double_array.build(wanted).pack())
        seen = Counter(tuple(text[i : i + k]) for k in range(1, 6) for i in range(n_text - k + 1) if piece[i] == piece[i + k - 1])
        assert trie.counts(text, piece, 5).tolist() == [seen[tuple(p)] for p in wanted]
    assert double_array.build([]).counts(np.array([1, 2], np.uint64), np.array([0, 0]), 5).tolist() == []


def nearest_by_hand(rows, queries, k):
    def unit(v):
        v = np.array(v, float) / np.abs(v).max()
        return v / np.sqrt((v * v).sum())

    def good(v):
        return v and None not in v and np.isfinite(v).all() and any(v)

    out = []
    for q in sorted({i for i, v in queries if i is not None and good(v)}):
        v = next(v for i, v in queries if i == q and good(v))
        near = {}
        for i, w in rows:
            if i is not None and i != q and good(w) and len(w) == len(v):
                near[i] = max(near.get(i, -2), float((unit(v) * unit(w)).sum()))
        out += [(q, r, i, s) for r, (i, s) in enumerate(sorted(near.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return out


def vectors(n, dim, seed):
    return np.random.default_rng(seed).standard_normal((n, dim)).astype("f4").tolist()


VECTOR_ROWS = [
    *enumerate(vectors(120, 8, 1)),
    *[(200 + i, v) for i, v in enumerate(vectors(3, 5, 2))],
    *[(300 + i, vectors(1, 8, 3)[0]) for i in range(40)],
    (7, vectors(1, 8, 4)[0]), (400, None), (401, []), (402, [0.0] * 8), (403, [1.0, None] * 4), (404, [float("nan")] * 8), (None, vectors(1, 8, 5)[0]),
    (405, [float("inf")] + [1.0] * 7), (406, [3e38] * 8), (407, [1e-38] * 8), (408, [2.0] * 8),
]


def searched(found):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())


def test_search_of_a_small_table_is_exact(spark):
    schema = "vec_id long, embedding array<float>, rank int, nid long, node string"
    frame = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in VECTOR_ROWS], schema)
    queries = [r for r in VECTOR_ROWS if r[0] != 7]
    got = searched(nn_descent.nearest(frame, frame.where("vec_id is null or vec_id <> 7")))
    want = sorted(nearest_by_hand(VECTOR_ROWS, queries, 5))
    assert [(q, i) for q, _, i, _ in got] == [(q, i) for q, _, i, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want], rtol=0, atol=1e-12)
    assert searched(nn_descent.nearest(frame.limit(0), frame.limit(0))) == []


@pytest.mark.parametrize("outside", [False, True])
def test_graph_search_finds_most(spark, outside):
    """Many leaves, a crowd of near copies, queries from the table and from elsewhere."""
    x, crowd = vectors(1500, 24, 6), vectors(1, 24, 7)[0]
    rows = [*enumerate(x), *[(2000 + i, (np.array(crowd) + np.array(e) * 0.02).tolist()) for i, e in enumerate(vectors(600, 24, 8))]]
    asked = [(5000 + i, v) for i, v in enumerate(vectors(60, 24, 9))] if outside else [r for r in rows if r[0] % 50 == 0]
    index = nn_descent.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), leaf=128)
    got = searched(nn_descent.search(index, spark.createDataFrame(asked, "vec_id long, embedding array<float>"), 5))
    want = nearest_by_hand(rows, asked, 5)
    found = {(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}
    assert len(got) == len(want) and len(found) >= 0.9 * len(want)
