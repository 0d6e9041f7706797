"""Mixing, packing, vectors and the pipeline."""

import math
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pyspark.sql import functions as F

from millrace.llm import cross_polytope, mixing, packing
from tests.llm import cases

ROWS = cases.odd_rows()


def test_poisson_table(spark):
    docs = spark.createDataFrame([("a", "x" * 99)] * 3 + [("b", "y" * 9)] * 2 + [(None, None)], "source string, text string")
    rates = {r.source: r for r in mixing.repetition_rates(docs, {"a": 1.0, "b": 3.0}).collect()}
    total = 300 + 20 + 1
    assert math.isclose(rates["a"].rate, total / 4 / 300) and math.isclose(rates["b"].rate, total * 3 / 4 / 20) and rates[None].rate == 0
    for r in (rates["a"], rates["b"]):
        exact = np.cumsum([math.exp(-r.rate + k * math.log(r.rate) - math.lgamma(k + 1)) for k in range(len(r.cdf))])
        assert np.allclose(r.cdf, exact) and r.cdf[-1] > 1 - 1e-12
    big = mixing.repetition_rates(docs.where("source = 'a'"), size=900.0).first()
    assert math.isclose(big.rate, 900) and big.cdf[-1] > 1 - 1e-9


def test_mix_reaches_the_weights(spark):
    rows = [(k, "x" * 99, "en", "big" if k % 4 else "small") for k in range(4000)]
    docs = cases.frame(spark, rows)
    out = mixing.mix_sources(docs, {"big": 0.3, "small": 0.6, "absent": 0.1}, size=1.0)
    assert out.columns == docs.columns
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    share = 4000 / 3, 4000 * 2 / 3  # weights count among the sources that are there
    assert abs(n["big"] - share[0]) < 5 * share[0] ** 0.5 and abs(n["small"] - share[1]) < 5 * (share[1] * 1.0) ** 0.5
    again = mixing.mix_report(docs, {"big": 0.3, "small": 0.6, "absent": 0.1})
    assert cases.collected(again, "doc_id", "copy") == cases.collected(mixing.mix_report(docs.repartition(5), {"big": 0.3, "small": 0.6, "absent": 0.1}), "doc_id", "copy")
    keys = [r.shuffle_key for r in again.select("shuffle_key").collect()]
    assert len(set(keys)) == len(keys)


def test_mix_of_odd_rows(spark, monkeypatch):
    docs = cases.frame(spark, ROWS)
    plain = cases.collected(mixing.mix_report(docs), "doc_id", "source", "copy")
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert cases.collected(mixing.mix_report(docs), "doc_id", "source", "copy") == plain
    assert {s for _, s, _ in plain} <= {"a", "b", "c", "d", None}
    assert mixing.mix_sources(docs, {}).count() == 0 and mixing.mix_sources(cases.frame(spark, [])).count() == 0


def test_mix_of_very_high_rates(spark):
    # one short text against one of 3 MB: equal weights repeat the short one 750 000 times
    docs = cases.frame(spark, [(1, "", "en", "short"), (2, "x" * 3_000_000, "en", "long")])
    rate = {r.source: (r.rate, r.parts) for r in mixing.repetition_rates(docs).collect()}
    want = (3_000_001 + 1) / 2
    assert math.isclose(rate["short"][0], want) and rate["short"][1] == math.ceil(want / mixing.PART_RATE) and rate["long"][1] == 1
    copies = mixing.mix_report(docs).select("doc_id", "copy").where("doc_id = 1")
    n, distinct = copies.agg(F.count("*"), F.count_distinct("copy")).first()
    assert n == distinct and abs(n - want) < 6 * want**0.5


def test_mix_in_parts_keeps_the_distribution(spark, monkeypatch):
    docs = cases.frame(spark, [(k, f"text {k:05d}", "en", "a") for k in range(3000)])
    monkeypatch.setattr(mixing, "PART_RATE", 2.0)
    out = mixing.mix_report(docs, size=9.0)
    assert mixing.repetition_rates(docs, size=9.0).first().parts == 5
    per = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("d")).toPandas()
    assert (per.n == per.d).all()
    n = np.concatenate([per.n.to_numpy(), np.zeros(3000 - len(per))])
    assert abs(n.mean() - 9) < 5 * (9 / 3000) ** 0.5 and abs(n.var() - 9) < 5 * (2 * 81 / 3000) ** 0.5


def test_mix_uses_no_python(spark):
    plan = mixing.mix_sources(cases.frame(spark, ROWS))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_encoder_equals_the_tokenizer(tokenizer):
    texts = [t or "" for _, t, *_ in ROWS] + ["  a  b\n\n c\t\td \xa0x　 y's it's  ", " ", "\n", "a\x1cb !\x1c", "a b \x85 c", "١٢٣ ４５"]
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts)):
            assert list(ids) == tokenizer.encode(text, add_special_tokens=False).ids


def test_new_words_are_encoded_together(tokenizer):
    """Words never met before take one call of the merger, and nothing of them stays behind."""
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join(f"{k:x}qz{k % 7}v" for k in range(a, a + 50)) for a in range(0, 2000, 50)]

    class Counted:
        calls, merger = 0, encoder.merger

        def encode_ordinary(self, text):
            self.calls += 1
            return self.merger.encode_ordinary(text)

    encoder.merger = Counted()
    before = {k: len(v) for k, v in vars(encoder).items() if hasattr(v, "__len__")}
    for text, ids in zip(texts, encoder.encode(texts)):
        assert list(ids) == tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.merger.calls <= len(texts) + 1
    assert before == {k: len(v) for k, v in vars(encoder).items() if hasattr(v, "__len__")}


def test_encoder_cuts_white_space_like_the_tokenizer(tokenizer):
    """Runs of every kind of white space, at both ends and between words."""
    draw = np.random.default_rng(6)
    white = [*" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b", *[" "] * 20]
    words = ["a", "The", "'s", "'", "?!", "12", "\xe9", "\u65e5\u672c", "<|endoftext|>", "don't", "\U0001f600", "_"]
    texts = ["".join(draw.choice(white if draw.random() < 0.6 else words) for _ in range(draw.integers(0, 25))) for _ in range(2000)]
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text, ids in zip(texts, encoder.encode(texts)):
        assert list(ids) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("length, shard", [(2048, 4 << 20), (64, 500)])
def test_pack_round_trip(spark, tokenizer, length, shard):
    docs = cases.frame(spark, ROWS)
    out = packing.pack(docs, length=length, shard_tokens=shard).toPandas()
    windows = {}
    for (seq,), g in out.sort_values("offset").groupby(["sequence_id"]):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= length
        windows[seq] = g.length.sum()
    shards = {s >> 32 for s in windows}
    assert sum(n < length for n in windows.values()) <= len(shards)
    expected = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t, *_ in ROWS)
    pieces = {}
    for r in out.itertuples():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        pieces.setdefault((None if r.doc_id != r.doc_id else r.doc_id, r.doc_tokens), []).append((r.start, list(r.ids)))
    got = []
    for (_, n), parts in pieces.items():
        copies = sum(len(p[1]) for p in parts) // n
        flat = {}
        for start, ids in parts:
            for k, token in enumerate(ids):
                flat.setdefault(start + k, []).append(token)
        assert sorted(flat) == list(range(n)) and all(len(v) == copies and len(set(v)) == 1 for v in flat.values())
        got += [[flat[k][0] for k in range(n)]] * copies
    assert sorted(got) == expected


def test_bm25_ranks_like_brute_force():
    draw = np.random.default_rng(3)
    tails = [draw.integers(0, 12, draw.integers(2, 40)).astype(np.uint32) for _ in range(40)]
    index = packing.Index(tails)
    terms = [[(a, b) for a, b in zip(t[:-1], t[1:])] for t in tails]
    df = {}
    for t in terms:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    mean = np.mean([len(t) for t in tails])
    order = {x: k for k, x in enumerate(sorted(df))}
    for seed in range(40):
        query = sorted((x for x in set(terms[seed]) if df[x] > 1), key=lambda x: (df[x], order[x]))[: packing.QUERY_TERMS]
        score = {}
        for d, t in enumerate(terms):
            hits = [x for x in query if x in t]
            if hits and d != seed:
                spread = packing.K1 * (1 - packing.B + packing.B * len(tails[d]) / mean)
                score[d] = sum(math.log1p((40 - df[x] + 0.5) / (df[x] + 0.5)) * t.count(x) * (packing.K1 + 1) / (t.count(x) + spread) for x in hits)
        unused = np.ones(40, bool)
        unused[seed] = False
        got = index.neighbours(seed, unused)
        assert set(got) == set(score)
        ranked = [score[d] for d in got]
        assert all(a >= b - 1e-9 for a, b in zip(ranked, ranked[1:]))


def test_neighbours_share_windows():
    """Documents about one subject land together although they were apart in the table."""
    draw = np.random.default_rng(4)
    tails = [draw.integers(1000 * (k % 8), 1000 * (k % 8) + 60, 100).astype(np.uint32) for k in range(64)]
    windows = packing.fill(tails, 400)
    alike = [len({i % 8 for i, _, _ in w}) for w in windows]
    assert np.mean(alike) < 1.5


def brute_vectors(rows, threshold=0.93):
    good = [v is not None and la is not None and None not in v and np.isfinite(v).all() and np.any(v) for _, v, la in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links.append((a, b))
    n = [sum(k in p for p in links) for k in range(len(rows))]
    comp = cases.components([r[0] for r in rows], links)
    return sorted(((r[0], k, c, r[0] == c) for r, k, c in zip(rows, n, comp)), key=repr)


@pytest.mark.parametrize("block", [2048, 4])
def test_vectors(spark, block):
    """Recall at the threshold's edge is measured; odd vectors link with nothing."""
    draw = np.random.default_rng(1)
    base = draw.normal(size=(20, 64))
    rows = [(k, (base[k % 20] + draw.normal(size=64) * (0.24 if k % 3 else 0.1)).tolist(), k % 20 // 7) for k in range(300)]
    rows += [(400 + k, base[0].tolist(), 0) for k in range(12)]
    rows += [(1, base[0].tolist(), 0), (450, (base[0] * 3).tolist(), 0), (451, base[0].tolist(), None), (452, None, 0), (453, [0.0] * 64, 0)]
    rows += [(454, [float("nan")] * 64, 0), (455, [None] * 64, 0), (456, [float("inf")] + [0.0] * 63, 0), (457, [1.0, 2.0], 0), (458, [1.0, 2.0], 0)]
    rows += [(459, [], 0), (460, [5.0], 1), (461, [2.0], 1)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, size int")
    found = cross_polytope.near_vectors(table, block=block)
    got, expected = cases.collected(found, "id", "n_links", "component_id", "kept"), brute_vectors(rows)
    links, real = sum(r[1] for r in got), sum(r[1] for r in expected)
    assert 0.97 * real <= links <= real
    assert {r[0]: r[1] for r in got if r[0] >= 450} == {r[0]: r[1] for r in expected if r[0] >= 450}
    assert sum(a == b for a, b in zip(got, expected)) >= 0.9 * len(rows)
    assert cross_polytope.near_vectors(table.limit(0)).count() == 0


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(2).normal(size=(5, 16))
    y = cross_polytope.hadamard(x)
    assert np.allclose(x @ x.T, y @ y.T) and np.allclose(cross_polytope.hadamard(y), x)


def test_pipeline_stages(spark, folder):
    """Every stage keeps the columns, works on all that the one before kept, and what it decides shows in the result."""
    docs = cases.frame(spark, ROWS)
    at, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, folder).cache()
        seen.append(at.count())
        assert name == "packing" or at.columns == docs.columns
    assert seen[0] == len(ROWS) - 5 and seen[1] == seen[0] and seen[2] < seen[1]
    assert corpus_pipeline.run(spark, folder).where("length > 0").count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, cases.frame(spark, []), folder).count() == 0


def test_similar_tails_meet_whatever_the_number_of_shards(spark):
    """Pairs of near copies share a shard, and shards stay bounded although one group of equal texts is heavy."""
    rows = [(k, cases.mutated(cases.prose(1000 + k % 150, 80, 10**6), k, 0.02), "en", "s") for k in range(300)]
    rows += [(1000 + k, cases.prose(7, 80, 10**6), "en", "s") for k in range(300)]
    out = packing.pack(cases.frame(spark, rows), shard_tokens=12_000, with_ids=False).toPandas()
    shard = dict(zip(out.doc_id, out.sequence_id // 2**32))
    assert len(set(shard.values())) >= 10
    assert np.mean([shard[k] == shard[k + 150] for k in range(150)]) > 0.8
    assert out.groupby(out.sequence_id // 2**32).length.sum().max() < 0.35 * out.length.sum()


def test_dealing_counts_terms_once(spark):
    """What places the groups and what places the tails read the same kept rows."""
    rows = [(k, k * 17, 10, [k % 5, 100 + k]) for k in range(40)]
    dealt = packing.deal(spark.createDataFrame(rows, "uid long, spread long, length long, sketch array<long>"), 3)
    assert "Generate" not in dealt._jdf.queryExecution().toString()
    assert sorted(r.uid for r in dealt.collect()) == list(range(40)) and {r.shard for r in dealt.collect()} <= {0, 1, 2}


def test_a_seed_asks_all_its_terms():
    """Neighbours that share only a common term are taken before longer strangers."""
    fresh = iter(range(10**4, 10**6))
    seed = np.array([t for k in range(40) for t in (100 + k, next(fresh))] + [1, 2] + [next(fresh) for _ in range(200)], np.uint32)
    rare = [np.array([seed[2 * k], seed[2 * k + 1]], np.uint32) for k in range(40)]
    common = [np.array([next(fresh), 1, 2, next(fresh)], np.uint32) for _ in range(6)]
    strangers = [np.array([next(fresh) for _ in range(60)], np.uint32) for _ in range(3)]
    window = packing.fill([seed, *rare, *common, *strangers], len(seed) + 2 * len(rare) + 4 * len(common))[0]
    assert {i for i, _, _ in window} == set(range(1 + len(rare) + len(common)))


def test_an_index_holds_few_bytes_a_token():
    rng = np.random.default_rng(5)
    tails = [rng.integers(0, 400, 1000).astype(np.uint32) for _ in range(100)]
    tracemalloc.start()
    try:
        index = packing.Index(tails)
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(index.docs) and held < 26 * 100_000 and peak < 75 * 100_000


def test_an_index_of_wide_ids_is_the_same():
    """Ids too wide to share a number with their tail are ranked first."""
    rng = np.random.default_rng(7)
    tails = [rng.integers(1, 40, rng.integers(1, 60)).astype(np.uint32) for _ in range(50)]
    narrow, wide = packing.Index(tails), packing.Index([t * np.uint32(1 << 25) for t in tails])
    assert all(np.array_equal(getattr(narrow, k), getattr(wide, k)) for k in ("docs", "edge", "held", "weight", "terms", "own"))
    assert packing.fill(tails, 64) == packing.fill([t * np.uint32(1 << 25) for t in tails], 64)


def test_workers_forget_the_encoder():
    path = public_tokenizers.path("byte_bpe_50k.json")
    first = packing.encoder_of(path)
    packing.forget_encoder()
    assert packing.encoder_of.cache_info().currsize == 0 and packing.encoder_of(path) is not first
