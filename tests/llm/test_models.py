"""Language, scoring and quality models against plain Python and held-out labels."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import compression, ngram_lm, ordinal, ppm
from tests.llm import cases

ROWS = cases.odd_rows()


def test_backoff_scores(spark):
    for block in (8 << 20, 2_000):
        got = {}
        for r in ngram_lm.score(cases.frame(spark, ROWS), block_bytes=block).collect():
            got.setdefault(r.doc_id, []).append(r)
        tokens = [(i, [*cases.words(cases.lower(t or "")), None]) for i, t, *_ in ROWS]
        held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in tokens}
        one, two = Counter(), Counter()
        for i, w in tokens:
            if not held[i]:
                one.update(w)
                two.update(zip(["<", *w[:-1]], w))
        total, distinct = sum(one.values()), len(one)
        state = {**one, "<": one[None]}
        for i, w in tokens:
            base = [(one[x] + 0.1) / (total + 0.1 * (distinct + 1)) for x in w]
            model = [(two[h, x] + ngram_lm.PRIOR * p) / (state.get(h, 0) + ngram_lm.PRIOR) for h, x, p in zip(["<", *w[:-1]], w, base)]
            same = [
                r
                for r in got[i]
                if r.n_tokens == len(w)
                and r.n_known == sum(one[x] > 0 for x in w)
                and r.train_tokens == total
                and r.held_out == held[i]
                and math.isclose(r.base_score, sum(map(math.log10, base)), rel_tol=1e-9)
                and math.isclose(r.score, sum(map(math.log10, model)), rel_tol=1e-9)
            ]
            assert same, (i, got[i], len(w))


def test_backoff_distribution_sums_to_one():
    """Over the vocabulary and one unknown word, after a seen history and after an unseen one."""
    words = np.array([1, 2, 3], np.uint64)
    machine_total, distinct = 10, 3
    texts = [b"a b a c", b"b a"]
    tokens, bounds = ngram_lm.tokens_of(texts)
    assert len(tokens) == 8 and (tokens[[4, 7]] == ngram_lm.END).all()
    counts = np.array([5, 3, 2, 0])
    p1 = (counts + 0.1) / (machine_total + 0.1 * (distinct + 1))
    assert math.isclose(p1.sum(), 1)
    pairs = np.array([2, 3, 0, 0])
    k = ngram_lm.PRIOR
    assert math.isclose(((pairs + k * p1) / (5 + k)).sum(), 1)
    assert len(words) == distinct


def test_without_training_text(spark):
    rows = [(k, "some words", "en", "s") for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0]
    for r in ngram_lm.score(cases.frame(spark, rows)).collect():
        assert (r.base_score, r.score, r.train_tokens, r.n_known) == (0, 0, 0, 0)
    assert ngram_lm.score(cases.frame(spark, [])).count() == 0


def brute_length(train: list[bytes], text: bytes, order: int) -> float:
    """Code length of ``text`` by context dictionaries, one byte after the other."""
    counts: dict[bytes, Counter] = {}
    for t in train:
        t = b"\0" * order + t
        for k in range(order, len(t)):
            for n in range(order + 1):
                counts.setdefault(t[k - n : k], Counter())[t[k]] += 1
    bits, text = 0.0, b"\0" * order + text
    for k in range(order, len(text)):
        for n in range(order, -1, -1):
            seen = counts.get(text[k - n : k])
            if seen is None:
                continue
            weight = sum(seen.values()) + len(seen)
            if seen[text[k]]:
                bits -= math.log2(seen[text[k]] / weight)
                break
            bits -= math.log2(len(seen) / weight)
        else:
            bits += 8
    return bits


def test_ppm_code_lengths(spark):
    rows = [(k, cases.prose(k, 30, 50 if k % 2 else 90), "xx" if k % 2 else "yy", "s") for k in range(12)]
    trees = ppm.learn(cases.frame(spark, rows), floor=0)
    scorer = ppm.Scorer(trees)
    tests = [b"w1 w2 w88", "été".encode(), b"", rows[0][1].encode()]
    got = scorer.lengths(tests)
    for k, lang in enumerate(scorer.names):
        train = [t.encode() for _, t, la, _ in rows if la == lang]
        for i, text in enumerate(tests):
            assert math.isclose(got[i, k], brute_length(train, text, ppm.ORDER), rel_tol=1e-9, abs_tol=1e-9)
    assert np.allclose(scorer.lengths(tests), got)


def test_language_of_odd_rows(spark):
    docs = cases.frame(spark, ROWS)
    out = ppm.language_report(docs).collect()
    assert len(out) == len(ROWS)
    texts = {i: t for i, t, *_ in ROWS if i is not None}
    for r in out:
        assert 0 <= r.score <= 1
        if r.doc_id in (11, 12, 13, 24):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.doc_id in texts:
            assert r.lang_pred in ("en", "fr", "de")
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    kept = ppm.language_filter(docs)
    assert kept.columns == docs.columns and kept.where("text is null or text = ''").count() == 0
    nothing = cases.frame(spark, [(1, "some text", None, "s")])
    assert ppm.language_report(nothing).first().lang_pred == "und"
    assert ppm.language_report(cases.frame(spark, [])).count() == 0


def test_language_filter_rejects_what_no_language_explains(spark):
    import base64
    import random

    draw = random.Random(5)
    rows = [(k, cases.prose(k, 120, 60), "en" if k % 2 else "fr", "s") for k in range(40)]
    odd = [base64.b64encode(draw.randbytes(300)).decode(), draw.randbytes(300).hex(), "Все люди рождаются свободными и равными. " * 4]
    odd += ["for (i = 0; i < n; ++i) p->x[i] ^= 0xff; return -EINVAL; /* done */", "人人生而自由在尊严和权利上一律平等他们赋有理性和良心" * 3]
    more = [(100 + k, t, None, "s") for k, t in enumerate(odd)] + [(200, cases.prose(900, 120, 60), None, "s"), (201, "w1 w2", None, "s")]
    kept = {r.doc_id for r in ppm.language_filter(cases.frame(spark, rows + more)).collect()}
    assert kept == {*range(40), 200, 201}
    unnamed = cases.frame(spark, more)
    assert ppm.language_filter(unnamed).count() == len(more)


def test_language_accuracy_on_held_out_documents(spark, folder):
    docs = spark.read.parquet(f"{folder.replace('0.001', '0.01')}/documents.parquet")
    out = ppm.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.98


def test_compression_counts(spark):
    docs = cases.frame(spark, ROWS)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert cases.collected(compression.quality_report(docs), *columns) == sorted(((i, *cases.text_counts(t)) for i, t, *_ in ROWS), key=repr)
    kept = [r.doc_id for r in compression.quality_report(docs).where("kept").collect()]
    assert sorted(kept, key=repr) == sorted([r.doc_id for r in compression.quality_filter(docs).collect()], key=repr)
    assert compression.quality_filter(docs).columns == docs.columns
    assert compression.quality_report(cases.frame(spark, [])).count() == 0


def test_compression_verdicts():
    import base64
    import random

    import zstandard

    noise = base64.b64encode(random.Random(1).randbytes(6000))
    loop = b"the same words again " * 300
    prose = cases.prose(5, 1500, 20_000).encode()
    pack = zstandard.ZstdCompressor(level=compression.LEVEL)
    whole, chunks = compression.ratios(prose, pack)
    assert math.isclose(whole, len(prose) / len(pack.compress(prose))) and len(chunks) == -(-len(prose) // compression.CHUNK)
    out = compression.measure([b" ".join(noise[k : k + 7] for k in range(0, 5600, 7)), loop])
    assert not out["kept"].any()
    assert compression.in_bands(3000, 2.0, 0, 3) and not compression.in_bands(3000, 2.0, 1, 3) and not compression.in_bands(3000, 9.0, 0, 3)


RUSSIAN = """Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.
Каждый человек должен обладать всеми правами и всеми свободами, провозглашенными настоящей Декларацией, без какого бы то ни было различия, как-то в отношении расы, цвета кожи, пола, языка, религии, политических или иных убеждений, национального или социального происхождения, имущественного, сословного или иного положения.
Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность. Никто не должен содержаться в рабстве или в подневольном состоянии; рабство и работорговля запрещаются во всех их видах.
Никто не должен подвергаться пыткам или жестоким, бесчеловечным или унижающим его достоинство обращению и наказанию. Каждый человек, где бы он ни находился, имеет право на признание его правосубъектности."""
CHINESE = """人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。
人人有资格享有本宣言所载的一切权利和自由,不分种族、肤色、性别、语言、宗教、政治或其他见解、国籍或社会出身、财产、出生或其他身分等任何区别。
人人有权享有生命、自由和人身安全。任何人不得使为奴隶或奴役;一切形式的奴隶制度和奴隶买卖,均应予以禁止。
任何人不得加以酷刑,或施以残忍的、不人道的或侮辱性的待遇或刑罚。人人在任何地方有权被承认在法律前的人格。
法律之前人人平等,并有权享受法律的平等保护,不受任何歧视。任何人不得加以任意逮捕、拘禁或放逐。"""


def passes(text):
    data = text.encode() if isinstance(text, str) else text
    out = compression.measure([data])
    width = len(data) / len(data.decode())
    return compression.in_bands(len(data), out["ratio"][0], out["chunks_out"][0], out["chunks"][0], width=width)


def test_compression_bands_by_script_and_length():
    import base64
    import random

    # clean prose in scripts of two and three bytes a character, whole and by its first half
    for text in (RUSSIAN, CHINESE):
        assert passes(text) and passes(text[: len(text) // 2])
        assert not passes(text[:60] * 60)
    draw = random.Random(3)
    for n in (1_500, 6_000, 40_000, 400_000):
        assert not passes(base64.b64encode(draw.randbytes(n)))
        assert not passes((b"the same words again and more of them " * (n // 30))[:n])
        prose = cases.prose(n, n // 6, 20_000)
        assert passes(prose)
        # a loop in a fifth of the text shows in the chunks
        assert not passes(prose[: n // 2] + "again and again " * (n // 4 // 16 + 130) + prose[n // 2 :])


def test_compression_bands_follow_the_table(spark):
    rows = [(k, cases.prose(k, 400, 20_000), "en", "a") for k in range(150)] + [(900, RUSSIAN, "ru", "a"), (901, CHINESE * 2, "zh", "a")]
    rows += [(1_000 + k, "one loop of junk text without end " * 70, "en", "a") for k in range(300)]
    docs = cases.frame(spark, rows)
    bands = compression.learn_bands(docs)
    for (length, wide), top in bands.tops.items():
        text = [t for _, t, *_ in rows if compression.class_of(len(t.encode()), len(t.encode()) / len(t)) == (length, wide)]
        n = len([t for t in text if not compression.measure([t.encode()])["base_failed"][0]])
        ratios = np.sort([compression.measure([t.encode()])["ratio"][0] for t in text])
        middle, upper = ratios[math.ceil(0.5 * n) - 1], ratios[math.ceil(0.75 * n) - 1]
        widest = compression.WIDEST.whole(int(2 ** (length / 2)), wide / 2 + 0.25)[1]
        assert math.isclose(top, (n * (middle + 5 * (upper - middle) / 0.6745) + 50 * widest) / (n + 50))
    kept = {r.doc_id for r in compression.quality_report(docs).where("kept").collect()}
    assert {k for k, *_ in rows if k < 900} | {900} <= kept and not any(k >= 1_000 for k in kept)


@pytest.fixture(scope="module")
def graded(spark, folder):
    folder = folder.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = ordinal.quality_grades(docs, labels).join(labels.select("doc_id", ordinal.grade_of().alias("grade")), "doc_id")
    return out.where("held_out").toPandas()


def test_ordinal_held_out(graded):
    kept = graded.groupby("grade").kept.mean()
    # About a quarter of these toxic labels are on texts without any word that marks one.
    assert kept[2] > 0.95 and kept[0] < 0.4 and kept[1] < 0.3
    expected = graded.groupby("grade").expected_grade.mean()
    assert expected[0] < expected[1] < expected[2]


def test_features_do_not_depend_on_neighbours():
    texts = [None, b"", b"a", b"ab cd", "été là".encode(), *[cases.prose(k, 40).encode() for k in range(20)]]
    whole, cut = ordinal.features(texts), ordinal.features_by_slices(texts, 100)
    assert np.array_equal(whole.index, cut.index) and np.allclose(whole.value, cut.value) and np.array_equal(whole.bounds, cut.bounds)
    for k, text in enumerate(texts):
        alone = ordinal.features([text])
        part = slice(whole.bounds[k], whole.bounds[k + 1])
        assert np.array_equal(alone.index, whole.index[part]) and np.allclose(alone.value, whole.value[part])


def test_ordinal_gradient_fit_orders_grades():
    texts = [f"{'bad ' * (k % 3 == 0)}{'so ' * (k % 3 == 1)}{'good ' * (k % 3 == 2)}{cases.prose(k, 10, 30)}".encode() for k in range(300)]
    grade = np.arange(300) % 3
    rows = ordinal.features(texts)
    w, t = ordinal.fit(rows, grade, np.ones(300), 3, steps=60)
    f = rows.score(w)
    assert (np.diff(t) > 0).all() and f[grade == 0].mean() < f[grade == 1].mean() < f[grade == 2].mean()


def test_ordinal_of_odd_rows(spark):
    docs = cases.frame(spark, ROWS)
    labels = spark.createDataFrame([(7, 1, 0), (9, 0, 0), (14, 1, 1), (7, 1, 0), (None, 1, 0), (18, None, 0), (500, 1, 1)], "doc_id long, quality int, toxic int")
    out = ordinal.quality_grades(docs, labels).collect()
    assert len(out) == len(ROWS)
    for r in out:
        if r.doc_id in (11, 12, 13):
            assert (r.expected_grade, r.tail, r.kept) == (0, 0, False)
        assert 0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2
    one = labels.where("toxic = 0 and quality = 1")
    assert {r.kept for r in ordinal.quality_grades(docs, one).where("doc_id = 7 or doc_id = 11").collect()} == {True, False}
    assert ordinal.quality_grades(docs, labels.limit(0)).where("kept").count() == 0
    assert ordinal.quality_grades(cases.frame(spark, []), labels).count() == 0
    assert ordinal.select_quality(docs, labels.select("doc_id", ordinal.grade_of().alias("grade"))).columns == docs.columns
