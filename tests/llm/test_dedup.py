"""Near copies, lines and substrings against plain Python."""

import pytest

from millrace.llm import line_dedup, minhash, substring
from tests.llm import cases

ROWS = cases.odd_rows()


@pytest.mark.parametrize("n, num", [(3, 85), (5, 80)])
def test_near_duplicates_of_odd_rows(spark, n, num):
    like = minhash.Likeness(words=n, num=num)
    found = minhash.duplicate_report(cases.frame(spark, ROWS), like)
    got = cases.collected(found, "doc_id", "n_shingles", "component_id", "kept")
    assert got == cases.near_copies(ROWS, n, num)


def test_families_that_straddle_the_threshold(spark, monkeypatch):
    """Copies of one text, changed more or less, of which some link only with each other; blocks of three nodes."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rows = []
    for f in range(3):
        base = cases.prose(100 + f, 150, 10**6)
        rows += [(1000 * f + k, cases.mutated(base, k, 0.005 * (k % 12)), "en", "s") for k in range(40)]
        far = cases.mutated(base, 77, 0.09)
        rows += [(1000 * f + 500 - k, cases.mutated(far, 90 + k, 0.01), "en", "s") for k in range(4)]
    found = minhash.duplicate_report(cases.frame(spark, rows), minhash.Likeness(words=3, num=85))
    expected = cases.near_copies(rows, 3, 85)
    assert cases.collected(found, "doc_id", "n_shingles", "component_id", "kept") == expected
    assert len({c for _, _, c, _ in expected}) > 5


def test_keys_miss_no_pair_within_the_distance():
    for distance in (3, 16, 22, 27):
        masks = minhash.chunk_masks(distance)
        draw = __import__("random").Random(distance)
        for _ in range(300):
            wrong = set(draw.sample(range(minhash.POSITIONS), distance))
            hit = False
            for chunk, mask in masks:
                free = [i for i in range(minhash.WIDTH) if not mask >> (minhash.LANE * i) & 1]
                hit |= all(p % minhash.WIDTH in free for p in wrong if p // minhash.WIDTH == chunk)
            assert hit


def test_near_dedup_keeps_one_of_each_group(spark):
    docs = cases.frame(spark, ROWS)
    like = minhash.Likeness(words=5, num=80)
    kept = minhash.near_dedup(docs, like)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    best = [i for i, n, c, k in cases.near_copies(ROWS, 5, 80) if k and n and i is not None]
    blank = [i for i, t, *_ in ROWS if not cases.words(t)]
    assert sorted(ids, key=repr) == sorted([*set(best), *blank], key=repr)


def test_near_dedup_goes_by_group_not_by_id(spark):
    """Unrelated texts under one id all stay, a group without ids leaves one row, and one with some leaves one with an id."""
    a, b, c, d = (cases.prose(60 + k, 120, 10**6) for k in range(4))
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (2, f"{b} more", "en", "s"), (1, b, "en", "s")]
    rows += [(None, c, "en", "s"), (None, f"{c} more", "en", "s"), (None, c, "en", "s")]
    rows += [(None, d, "en", "s"), (5, f"{d} more", "en", "s"), (None, "", "en", "s"), (None, None, "en", "s")]
    kept = minhash.near_dedup(cases.frame(spark, rows), minhash.Likeness(words=5, num=80)).collect()
    assert len([r for r in kept if not r.text]) == 2
    kept = [r for r in kept if r.text]
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 1, 5]
    assert {a, b} <= {r.text for r in kept} and len({r.text for r in kept} & {rows[4][1], rows[5][1]}) == 1


def test_lines(spark):
    docs = cases.frame(spark, ROWS)
    got = cases.collected(line_dedup.line_report(docs), "doc_id", "n_lines", "n_dropped", "text")
    assert got == cases.lines_left(ROWS)
    assert sum(r[2] for r in got) >= 4
    out = line_dedup.line_dedup(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.where("text is null").collect()} == {11, None}
    same = line_dedup.line_report(docs, min_docs=3).where("n_dropped > 0").count()
    assert same < sum(r[2] > 0 for r in got)


@pytest.mark.parametrize("group, block", [(50_000, 8 << 20), (1, 2_000)])
def test_substrings(spark, group, block):
    """One block and one group, and many blocks whose groups are all split by whole windows."""
    got = cases.collected(substring.substring_report(cases.frame(spark, ROWS), group=group, block_bytes=block), "doc_id", "n_words", "n_removed", "text")
    assert got == cases.substrings_left(ROWS)
    assert sum(r[2] > 0 for r in got) >= 5


def test_substrings_of_many_copies(spark):
    """One passage in many documents, cut at different places, and repeats within a document."""
    passage = cases.prose(50, 60, 10**6)
    rows = [(k, f"{cases.prose(200 + k, k)} {' '.join(passage.split()[k % 7 : 60 - k % 11])} {cases.prose(300 + k, 20)}", "en", "s") for k in range(60)]
    rows.append((99, f"{passage} {passage}", "en", "s"))
    for group, block in ((50_000, 8 << 20), (10, 3_000)):
        got = cases.collected(substring.substring_report(cases.frame(spark, rows), group=group, block_bytes=block), "doc_id", "n_words", "n_removed", "text")
        assert got == cases.substrings_left(rows)


def test_empty_tables(spark):
    docs = cases.frame(spark, [])
    for report in (minhash.duplicate_report, minhash.near_dedup, line_dedup.line_report, line_dedup.line_dedup, substring.substring_report):
        assert report(docs).count() == 0


def test_near_dedup_deals_texts_out_once_at_the_end(spark):
    """The rows that stay and their repeats are told by one key, so that no second exchange of texts follows."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = minhash.near_dedup(cases.frame(spark, ROWS))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(id#" in x and "print#" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
