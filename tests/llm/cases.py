"""Fixtures of odd rows, and plain-Python versions that the operators must match."""

from __future__ import annotations

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, key string, row string, n long, node string, "
    "pos int, part long, block long, size int, print long, copy string, n_lines string, score string, kept string"
)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{int(vocabulary * draw.random() ** 2)}" for _ in range(n))


def mutated(text: str, seed: int, share: float) -> str:
    draw = random.Random(seed)
    return " ".join(f"m{draw.randrange(10**6)}" if draw.random() < share else w for w in text.split())


def odd_rows() -> list[tuple]:
    """(doc_id, text, lang, source): missing, empty, blank, short, repeated, equal, near, shared and very long texts."""
    base, passage = prose(1, 120), prose(2, 40, 10**6)
    long = prose(3, 30_000, 20_000)
    return [
        (7, base, "en", "a"),
        (3, base.upper(), "en", "a"),
        (3, base.upper(), "en", "a"),
        (9, mutated(base, 1, 0.02), "en", None),
        (None, base, "en", "a"),
        (11, None, "en", "b"),
        (12, "", None, "b"),
        (13, " \t\r\n \x0b\x0c ", "fr", "b"),
        (14, "One", "fr", "b"),
        (15, "one", "fr", "b"),
        (16, "one two", "fr", None),
        (17, f"{prose(4, 30)} {passage} {prose(5, 30)}", "fr", "c"),
        (18, f"{prose(6, 10)} {passage}", "de", "c"),
        (19, f"{passage} {prose(7, 10)}\n A line of ten\nsecond line here\n\n", "de", "c"),
        (20, f"{prose(8, 60)}\n\ta LINE of ten \nsecond line here\nsecond line here", "de", "c"),
        (21, "été à la plage où l’eau était bleue 　 naïve", "fr", "c"),
        (22, long, "en", "d"),
        (23, f"{prose(9, 5)} {long}", "en", "d"),
        (24, "12345 67 !! --", None, None),
        (25, "don't  stop\x1cnow <|endoftext|> ok", "en", "d"),
        (None, None, None, None),
        (-4, "word " * 300, "en", "a"),
    ]


def frame(spark, rows):
    """Rows with further columns whose names clash with working names; some are null."""
    full = [(i, t, la, s, len(t or ""), 1, "k", None, 5, "n", 0, 2, None, 3, 4, "c", "x", None, "y") for i, t, la, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def collected(df, *columns) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def shingles(text: str | None, n: int) -> frozenset:
    w = words(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(ids: list, links: list[tuple[int, int]]) -> list:
    """Smallest id of each row's group; rows are numbered, ids may be missing."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    groups: dict[int, list] = {}
    for x in range(len(ids)):
        groups.setdefault(find(x), []).append(ids[x])
    return [min((i for i in groups[find(x)] if i is not None), default=None) for x in range(len(ids))]


def near_copies(rows, n: int, num: int) -> list[tuple]:
    sets = [shingles(t, n) for _, t, *_ in rows]
    links = [
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
    comp = components([r[0] for r in rows], links)
    return sorted(((r[0], len(s), c, r[0] == c) for r, s, c in zip(rows, sets, comp)), key=repr)


def lines_left(rows, least: int = 10) -> list[tuple]:
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    held: dict[str, set] = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(LAST if i is None else i)
    out = []
    for i, t, *_ in rows:
        own, lines = LAST if i is None else i, (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(held[key(x)]) < 2 or min(held[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def substrings_left(rows, n: int = 13) -> list[tuple]:
    first: dict[tuple, int] = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            first[g] = min(first.get(g, LAST), LAST if i is None else i)
    out = []
    for i, t, *_ in rows:
        w, own, gone = words(t), LAST if i is None else i, set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < own:
                gone.update(range(k, k + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def text_counts(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w, text = words(text), text or ""
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) for j in range(3) if grams[tuple(w[k : k + 3])] > 1}
    full = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered), failed
