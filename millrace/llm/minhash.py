"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

A signature is POSITIONS minima reduced to BITS bits, packed four to a long: one long is one chunk. Two
sets of similarity s differ in about (1 - s) of the positions; ``plan`` takes the distance t that all but
MISS of such pairs keep. By pigeonhole a pair within t differs in at most e positions of one of the first
r + 1 chunks or e - 1 of a later one (t = e * chunks + r), so masking every choice of that many positions
of a chunk gives keys of which such a pair shares one: no pair within t is lost.

Texts with equal sets are one node from the start. In every bucket all nodes are first compared with its
smallest one; what that verifies makes components. Only buckets that still hold several components are looked
at again: nodes outside the bucket's largest component against those of other components, block by block in
tasks that return nodes and forest edges, never pairs. A pair is looked at in the first bucket that it shares. So a
group of near copies that hang together costs its size, and no link between components is lost. Every link is
confirmed on the full sets of both texts.

Shuffled: keys and node numbers twice, texts of candidate nodes by node. Signatures, buckets and links are
checkpointed; components are found by distributed minimum labels.

Defined cases. A missing or empty text has an empty set, links with nothing and is kept. A row without an id
belongs to its group like others; a group of such rows only has no component id. Repeated rows of one id are
all reported (and all kept if that id is kept); ``near_dedup`` goes by groups and leaves one row of each, whatever the ids. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import packed, unpacked
from millrace.llm.text import column_bytes, mix, slices, windows_of, words_of
from millrace.plans.components import connected_components
from millrace.plans.lineage import cut_lineage

POSITIONS = 64
WIDTH = 4
BITS = 14
LANE = 16
#: Share of pairs at the least similarity whose signatures may lie beyond the distance that is searched.
MISS = 1e-5
#: Nodes of a bucket that a task compares with as many others, and shingles counted at a time there.
BLOCK = 1024
STRIP = 4096
#: Rows of a call that decides many small tasks, on average.
BUNDLE = 16_384
#: Shingles that the texts of a block, or of a call on full sets, hold on average; a longer text is a block of its own size.
BLOCK_SHINGLES = 1 << 19
_FACTORS = (np.random.default_rng(20240607).integers(1, 1 << 63, POSITIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ONES = sum(((1 << BITS) - 1) << (LANE * i) for i in range(WIDTH))
_TOPS = sum((1 << BITS) << (LANE * i) for i in range(WIDTH))


@dataclass(frozen=True)
class Likeness:
    """Shingles of ``words`` words; linked when ``den`` * shared >= ``num`` * union."""

    words: int = 5
    num: int = 80
    den: int = 100


def distance_bound(similarity: float, miss: float = MISS, positions: int = POSITIONS) -> int:
    """Smallest distance that a pair of this similarity exceeds with probability ``miss`` at most."""
    p, tail = 1.0 - similarity, 1.0
    for t in range(positions + 1):
        tail -= math.comb(positions, t) * p**t * (1 - p) ** (positions - t)
        if tail <= miss:
            return t
    return positions


def chunk_masks(distance: int, chunks: int = POSITIONS // WIDTH) -> list[tuple[int, int]]:
    """(chunk, mask of the positions that must agree): the keys that no pair within ``distance`` escapes."""
    most, rest = divmod(distance, chunks)
    lane, out = (1 << BITS) - 1, []
    for chunk in range(chunks):
        wrong = most if chunk <= rest else most - 1
        if wrong < 0:
            continue
        for free in combinations(range(WIDTH), min(wrong, WIDTH)):
            out.append((chunk, sum(lane << (LANE * i) for i in range(WIDTH) if i not in free)))
    return out


def shingle_hashes(texts: list[bytes | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of all shingles, bounds by text); a text with fewer words is one shingle, one without words has none."""
    found = words_of(texts, lower=True)
    hashes, owner = windows_of(found, words)
    short = np.flatnonzero((found.counts > 0) & (found.counts < words))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for i, t in enumerate(short):
            run = found.hashes[found.bounds[t] : found.bounds[t + 1]]
            whole[i] = xxhash.xxh3_64_intdigest(run.tobytes(), seed=len(run))
        order = np.argsort(np.concatenate([owner, short]), kind="stable")
        hashes, owner = np.concatenate([hashes, whole])[order], np.concatenate([owner, short])[order]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, chunks) packed signatures of texts that all have a shingle."""
    lanes = np.zeros((len(bounds) - 1, POSITIONS), np.int64)
    for i, factor in enumerate(_FACTORS):
        least = np.minimum.reduceat(hashes * factor, bounds[:-1])
        lanes[:, i] = (mix(least) >> np.uint64(64 - BITS)).astype(np.int64)
    lanes = lanes.reshape(len(lanes), -1, WIDTH)
    return reduce(np.bitwise_or, (lanes[:, :, k] << (LANE * k) for k in range(WIDTH)))


def _sign(docs: DataFrame, words: int) -> DataFrame:
    """id, print, n, node, sig of every row; node and sig are null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            hashes, bounds = shingle_hashes(texts, words)
            sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            full = np.flatnonzero(np.diff(bounds))
            packed_rows: list = [None] * len(texts)
            if len(full):
                signed = signatures(hashes, np.append(bounds[full], len(hashes)))
                for i, row in zip(full.tolist(), signed.tolist()):
                    packed_rows[i] = row
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array(packed_rows, pa.list_(pa.int64())),
                ],
                ["id", "print", "n", "node", "sig"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("print"), "text")
    return rows.mapInArrow(run, "id long, print long, n long, node binary, sig array<long>")


def _distance(a: str, b: str) -> Column:
    """Positions in which two packed signatures differ."""
    differ = [F.bit_count((F.col(a)[c].bitwiseXOR(F.col(b)[c]) + F.lit(_ONES)).bitwiseAND(F.lit(_TOPS))) for c in range(POSITIONS // WIDTH)]
    return reduce(lambda x, y: x + y, differ)


def _sizes(a: str, b: str, like: Likeness) -> Column:
    """Whether sets of these sizes can be linked at all."""
    return F.least(a, b) * like.den >= F.greatest(a, b) * like.num


def _texts(nodes: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(nid, text) of the nodes; the print deals the join out, ids are compared null-safe."""
    where = nodes.join(reps.select("nid", F.col("first_id").alias("id"), F.col("print")), "nid")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("print"), "text")
    texts = rows.alias("r").join(where.alias("w"), (F.col("r.print") == F.col("w.print")) & F.col("r.id").eqNullSafe(F.col("w.id")))
    return texts.select("nid", "text")


def _confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) of nodes whose full sets are linked."""
    texts = _texts(pairs.select(F.col("a").alias("nid")).union(pairs.select("b")).distinct(), docs, reps)
    wide = (
        pairs.join(texts.select(F.col("nid").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("nid").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch, right in slices(batches, "text_b", 1 << 20):
            left = column_bytes(batch, "text_a")
            ids = batch.column(0).to_pylist()
            hashes, bounds = shingle_hashes(right, like.words)
            keep = np.zeros(len(right), bool)
            for i, a in enumerate(ids):
                if a != last or mine is None:
                    last, mine = a, np.unique(shingle_hashes([left[i]], like.words)[0])
                other = np.unique(hashes[bounds[i] : bounds[i + 1]])
                shared = len(np.intersect1d(mine, other, assume_unique=True))
                keep[i] = like.den * shared >= like.num * (len(mine) + len(other) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return wide.mapInArrow(run, "a long, b long").distinct()


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b) positions in which packed signatures differ."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for c in range(a.shape[1]):
        out += np.bitwise_count(((a[:, c][:, None] ^ b[:, c][None, :]) + _ONES) & _TOPS)
    return out


def _segments(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows of a bundle in order of (key, low, high), with the first row and number of rows of each such task."""
    key, low, high = (table[c].to_numpy() for c in ("key", "low", "high"))
    order = np.lexsort((high, low, key))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(key[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
    first = np.flatnonzero(fresh)
    return table.take(pa.array(order)), first, np.diff(np.append(first, len(order)))


def _near_in_bucket(masks: list[tuple[int, int]], bound: int, like: Likeness):
    """Nodes of two blocks of a bucket that have a partner in reach, in another component, met here first.

    A call gets a bundle of such tasks; those of two nodes, the most, are decided all at once.
    """

    def run(table: pa.Table) -> pa.Table:
        table, first, size = _segments(table)
        half, part, n, low, high, slot = (table[c].to_numpy() for c in ("half", "part", "n", "low", "high", "slot"))
        sig = table["sig"].combine_chunks().flatten().to_numpy().reshape(len(half), -1)
        ones = first[size == 2]
        use = ((half[ones] == low[ones]) & (half[ones + 1] == high[ones])) | ((half[ones] == high[ones]) & (half[ones + 1] == low[ones]))
        near = np.bitwise_count(((sig[ones] ^ sig[ones + 1]) + _ONES) & _TOPS).sum(axis=1) <= bound
        small, large = np.minimum(n[ones], n[ones + 1]), np.maximum(n[ones], n[ones + 1])
        use &= near & (part[ones] != part[ones + 1]) & (like.den * small >= like.num * large)
        a, b = [ones[use]], [ones[use] + 1]
        for start, rows in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            own = half[start : start + rows]
            left, right = start + np.flatnonzero(own == low[start]), start + np.flatnonzero(own == high[start])
            close = (_distances(sig[left], sig[right]) <= bound) & (part[left][:, None] != part[right][None, :])
            small, large = np.minimum(n[left][:, None], n[right]), np.maximum(n[left][:, None], n[right])
            x, y = np.nonzero(close & (like.den * small >= like.num * large))
            a.append(left[x])
            b.append(right[y])
        a, b = np.concatenate(a), np.concatenate(b)
        kept = []
        for value in np.unique(slot[a]).tolist():
            x, y = a[slot[a] == value], b[slot[a] == value]
            for c, mask in masks[:value]:
                later = ((sig[x, c] ^ sig[y, c]) & mask) != 0
                x, y = x[later], y[later]
            kept += [x, y]
        rows = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
        return table.select(["key", "low", "high", "half", "nid"]).take(pa.array(rows))

    return run


def _linked_in_bucket(like: Likeness):
    """Links between two blocks of a bucket by exact set sizes, as edges of a spanning forest; a call gets a bundle."""

    def run(table: pa.Table) -> pa.Table:
        table, first, size = _segments(table)
        return pa.concat_tables([linked(table.slice(s, n)) for s, n in zip(first.tolist(), size.tolist())])

    def linked(table: pa.Table) -> pa.Table:
        half, nid = table["half"].to_numpy(), table["nid"].to_numpy()
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        hashes, bounds = shingle_hashes(column_bytes(table, "text"), like.words)
        sets = [np.unique(hashes[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]
        size = np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), size)
        _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # Shingles of one text only are shared with none; the rest are counted in strips of columns.
        several = times > 1
        column = np.cumsum(several) - 1
        use = several[code]
        owner, column = owner[use], column[code[use]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        shared = np.zeros((len(sets), len(sets)), np.float32)
        for start in range(0, int(several.sum()), STRIP):
            x, y = np.searchsorted(column, (start, start + STRIP))
            strip = np.zeros((len(sets), STRIP), np.float32)
            strip[owner[x:y], column[x:y] - start] = 1
            shared += strip @ strip.T
        shared = shared.astype(np.int64)
        linked = like.den * shared >= like.num * (size[:, None] + size[None, :] - shared)
        linked &= ((half == low)[:, None] & (half == high)[None, :]) & (nid[:, None] != nid[None, :])
        a, b = np.nonzero(linked)
        root = np.arange(len(sets))
        while True:
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            least = least[least]
            if (least == root).all():
                break
            root = least
        joined = np.flatnonzero(root != np.arange(len(sets)))
        return pa.table({"a": nid[root[joined]], "b": nid[joined]})

    return run


def _across(members: DataFrame, groups: DataFrame, docs: DataFrame, reps: DataFrame, like: Likeness, masks: list, bound: int) -> DataFrame | None:
    """Links between the components that still share a bucket, or None where no node has a partner in reach.

    A bucket's nodes outside its largest component are dealt to blocks, its largest component to others;
    tasks are pairs of blocks of which one at least lies outside. Signatures settle which nodes stay, full
    sets which are linked; both stages return nodes, not pairs.
    """
    named = members.join(groups, "nid", "left").join(reps.select("nid", "n"), "nid").select("key", "slot", "nid", F.coalesce("component", "nid").alias("part"), "n")
    parts = named.groupBy("key", "part").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    mixed = parts.groupBy("key").agg(
        F.count("*").alias("parts"), F.max_by("part", F.struct("size", "part")).alias("major"), F.max("size").alias("inside"),
        F.max_by("weight", F.struct("size", "part")).alias("inside_weight"), F.sum("size").alias("all"), F.sum("weight").alias("all_weight"),
    )
    blocks = lambda rows, weight: F.ceil(F.greatest(rows / BLOCK, F.least(rows, weight / BLOCK_SHINGLES))).cast("int")
    outside = F.col("all") - F.col("inside")
    mixed = mixed.where("parts > 1").select(
        "key", "major", outside.alias("outside"), "inside",
        blocks(outside, F.col("all_weight") - F.col("inside_weight")).alias("outer"), blocks(F.col("inside"), F.col("inside_weight")).alias("inner"),
    )
    mixed = cut_lineage(mixed)
    # A node outside meets all blocks, one inside those outside: so many rows are dealt.
    copies = mixed.agg(F.sum(F.col("outside") * (F.col("outer") + F.col("inner")) + F.col("inside") * F.col("outer"))).first()[0] or 0
    if not copies:
        return None
    mixed = mixed.select("key", "major", "outer", "inner")
    here = F.pmod(F.xxhash64("nid", "key"), F.when(F.col("part") == F.col("major"), F.col("inner")).otherwise(F.col("outer"))).cast("int")
    # Blocks 0 .. outer - 1 lie outside, the ones after them are the largest component's.
    half = F.when(F.col("part") == F.col("major"), F.col("outer") + here).otherwise(here)
    nodes = named.join(mixed, "key").withColumn("half", half)
    last = F.when(F.col("half") < F.col("outer"), F.col("outer") + F.col("inner")).otherwise(F.col("outer"))
    dealt = nodes.withColumn("other", F.explode(F.sequence(F.lit(0), last - 1)))
    dealt = dealt.select("key", "slot", F.least("half", "other").alias("low"), F.greatest("half", "other").alias("high"), "half", "nid", "part", "n")
    dealt = dealt.join(reps.select("nid", "sig"), "nid").select("key", "slot", "low", "high", "half", "nid", "part", "n", "sig")
    # Most tasks are tiny, so several go into one call: bundles by a hash of the task, about as many rows (and shingles of full sets) each.
    bundle = lambda calls: F.pmod(F.xxhash64("key", "low", "high"), F.lit(math.ceil(calls) or 1)).alias("bundle")
    dealt = dealt.select(bundle(copies / BUNDLE), "*")
    near = cut_lineage(dealt.groupBy("bundle").applyInArrow(_near_in_bucket(masks, bound, like), "key long, low int, high int, half int, nid long"))
    rows, weight = near.join(reps.select("nid", "n"), "nid").agg(F.count("*"), F.sum("n")).first()
    if not rows:
        return None
    texts = _texts(near.select("nid").distinct(), docs, reps)
    wide = near.join(texts, "nid").select(bundle(max(rows / BLOCK, weight / BLOCK_SHINGLES)), "key", "low", "high", "half", "nid", "text")
    return wide.groupBy("bundle").applyInArrow(_linked_in_bucket(like), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, like: Likeness = Likeness(), miss: float = MISS) -> DataFrame:
    """(id, print, n_shingles, component_id, group) of every row; ``print`` is the hash of its text, ``group`` the smallest
    node of its component, null without words."""
    bound = distance_bound(like.num / like.den, miss)
    rows = cut_lineage(_sign(docs, like.words))
    reps = rows.where("n > 0").groupBy("node").agg(
        F.min("id").alias("first_id"), F.coalesce(F.min_by("print", "id"), F.min("print")).alias("print"), F.first("n").alias("n"), F.first("sig").alias("sig")
    )
    reps = cut_lineage(reps.withColumn("nid", F.monotonically_increasing_id()))
    masks = chunk_masks(bound)
    key = F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.col("sig")[c].bitwiseAND(F.lit(mask))) for i, (c, mask) in enumerate(masks)]))
    keys = reps.select(key.alias("slot", "key"), "nid")
    hubs = keys.groupBy("key").agg(F.min("nid").alias("hub"), F.max("nid").alias("top")).where("hub < top").select("key", "hub")
    members = cut_lineage(keys.join(hubs, "key").select("key", "slot", "nid", "hub"))
    signed = reps.select("nid", "n", "sig")
    left = signed.select(F.col("nid").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    right = signed.select(F.col("nid").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    near = _sizes("n_a", "n_b", like) & (_distance("sig_a", "sig_b") <= bound)

    star = members.where("nid <> hub").select(F.col("hub").alias("a"), F.col("nid").alias("b")).distinct()
    star = cut_lineage(star.join(right, "b").join(left, "a").where(near).select("a", "b"))
    links = cut_lineage(_confirm(star, docs, reps, like))
    groups = _components(links)

    further = _across(members, groups, docs, reps, like, masks, bound)
    if further is not None:
        links = cut_lineage(links.union(further))
        groups = _components(links)

    smallest = groups.join(reps.select("nid", "first_id"), "nid").groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = groups.join(smallest, "component").select("nid", "component", "component_id")
    label = F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("component_id"))
    labels = reps.join(found, "nid", "left").select("node", F.coalesce("component", "nid").alias("group"), label.alias("component_id"))
    out = rows.select("id", "print", "n", "node").join(labels, "node", "left")
    return out.select(
        "id", "print", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "group"
    )


def _components(links: DataFrame) -> DataFrame:
    """(nid, component) of all nodes with a link."""
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    nodes = both.select(F.col("src").alias("id")).union(both.select("dst")).distinct()
    return connected_components(nodes, both).select(F.col("id").alias("nid"), "component")


def duplicate_report(docs: DataFrame, like: Likeness = Likeness(), miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each document."""
    found = near_duplicates(docs, like, miss)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, like: Likeness = Likeness(), miss: float = MISS) -> DataFrame:
    """``docs`` with one row of each group of near copies, columns unchanged.

    That is the row with the smallest id, missing ids last; of several such rows the one with the smallest hash of its
    text, of equal rows one. Rows without words are no copies of each other and all stay.
    """
    found = near_duplicates(docs, like, miss).where("n_shingles > 0")
    best = found.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "print")).alias("best"))
    best = best.select(F.struct("best.id", "best.print").alias("me"))
    # One key for both steps, so that texts are dealt out once; in a struct a missing id equals a missing id.
    rows = packed(docs, me=F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("print")), text=F.col("text"))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    one = rows.where(~blank).join(best, "me", "left_semi").dropDuplicates(["me"])
    return unpacked(one.select("row").union(rows.where(blank).select("row")), docs)
