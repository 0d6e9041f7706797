"""Packing by lexical retrieval: windows of LENGTH tokens filled with BM25 neighbours of a seed document.

Documents are tokenised and closed with an end id. Full windows of a document are sequences of their own, made
where it is tokenised; the tail that is left joins a shard. A shard holds a bounded number of tail tokens and its
own inverted index; terms are adjacent token pairs, the lexical unit that stands for words whatever the
vocabulary. The longest unused tail seeds a window; the index returns its unused neighbours by BM25 over the
seed's rarest shared terms; those that fit are taken in rank order, then the best one left is cut to fill the
window, and its rest stays in the pool. When these neighbours are used up the seed's next terms are asked, to the
last one; only then the next longest tail is taken. So every window but a shard's last one is full. Each token lies
in exactly one piece.

Shards are dealt by content (``deal``): tails that agree in the rarest term they share with any other tail form a
group, groups that agree in their commonest term lie next to each other, and only groups heavier than a shard are
split. Terms are compared on sketches, the SKETCH smallest term hashes of a tail, so a neighbour may still lie in
another shard; README states the share found.

Shuffled: tails as two or four bytes a token twice, sketches, and one short row for each full window.

Defined cases. A missing text is packed as an empty one: its end id. Equal rows are separate documents with equal
ids. Rows without an id are packed alike. Very long texts are cut where they are read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import mix, slices
from millrace.plans.lineage import cut_lineage

LENGTH = 2048
END = 1
#: Tail tokens of a shard at most on average, counted as bytes where a text is short.
SHARD_TOKENS = 4 << 20
#: Terms of a seed that are asked at a time.
QUERY_TERMS = 32
#: Term hashes by which tails are dealt to shards; shorter tails are compared whole.
SKETCH = 32
#: Ranges of commonest terms whose tokens the driver sums.
BUCKETS = 1 << 16
K1, B = 1.2, 0.75
#: Text that is cut into chunks and encoded at a time.
ENCODED_BYTES = 4 << 20

#: White space as the vocabulary's pattern knows it.
_WHITE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A space inside a run of white space that goes on behind it: there the pattern may not cut.
_RUN = f"{_WHITE} (?:{_WHITE}|$)"
_EDGE = f"^(?:{_WHITE}|$)|{_WHITE}$"


def _bytes_of_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Encoder:
    """Token ids of texts; each distinct chunk of a call, a space and what follows it up to the next one, is encoded once.

    The vocabulary's pattern always cuts before a space that follows other than white space or precedes it, so a
    text's ids are those of its chunks in turn. Texts with a space in the middle of a run of white space are encoded
    whole. Distinct chunks are encoded as one text, whose ids are dealt back by the bytes they stand for. The merger
    is built from the tokenizer file's own vocabulary, whose ids are its merge ranks. Nothing is kept between calls.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        letters = _bytes_of_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in tokenizer.get_vocab().items() if token not in special}
        self.merger = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = list(map(len, ranks))

    def _joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each) of ``words`` with a space before each; none is empty or has white space at an end."""
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar(" ", words.type))[0].as_py()
        ids = np.array(self.merger.encode_ordinary(f" {text}" if text else ""), np.uint32)
        ends = np.cumsum(pc.binary_length(words).to_numpy() + 1)
        return ids, np.diff(np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1, prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        given = pa.array(texts, pa.large_string())
        whole = pc.match_substring_regex(given, _RUN)
        cut = pc.split_pattern(pc.if_else(whole, "", given), " ")
        edge = cut.offsets.to_numpy()
        head = np.zeros(edge[-1], bool)
        head[edge[:-1]] = True
        words = cut.values.filter(pa.array(~head)).dictionary_encode()
        white = pc.match_substring_regex(words.dictionary, _EDGE)
        flat, size = self._joined(words.dictionary.filter(pc.invert(white)))
        # What follows no space, and what begins or ends with white space, is encoded alone.
        alone = [f" {w}" for w in words.dictionary.filter(white).to_pylist()] + pc.if_else(whole, given, cut.values.take(cut.offsets[:-1])).to_pylist()
        ids = list(map(self.merger.encode_ordinary, alone))
        flat = np.concatenate((flat, np.fromiter(chain.from_iterable(ids), np.uint32)))
        size = np.concatenate((size, np.fromiter(map(len, ids), np.int64, len(ids))))
        at = np.empty(len(head), np.int64)
        at[head] = np.arange(len(size) - len(texts), len(size))
        at[~head] = np.argsort(np.argsort(white.to_numpy(zero_copy_only=False), kind="stable"))[words.indices.to_numpy()]
        first, size = (np.cumsum(size) - size)[at], size[at]
        ends = np.cumsum(size)
        flat = flat[np.repeat(first - (ends - size), size) + np.arange(int(size.sum()))]
        edge = np.concatenate(([0], ends))[edge]
        return [flat[a:b] for a, b in zip(edge[:-1], edge[1:])]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)


def forget_encoder() -> None:
    """Workers live on after the stage that encodes; the encoder's memory goes back to the system."""
    encoder_of.cache_clear()
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


class Index:
    """BM25 index of one shard's tails: postings by term, weights ready to add. Places are 32 bits wide: a shard has a few million postings."""

    def __init__(self, tails: list[np.ndarray]) -> None:
        n = len(tails)
        size = np.fromiter(map(len, tails), np.int64, n)
        flat = np.concatenate(tails) if n else np.zeros(0, np.uint32)
        owner = np.repeat(np.arange(n, dtype=np.int32), size)
        inside = owner[:-1] == owner[1:]
        # Pair and owner in one number, so that one plain sort gives the postings.
        places, bits = n.bit_length(), int(flat.max()).bit_length() if len(flat) else 0
        ranked = 2 * bits + places > 63
        posting = flat[:-1].astype(np.int64)
        posting <<= 32 if ranked else bits
        posting |= flat[1:]
        owner, posting = owner[:-1][inside], posting[inside]
        del flat, inside
        if ranked:
            posting = np.unique(posting, return_inverse=True)[1]
        posting <<= places
        posting |= owner
        del owner
        posting.sort()
        at = np.flatnonzero(np.diff(posting, prepend=-1))
        times = np.diff(at, append=len(posting)).astype(np.int32)
        posting = posting[at]
        del at
        self.docs = (posting & ((1 << places) - 1)).astype(np.int32)
        posting >>= places
        new = np.diff(posting, prepend=-1) != 0
        self.edge = np.append(np.flatnonzero(new), len(posting))
        self.held = np.diff(self.edge).astype(np.int32)
        del posting
        term = np.cumsum(new, dtype=np.int32)
        term -= 1
        idf = np.log1p((n - self.held + 0.5) / (self.held + 0.5))
        spread = K1 * (1 - B + B * size / max(size.mean() if n else 1, 1))
        self.weight = idf[term] * times
        self.weight *= K1 + 1
        self.weight /= times + spread[self.docs]
        del times, new
        self.own = np.concatenate(([0], np.cumsum(np.bincount(self.docs, minlength=n))))
        by = self.docs.astype(np.int64)
        by <<= 32
        by |= term
        by.sort()
        self.terms = by.astype(np.int32)
        self.asked: tuple[int, np.ndarray] = (-1, self.terms[:0])

    def shared_terms(self, seed: int) -> np.ndarray:
        """The seed's terms that another item holds too, rarest first."""
        if self.asked[0] != seed:
            terms = self.terms[self.own[seed] : self.own[seed + 1]]
            by = (self.held[terms].astype(np.int64) << 32) | terms
            by.sort()
            self.asked = (seed, by[np.searchsorted(by, 2 << 32) :] & 0xFFFFFFFF)
        return self.asked[1]

    def drop_used(self, unused: np.ndarray) -> None:
        """Forget postings of used items; weights and the number of items that hold a term stay."""
        keep = unused[self.docs]
        self.edge = np.concatenate(([0], np.cumsum(keep)))[self.edge]
        self.docs, self.weight = self.docs[keep], self.weight[keep]

    def neighbours(self, seed: int, unused: np.ndarray, first: int = 0) -> np.ndarray:
        """Unused items that share one of QUERY_TERMS of the seed's terms from the ``first`` rarest on, best first; ties go to the lower number."""
        terms = self.shared_terms(seed)[first : first + QUERY_TERMS]
        if not len(terms):
            return np.zeros(0, np.int64)
        size = self.edge[terms + 1] - self.edge[terms]
        at = np.repeat(self.edge[terms] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        at = at[unused[self.docs[at]]]
        docs, weight = self.docs[at], self.weight[at]
        if 16 * len(docs) < len(unused):
            found, code = np.unique(docs, return_inverse=True)
            score = np.bincount(code, weight, len(found))
        else:
            score = np.bincount(docs, weight, len(unused))
            found = np.flatnonzero(score)
            score = score[found]
        return found[np.argsort(-score, kind="stable")]


def fill(tails: list[np.ndarray], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (tail, first token, tokens) that cover every tail exactly."""
    index = Index(tails)
    size = np.fromiter(map(len, tails), np.int64, len(tails))
    done = np.zeros(len(tails), np.int64)
    unused = size > 0
    order = np.argsort(-size, kind="stable")
    windows, at, held = [], 0, len(tails)

    def take(item: int, room: int) -> int:
        n = int(min(room, size[item] - done[item]))
        windows[-1].append((int(item), int(done[item]), n))
        done[item] += n
        unused[item] = done[item] < size[item]
        return room - n

    while True:
        while at < len(order) and not unused[order[at]]:
            at += 1
        if at == len(order):
            return windows
        seed = order[at]
        windows.append([])
        room = take(seed, length)
        if not room:
            continue
        left = int(unused.sum())
        if 2 * left < held:
            index.drop_used(unused)
            held = left
        for first in range(0, len(index.shared_terms(seed)), QUERY_TERMS):
            if not room or not left:
                break
            ranked = index.neighbours(seed, unused, first)
            for item in ranked:
                if size[item] - done[item] <= room and room:
                    room = take(item, room)
            for item in ranked:
                if room and unused[item]:
                    room = take(item, room)
                    break
        further = at
        while room and further < len(order):
            if unused[order[further]]:
                room = take(order[further], room)
            else:
                further += 1


_WIDE = "spread long, doc_id long, print long, nth long, start long, length long, ids_crc32 long, doc_tokens long, full boolean, tokens binary, sketch array<long>"
#: Mark of the sequence ids of full windows; those of a shard start at its number times 2^32.
FULL = 1 << 62
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def sketch(ids: np.ndarray) -> np.ndarray:
    """The SKETCH smallest hashes of the distinct adjacent pairs."""
    found = mix(((ids[:-1].astype(np.uint64) << np.uint64(32)) | ids[1:]) + np.uint64(1))
    found.sort()
    return found[np.append(True, found[1:] != found[:-1])[: len(found)]][:SKETCH].astype(np.int64)


def deal(tails: DataFrame, shards: int) -> DataFrame:
    """(uid, shard) of ``tails`` (uid, spread, length, sketch), of about equal numbers of tokens; similar tails meet."""
    terms = tails.select("uid", F.explode("sketch").alias("term"))
    held = terms.groupBy("term").agg(F.count("*").alias("held")).where("held > 1")
    rank = F.struct("held", "term")
    own = terms.join(held, "term").groupBy("uid").agg(F.min(rank).getField("term").alias("rarest"), F.max(rank).getField("term").alias("common"))
    # A tail that shares nothing is a group of its own.
    named = tails.select("uid", "spread", "length").join(own, "uid", "left")
    # Kept: groups and the join below both read it, and terms are counted once.
    named = cut_lineage(named.select("uid", "spread", "length", F.coalesce("rarest", "spread").alias("rarest"), F.coalesce("common", "spread").alias("common")))
    groups = named.groupBy("rarest").agg(F.min("common").alias("common"), F.sum("length").alias("tokens"))
    groups = cut_lineage(groups.select("rarest", "tokens", F.pmod(F.xxhash64("common"), F.lit(BUCKETS)).alias("bucket")))
    sums = dict(groups.groupBy("bucket").agg(F.sum("tokens")).collect())
    each = max(sum(sums.values()) / shards, 1)
    start, rows = 0, []
    for bucket in sorted(sums):
        end = start + sums[bucket]
        low = min(int(start / each), shards - 1)
        rows.append((bucket, low, min(max(math.ceil(end / each) - 1, low), shards - 1) - low + 1 if end - start > each else 1))
        start = end
    ranges = tails.sparkSession.createDataFrame(rows, "bucket long, low long, parts long")
    placed = groups.join(F.broadcast(ranges), "bucket").select("rarest", "low", "parts", (F.col("tokens") > each).alias("heavy"))
    part = F.pmod(F.xxhash64(F.when(F.col("heavy"), F.col("spread")).otherwise(F.col("rarest")), F.lit(1)), F.col("parts"))
    return named.join(placed, "rarest").select("uid", (F.col("low") + part).alias("shard"))


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, shard_tokens: int = SHARD_TOKENS, with_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, their token ids)."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    bound = F.least(F.coalesce(F.octet_length("text"), F.lit(0)) + 1, F.lit(length - 1))
    shards = max(1, math.ceil((docs.agg(F.sum(bound)).first()[0] or 0) / shard_tokens))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, met = encoder_of(path), Counter()
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
        schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in _WIDE.split(", "))])
        for batch, raw in slices(batches, "text", ENCODED_BYTES):
            out = []
            for doc_id, text, ids in zip(batch.column(0).to_pylist(), raw, encoder.encode([(t or b"").decode() for t in raw])):
                ids = np.append(ids, np.uint32(END))
                mark = xxhash.xxh3_64_intdigest(text or b"", seed=(doc_id or 0) & 0xFFFFFFFF) >> 1
                met[doc_id, mark] += 1
                nth = met[doc_id, mark]
                spread = xxhash.xxh3_64_intdigest(f"{doc_id} {mark} {nth}".encode()) >> 1
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    full = len(piece) == length
                    blob = piece.astype("<u4" if piece.max() >> 16 else "<u2").tobytes() if with_ids or not full else None
                    out.append((spread, doc_id, mark, nth, start, len(piece), _crc(piece) if full else 0, len(ids), full, blob, None if full else sketch(piece)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    kinds = [pa.int64()] * 7 + ([pa.list_(pa.int32())] if with_ids else [])
    names = [x.split()[0] for x in _PIECE.split(", ")] + (["ids"] if with_ids else [])

    def read(blob: bytes, n: int) -> np.ndarray:
        return np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype(np.uint32)

    def join(table: pa.Table) -> pa.Table:
        forget_encoder()
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "print", "nth", "start")])
        base = table["shard"][0].as_py() << 32
        column = {c: table[c].to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "tokens")}
        tails = [read(blob, n) for blob, n in zip(column.pop("tokens"), column["length"])]
        out = []
        for k, window in enumerate(fill(tails, length)):
            offset = 0
            for i, first, n in window:
                ids = tails[i][first : first + n]
                row = (column["doc_id"][i], column["start"][i] + first, n, _crc(ids), column["doc_tokens"][i], base + k, offset)
                out.append(row + ((ids.astype(np.int32),) if with_ids else ()))
                offset += n
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _WIDE)
    rows = cut_lineage(rows.withColumn("uid", F.monotonically_increasing_id()))
    # A full window has nothing to look for: it is a sequence by its number, and no shard holds it.
    full = rows.where("full").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("uid").bitwiseOR(F.lit(FULL)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "tokens")
    shape = _PIECE + (", ids array<int>" if with_ids else "")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = pa.array([read(blob, length).astype(np.int32) for blob in part.column(7).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:7], ids], names=names)

    full = full.mapInArrow(decode, shape) if with_ids else full.drop("tokens")
    rest = rows.where(~F.col("full"))
    if shards > 1:
        rest = rest.join(deal(rest.select("uid", "spread", "length", "sketch"), shards), "uid")
    else:
        rest = rest.withColumn("shard", F.lit(0).cast("long"))
    rest = rest.select("shard", "doc_id", "print", "nth", "start", "length", "doc_tokens", "tokens")
    return full.unionByName(rest.groupBy("shard").applyInArrow(join, shape))
