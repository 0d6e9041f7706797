"""Embedding near-dedup by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

A table turns a vector by three rounds of random signs and the fast Walsh-Hadamard transform and names
the nearest of the 2d signed axes; two turns make a bucket. A vector also enters the buckets in which one of
the two names is its second-nearest axis (multiprobe), so near misses meet. Buckets of all tables are verified by
exact cosines in double precision: nothing below the threshold is linked.

A pair may meet in several buckets. It is counted in the first one that both entries list, so counts need no
list of pairs: a task returns how many links each vector has and, for the components, edges of a spanning
forest. Equal vectors are one node that carries how many it stands for. Entries of a bucket with more
than BLOCK of them are dealt to blocks, and each pair of blocks is a task of its own: no bucket is capped, none
is gathered whole.

Defined cases. A vector that is missing, zero, or holds a missing or non-finite component links with
nothing, nor does one without a label. Vectors of different lengths never link. Repeated rows of one id are vectors of
their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.components import connected_components
from millrace.plans.lineage import cut_lineage

THRESHOLD = 0.93
TABLES = 12
TURNS = 2
BLOCK = 2048
SEED = 20240611


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (their length is a power of two), keeping lengths."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(-1, n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


def axes(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """(rows, 2) codes of the nearest and second-nearest signed axis after rounds of ``signs`` and transform."""
    for row in signs:
        x = hadamard(x * row)
    near = np.argpartition(-np.abs(x), 1, axis=1)[:, :2]
    value = np.take_along_axis(x, near, 1)
    turn = np.abs(value[:, 1]) > np.abs(value[:, 0])
    near[turn], value[turn] = near[turn][:, ::-1], value[turn][:, ::-1]
    return near * 2 + (value < 0)


def bucket_keys(x: np.ndarray, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """(rows, 3 * tables) buckets of unit vectors: in each table the own one and two probes."""
    size = 1 << max(1, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    draw, keys = np.random.default_rng([seed, size]), []
    for table in range(tables):
        one, two = (axes(x, draw.choice([-1.0, 1.0], (3, size))) for _ in range(TURNS))
        for a, b in ((0, 0), (1, 0), (0, 1)):
            keys.append((table * 2 * size + one[:, a]) * 2 * size + two[:, b])
    return np.stack(keys, axis=1).astype(np.int64)


def _vectors(table: DataFrame, id_col: str, column: str, label: str) -> DataFrame:
    """id, node (of vector and label; null if it links with nothing), label, vec as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, vectors = [], []
            for vector, name in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                good = bool(vector) and name is not None and None not in vector
                if good:
                    array = np.array(vector, "<f8") + 0.0
                    top = np.abs(array).max()
                    good = bool(np.isfinite(array).all()) and top > 0
                nodes.append(xxhash.xxh3_128_digest(name.encode() + b"\0" + array.tobytes()) if good else None)
                # Scaled by its largest component, so that squares neither overflow nor vanish.
                vectors.append((array / top).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.binary()), batch.column(2), pa.array(vectors, pa.binary())], ["id", "node", "label", "vec"]
            )

    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vec"), F.col(label).cast("string").alias("label"))
    return rows.mapInArrow(run, "id long, node binary, label string, vec binary")


def _unit(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket of a vector; buckets are named by label and length as well."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 2000):
            part = batch.slice(begin, 2000)
            nids, labels, blobs = (part.column(i).to_pylist() for i in (0, 1, 2))
            by_size: dict[int, list[int]] = {}
            for i, blob in enumerate(blobs):
                by_size.setdefault(len(blob), []).append(i)
            for size, rows in by_size.items():
                keys = bucket_keys(_unit([blobs[i] for i in rows]))
                salt = np.array([xxhash.xxh3_64_intdigest(f"{size} {labels[i]}".encode()) for i in rows], np.uint64).view(np.int64)
                keys = (keys * np.int64(0x2545F4914F6CDD1D)) ^ salt[:, None]
                width = keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat([nids[i] for i in rows], width), pa.int64())], ["key", "nid"]
                )


def _verify(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Links between the two blocks of a bucket (or within one): counts by node, and forest edges."""
        name, low, high = (k.as_py() for k in key[:3])
        half, nid, copies = (table[c].to_numpy() for c in ("half", "nid", "copies"))
        x = _unit(table["vec"].to_pylist())
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), "<i8").reshape(len(x), -1)
        left, right = np.flatnonzero(half == low), np.flatnonzero(half == high)
        a, b = np.nonzero(x[left] @ x[right].T >= threshold)
        a, b = left[a], right[b]
        use = nid[a] < nid[b] if low == high else nid[a] != nid[b]
        a, b = a[use], b[use]
        # Counted where the first bucket that both list is this one.
        first = np.empty(len(a), bool)
        for i in range(0, len(a), 20_000):
            p, q = keys[a[i : i + 20_000]], keys[b[i : i + 20_000]]
            common = (p[:, :, None] == q[:, None, :]).any(axis=2)
            first[i : i + 20_000] = np.take_along_axis(p, common.argmax(axis=1)[:, None], 1)[:, 0] == name
        links = np.bincount(a[first], copies[b[first]], len(x)) + np.bincount(b[first], copies[a[first]], len(x))
        root = np.arange(len(x))
        while True:
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            least = least[least]
            if (least == root).all():
                break
            root = least
        counted, joined = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(x)))
        return pa.table(
            {
                "nid": np.concatenate([nid[counted], nid[joined]]),
                "other": pa.concat_arrays([pa.nulls(len(counted), pa.int64()), pa.array(nid[root[joined]])]),
                "links": np.concatenate([links[counted], np.zeros(len(joined))]).astype(np.int64),
            }
        )

    return run


def near_vectors(
    table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", column: str = "embedding", label: str = "label", block: int = BLOCK
) -> DataFrame:
    """(id, n_links, component_id, kept), a row for each vector."""
    rows = cut_lineage(_vectors(table, id_col, column, label))
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec")
    )
    nodes = cut_lineage(nodes.withColumn("nid", F.monotonically_increasing_id()))
    entries = nodes.select("nid", "label", "vec").mapInArrow(_entries, "key long, nid long").distinct()
    sizes = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    entries = cut_lineage(entries.join(sizes, "key").select("key", "nid", F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    # All of a node's shared buckets, in one order, for the rule that a pair counts once.
    listed = entries.groupBy("nid").agg(F.sort_array(F.collect_set("key")).alias("all"))
    width = listed.agg(F.max(F.size("all"))).first()[0] or 1
    # Padding differs by node, so that it never counts as a common bucket.
    listed = listed.join(nodes.select("nid", "copies", "vec"), "nid").mapInArrow(_padded(width), "nid long, copies long, vec binary, keys binary")
    own = F.pmod(F.xxhash64("nid", "key"), F.col("blocks")).cast("int")
    dealt = entries.withColumn("half", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("half", "other").alias("low"), F.greatest("half", "other").alias("high"), "half", "nid").join(listed, "nid")
    found = dealt.groupBy("key", "low", "high").applyInArrow(_verify(threshold), "nid long, other long, links long")
    found = cut_lineage(found)

    edges = found.where("other is not null").select(F.col("nid").alias("src"), F.col("other").alias("dst")).distinct()
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    groups = connected_components(ends, edges).select(F.col("id").alias("nid"), "component")
    smallest = groups.join(nodes.select("nid", "first_id"), "nid").groupBy("component").agg(F.min("first_id").alias("component_id"))
    groups = groups.join(smallest, "component").select("nid", "component_id")
    counts = found.groupBy("nid").agg(F.sum("links").alias("links"))
    labels = nodes.join(groups, "nid", "left").join(counts, "nid", "left").select(
        "node", F.coalesce("component_id", "first_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = rows.select("id", "node").join(labels, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _padded(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nids, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            blobs = []
            for nid, keys in zip(nids, lists):
                row = np.full(width, xxhash.xxh3_64_intdigest(nid.to_bytes(8, "little")), np.uint64).view(np.int64)
                row[: len(keys)] = keys
                blobs.append(row.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(blobs, pa.binary())], ["nid", "copies", "vec", "keys"]
            )

    return run
