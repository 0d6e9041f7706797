"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

The graph starts from the best of small leaves: one table of leaves by hash, others by the signs of random projections. A
round joins every vector with the vectors on both ends of its edges: those that share a neighbour meet in that neighbour's
task, which compares them by one matrix product and hands each the best ones it did not know. The rounds end
when few edges change. Hubs take part with their NEAR best incoming edges, so no vector gathers more than twice NEAR others.

A query keeps a pool of the POOL best vectors met. It starts from its own vector's edges, or from the vectors of an entry sample if it is not
in the table, and each round follows the edges of the pool's unexpanded members at once, until none is left. The pool's
best are compared again exactly, in double precision, on the original vectors. Vectors travel as half floats until then.

Equal vectors are one node with its smallest ids, as many as a result can name, so groups of copies cost one node and ties go to the smaller id.

Defined cases. Vectors that are missing, empty, zero or hold a missing or non-finite component take no part, neither as queries; vectors of different
lengths are never neighbours. Rows of one id are the same object: none is a candidate for a query of that id; a query id with several
vectors searches with its first one in the order of their bytes. A row without an id takes no part. A table smaller than a leaf is searched
exactly. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.lineage import cut_lineage

NEAR = 32
LEAF = 2048
TABLES = 4
GIVEN = 8
ROUNDS = 12
SETTLED = 0.01
POOL = 192
STEP = 48
SEED = 20250309
#: Vectors whose edges one task improves, and queries whose pools one task holds.
CENTRES = 1500
ASKED = 64


def _nodes(table: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, node, dim, vec) of the rows that take part; ``vec`` is the original in doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nodes, dims, blobs = [], [], [], []
            for i, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not vector or None in vector:
                    continue
                array = np.array(vector, "<f8") + 0.0
                if np.isfinite(array).all() and array.any():
                    ids.append(i)
                    dims.append(len(array))
                    blobs.append(array.tobytes())
                    nodes.append(xxhash.xxh3_128_digest(blobs[-1]))
            columns = [pa.array(ids, pa.int64()), pa.array(nodes, pa.binary()), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "dim", "vec"])

    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, "id long, node binary, dim int, vec binary")


def _scaled(blobs: list[bytes]) -> np.ndarray:
    """Unit vectors of doubles; scaling by the largest component first keeps squares in range."""
    x = np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _halves(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f2").reshape(len(blobs), -1).astype(np.float32)


def _coded(bits: int, tables: int, seed: int):
    """nid, dim, code (unit vector as half floats) and a leaf name a table: the first is one for all, the others are projections' signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nid, dim, blobs = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for d in np.unique(dim):
                rows = np.flatnonzero(dim == d)
                x = _scaled([blobs[i] for i in rows])
                draw = np.random.default_rng([seed, int(d)])
                turned = x @ draw.standard_normal((d, (tables - 1) * max(bits, 1))) >= 0
                signs = turned.reshape(len(rows), tables - 1, -1)[:, :, :bits].astype(np.int64)
                leaves = np.concatenate([np.zeros((len(rows), 1), np.int64), (signs << np.arange(bits)).sum(axis=2)], axis=1)
                codes = [c.tobytes() for c in x.astype("<f2")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nid[i] for i in rows], pa.int64()), pa.array(dim[rows]), pa.array(codes, pa.binary()), pa.array(list(leaves), pa.list_(pa.int64()))],
                    ["nid", "dim", "code", "leaves"],
                )

    return run


def _best(own: np.ndarray, other: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Positions of each ``own``'s ``most`` nearest distinct others, grouped by own, nearest first."""
    order = np.lexsort((other, own))
    first = np.ones(len(order), bool)
    first[1:] = (own[order][1:] != own[order][:-1]) | (other[order][1:] != other[order][:-1])
    order = order[first]
    order = order[np.lexsort((other[order], -near[order], own[order]))]
    own = own[order]
    begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))[: len(own)])
    rank = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
    return order[rank < most]


def _edges(own: np.ndarray, other: np.ndarray, near: np.ndarray) -> pa.Table:
    return pa.table({"nid": pa.array(own, pa.int64()), "other": pa.array(other, pa.int64()), "near": pa.array(near, pa.float32())})


def _leaf(most: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """The nearest ones of every vector of a leaf, within it."""
        nid, x = table["nid"].to_numpy(), _halves(table["code"].to_pylist())
        near = x @ x.T
        np.fill_diagonal(near, -np.inf)
        width = min(most, len(x) - 1)
        if width <= 0:
            return _edges(nid[:0], nid[:0], near[0, :0])
        best = np.argpartition(-near, width - 1, axis=1)[:, :width]
        return _edges(np.repeat(nid, width), nid[best].ravel(), np.take_along_axis(near, best, 1).ravel())

    return run


def _local_join(given: int, most: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Pairs of vectors that share a centre of this task, where one would be an edge the other lacks."""
        centre, nid = table["centre"].to_numpy(), table["nid"].to_numpy()
        order = np.argsort(centre, kind="stable")
        centre, nid = centre[order], nid[order]
        x, floor = _halves(table["code"].to_pylist())[order], table["floor"].to_numpy()[order]
        begin = np.flatnonzero(np.concatenate(([True], centre[1:] != centre[:-1])))
        own, other, near = [], [], []
        for a, b in zip(begin, np.append(begin[1:], len(centre))):
            sims = x[a:b] @ x[a:b].T
            np.fill_diagonal(sims, -np.inf)
            width = min(given, b - a - 1)
            if width <= 0:
                continue
            best = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            value = np.take_along_axis(sims, best, 1)
            i, j = np.nonzero(value > floor[a:b, None])
            own.append(nid[a:b][i])
            other.append(nid[a:b][best[i, j]])
            near.append(value[i, j])
        if not own:
            return _edges(nid[:0], nid[:0], floor[:0])
        own, other, near = map(np.concatenate, (own, other, near))
        keep = _best(own, other, near, most)
        return _edges(own[keep], other[keep], near[keep])

    return run


def _merged(most: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """The best edges of each vector of this task, old and new; ``fresh`` marks new ones."""
        nid, other, near, fresh = (table[c].to_numpy() for c in ("nid", "other", "near", "fresh"))
        order = np.argsort(fresh, kind="stable")
        nid, other, near, fresh = nid[order], other[order], near[order], fresh[order]
        keep = _best(nid, other, near, most)
        return _edges(nid[keep], other[keep], near[keep]).append_column("fresh", pa.array(fresh[keep], pa.int32()))

    return run


_EDGE = "nid long, other long, near float"


def _dealt(key: str, n: int, each: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(max(1, math.ceil(n / each))))


class Index:
    """``members`` (id, nid) of every row, ``nodes`` (nid, dim, vec), ``codes`` (nid, dim, code), ``graph`` (nid, other, near)."""

    def __init__(self, members: DataFrame, nodes: DataFrame, codes: DataFrame, graph: DataFrame, size: int):
        self.members, self.nodes, self.codes, self.graph, self.size = members, nodes, codes, graph, size


def build(
    table: DataFrame, id_col: str = "vec_id", column: str = "embedding", most: int = NEAR, leaf: int = LEAF, tables: int = TABLES, rounds: int = ROUNDS
) -> Index:
    """Neighbour graph over all rows of ``table``."""
    rows = cut_lineage(_nodes(table, id_col, column))
    nodes = rows.groupBy("node").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    nodes = cut_lineage(nodes.withColumn("nid", F.monotonically_increasing_id()))
    members = cut_lineage(rows.select("id", "node").join(nodes.select("node", "nid"), "node").select("id", "nid", "node"))
    size = nodes.count()
    bits = max(0, math.ceil(math.log2(max(1, 2 * size / leaf)))) if size > leaf else 0
    coded = cut_lineage(nodes.select("nid", "dim", "vec").mapInArrow(_coded(bits, tables, SEED), "nid long, dim int, code binary, leaves array<long>"))
    codes = coded.select("nid", "dim", "code")

    # Leaves with more than ``leaf`` vectors are dealt by hash, so a crowd of near copies is several tasks.
    entries = coded.select("nid", "dim", F.posexplode("leaves").alias("table", "name"), "code")
    if not bits:
        entries = entries.where(F.col("table") == 0)
    sizes = entries.groupBy("dim", "table", "name").agg(F.ceil(F.count("*") / leaf).alias("parts"))
    entries = entries.join(sizes, ["dim", "table", "name"]).withColumn("part", F.pmod(F.xxhash64("nid", "table"), F.col("parts")))
    found = entries.groupBy("dim", "table", "name", "part").applyInArrow(_leaf(most), _EDGE)
    graph = _keep(found.withColumn("fresh", F.lit(1)), size, most)

    for _ in range(rounds if bits else 0):
        floor = graph.groupBy("nid").agg(F.min("near").alias("floor"), F.count("*").alias("n"))
        floor = floor.select("nid", F.when(F.col("n") >= most, F.col("floor")).otherwise(F.lit(-2.0)).cast("float").alias("floor"))
        order = Window.partitionBy("centre").orderBy(F.desc("near"), "nid")
        back = graph.select(F.col("other").alias("centre"), "nid", "near").withColumn("rank", F.row_number().over(order))
        ends = graph.select(F.col("nid").alias("centre"), F.col("other").alias("nid")).unionByName(back.where(F.col("rank") <= most).select("centre", "nid"))
        ends = ends.unionByName(codes.select(F.col("nid").alias("centre"), "nid")).distinct()
        known = codes.select("nid", "code").join(floor, "nid")
        met = ends.join(known, "nid").withColumn("task", _dealt("centre", size, CENTRES))
        found = met.groupBy("task").applyInArrow(_local_join(GIVEN, most), _EDGE)
        graph = _keep(graph.select("nid", "other", "near", F.lit(0).alias("fresh")).unionByName(found.withColumn("fresh", F.lit(1))), size, most)
        if (graph.agg(F.sum("fresh")).first()[0] or 0) < SETTLED * most * size:
            break
    return Index(members, nodes.select("nid", "dim", "vec"), codes, graph.select("nid", "other", "near"), size)


def _keep(edges: DataFrame, size: int, most: int) -> DataFrame:
    dealt = edges.select("nid", "other", "near", F.col("fresh").cast("int").alias("fresh")).withColumn("task", _dealt("nid", size, CENTRES))
    return cut_lineage(dealt.groupBy("task").applyInArrow(_merged(most), f"{_EDGE}, fresh int"))


def _pool(size: int, step: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """The pools of this task's queries with the vectors they met: nearness where it is not known yet, the best ``size`` kept, which to expand next."""
        query, nid, near, state = (table[c].to_numpy(zero_copy_only=False) for c in ("query", "nid", "near", "state"))
        near = near.astype(np.float32)
        fresh = table["code"].is_valid().to_numpy()
        new = np.flatnonzero(fresh)
        if len(new):
            codes, asked = table["code"].to_pylist(), table["asked"].to_pylist()
            by_size: dict[int, list[int]] = {}
            for i in new:
                by_size.setdefault(len(codes[i]), []).append(i)
            for same in by_size.values():
                for begin in range(0, len(same), 20_000):
                    at = same[begin : begin + 20_000]
                    near[at] = np.einsum("ij,ij->i", _halves([codes[i] for i in at]), _halves([asked[i] for i in at]))
        # Members stand before the same vector met again.
        order = np.argsort(fresh, kind="stable")
        query, nid, near, state = query[order], nid[order], near[order], state[order]
        keep = _best(query, nid, near, size)
        query, nid, near, state = query[keep], nid[keep], near[keep], state[keep].copy()
        state[state == 1] = 2
        open_ = np.flatnonzero(state == 0)
        begin = np.searchsorted(query[open_], query[open_])
        state[open_[np.arange(len(open_)) - begin < step]] = 1
        return pa.table({"query": query, "nid": nid, "near": near, "state": pa.array(state, pa.int32())})

    return run


_POOL = "query long, nid long, near float, state int"


def search(index: Index, queries: DataFrame, k: int, id_col: str = "vec_id", column: str = "embedding", pool: int = POOL, step: int = STEP) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query, those of its own id left out."""
    asked = _nodes(queries, id_col, column)
    first = asked.groupBy(F.col("id").alias("query")).agg(F.min(F.struct("node", "dim", "vec")).alias("v")).select("query", "v.*")
    own = index.members.select("node", F.col("nid").alias("own")).distinct()
    asked = cut_lineage(first.join(own, "node", "left").mapInArrow(_asked, "query long, own long, dim int, vec binary, asked binary"))
    n = asked.count()
    # States: 0 met, 1 to expand now, 2 expanded. An entry is a vector of low hash, at most ``pool`` for each length.
    lowest = Window.partitionBy("dim").orderBy(F.xxhash64("nid"), "nid")
    entry = index.codes.select("dim", "nid").withColumn("rank", F.row_number().over(lowest)).where(F.col("rank") <= pool)
    met = asked.where("own is null").join(entry, "dim").select("query", "nid")
    met = met.unionByName(asked.where("own is not null").select("query", F.col("own").alias("nid")))
    pools = None
    while True:
        new = met.join(index.codes.select("nid", "code"), "nid").join(asked.select("query", "asked"), "query")
        new = new.select("query", "nid", F.lit(0.0).cast("float").alias("near"), F.lit(0).alias("state"), "code", "asked")
        none = F.lit(None).cast("binary")
        rows = new if pools is None else new.unionByName(pools.select("*", none.alias("code"), none.alias("asked")))
        rows = rows.withColumn("task", _dealt("query", n, ASKED))
        pools = cut_lineage(rows.groupBy("task").applyInArrow(_pool(pool, step), _POOL))
        front = pools.where("state = 1").select("query", "nid")
        if front.isEmpty():
            break
        met = front.join(index.graph.select("nid", "other"), "nid").select("query", F.col("other").alias("nid")).distinct()
        met = met.join(pools.select("query", "nid"), ["query", "nid"], "left_anti")
    return _exact(index, asked, pools, k)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.select(["query", "own", "dim", "vec"])
        halves = [_scaled([v]).astype("<f2").tobytes() for v in rows.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(halves, pa.binary())], ["query", "own", "dim", "vec", "asked"])


def _exact(index: Index, asked: DataFrame, pools: DataFrame, k: int) -> DataFrame:
    """Cosines of the original vectors for the best of every pool; a vector stands for its ``k + 1`` smallest ids."""
    best = Window.partitionBy("query").orderBy(F.desc("near"), "nid")
    short = pools.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= 4 * k + 12).select("query", "nid")
    pairs = short.join(index.nodes.select("nid", "vec"), "nid").join(asked.select("query", F.col("vec").alias("asked")), "query")
    scored = pairs.mapInArrow(_cosines, "query long, nid long, score double")
    distinct = index.members.select("nid", "id").distinct()
    ids = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("nid").orderBy("id"))).where(F.col("rank") <= k + 1).select("nid", "id")
    named = scored.join(ids, "nid").where(F.col("id") != F.col("query")).groupBy("query", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = [float((a * b).sum()) for v, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()) for a, b in [_scaled([v, q])]]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], ["query", "nid", "score"])


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", column: str = "embedding", **settings) -> DataFrame:
    """Build the graph over ``table`` and search it for ``queries``."""
    return search(build(table, id_col, column, **settings), queries, k, id_col, column)
