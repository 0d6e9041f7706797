"""Exact minimum spanning trees of points: single linkage and density clusters at every radius.

The nearest NEAR points of every point are found first (see ``neighbors``). Any other point lies no nearer than the last of them, so a
component whose cheapest listed edge is lighter than that floor of all its points has found its cheapest edge, and joins. Components are
joined in rounds of such edges; of a component of up to NEAR - 1 points every point lists one outside. What does not join that way,
groups of more points that lie closer together than to any other, looks for its cheapest edge in the cells that may hold one: points whose floor lies above a known edge of
their component stay out, the largest component only answers, and components at least halve each round.

Weights are distances or, with core distances, the largest of the distance and both cores (mutual reachability). Equal
weights are ordered by ids, so the tree is unique. Equal points without a core distance are one point with links of weight 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.cluster import neighbors as nb
from millrace.operators.cluster.quality import NOISE
from millrace.plans.components import connected_components
from millrace.plans.lineage import cut_lineage, forget_size

#: Edges up to which the rest of the tree is found in one task.
MERGE = 1_000_000
#: Neighbours a point lists before components look for edges themselves, the point itself among them.
NEAR = 12
#: Pivots through which a first bound of a component's cheapest edge is found.
THROUGH = 32
EDGE = "src bigint, dst bigint, weight double"
#: A forest in the making: edges taken (own is null), edges between components (a, b) and components (own) with their floor.
STATE = "kind string, src bigint, dst bigint, weight double, a bigint, b bigint"


def _root(parent: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def _certain(edges: pd.DataFrame, floors: pd.DataFrame) -> pd.DataFrame:
    """Rounds of cheapest edges lighter than the floor of their component, until there is none (see STATE)."""
    names = floors["id"].to_numpy()
    floor = floors["floor"].to_numpy()
    order = np.lexsort((edges["dst"].to_numpy(), edges["src"].to_numpy(), edges["weight"].to_numpy()))
    src, dst, weight = (edges[c].to_numpy()[order] for c in ("src", "dst", "weight"))
    by = np.argsort(names)
    place = lambda v: by[np.searchsorted(names, v, sorter=by)]
    a, b = place(edges["a"].to_numpy()[order]), place(edges["b"].to_numpy()[order])
    at, own, taken = np.arange(len(src)), np.arange(len(names)), []
    while len(at):
        # edges ascend, so the first of a component is its cheapest
        first = np.full(len(names), len(at))
        np.minimum.at(first, a, np.arange(len(at)))
        np.minimum.at(first, b, np.arange(len(at)))
        having = np.flatnonzero(first < len(at))
        sure = having[weight[at[first[having]]] < floor[having]]
        if not len(sure):
            break
        chosen = np.unique(first[sure])
        taken.append(at[chosen])
        # links form a forest: the far end of each component's edge is its parent, of two that chose one edge the smaller stays
        parent = np.arange(len(names))
        e = first[sure]
        other = np.where(a[e] == sure, b[e], a[e])
        parent[sure] = other
        mutual = sure[(parent[other] == sure) & (sure < other)]
        parent[mutual] = mutual
        parent = _root(parent)
        least = np.full(len(names), np.inf)
        np.minimum.at(least, parent, floor)
        floor, own, a, b = least, parent[own], parent[a], parent[b]
        kept = a != b
        at, a, b = at[kept], a[kept], b[kept]
    used = np.concatenate(taken) if taken else np.zeros(0, int)
    smallest = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(smallest, own, names)
    return pd.concat([
        pd.DataFrame({"kind": "taken", "src": src[used], "dst": dst[used], "weight": weight[used], "a": 0, "b": 0}),
        pd.DataFrame({"kind": "left", "src": src[at], "dst": dst[at], "weight": weight[at], "a": smallest[a], "b": smallest[b]}),
        pd.DataFrame({"kind": "named", "src": names, "dst": smallest[own], "weight": floor[own], "a": 0, "b": 0}),
    ])


def _joined(named: DataFrame, links: DataFrame) -> DataFrame:
    """(id, own, floor) after the components ``own`` are joined by ``links`` (a, b)."""
    nodes = named.groupBy("own").agg(F.min("floor").alias("floor"))
    linked = connected_components(nodes.select(F.col("own").alias("id")), links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    found = linked.select(F.col("id").alias("own"), F.col("component").alias("_to"))
    least = nodes.join(found, "own").groupBy("_to").agg(F.min("floor").alias("_least"))
    moved = named.join(found, "own").join(least, "_to")
    return forget_size(moved.select("id", F.col("_to").alias("own"), F.col("_least").alias("floor")))


def _between(edges: DataFrame, named: DataFrame) -> DataFrame:
    """The lightest edge (src, dst, weight, a, b) between any two components ``own`` of ``named``; a < b."""
    first = named.select(F.col("id").alias("src"), F.col("own").alias("_a"))
    second = named.select(F.col("id").alias("dst"), F.col("own").alias("_b"))
    moved = edges.select("src", "dst", "weight").join(first, "src").join(second, "dst").where("_a <> _b")
    pair = [F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")]
    return forget_size(moved.groupBy(*pair).agg(F.min(F.struct("weight", "src", "dst")).alias("e")).select("e.src", "e.dst", "e.weight", "a", "b"))


def _cheapest(rest: DataFrame) -> DataFrame:
    """(own, weight, src, dst, a, b): the cheapest edge of every component that has one."""
    ends = rest.select("src", "dst", "weight", "a", "b", F.explode(F.array("a", "b")).alias("own"))
    return ends.groupBy("own").agg(F.min(F.struct("weight", "src", "dst", "a", "b")).alias("e")).select("own", "e.*")


def _grown(edges: DataFrame, floors: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """(edges of the tree, edges left, (id, own, floor)) after all rounds in which a component's listed edge is certain."""
    named = cut_lineage(floors.select("id", F.col("id").alias("own"), "floor"))
    rest = _between(edges, named)
    taken = []
    while rest.count() > MERGE:
        sure = _cheapest(rest).join(named.groupBy("own").agg(F.min("floor").alias("_floor")), "own").where("weight < _floor")
        chosen = cut_lineage(sure.select("src", "dst", "weight", "a", "b").distinct())
        if chosen.isEmpty():
            return taken, rest, named
        taken.append(chosen.select("src", "dst", "weight"))
        named = _joined(named, chosen)
        rest = _between(rest, named)
    nodes = named.groupBy("own").agg(F.min("floor").alias("floor")).select(F.col("own").alias("id"), "floor")
    sides = rest.select(F.lit(0).alias("_all"), "src", "dst", "weight", "a", "b").groupBy("_all").cogroup(_ends(nodes, rest).select(F.lit(0).alias("_all"), "id", "floor").groupBy("_all"))
    state = cut_lineage(sides.applyInPandas(lambda rows, ids: _certain(rows, ids), STATE))
    taken.append(state.where("kind = 'taken'").select("src", "dst", "weight"))
    moved = state.where("kind = 'named'").select(F.col("src").alias("own"), F.col("dst").alias("_to"), F.col("weight").alias("_least"))
    joined = named.join(moved, "own", "left").select("id", F.coalesce("_to", "own").alias("own"), F.coalesce("_least", "floor").alias("floor"))
    return taken, forget_size(state.where("kind = 'left'").select("src", "dst", "weight", "a", "b")), forget_size(joined)


def _ends(nodes: DataFrame, rest: DataFrame) -> DataFrame:
    """The components that still have an edge; the others stay as they are."""
    return nodes.join(rest.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")


def _lightest(batches):
    """Per component of a pair's query block the lightest edge to another component, within the queries' limits."""
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            q_ids, r_ids, q_own, r_own = (np.asarray(v) for v in (row.ids, row.r_ids, row.owner, row.r_owner))
            q, r = np.asarray(row.vecs, float).reshape(len(q_ids), -1), np.asarray(row.r_vecs, float).reshape(len(r_ids), -1)
            q_core, r_core, limit = (np.asarray(v, float) for v in (row.core, row.r_core, row.limit))
            middle = r.mean(0)
            for part in nb.slices(len(q), len(r)):
                x, y, own = q[part], r, q_own[part]
                d = nb.distances(x - middle, y - middle)
                # the expansion is off by rounding, most where distances are small beside the vectors
                slack = 1e-6 * (1.0 + np.sqrt(((x - middle) ** 2).sum(1)) + np.sqrt(((y - middle) ** 2).sum(1).max()))
                w = np.maximum(np.maximum(d, q_core[part][:, None]), r_core[None, :])
                w[own[:, None] == r_own[None, :]] = np.inf
                order = np.argsort(own, kind="stable")
                starts = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
                least = np.repeat(np.minimum.reduceat(w.min(1)[order], starts), np.diff(np.r_[starts, len(own)]))
                bar = np.empty(len(own))
                bar[order] = least
                bar = np.minimum(bar + 2 * slack.max(), limit[part] + slack)
                i, j = np.nonzero((w <= bar[:, None]) & np.isfinite(w))
                best: list[pd.DataFrame] = []
                for some in np.array_split(np.arange(len(i)), len(i) // 100_000 + 1):
                    si, sj = i[some], j[some]
                    # differences: a pair weighs the same in whichever task it is met
                    exact = np.maximum(np.sqrt(((x[si] - y[sj]) ** 2).sum(1)), np.maximum(q_core[part][si], r_core[sj]))
                    a, b = q_ids[part][si], r_ids[sj]
                    found = pd.DataFrame({"own": own[si], "src": np.minimum(a, b), "dst": np.maximum(a, b), "weight": exact, "a": own[si], "b": r_own[sj]})
                    best.append(found.sort_values(["own", "weight", "src", "dst"]).drop_duplicates("own"))
                out.append(pd.concat(best).sort_values(["own", "weight", "src", "dst"]).drop_duplicates("own"))
        yield pd.concat(out) if out else pd.DataFrame({c: [] for c in ("own", "src", "dst", "weight", "a", "b")})


def _known(placed: DataFrame, pivots: np.ndarray, named: DataFrame) -> DataFrame:
    """(own, near): a weight that the cheapest edge of a component does not exceed, by the points nearest to the pivots."""

    def near(batches):
        for pdf in batches:
            if len(pdf):
                x, core = np.stack(pdf["vec"].to_numpy()), pdf["core"].to_numpy()
                own, place = np.unique(pdf["own"].to_numpy(), return_inverse=True)
                for i, pivot in enumerate(pivots):
                    least = np.full(len(own), np.inf)
                    np.minimum.at(least, place, np.maximum(np.sqrt(((x - pivot) ** 2).sum(1)), core))
                    yield pd.DataFrame({"pivot": i, "own": own, "d": least})

    # through a pivot: a point of the component and one of another, both as near to it as any
    members = placed.join(named.select(F.col("id").alias("_id"), "own"), F.col("id") == F.col("_id")).select("own", "vec", "core")
    sides = cut_lineage(members.mapInPandas(near, "pivot int, own bigint, d double").groupBy("pivot", "own").agg(F.min("d").alias("d")))
    two = Window.partitionBy("pivot").orderBy("d", "own")
    top = sides.withColumn("_n", F.row_number().over(two)).where("_n <= 2").groupBy("pivot").agg(
        F.min_by("own", "_n").alias("first"), F.min("d").alias("d1"), F.when(F.count(F.lit(1)) > 1, F.max("d")).alias("d2")
    )
    return sides.join(top, "pivot").select("own", (F.col("d") + F.when(F.col("first") == F.col("own"), F.col("d2")).otherwise(F.col("d1"))).alias("near")).groupBy("own").agg(F.min("near").alias("near"))


def _searched(placed: DataFrame, shape: nb.Cells, rest: DataFrame, named: DataFrame) -> DataFrame:
    """(src, dst, weight, a, b): the cheapest edge of every component but the largest."""
    sizes = named.groupBy("own").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.orderBy(F.desc("n"), "own").first()["own"]
    known = _known(placed, shape.pivots[:THROUGH], named).select("own", F.col("near").alias("weight")).unionByName(_cheapest(rest).select("own", "weight"))
    bound = known.groupBy("own").agg(F.min("weight").alias("_most"))
    held = cut_lineage(placed.join(named.select(F.col("id").alias("_id"), F.col("own").alias("owner"), "floor"), F.col("id") == F.col("_id")).drop("_id"))
    asking = held.where(F.col("owner") != largest).join(bound, F.col("owner") == F.col("own"), "left").withColumn("limit", F.coalesce("_most", F.lit(float("inf"))) * (1 + 1e-9) + 1e-12)
    alone = held.groupBy("cell").agg(F.min("owner").alias("owner"), F.max("owner").alias("_last")).where("owner = _last").select("cell", "owner")
    asking = cut_lineage(asking.where((F.col("own_floor") <= F.col("limit")) & (F.col("core") <= F.col("limit"))).select("id", "vec", "cell", "owner", "core", "limit"))
    routed = nb.route(asking.select("id", "vec", "cell", "owner", "limit"), shape, F.col("limit"), taken=alone)
    cores = asking.select(F.col("id").alias("_id"), "core")
    visits = routed.join(cores, F.col("id") == F.col("_id")).select("id", "vec", "cell", "owner", "core", "limit")
    pairs = nb.block_pairs(visits, held.select("id", "vec", "cell", "owner", "core"), ["owner", "core", "limit"], ["owner", "core"], size=nb.block_size(shape.count.sum()))
    found = pairs.select("ids", "vecs", "owner", "core", "limit", "r_ids", "r_vecs", "r_owner", "r_core").mapInPandas(_lightest, "own bigint, src bigint, dst bigint, weight double, a bigint, b bigint")
    listed = _cheapest(rest).where(F.col("own") != largest)
    both = found.unionByName(listed.select("own", "src", "dst", "weight", "a", "b"))
    best = both.groupBy("own").agg(F.min(F.struct("weight", "src", "dst", "a", "b")).alias("e"))
    return cut_lineage(best.select("e.src", "e.dst", "e.weight", F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).distinct())


def _last_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["weight", "src", "dst"])
    parent: dict[int, int] = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    keep = np.zeros(len(pdf), bool)
    for i, (a, b) in enumerate(zip(pdf["a"].to_numpy().tolist(), pdf["b"].to_numpy().tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[b] = a
            keep[i] = True
    return pdf.loc[keep, ["src", "dst", "weight"]]


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest of a graph of any size: (src, dst, weight) of the edges kept, ties to smaller ids.

    A round takes the cheapest edge of every component and joins what it links, so components at least halve.
    """
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    rest = cut_lineage(edges.where("src <> dst").select(lo.alias("src"), hi.alias("dst"), "weight").distinct().select("*", F.col("src").alias("a"), F.col("dst").alias("b")))
    taken = []
    while (left := rest.count()) > MERGE:
        ends = rest.select("src", "dst", "weight", "a", "b", F.explode(F.array("a", "b")).alias("own"))
        best = ends.groupBy("own").agg(F.min(F.struct("weight", "src", "dst", "a", "b")).alias("e"))
        chosen = cut_lineage(best.select("e.*").distinct())
        taken.append(chosen.select("src", "dst", "weight"))
        nodes = chosen.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        named = cut_lineage(connected_components(nodes, chosen.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
        # every component that still has an edge chose one, so all ends are named
        first = named.select(F.col("id").alias("a"), F.col("component").alias("_a"))
        second = named.select(F.col("id").alias("b"), F.col("component").alias("_b"))
        moved = rest.join(first, "a").join(second, "b").where("_a <> _b")
        pair = [F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")]
        rest = forget_size(moved.groupBy(*pair).agg(F.min(F.struct("weight", "src", "dst")).alias("e")).select("e.src", "e.dst", "e.weight", "a", "b"))
    if left:
        taken.append(rest.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda pdf: _last_edges(pdf), EDGE))
    if not taken:
        return edges.select("src", "dst", "weight").limit(0)
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out


def spanning_tree(points: DataFrame, core: DataFrame | None = None, cells: int | None = None) -> DataFrame:
    """The minimum spanning tree of ``points`` (id, vec) as (src, dst, weight), src < dst.

    ``core`` (id, core) makes weights mutual reachability; points without a core distance take no part. Points with a
    missing id or vector take no part; of rows with the same id the one with the smallest vector does.
    """
    points = points.where("id IS NOT NULL AND vec IS NOT NULL").groupBy("id").agg(F.min("vec").alias("vec"))
    if core is None:
        rows = points.withColumn("core", F.lit(0.0))
    else:
        rows = points.join(core.where("core IS NOT NULL").select("id", "core"), "id")
    rows = cut_lineage(rows)
    # copies without a core distance lie at weight 0: the smallest id stands for them
    copies = cut_lineage(rows.where("core = 0").groupBy("vec").agg(F.min("id").alias("src"), F.collect_set("id").alias("ids")).where("size(ids) > 1").select("src", F.explode("ids").alias("dst")).where("src <> dst"))
    rows = cut_lineage(rows.join(copies.select(F.col("dst").alias("id")), "id", "left_anti"))
    linked = copies.select("src", "dst", F.lit(0.0).alias("weight"))
    plain = rows.select("id", "vec")
    near = cut_lineage(nb.knn_join(plain, plain, NEAR, cells=cells))
    ends = rows.select("id", "core")
    listed = near.where("id <> neighbor").join(ends, "id").join(ends.select(F.col("id").alias("neighbor"), F.col("core").alias("_core")), "neighbor")
    edges = listed.select(F.least("id", "neighbor").alias("src"), F.greatest("id", "neighbor").alias("dst"), F.greatest("distance", "core", "_core").alias("weight")).distinct()
    # a point with fewer neighbours than asked for lists all there are
    floors = cut_lineage(near.groupBy("id").agg(F.when(F.count(F.lit(1)) < NEAR, float("inf")).otherwise(F.max("distance")).alias("floor")))
    taken, rest, named = _grown(edges, floors)
    placed = shape = None
    while named.agg(F.count_distinct("own")).first()[0] > 1:
        if placed is None:
            shape = nb.build_cells(rows.select("id", "vec"), cells)
            placed = shape.placed.select("id", "vec", "cell").join(rows.select("id", "core"), "id")
            placed = cut_lineage(placed.join(floors.withColumnRenamed("floor", "own_floor"), "id"))
        chosen = _searched(placed, shape, rest, named)
        taken.append(chosen.select("src", "dst", "weight"))
        named = _joined(named, chosen)
        rest = _between(rest, named)
    for part in taken:
        linked = linked.unionByName(part)
    return linked


def merges(tree: DataFrame) -> DataFrame:
    """(src, dst, height): the joins of single linkage, one for each edge of the tree; sort by height, src, dst."""
    return tree.select("src", "dst", F.col("weight").alias("height"))


def single_linkage(points: DataFrame, tree: DataFrame, k: int | None = None, height: float | None = None) -> DataFrame:
    """(id, cluster) of single linkage with ``k`` clusters or cut at ``height``; clusters are named by their smallest id.

    ``tree`` is the spanning tree of ``points``. Among equal heights later ids are cut first; with fewer points than ``k``
    each is a cluster.
    """
    if (k is None) == (height is None):
        raise ValueError("give either k or height")
    if k is not None:
        if k < 1:
            raise ValueError("k must be positive")
        cut = tree.orderBy(F.desc("weight"), F.desc("src"), F.desc("dst")).limit(k - 1)
        kept = tree.join(cut, ["src", "dst"], "left_anti")
    else:
        kept = tree.where(F.col("weight") <= height)
    ids = points.where("id IS NOT NULL AND vec IS NOT NULL").select("id").distinct()
    return connected_components(ids, kept).select("id", F.col("component").alias("cluster"))


def core_distances(points: DataFrame, min_pts: int, cells: int | None = None) -> DataFrame:
    """(id, core): distance to the ``min_pts``-th point, the point itself counted as the first; none with fewer points."""
    near = nb.knn_join(points, points, min_pts, cells=cells)
    return near.where(F.col("rank") == min_pts).select("id", F.col("distance").alias("core"))


def density_tree(points: DataFrame, min_pts: int, cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(core distances, spanning tree of mutual reachability): the density clusters of every radius at once."""
    core = cut_lineage(core_distances(points, min_pts, cells))
    return core, cut_lineage(spanning_tree(points, core, cells))


def density_labels(core: DataFrame, tree: DataFrame, radii: Sequence[float]) -> DataFrame:
    """(eps, id, cluster) for each radius: core points by their cluster's smallest id, all others -1.

    Radii ascend inside: clusters of a radius are joined to those of the next, so an edge is used once.
    """
    out, named, before = None, core.select("id", F.col("id").alias("cluster")), -1.0
    for eps in sorted(set(radii)):
        fresh = tree.where((F.col("weight") <= eps) & (F.col("weight") > before))
        left = named.select(F.col("id").alias("src"), F.col("cluster").alias("_a"))
        right = named.select(F.col("id").alias("dst"), F.col("cluster").alias("_b"))
        links = fresh.join(left, "src").join(right, "dst").select(F.col("_a").alias("src"), F.col("_b").alias("dst"))
        joined = connected_components(named.select(F.col("cluster").alias("id")).distinct(), links)
        named = forget_size(named.join(joined.select(F.col("id").alias("cluster"), "component"), "cluster").select("id", F.col("component").alias("cluster")))
        inner = core.select(F.col("id").alias("_id"), "core")
        part = named.join(inner, F.col("id") == F.col("_id")).select(
            F.lit(float(eps)).alias("eps"), "id", F.when(F.col("core") <= eps, F.col("cluster")).otherwise(F.lit(NOISE).cast("bigint")).alias("cluster")
        )
        out = part if out is None else out.unionByName(part)
        before = eps
    return out
