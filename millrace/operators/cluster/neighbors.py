"""Exact neighbour search by cells, without a cross join.

Points are assigned to the nearest of some pivots. The triangle inequality tells which cells
can hold a neighbour of a point, so it is sent to those cells only. Inside a cell points are
packed into blocks of bounded size on both sides; a pair of blocks is one Arrow row, and its
distances are matrix products in numpy, a slice of the queries at a time. Blocks widen with the table up to WIDE rows, so
that points without clusters, which meet every block, are not sent more often in larger tables. A hot cell becomes many block pairs, never one big
group, and only the wanted neighbours leave a block.

Cells keep their size: there are as many as the points need, and they are small where points have at most LOW_DIMENSIONS
coordinates, since few cells can then hold a neighbour. Besides the triangle inequality the plane halfway between two pivots rules
cells out: all of a cell lies on its pivot's side. Up to FLAT pivots all tasks know them all. Beyond that
pivots form two levels. The upper one has about the square root of their number and is known everywhere; the lower one
is a table, and points meet the lower pivots of an upper cell in tasks of at most MEET points.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.frames import col
from millrace.plans.lineage import cut_lineage

BLOCK = 1_000
#: Blocks of reference points that a point meets at most, about, while blocks have fewer than WIDE rows.
BLOCKS = 32
WIDE = 16_000
#: Distances of a block pair that are held at once.
SLICE = 2_000_000
ROWS_PER_CELL = 20_000
#: Points of a cell where they have few coordinates.
LOW_DIMENSIONS = 4
LOW_ROWS_PER_CELL = 1_000
FLAT = 256
MEET = 50_000
#: Lower pivots of one upper cell are numbered within this many.
LOWER = 1 << 31


@dataclass(frozen=True)
class Cells:
    """Upper pivots with the spread of the reference points around them and, in two levels, the table of lower ones.

    ``lower`` is (upper, cell, pivot, radius, n), ``placed`` the reference points with their ``cell``.
    """

    pivots: np.ndarray
    count: np.ndarray
    radius: np.ndarray
    placed: DataFrame
    lower: DataFrame | None = None


def as_points(df: DataFrame, id_col: str, vector: str | Column) -> DataFrame:
    """(id, vec) with vec as array<double>."""
    v = col(vector) if isinstance(vector, str) else vector
    return df.select(col(id_col).cast("bigint").alias("id"), v.cast("array<double>").alias("vec"))


def pack_columns(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    return as_points(df, id_col, F.array(*[col(c).cast("double") for c in cols]))


def choose_pivots(points: DataFrame, n: int) -> np.ndarray:
    """The points with the smallest id hash: a deterministic uniform sample; ``n`` is at most about the root of the number of cells."""
    rows = points.orderBy(F.xxhash64("id"), "id").limit(n).select("vec").collect()
    return np.array([r["vec"] for r in rows], dtype=float)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances by the expansion; small errors, see ``_exact``."""
    sq = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * x @ y.T
    return np.sqrt(np.maximum(sq, 0.0))


def _nearest_pivot(points: DataFrame, pivots: np.ndarray, name: str) -> DataFrame:
    """Add ``name`` (place of the nearest pivot) and ``reach`` (distance to it)."""

    @F.pandas_udf("cell bigint, reach double")
    def nearest(vec: pd.Series) -> pd.DataFrame:
        x = np.stack(vec.to_numpy())
        cell = distances(x, pivots).argmin(1)
        return pd.DataFrame({"cell": cell, "reach": np.sqrt(((x - pivots[cell]) ** 2).sum(1))})

    return points.withColumn("_a", nearest("vec")).select("*", F.col("_a.cell").alias(name), "_a.reach").drop("_a")


def _beyond(x: np.ndarray, d: np.ndarray, pivots: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Pivots (columns) whose cells lie further than ``bound`` from the points ``x``, behind the plane between them and the nearest pivot.

    A cell's points are nearer to its pivot p than to any other pivot o, so they are at least (d(x, p)^2 - d(x, o)^2) / (2 d(p, o)) away.
    """
    near = d.argmin(1)
    apart = distances(pivots, pivots)[near]
    norms = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :]
    room = np.where(apart > 0, 2.0 * apart, 0.0)
    with np.errstate(invalid="ignore"):
        far = d * d - np.take_along_axis(d, near[:, None], 1) ** 2 > room * (bound[:, None] + 1e-9 * (1.0 + d)) + 1e-9 * (1.0 + norms)
    return far & (apart > 0)


def _spread(placed: DataFrame, name: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    count, radius = np.zeros(n, dtype=int), np.zeros(n)
    for s in placed.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("r")).collect():  # row per upper pivot
        count[s[name]], radius[s[name]] = s["n"], s["r"]
    return count, radius


def _meeting(rows: DataFrame, lower: DataFrame, run, schema: str) -> DataFrame:
    """``run(rows, lower pivots)`` for every upper cell; an upper cell with more than MEET rows is several tasks."""
    sizes = rows.groupBy("upper").agg(F.ceil(F.count(F.lit(1)) / MEET).alias("parts"))
    left = rows.join(sizes, "upper").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    spread = lower.join(sizes, "upper").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    # names of their own: both sides may come from one frame
    right = spread.select(F.col("upper").alias("_upper"), F.col("part").alias("_part"), *[c for c in lower.columns if c != "upper"])
    return left.groupBy("upper", "part").cogroup(right.groupBy("_upper", "_part")).applyInPandas(run, schema)


def _home(points: DataFrame, lower: DataFrame) -> DataFrame:
    """(id, vec, upper, cell, reach): the nearest lower pivot of each point's upper cell."""

    def run(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or pivots.empty:
            return rows[["id", "vec", "upper"]].assign(cell=0, reach=0.0).iloc[:0]
        pivots = pivots.sort_values("cell")
        x, p = np.stack(rows["vec"].to_numpy()), np.stack(pivots["pivot"].to_numpy())
        best = distances(x, p).argmin(1)
        return rows[["id", "vec", "upper"]].assign(cell=pivots["cell"].to_numpy()[best], reach=np.sqrt(((x - p[best]) ** 2).sum(1)))

    return _meeting(points, lower, run, "id bigint, vec array<double>, upper bigint, cell bigint, reach double")


def build_cells(points: DataFrame, cells: int | None = None) -> Cells:
    """Cells over the reference points (id, vec); ``cells`` is about how many, by default one for ROWS_PER_CELL points, LOW_ROWS_PER_CELL of few coordinates."""
    n, width = points.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    each = LOW_ROWS_PER_CELL if width and width <= LOW_DIMENSIONS else ROWS_PER_CELL
    wanted = max(1, min(n, cells if cells is not None else n // each + 1))
    if wanted <= FLAT:
        pivots = choose_pivots(points, wanted)
        placed = _nearest_pivot(points, pivots, "cell")
        return Cells(pivots, *_spread(placed, "cell", len(pivots)), placed)
    pivots = choose_pivots(points, int(np.ceil(np.sqrt(wanted))))
    first = cut_lineage(_nearest_pivot(points, pivots, "upper"))
    count, radius = _spread(first, "upper", len(pivots))
    # Lower pivots are a sample of the points by another hash, so dense regions get more; equal ones count once.
    share = max(1, n // wanted)
    sample = first.where(F.pmod(F.xxhash64("id", F.lit("lower")), F.lit(share)) == 0).select("upper", F.col("vec").alias("pivot"))
    own = points.sparkSession.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "upper bigint, pivot array<double>")
    pairs = sample.unionByName(own).distinct()
    number = F.row_number().over(Window.partitionBy("upper").orderBy(F.xxhash64("pivot"), "pivot"))
    lower = cut_lineage(pairs.withColumn("cell", F.col("upper") * LOWER + number))
    placed = cut_lineage(_home(first.select("id", "vec", "upper"), lower))
    inside = placed.groupBy("cell").agg(F.max("reach").alias("radius"), F.count(F.lit(1)).alias("n"))
    return Cells(pivots, count, radius, placed, cut_lineage(lower.join(inside, "cell")))


def place(points: DataFrame, cells: Cells) -> DataFrame:
    """``points`` (id, vec) with their home ``cell``."""
    if cells.lower is None:
        return _nearest_pivot(points, cells.pivots, "cell")
    # Homes are cells that hold reference points, and so are upper ones.
    held = np.flatnonzero(cells.count > 0)
    upper = _nearest_pivot(points, cells.pivots[held], "_u").select("id", "vec", F.lit(held.tolist())[F.col("_u").cast("int")].cast("bigint").alias("upper"))
    return _home(upper, cells.lower)


def route(points: DataFrame, cells: Cells, limit: Column, skip_home: bool = False, least: int = 0, taken: DataFrame | None = None) -> DataFrame:
    """One row (id, vec, limit, cell) per cell that may hold a point within ``limit``.

    With ``least``, ``limit`` is lowered to the distance within which the upper cells must hold that many points. ``taken`` (cell, owner) with a column
    ``owner`` of the points leaves out cells that are the owner's alone.
    """
    pivots, count, radius = cells.pivots, cells.count, cells.radius
    flat, owned = cells.lower is None, taken is not None

    @F.pandas_udf("limit double, targets array<bigint>")
    def targets(vec: pd.Series, bound: pd.Series, home: pd.Series) -> pd.DataFrame:
        x = np.stack(vec.to_numpy())
        d = distances(x, pivots)
        slack = 1e-9 * (1.0 + d)
        bound = bound.to_numpy()
        if 0 < least <= count.sum():
            reach = np.where(count > 0, d + radius + slack, np.inf)
            order = reach.argsort(axis=1)
            enough = (np.cumsum(count[order], axis=1) >= least).argmax(axis=1)
            bound = np.minimum(bound, np.take_along_axis(reach, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0])
        ok = (d - radius[None, :] <= bound[:, None] + slack) & (count[None, :] > 0) & ~_beyond(x, d, pivots, bound)
        if skip_home and flat:
            ok[np.arange(len(d)), home.to_numpy()] = False
        return pd.DataFrame({"limit": bound, "targets": [np.flatnonzero(row).tolist() for row in ok]})

    owner = [F.col("owner")] if owned else []
    routed = points.withColumn("_t", targets("vec", limit, "cell")).select("id", "vec", "cell", *owner, "_t.limit", F.explode("_t.targets").alias("upper"))
    if flat:
        routed = routed.select("id", "vec", "limit", *owner, F.col("upper").alias("cell"))
    else:
        kept = ["id", "vec", "limit", *(["owner"] if owned else [])]

        def visit(rows: pd.DataFrame, lower: pd.DataFrame) -> pd.DataFrame:
            if rows.empty or lower.empty:
                return rows[kept].assign(cell=0).iloc[:0]
            x, p, bound = np.stack(rows["vec"].to_numpy()), np.stack(lower["pivot"].to_numpy()), rows["limit"].to_numpy()
            d = distances(x, p)
            ok = (d - lower["radius"].to_numpy()[None, :] <= bound[:, None] + 1e-9 * (1.0 + d)) & ~_beyond(x, d, p, bound)
            names = lower["cell"].to_numpy()
            if skip_home:
                ok &= names[None, :] != rows["cell"].to_numpy()[:, None]
            i, j = np.nonzero(ok)
            return rows[kept].iloc[i].assign(cell=names[j])

        schema = "id bigint, vec array<double>, limit double" + (", owner bigint" if owned else "") + ", cell bigint"
        routed = _meeting(cut_lineage(routed), cells.lower, visit, schema)
    if owned:
        routed = routed.join(taken, ["cell", "owner"], "left_anti")
    return routed


def block_size(n: int) -> int:
    """Rows of a block for ``n`` reference points."""
    return max(BLOCK, min(WIDE, -(-int(n) // BLOCKS)))


def slices(rows: int, others: int):
    """Slices of the query rows of a block pair, at most SLICE distances each."""
    step = max(1, SLICE // max(1, others))
    return [slice(start, start + step) for start in range(0, rows, step)]


def _parts(rows: DataFrame, size: int) -> DataFrame:
    """(cell, parts): blocks per cell; one small row per cell."""
    return rows.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).alias("parts"))


def _with_parts(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    small = sizes.select(F.col("cell").alias("_cell"), "parts")
    return rows.join(small, F.col("cell") == F.col("_cell")).drop("_cell")


def _member(rows: str, name: str) -> Column:
    return F.transform(rows, lambda r: r[name])


def _blocks(rows: DataFrame, sizes: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Pack rows of a cell into its ``parts`` blocks: ids, flat vectors, extras as arrays."""
    keyed = _with_parts(rows, sizes).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    packed = keyed.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "vec", *extra)).alias("rows"))
    return packed.select(
        "cell",
        "part",
        _member("rows", "id").alias("ids"),
        F.flatten(_member("rows", "vec")).alias("vecs"),
        *[_member("rows", e).alias(e) for e in extra],
    )


def block_pairs(queries: DataFrame, refs: DataFrame, q_extra: Sequence[str] = (), r_extra: Sequence[str] = (), size: int | None = None) -> DataFrame:
    """Pairs of query and reference blocks of the same cell, of about ``size`` rows (BLOCK by default).

    Query blocks are repeated once per reference block of their cell and meet it on
    (cell, part), so the pairs of a hot cell spread over all tasks.
    """
    size = size or BLOCK
    sizes = _parts(refs, size)
    r = _blocks(refs, sizes, r_extra)
    r = r.select(
        F.col("cell").alias("_rc"), F.col("part").alias("_rp"), F.col("ids").alias("r_ids"), F.col("vecs").alias("r_vecs"),
        *[col(e).alias(f"r_{e}") for e in r_extra],
    )
    q = _blocks(queries, _parts(queries, size), q_extra).drop("part")
    spread = _with_parts(q, sizes).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    # a fixed partition number keeps the heavy pairs apart, however few bytes they hold
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = spread.repartition(tasks, "cell", "part")
    return spread.join(r, (F.col("cell") == F.col("_rc")) & (F.col("part") == F.col("_rp"))).drop("_rc", "_rp")


def _nearest_in_blocks(pairs: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    def nearest(q_ids, q, limit, r_ids, r) -> pd.DataFrame:
        d = distances(q, r)
        if exclude_self:
            d[q_ids[:, None] == r_ids[None, :]] = np.inf
        kk = min(k, len(r_ids))
        kth = np.partition(d, kk - 1, axis=1)[:, kk - 1]
        # the expansion is off by rounding, most for long vectors: keep near-ties and settle them exactly
        size = np.sqrt((q * q).sum(1)) + np.sqrt((r * r).sum(1).max())
        bar = np.minimum(kth, limit) + 1e-6 * (1.0 + size + np.where(np.isfinite(kth), kth, 0.0))
        qi, ri = np.nonzero((d <= bar[:, None]) & np.isfinite(d))
        exact = np.sqrt(((q[qi] - r[ri]) ** 2).sum(1))
        order = np.lexsort((r_ids[ri], exact, qi))
        qi, ri, exact = qi[order], ri[order], exact[order]
        first = np.searchsorted(qi, qi, side="left")
        keep = np.arange(len(qi)) - first < k
        return pd.DataFrame({"id": q_ids[qi[keep]], "neighbor": r_ids[ri[keep]], "distance": exact[keep]})

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                q_ids, r_ids = np.asarray(row.ids), np.asarray(row.r_ids)
                q = np.asarray(row.vecs, dtype=float).reshape(len(q_ids), -1)
                r = np.asarray(row.r_vecs, dtype=float).reshape(len(r_ids), -1)
                limit = np.asarray(row.limit, dtype=float)
                for part in slices(len(q), len(r)):
                    out.append(nearest(q_ids[part], q[part], limit[part], r_ids, r))
            yield pd.concat(out) if out else pd.DataFrame({"id": [], "neighbor": [], "distance": []})

    return pairs.select("ids", "vecs", "limit", "r_ids", "r_vecs").mapInPandas(run, "id bigint, neighbor bigint, distance double")


def _top(rows: DataFrame, k: int) -> DataFrame:
    """Best ``k`` per point; Spark limits each task's share before the shuffle."""
    order = Window.partitionBy("id").orderBy("distance", "neighbor")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_join(queries: DataFrame, refs: DataFrame, k: int, *, exclude_self: bool = False, cells: int | None = None) -> DataFrame:
    """Exact ``k`` nearest reference points of every query point: (id, neighbor, distance, rank).

    Both sides are (id, vec) frames, see :func:`as_points`. Ties go to the smaller id. Round
    one searches the home cell and yields an upper bound per point; round two visits the other
    cells that bound cannot rule out.
    """
    shape = build_cells(refs, cells)
    if not len(shape.pivots):
        return queries.sparkSession.createDataFrame([], "id bigint, neighbor bigint, distance double, rank int")
    r, size = shape.placed, block_size(shape.count.sum())
    # read several times: as blocks, as bounds and by the steps that route them
    q = shape.placed.select("id", "vec", "cell") if queries is refs else place(queries, shape)
    q = cut_lineage(q) if shape.lower is None or queries is not refs else q
    anywhere = F.lit(float("inf"))
    home = q.withColumn("limit", anywhere).select("id", "vec", "limit", "cell")
    local = _top(_nearest_in_blocks(block_pairs(home, r, ["limit"], size=size), k, exclude_self), k)
    if len(shape.pivots) == 1 and shape.lower is None:
        return local
    local = cut_lineage(local)  # read twice: as bound and as result
    bound = local.groupBy("id").agg(F.max("distance").alias("_far"), F.count(F.lit(1)).alias("_n"))
    bounded = q.join(bound.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    limit = F.when(F.col("_n") >= k, F.col("_far")).otherwise(anywhere)
    away = route(bounded.select("id", "vec", "cell", limit.alias("limit")), shape, F.col("limit"), skip_home=True, least=k + exclude_self)
    remote = _nearest_in_blocks(block_pairs(away, r, ["limit"], size=size), k, exclude_self)
    return _top(local.drop("rank").unionByName(remote), k)


def knn_predict(train: DataFrame, test: DataFrame, k: int = 5, *, regression: bool = False, exclude_self: bool = False, cells: int | None = None) -> DataFrame:
    """Majority class (ties: smaller label) or mean of the ``k`` nearest: (id, prediction).

    ``train`` is (id, vec, label), ``test`` (id, vec).
    """
    near = knn_join(test, train.select("id", "vec"), k, exclude_self=exclude_self, cells=cells)
    labels = train.select(F.col("id").alias("_train"), F.col("label").cast("double").alias("label"))
    joined = near.join(labels, F.col("neighbor") == F.col("_train"))
    if regression:
        return joined.groupBy("id").agg(F.avg("label").alias("prediction"))
    votes = joined.groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("prediction"))
