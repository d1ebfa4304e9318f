"""Exact nearest neighbours over a metric index, and local outlier factors.

Distinct points are dealt to their nearest pivot (pivots come from a bounded sample; any will do). The
points of a pivot, sorted by distance from it, are cut into packs: shells with a least and a greatest
radius. A pack is first compared with itself and with the packs of its points' nearest cells, which bounds the distance of each
point's k-th neighbour. For a point q whose own pivot is at distance o and another pivot p at distance d, no point of p's cell is nearer than

* d - (greatest radius), or (least radius) - d, by the triangle inequality, nor than
* (d - o) / 2, as every point is nearest to its own pivot.

Packs that all of these allow for some point are compared, the others never meet. Equal points
are one point with the least of their ids, so that copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyward.session import materialize

#: Points that pivots are chosen from, pivots, and points of a pack, at most.
SAMPLE, PIVOTS, PACK = 8192, 1024, 256
#: Cells that each point visits first.
NEAREST = 3
#: Bounds keep this much room for rounding.
ROOM = 1e-9


def _pivots(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """k means of a sample, as pivots near the points."""
    c = x[np.random.default_rng(7).permutation(len(x))[:k]]
    for _ in range(rounds):
        own = _distances(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances by differences, not by products, so that near points lose no digits."""
    out = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        out += (x[:, i, None] - y[None, :, i]) ** 2
    return np.sqrt(out)


def _points(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Index:
    """Packs of points (point long, x array<double> of dim numbers) around pivots."""

    def __init__(self, points: DataFrame, dim: int, pack: int = PACK, pivots: int = PIVOTS):
        spark = points.sparkSession
        self.dim = dim
        n = points.count()
        share, cells = min(1.0, 1.2 * SAMPLE / max(1, n) + 1e-6), 1 << 30
        drawn = points.withColumn("cell", F.pmod(F.xxhash64("point"), F.lit(cells)))
        drawn = drawn.where(F.col("cell") < int(share * cells)) if share < 1 else drawn
        # SAMPLE points at most reach the driver
        sample = np.array([r["x"] for r in drawn.orderBy("cell", "point").limit(SAMPLE).collect()], float).reshape(-1, dim)
        self.pivots = _pivots(sample, min(pivots, max(1, n // pack))) if n else np.zeros((0, dim))
        shared = spark.sparkContext.broadcast(self.pivots)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    d = _distances(_points(b.column(1), dim), shared.value)
                    cell = d.argmin(1)
                    yield pa.record_batch([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["point", "x", "cell", "radius"])

        placed = points.select("point", "x").mapInArrow(assign, "point long, x array<double>, cell int, radius double")
        # a range partition holds consecutive points; numbering within it needs no global sort
        placed = placed.repartitionByRange("cell", "radius", "point").sortWithinPartitions("cell", "radius", "point").withColumn("at", F.monotonically_increasing_id())
        self.points = materialize(placed.withColumn("pack", F.xxhash64("cell", F.floor(F.col("at") / pack))).drop("at"))
        self.packs = materialize(self.points.groupBy("pack").agg(F.first("cell").alias("cell"), F.min("radius").alias("near"), F.max("radius").alias("far"), F.count("*").alias("n")))
        # a row per pivot
        cell = {r["cell"]: (r["near"], r["far"]) for r in self.packs.groupBy("cell").agg(F.min("near").alias("near"), F.max("far").alias("far")).collect()}
        self.near = np.array([cell.get(i, (np.inf, np.inf))[0] for i in range(len(self.pivots))])
        self.far = np.array([cell.get(i, (-np.inf, -np.inf))[1] for i in range(len(self.pivots))])

    def within(self, k: int) -> DataFrame:
        """(point, other, d): the k nearest of each point's own pack."""
        dim = self.dim

        def work(t: pa.Table) -> pa.Table:
            x, ids = _points(t["x"], dim), t["point"].to_numpy()
            d = _distances(x, x)
            np.fill_diagonal(d, np.inf)
            return _nearest(d, ids, ids, k, np.full(len(ids), np.inf))

        return self.points.groupBy("pack").applyInArrow(work, "point long, other long, d double")

    def pairs(self, reach: DataFrame, nearest: int = 0) -> DataFrame:
        """(pack, other): packs that some point of a pack must be compared with, given each point's reach (point, reach); with nearest, only those of each point's so many nearest cells."""
        shared, dim = self.points.sparkSession.sparkContext.broadcast((self.pivots, self.near, self.far)), self.dim

        def work(t: pa.Table) -> pa.Table:
            pivots, near, far = shared.value
            d = _distances(_points(t["x"], dim), pivots)
            reach = t["reach"].to_numpy()[:, None]
            room = ROOM * (1 + d)
            least = np.maximum(np.maximum(d - far, near - d), (d - d.min(1, keepdims=True)) / 2)
            open_ = (least <= reach + room) & (far >= 0)
            if 0 < nearest < d.shape[1]:
                open_ &= d <= np.partition(d, nearest - 1, axis=1)[:, [nearest - 1]]
            cells = np.flatnonzero(open_.any(0))
            lo = np.where(open_, d - reach - room, np.inf).min(0)[cells]
            hi = np.where(open_, d + reach + room, -np.inf).max(0)[cells]
            return pa.table({"pack": pa.array(np.full(len(cells), t["pack"][0].as_py())), "cell": pa.array(cells.astype(np.int32)), "lo": pa.array(lo), "hi": pa.array(hi)})

        asked = self.points.join(reach, "point", "left").select("pack", "x", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
        cells = asked.groupBy("pack").applyInArrow(work, "pack long, cell int, lo double, hi double")
        shells = self.packs.select(F.col("pack").alias("other"), "cell", "near", "far")
        # shells of an open cell that the distances from its pivot allow
        return cells.join(shells, "cell").where((F.col("far") >= F.col("lo")) & (F.col("near") <= F.col("hi")) & (F.col("pack") != F.col("other"))).select("pack", "other")

    def across(self, pairs: DataFrame, reach: DataFrame, k: int) -> DataFrame:
        """(point, other, d): for each pair of packs, the k nearest within reach of the first pack's points."""
        dim = self.dim

        def work(t: pa.Table) -> pa.Table:
            first = t["first"].to_numpy(zero_copy_only=False)
            x, ids = _points(t["x"], dim), t["point"].to_numpy()
            far = t["reach"].to_numpy()[first]
            return _nearest(_distances(x[first], x[~first]), ids[first], ids[~first], k, far)

        points = self.points.select("pack", "point", "x").join(reach, "point", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
        asking = pairs.join(points, "pack").select("pack", "other", "point", "x", "reach", F.lit(True).alias("first"))
        asked = pairs.join(points.select(F.col("pack").alias("other"), "point", "x", "reach"), "other").select("pack", "other", "point", "x", "reach", F.lit(False).alias("first"))
        return asking.unionByName(asked).groupBy("pack", "other").applyInArrow(work, "point long, other long, d double")

    def nearest(self, k: int) -> DataFrame:
        """(point, other, d): the k nearest other points of each point, exactly; ties by the number of the point."""
        best = lambda df: df.withColumn("_r", F.row_number().over(W.partitionBy("point").orderBy("d", "other"))).where(F.col("_r") <= k).drop("_r")
        reached = lambda df: materialize(df.groupBy("point").agg(F.count("*").alias("n"), F.max("d").alias("reach")).where(F.col("n") == k).drop("n"))
        found = materialize(self.within(k))
        # the nearest cells first, so that few others stay open
        reach = reached(found)
        first = materialize(self.pairs(reach, NEAREST))
        found = materialize(best(found.unionByName(self.across(first, reach, k))))
        reach = reached(found)
        rest = materialize(self.pairs(reach).join(first, ["pack", "other"], "left_anti"))
        self.compared = first.unionByName(rest)
        return best(found.unionByName(self.across(rest, reach, k)))


def _nearest(d: np.ndarray, ids: np.ndarray, others: np.ndarray, k: int, reach: np.ndarray) -> pa.Table:
    """Rows (point, other, d) of the k least of each row of d within reach, ties by other."""
    by_id = np.argsort(others, kind="stable")
    at = by_id[np.argsort(d[:, by_id], 1, kind="stable")[:, :k]]
    value = np.take_along_axis(d, at, 1)
    keep = np.isfinite(value) & (value <= reach[:, None])
    row = np.broadcast_to(np.arange(len(d))[:, None], at.shape)[keep]
    return pa.table({"point": pa.array(ids[row]), "other": pa.array(others[at[keep]]), "d": pa.array(value[keep])})


def neighbours(df: DataFrame, row: str, columns: list[str], k: int, block: int = PACK, pivots: int = PIVOTS) -> DataFrame:
    """(row, other, d): the k nearest other rows of each row by Euclidean distance, ties by row. Exact. Packs hold block points.

    Rows with a null, NaN or infinite coordinate take no part; rows may share an id only if they share the point too.
    """
    x = F.array(*[F.col(f"`{c}`").cast("double") + F.lit(0.0) for c in columns])  # one zero
    sound = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.select(F.col(row).alias("row"), x.alias("x")).where(sound)
    # equal points are one; of its rows only the k + 1 first can be neighbours
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("x").orderBy("row"))).where(F.col("_r") <= k + 1)
    points = ranked.groupBy("x").agg(F.array_sort(F.collect_list("row")).alias("rows")).withColumn("point", F.xxhash64("x"))
    points = materialize(points)
    index = Index(points, len(columns), block, pivots)
    near = index.nearest(k)
    # each point with its own rows at distance 0, then those of its neighbours
    own = points.select("point", F.col("point").alias("other"), F.lit(0.0).alias("d"))
    lists = near.unionByName(own).join(points.select(F.col("point").alias("other"), "rows"), "other")
    lists = lists.groupBy("point").agg(F.collect_list(F.struct("d", "rows")).alias("lists"))  # k + 1 lists of k + 1 rows
    flat = F.flatten(F.transform("lists", lambda g: F.transform(g["rows"], lambda r: F.struct(g["d"].alias("d"), r.alias("other")))))
    lists = lists.select("point", F.array_sort(flat).alias("all"))
    found = rows.withColumn("point", F.xxhash64("x")).join(lists, "point")
    mine = F.slice(F.filter("all", lambda n: n["other"] != F.col("row")), 1, k)
    return found.select("row", F.explode(mine).alias("n")).select("row", "n.other", "n.d")


def local_outlier_factor(df: DataFrame, row: str, columns: list[str], k: int = 20) -> DataFrame:
    """(row, lof): mean density of the k neighbours over the row's own, densities from reach distances."""
    n = materialize(neighbours(df, row, columns, k))
    kd = n.groupBy(F.col("row").alias("other")).agg(F.max("d").alias("kd"))
    reach = n.join(kd, "other").withColumn("reach", F.greatest("d", "kd"))
    lrd = reach.groupBy("row").agg((1 / F.greatest(F.avg("reach"), F.lit(1e-10))).alias("lrd"))
    of = lrd.select(F.col("row").alias("other"), F.col("lrd").alias("other_lrd"))
    return n.join(of, "other").groupBy("row").agg(F.avg("other_lrd").alias("m")).join(lrd, "row").select("row", (F.col("m") / F.col("lrd")).alias("lof"))
