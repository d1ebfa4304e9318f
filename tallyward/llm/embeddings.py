"""Embedding near-dedup by an epsilon grid order join.

Unit vectors of one label are projected on the leading principal directions, sorted by the cells of
a grid as wide as the join distance, and cut into sequence intervals. Projection never lengthens a
distance, so two intervals whose boxes are farther apart than the join distance hold no link and
are skipped; so are halves of intervals, recursively. What is left is compared in double precision.

A link is a cosine at or above the threshold, as dot(u, v) / (|u| * |v|) in double precision, after
scaling by powers of two, so that very large and very small components neither overflow nor vanish.
Equal vectors count once, with their number; they are known by a 64-bit hash of label and content. A task returns
counts per vector and a spanning forest of its links, never the pairs.

Intervals are the leaves of a tree of FANOUT children each; pairs of subtrees are joined level by
level, and only the children of pairs that are near go on. So no label's intervals all meet.

Vectors that are null, zero, or that hold null or non-finite components, and vectors whose label is
null, link with nothing. Vectors of different lengths do not link. Repeated rows are equal vectors;
rows that repeat a vec_id count each with its own content, and a null vec_id is never the smallest of
a component with others. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.common import Scratch, connected_components, table

#: Principal directions of the grid, vectors per sequence interval, and vectors per leaf of the recursion.
DIRECTIONS, INTERVAL, LEAF = 6, 1024, 64
#: Children of a node of the tree of intervals, as a power of two.
FANOUT = 5
#: Distances keep this much room for rounding before anything is skipped.
ROOM = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _scaled(m: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which brings their largest component to between 0.5 and 1."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(1, initial=0.0))[1][:, None])


def _unit(m: np.ndarray) -> np.ndarray:
    m = _scaled(m)
    return m / np.linalg.norm(m, axis=1)[:, None]


def principal_directions(vectors: DataFrame, dim: int, k: int) -> np.ndarray:
    """The k leading eigenvectors of the second moments of all unit vectors; tasks send dim * dim sums."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            if len(b):
                m = _unit(_matrix(b.column(0)))
                total += m.T @ m
        yield pa.record_batch([pa.array(range(dim), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["row", "sums"])

    parts = vectors.select("embedding").mapInArrow(moments, "row int, sums array<double>")
    sums = parts.select("row", F.posexplode("sums").alias("col", "x")).groupBy("row", "col").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros((dim, dim))
    total[sums.row, sums.col] = sums.x
    values, directions = np.linalg.eigh((total + total.T) / 2)
    return directions[:, np.argsort(values)[::-1][:k]]


def _boxes_apart(a: np.ndarray, b: np.ndarray, radius: float) -> bool:
    """Whether the boxes around two sets of projected vectors are farther apart than radius."""
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(gap @ gap) > radius * radius


def join_intervals(va: np.ndarray, pa_: np.ndarray, vb: np.ndarray, pb: np.ndarray, threshold: float, radius: float, same: bool, found: list, oa: int = 0, ob: int = 0) -> None:
    """Recursive join of two sequence intervals; appends arrays of (i, j) with cosine >= threshold.

    va and vb are unit vectors in double precision, pa_ and pb their projections, same: one interval with itself.
    """
    if not len(va) or not len(vb) or _boxes_apart(pa_, pb, radius):
        return
    if len(va) <= LEAF and len(vb) <= LEAF:
        i, j = np.nonzero(va @ vb.T >= threshold)
        if same:
            i, j = i[i < j], j[i < j]
        found.append(np.stack([i + oa, j + ob], 1))
        return
    ha, hb = (len(va) + 1) // 2, (len(vb) + 1) // 2
    for sa, da in ((slice(0, ha), 0), (slice(ha, None), ha)):
        for sb, db in ((slice(0, hb), 0), (slice(hb, None), hb)):
            if same and da > db:
                continue
            join_intervals(va[sa], pa_[sa], vb[sb], pb[sb], threshold, radius, same and da == db, found, oa + da, ob + db)


def _forest(n: int, links: np.ndarray) -> list[tuple[int, int]]:
    parent, out = list(range(n)), []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in links.tolist():
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def near_intervals(ordered: DataFrame, radius: float) -> DataFrame:
    """(i, j): pairs of intervals whose boxes are not farther apart than radius, found from the top of a tree of intervals down.

    A level's nodes are runs of intervals of one partition of the grid order, then runs of partitions.
    """
    k = DIRECTIONS
    boxes = ordered.groupBy("label", "dim", "part", "number", "interval").agg(*[f(F.col("point")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("lo", F.min), ("hi", F.max))])
    most = boxes.agg(F.max("number").alias("number"), F.max("part").alias("part")).first()
    steps = [(0, FANOUT * s) for s in range(1, 64) if most["number"] >> (FANOUT * (s - 1))]
    steps += [(FANOUT * s, 63) for s in range(1, 13) if most["part"] >> (FANOUT * (s - 1))]
    levels, names = [], ["interval"]
    for parts, numbers in steps:
        names.append(f"up{len(names)}")
        boxes = boxes.withColumn(names[-1], F.xxhash64("label", "dim", F.shiftright("part", parts), F.shiftright("number", numbers) if numbers < 63 else F.lit(0), F.lit(len(names))))
    bounds = [f(f"{n}{i}").alias(f"{n}{i}") for i in range(k) for n, f in (("lo", F.min), ("hi", F.max))]
    for at, name in enumerate(names):
        above = F.xxhash64("label", "dim") if at + 1 == len(names) else F.col(names[at + 1])
        levels.append(boxes.select(above.alias("above"), F.col(name).alias("key"), *[c for i in range(k) for c in (f"lo{i}", f"hi{i}")]).groupBy("above", "key").agg(*bounds))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"x.lo{i}") - F.col(f"y.hi{i}"), F.col(f"y.lo{i}") - F.col(f"x.hi{i}")), 2.0) for i in range(k)), F.lit(0.0))
    top = levels[-1].select("above").distinct()
    near = top.select(F.col("above").alias("i"), F.col("above").alias("j"))
    for level in reversed(levels):
        x, y = level.alias("x"), level.alias("y")
        pairs = near.join(x, F.col("i") == F.col("x.above")).join(y, F.col("j") == F.col("y.above"))
        # children of one node meet once; those of two nodes all meet
        pairs = pairs.where((F.col("i") != F.col("j")) | (F.col("x.key") <= F.col("y.key"))).where(gap <= radius * radius)
        near = pairs.select(F.col("x.key").alias("i"), F.col("y.key").alias("j"))
    return near


def near_vectors(vectors: DataFrame, threshold: float = 0.93, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "embeddings")
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    base = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    base = base.withColumn("node", F.when(F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull(), F.xxhash64("label", F.size("embedding"), "embedding")))
    # equal vectors once
    nodes = base.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = scratch.save(nodes.withColumn("dim", F.size("embedding")), "nodes")
    row = nodes.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if row is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # the usual length has its own directions; any orthogonal ones will do, so other lengths use the first axes
    usual = row["dim"]
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + ROOM
    shared = spark.sparkContext.broadcast(principal_directions(nodes.where(F.col("dim") == usual), usual, min(DIRECTIONS, usual)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                m = _unit(_matrix(own.column(2)))
                p = np.zeros((len(m), DIRECTIONS))
                p[:, : min(dim, DIRECTIONS)] = m @ shared.value if dim == usual else m[:, :DIRECTIONS]
                yield pa.record_batch([own.column(0), pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(np.floor(p / radius).astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["node", "point", "cell"])

    placed = nodes.select("node", "dim", "embedding").mapInArrow(project, "node long, point array<double>, cell array<int>")
    placed = scratch.save(nodes.select("node", "label", "dim").join(placed, "node"), "placed")
    # sequence intervals: the grid order cut at equal distances, label by label; a range partition holds
    # consecutive rows, and numbering within it needs no global sort
    ordered = placed.repartitionByRange("label", "dim", "cell", "node").sortWithinPartitions("label", "dim", "cell", "node")
    ordered = ordered.withColumn("place", F.monotonically_increasing_id())
    ordered = ordered.withColumns({"part": F.shiftright("place", 33), "number": F.floor(F.pmod("place", F.lit(1 << 33)) / INTERVAL)})
    ordered = ordered.withColumn("interval", F.xxhash64("label", "dim", "part", "number"))
    ordered = scratch.save(ordered.select("node", "label", "dim", "point", "place", "part", "number", "interval"), "ordered")
    tasks = scratch.save(near_intervals(ordered, radius), "tasks")
    sides = tasks.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("interval"))
    rows = ordered.select("node", "interval", "place", "point").join(nodes.select("node", "embedding", "copies"), "node").join(sides, "interval")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", kind="stable")
        v = _scaled(np.array(pdf["embedding"].tolist(), np.float64))
        norm = np.sqrt((v * v).sum(1))
        m = v / norm[:, None]
        p = np.array(pdf["point"].tolist())
        node, copies = pdf["node"].to_numpy(), pdf["copies"].to_numpy()
        first = pdf["interval"].to_numpy() == pdf["i"].to_numpy()
        a, b = np.flatnonzero(first), np.flatnonzero(~first)
        found: list[np.ndarray] = []
        # a little below the threshold here, then the plain quotient decides
        loose = threshold - 1e-12
        if len(b):
            join_intervals(m[a], p[a], m[b], p[b], loose, radius, False, found)
        else:
            join_intervals(m, p, m, p, loose, radius, True, found)
        links = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        if len(b) and len(links):
            links = np.stack([a[links[:, 0]], b[links[:, 1]]], 1)
        if len(links):
            keep = np.concatenate([(v[x[:, 0]] * v[x[:, 1]]).sum(1) / (norm[x[:, 0]] * norm[x[:, 1]]) >= threshold for x in np.array_split(links, len(links) // 65536 + 1)])
            links = links[keep]
        weight = np.bincount(links[:, 0], copies[links[:, 1]], len(node)) + np.bincount(links[:, 1], copies[links[:, 0]], len(node))
        rows = [(node[x], None, int(weight[x])) for x in np.flatnonzero(weight)] + [(node[x], node[y], 0) for x, y in _forest(len(node), links)]
        return pd.DataFrame({"u": pd.array([r[0] for r in rows], "Int64"), "v": pd.array([r[1] for r in rows], "Int64"), "links": pd.array([r[2] for r in rows], "Int64")})

    found = scratch.save(rows.groupBy("i", "j").applyInPandas(work, "u long, v long, links long"), "links")
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("v is not null").select("u", "v"), scratch)
    facts = nodes.select("node", "least", "copies").join(counts, "node", "left").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    facts = scratch.save(facts, "facts")
    least = facts.groupBy("component").agg(F.min("least").alias("first"))
    facts = facts.join(least, "component").select(F.col("node").alias("m"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "first")
    facts = scratch.save(facts, "named")
    out = base.select("vec_id", "node").join(facts, F.col("node") == F.col("m"), "left")
    component = F.coalesce("first", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op9_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_epsilon_grid_join": op9_epsilon_grid_join}
SQL: dict[str, str] = {}
