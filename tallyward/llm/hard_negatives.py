"""Hard-negative mining over K-means inverted lists.

Rows are cut into lists by their nearest centroid (K-means on a bounded sample; every row is listed).
A list is stored in packs of one label, sorted by distance from the centroid, each with its exact
radius. For an anchor a and a list with centroid c and radius r, Cauchy-Schwarz bounds every score:
a.c - |a| r <= a.x <= a.c + |a| r. Anchors visit lists by falling upper bound in two waves: the
first lists give a kth best score, and of the others only those go on whose bound is not strictly below it
and whose range of scores meets the window. Each pack repeats the test with its own, smaller radius.
What is visited is compared exactly, so the result is exact whatever the sample was.

Scores are inner products of floor(256 * component) in 64-bit integers (results are defined while they fit).
Rows with a null label, a null vector, or a null or non-finite component take no part; vectors of other lengths
never meet. A null vec_id is no anchor and comes after all others in ties. Rows that repeat id, label and
floored vector count once; rows that share an id and differ in the rest are rows of their own, and the other
rows of an anchor are all but itself. Empty vectors score 0. Empty tables and anchors without positives or
negatives give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyward.llm.common import Scratch, table

#: Rows that centroids are fitted on, centroids, and rounds of K-means, at most.
SAMPLE, CLUSTERS, ROUNDS = 8192, 1024, 8
#: Rows of a pack of a list, anchors of a pack, and lists each anchor visits in the first wave.
PACK, ANCHORS, FIRST = 512, 256, 4
POSITIVES, NEGATIVES = 5, 10
LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: Float bounds keep this much room for rounding.
ROOM = 1e-9

_PACK = "pack long, dim int, label long, cluster int, radius double, n int, ids binary, vecs binary, row long, vec_id long"
_ANCHORS = "apack long, dim int, n int, rows binary, ids binary, labels binary, vecs binary, lo binary, hi binary, kth binary"


def _matrix(buffer: bytes, n: int, dim: int) -> np.ndarray:
    """n vectors of int32, or of int64 where a component is too large for that."""
    kind = np.int64 if dim and len(buffer) == 8 * n * dim else np.int32
    return np.frombuffer(buffer, kind).reshape(n, dim)


def _packed(m: np.ndarray) -> bytes:
    small = not m.size or (m.min() >= -(2**31) and m.max() < 2**31)
    return m.astype(np.int32 if small else np.int64).tobytes()


def _longs(buffer: bytes, width: int = 0) -> np.ndarray:
    out = np.frombuffer(buffer, np.int64)
    return out.reshape(-1, width) if width else out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: by doubles where all partial sums fit them."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if not x.size or not y.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.sqrt((x * x).sum(1).max()) * np.sqrt((y * y).sum(1).max()) < 2**52:
        return (x @ y.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


# --- lists --------------------------------------------------------------------------------------


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """k centroids by Lloyd's rounds from distinct rows; empty clusters keep their place."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]].astype(np.float64)
    for _ in range(rounds):
        own = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Lists:
    """Packs of every row, anchors as rows, and what is known of each centroid (bounded by CLUSTERS)."""

    def __init__(self, rows: DataFrame, scratch: Scratch, clusters: int = CLUSTERS):
        """rows: vec_id, label (long), v (array<double> of integers), anchor (boolean)."""
        spark = rows.sparkSession
        rows = rows.withColumn("dim", F.size("v"))
        usual = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
        self.dim, n = (usual["dim"], usual["count"]) if usual else (0, 0)
        self.centroids = np.zeros((1, self.dim))
        if n and self.dim:
            cells = 1 << 30
            share = min(1.0, 1.2 * SAMPLE / n + 1e-6)
            drawn = rows.where(F.col("dim") == self.dim).withColumn("cell", F.pmod(F.xxhash64("v", "vec_id", "label"), F.lit(cells)))
            drawn = drawn.where(F.col("cell") < int(share * cells)) if share < 1 else drawn
            # at most SAMPLE vectors reach the driver
            drawn = np.array([r["v"] for r in drawn.orderBy("cell", "vec_id").limit(SAMPLE).select("v").collect()], np.float64)
            self.centroids = kmeans(drawn, min(clusters, max(1, int(np.sqrt(n) / 4))))
        self.packs, self.anchors = self._build(rows, scratch)
        radius = {r["cluster"]: r["radius"] for r in self.packs.where(F.col("dim") == self.dim).groupBy("cluster").agg(F.max("radius").alias("radius")).collect()}
        #: a cluster without rows has no list to visit
        self.radii = np.array([radius.get(i, -1.0) for i in range(len(self.centroids))])
        self.shared = spark.sparkContext.broadcast((self.dim, self.centroids, self.radii))

    def _build(self, rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        usual, shared = self.dim, rows.sparkSession.sparkContext.broadcast(self.centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims = b.column(4).to_numpy()
                for dim in np.unique(dims):
                    own = b.filter(pa.array(dims == dim))
                    # casts of doubles to long stop at the ends of the range, as Spark's do
                    x = own.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(own), dim)
                    m = np.where(x >= 2.0**63, HIGHEST, np.where(x < -(2.0**63), LOWEST, x).astype(np.int64, copy=False)) if np.abs(x).max(initial=0) >= 2.0**62 else x.astype(np.int64)
                    c = nearest(x, shared.value) if dim == usual else np.zeros(len(x), np.int64)
                    far = np.sqrt(((x - shared.value[c]) ** 2).sum(1)) if dim == usual else np.full(len(x), np.inf)
                    yield pa.record_batch([own.column(0), own.column(1), own.column(4), pa.array(c.astype(np.int32)), pa.array(far), pa.array([_packed(r) for r in m], pa.binary()), own.column(3)], names=["vec_id", "label", "dim", "cluster", "far", "v", "anchor"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, number = TaskContext.get().partitionId(), 0
            held: list[tuple] = []

            def flush() -> pa.RecordBatch:
                nonlocal number
                name = (part << 24) + number
                number += 1
                dim, label, cluster = held[0][:3]
                m = np.array([_long_vector(r[5], dim) for r in held], np.int64).reshape(len(held), dim)
                ids = np.array([HIGHEST if r[4] is None else r[4] for r in held], np.int64)
                out = [(name, dim, label, cluster, held[-1][3], len(held), ids.tobytes(), _packed(m), None, None)]
                out += [(None, dim, label, cluster, None, 1, None, r[5], name * PACK + i, r[4]) for i, r in enumerate(held) if r[6]]
                held.clear()
                return pa.RecordBatch.from_pylist([dict(zip(_FIELDS, r, strict=True)) for r in out], schema=_SCHEMA)

            last = None
            for b in batches:
                for r in zip(*[b.column(i).to_pylist() for i in range(7)], strict=True):
                    if held and (r[:3] != held[0][:3] or len(held) == PACK):
                        yield flush()
                    if r[:6] != last:
                        held.append(r)
                    last = r[:6]
            if held:
                yield flush()

        placed = rows.select("vec_id", "label", "v", "anchor", "dim").mapInArrow(assign, "vec_id long, label long, dim int, cluster int, far double, v binary, anchor boolean")
        order = ["dim", "label", "cluster", "far", "vec_id", "v"]
        both = placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "anchor").mapInArrow(pack, _PACK)
        both = scratch.save(both, "lists")
        return both.where("row is null").drop("row", "vec_id"), both.where("row is not null").select("row", "vec_id", "label", "dim", "cluster", F.col("vecs").alias("v"))


_FIELDS = [x.split()[0] for x in _PACK.split(", ")]
_SCHEMA = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}[f.split()[1]]) for f in _PACK.split(", ")])


def _long_vector(buffer: bytes, dim: int) -> np.ndarray:
    return _matrix(buffer, 1, dim)[0].astype(np.int64)


def pack_anchors(anchors: DataFrame, scratch: Scratch) -> DataFrame:
    """Anchors in packs of about ANCHORS, of one or neighbouring clusters; the window has a row per centroid."""
    counts = anchors.groupBy("dim", "cluster").agg(F.count("*").alias("n"))
    counts = counts.withColumn("start", F.sum("n").over(W.partitionBy("dim").orderBy("cluster").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n"))
    slot = F.floor((F.col("start") + F.pmod(F.xxhash64("row"), F.col("n"))) / ANCHORS)
    placed = anchors.join(counts, ["dim", "cluster"]).withColumn("slot", slot).withColumn("apack", F.xxhash64("dim", "slot"))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        dim, n = t["dim"][0].as_py(), len(t)
        m = np.array([_long_vector(v, dim) for v in t["v"].to_pylist()], np.int64).reshape(n, dim)
        whole = [np.full((n, 1), x, np.int64).tobytes() for x in (LOWEST, HIGHEST, LOWEST)]
        out = [t["apack"][0].as_py(), dim, n, *[t[c].to_numpy().astype(np.int64).tobytes() for c in ("row", "vec_id", "label")], _packed(m), *whole]
        return pa.table([pa.array([x], f.type) for x, f in zip(out, _ANCHOR_SCHEMA, strict=True)], schema=_ANCHOR_SCHEMA)

    packed = placed.select("apack", "dim", "row", "vec_id", "label", "v").groupBy("apack").applyInArrow(build, _ANCHORS)
    return scratch.save(packed, "anchors")


_ANCHOR_SCHEMA = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in _ANCHORS.split(", ")])


# --- visits --------------------------------------------------------------------------------------


class _Pack:
    """A pack of anchors with its windows (lo to hi) and kth scores so far."""

    def __init__(self, row: dict):
        self.n, self.dim = row["n"], row["dim"]
        self.rows, self.ids, self.labels = _longs(row["rows"]), _longs(row["ids"]), _longs(row["labels"])
        self.vecs = _matrix(row["vecs"], self.n, self.dim)
        width = len(row["lo"]) // (8 * self.n)
        self.lo, self.hi, self.kth = (_longs(row[c], width) for c in ("lo", "hi", "kth"))

    def bounds(self, facts: tuple) -> tuple[np.ndarray, np.ndarray]:
        """a.c and |a| for all centroids; other lengths than the usual one have a single list without bound."""
        usual, centroids, _ = facts
        x = self.vecs.astype(np.float64)
        return (x @ centroids.T if self.dim == usual else np.zeros((self.n, 1))), np.sqrt((x * x).sum(1))

    def open(self, middle: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Anchors by lists: whether a list's scores, within reach of middle, may enter a window at or above the kth score."""
        room = ROOM * (1 + np.abs(middle) + reach)
        top, bottom = (middle + reach + room)[:, :, None], (middle - reach - room)[:, :, None]
        floor = np.maximum(self.lo, self.kth).astype(np.float64)
        return ((top >= floor[:, None, :]) & (bottom <= self.hi.astype(np.float64)[:, None, :]) & (self.lo <= self.hi)[:, None, :]).any(2)


def visits(anchors: DataFrame, lists: Lists, wave: int) -> DataFrame:
    """(apack, dim, cluster, label): lists that some anchor of a pack visits, with the anchor's label; wave 1 are each anchor's first, wave 2 the rest that is still open."""
    shared = lists.shared

    def work(t: pa.Table) -> pa.Table:
        facts = shared.value
        out: list[tuple] = []
        for row in t.to_pylist():
            p = _Pack(row)
            middle, norm = p.bounds(facts)
            radii = facts[2] if p.dim == facts[0] else np.array([np.inf])
            reach = np.where(radii < 0, 0.0, radii)[None, :] * norm[:, None] if p.dim == facts[0] else np.full_like(middle, np.inf)
            there = np.broadcast_to(radii >= 0, middle.shape)
            # the first wave goes by the windows alone, so that the second knows what was visited
            kth, p.kth = p.kth, np.full_like(p.kth, LOWEST)
            able = p.open(middle, reach) & there
            rank = np.argsort(np.argsort(-np.where(able, middle + reach, -np.inf), axis=1, kind="stable"), axis=1)
            first = able & (rank < FIRST)
            p.kth = kth
            pick = first if wave == 1 else able & p.open(middle, reach)
            for label in np.unique(p.labels):
                mine = p.labels == label
                seen = first[mine].any(0)
                chosen = pick[mine].any(0) & (True if wave == 1 else ~seen)
                out += [(row["apack"], p.dim, int(c), int(label)) for c in np.flatnonzero(chosen)]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["apack", "dim", "cluster", "label"])

    return anchors.groupBy("apack").applyInArrow(work, "apack long, dim int, cluster int, label long")


def comparer(shared, k: int, same: bool) -> Callable:
    """Best k rows of one pack of a list for each anchor and window, of the anchor's label (same) or of others; visits holds the labels whose anchors visit the list in this wave."""

    def work(t: pa.Table) -> pa.Table:
        facts = shared.value
        found: list[np.ndarray] = []
        for row in t.to_pylist():
            p = _Pack(row)
            n = row["ln"]
            label, ids = row["llabel"], _longs(row["lids"])
            mine = np.isin(p.labels, row["visits"]) & ((p.labels == label) == same)
            middle, norm = p.bounds(facts)
            if p.dim == facts[0]:
                mine &= p.open(middle[:, [row["cluster"]]], norm[:, None] * row["radius"])[:, 0]
            who = np.flatnonzero(mine)
            if not len(who):
                continue
            s = products(p.vecs[who], _matrix(row["lvecs"], n, p.dim))
            own = row["pack"] * PACK + np.arange(n)
            by_id = np.argsort(ids, kind="stable")
            for i, a in enumerate(who):
                at = by_id[np.argsort(-s[i, by_id], kind="stable")]
                at = at[own[at] != p.rows[a]] if same else at
                score = s[i, at]
                for w in range(p.lo.shape[1]):
                    if p.lo[a, w] > p.hi[a, w]:
                        continue
                    start = np.searchsorted(-score, -p.hi[a, w]) if p.hi[a, w] < HIGHEST else 0
                    end = min(start + k, np.searchsorted(-score, -max(p.lo[a, w], p.kth[a, w], -HIGHEST), "right"))
                    if end > start:
                        take = at[start:end]
                        found.append(np.stack([np.full(len(take), row["apack"]), np.full(len(take), a), np.full(len(take), w), score[start:end], ids[take]]))
        m = np.concatenate(found, 1) if found else np.zeros((5, 0), np.int64)
        return pa.table([pa.array(m[0]), pa.array(m[1].astype(np.int32)), pa.array(m[2].astype(np.int32)), pa.array(m[3]), pa.array(m[4])], names=["apack", "place", "w", "score", "id"])

    return work


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and window; Spark keeps k of each before the shuffle as well."""
    rank = F.row_number().over(W.partitionBy("apack", "place", "w").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def search(anchors: DataFrame, lists: Lists, k: int, same: bool, scratch: Scratch) -> DataFrame:
    """(apack, place, w, score, id, rank): exact best k rows of every anchor and window."""
    other = F.col("x.label") == F.col("y.label") if same else F.col("x.label") != F.col("y.label")

    def compare(anchors: DataFrame, wave: int) -> DataFrame:
        x = visits(anchors, lists, wave).alias("x")
        y = lists.packs.select("pack", "dim", "cluster", "label").alias("y")
        pairs = x.join(y, (F.col("x.dim") == F.col("y.dim")) & (F.col("x.cluster") == F.col("y.cluster")) & other)
        # as many labels as a pack of anchors holds, at most
        pairs = scratch.save(pairs.groupBy("apack", "pack").agg(F.collect_set("x.label").alias("visits")), "pairs")
        sides = lists.packs.select("pack", "cluster", "radius", F.col("n").alias("ln"), F.col("label").alias("llabel"), F.col("ids").alias("lids"), F.col("vecs").alias("lvecs"))
        met = pairs.join(sides, "pack").join(anchors, "apack")
        hits = met.groupBy("apack", "pack").applyInArrow(comparer(lists.shared, k, same), "apack long, place int, w int, score long, id long")
        return hits

    top = scratch.save(_best(compare(anchors, 1), k), "top")

    def raise_kth(key, a: pa.Table, t: pa.Table) -> pa.Table:
        if not len(a):
            return a
        p = _Pack(a.to_pylist()[0])
        kth = p.kth.copy()
        kth[t["place"].to_numpy(), t["w"].to_numpy()] = t["score"].to_numpy()
        return a.set_column(a.schema.get_field_index("kth"), "kth", pa.array([kth.tobytes()], pa.binary()))

    reached = top.where(F.col("rank") == k).select("apack", "place", "w", "score")
    raised = scratch.save(anchors.groupBy("apack").cogroup(reached.groupBy("apack")).applyInArrow(raise_kth, _ANCHORS), "raised")
    return scratch.save(_best(top.drop("rank").unionByName(compare(raised, 2)), k), "best")


# --- mining ----------------------------------------------------------------------------------------


def mine(vectors: DataFrame, is_anchor: Column, *, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 30, high: int = 90, clusters: int = CLUSTERS, scratch: Scratch | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label).

    A negative's score lies between low and high percent of the positive's, ends included.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "negatives")
    rows = vectors.select("vec_id", (F.col("label") if label is None else label).cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    sound = F.col("x").isNotNull() & F.col("label").isNotNull() & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # doubles that hold the whole floor; those of 2**63 and more stop there, as a long does
    whole = F.transform("x", lambda c: F.floor(F.lit(256.0) * c).cast("double"))
    rows = rows.where(F.coalesce(sound, F.lit(False))).select("vec_id", "label", whole.alias("v"), "anchor")
    lists = Lists(rows, scratch, clusters)
    anchors = pack_anchors(lists.anchors, scratch)
    best = search(anchors, lists, positives, True, scratch)

    def windows(key, a: pa.Table, t: pa.Table) -> pa.Table:
        if not len(a):
            return a
        n = a["n"][0].as_py()
        lo, hi = np.full((n, positives), HIGHEST, np.int64), np.full((n, positives), LOWEST, np.int64)
        for place, rank, score in zip(*[t[c].to_pylist() for c in ("place", "rank", "score")], strict=True):
            lo[place, rank - 1], hi[place, rank - 1] = -(-low * score // 100), high * score // 100
        for name, x in (("lo", lo), ("hi", hi), ("kth", np.full((n, positives), LOWEST, np.int64))):
            a = a.set_column(a.schema.get_field_index(name), name, pa.array([x.tobytes()], pa.binary()))
        return a

    framed = anchors.groupBy("apack").cogroup(best.select("apack", "place", "rank", "score").groupBy("apack")).applyInArrow(windows, _ANCHORS)
    framed = scratch.save(framed, "framed")
    worst = search(framed, lists, negatives, False, scratch)

    def names(t: pa.Table) -> pa.Table:
        row = t.to_pylist()[0]
        return pa.table({"apack": pa.array([row["apack"]] * row["n"]), "place": pa.array(np.arange(row["n"]), pa.int32()), "anchor_id": pa.array(_longs(row["ids"]))})

    named = anchors.groupBy("apack").applyInArrow(names, "apack long, place int, anchor_id long")
    known = lambda c: F.when(F.col(c) != HIGHEST, F.col(c))
    pos = best.select("apack", "place", (F.col("rank") - 1).alias("w"), known("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = worst.join(pos, ["apack", "place", "w"]).join(named, ["apack", "place"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, F.pmod("vec_id", F.lit(100)) == 0, label=label)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
SQL = {
    "op11_hard_negatives": """
    WITH rows AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
      SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
    ), positives AS (
      SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
    ), ranked AS (
      SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS rank
      FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
    )
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
    """
}
