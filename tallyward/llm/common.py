"""Shared helpers: shared scratch tables, vectorised word hashing, connected components."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes outside these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step handles; longer single texts make a larger step.
CHUNK_BYTES = 1 << 19
#: Tasks among which the edges of one node are dealt.
SALT = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], name: str) -> str:
    """name, with as many underscores before it as keep it apart from columns (upper and lower case are one)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# --- shared scratch tables -------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one set here where none is set and all run in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; the shared folder then goes with the application
        pass


class Scratch:
    """Parquet tables in the shared folder that cut lineage, so a lost executor costs no recomputation.

    Tables stay until drop() or the end of the application, as results read them lazily.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(_delete, spark, self.base)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, df.scratch_path)

    def release(self) -> None:
        """Lets Spark's cleaner remove shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


# --- vectorised hashing of words ---------------------------------------------------------------

_rng = np.random.default_rng(20240607)
_EXACT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_M = 0x9E3779B97F4A7C15 | 1
_M_INV = pow(_M, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_M**i and its inverse modulo 2**64 for i < n."""
    if len(_powers.get("p", ())) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for key, base in (("p", _M), ("inv", _M_INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[key] = np.multiply.accumulate(out)
    return _powers["p"][:n], _powers["inv"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Runs:
    """Runs of bytes that a table calls inside, in some texts: first byte, end, hash by a table of codes, and per text the range of its runs."""

    def __init__(self, texts: list[bytes], inside: np.ndarray, code: np.ndarray):
        self.raw = b" ".join(texts) + b" "
        self.buf = buf = np.frombuffer(self.raw, np.uint8)
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        within = np.concatenate([[False], inside[buf], [False]])
        edge = np.flatnonzero(within[1:] != within[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        p, self._inv = powers(len(buf) + 1)
        self._sums = np.empty(len(buf) + 1, np.uint64)
        self._sums[0] = 0
        np.cumsum(code[buf] * p[:-1], out=self._sums[1:])
        self.hash = self.between(self.start, self.end)
        self.bounds = np.searchsorted(self.start, starts)

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from start to end."""
        return mix64((self._sums[end] - self._sums[start]) * self._inv[start] + (end - start).astype(np.uint64))


class Words:
    """Words of some texts: hash, first byte, end, and per text the range of its words."""

    def __init__(self, texts: list[bytes], fold: bool = True):
        self.raw = b" ".join(texts) + b" "
        buf = np.frombuffer(self.raw, np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lens + 1)])
        space = _SPACE[buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        p, inv = powers(len(buf) + 1)
        sums = np.empty(len(buf) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((_FOLDED if fold else _EXACT)[buf] * p[:-1], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * inv[self.start]
        self.hash = mix64(h + (self.end - self.start).astype(np.uint64))
        self.buf = buf
        #: words bounds[i] to bounds[i+1] belong to text i
        self.bounds = np.searchsorted(self.start, self.text_start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def chunks(batch: pa.RecordBatch, text_col: str = "text") -> Iterator[tuple[int, int, list[bytes]]]:
    """Whole texts of a batch in steps of about CHUNK_BYTES: first row, row after the last, UTF-8 bytes (null: empty)."""
    texts = [b"" if x is None else x for x in batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()]
    at, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > CHUNK_BYTES:
            yield at, i, texts[at:i]
            at, size = i, 0
        size += len(x) + 1
    if at < len(texts):
        yield at, len(texts), texts[at:]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start+1, … of each range, one range after the other."""
    if not len(lens):
        return np.zeros(0, np.int64)
    total = np.cumsum(lens)
    return np.arange(total[-1]) + np.repeat(starts - np.concatenate([[0], total[:-1]]), lens)


# --- connected components ------------------------------------------------------------------------


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Smallest node reachable for every node of an edge list (u, v long), as (node, component).

    Alternating large-star and small-star steps; each is one aggregation and one join, written to
    the shared folder. Only minima travel, and to SALT places each, so a node with very many
    neighbours gathers nothing and its edges meet its minimum in several tasks.
    """

    def spread(sym: DataFrame) -> DataFrame:
        low = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
        salted = sym.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int"))
        return salted.join(low, ["u", "salt"]).select("u", "v", F.least("u", "m").alias("m"))

    def stars(df: DataFrame) -> bool:
        """Whether each larger end has one edge only and is no edge's smaller end: then a further round would change nothing."""
        ends = df.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(df.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0] == 0

    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.save(e, "edges")
    while not stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = spread(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, "large")
        down = spread(large)  # every edge points to its smaller end
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = scratch.save(small, "small")
        scratch.drop(large)
        scratch.drop(e)
        e = new
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
