"""Suffix-array dedup: removes every byte covered by a string of LENGTH bytes that also starts elsewhere.

Equal strings have equal smallest grams, so each string of LENGTH bytes belongs to its leftmost smallest gram
of GRAM bytes (by hash), and consecutive strings with one gram form a piece of text. Only grams that
occur twice matter. Their distinct pieces meet by gram, and a task sorts the suffixes of the
pieces it holds in two stages: suffixes smaller than their successors directly, all others induced
from them by scanning the buckets in order; common prefixes of neighbours then show the strings
that start twice. Equal pieces of one step are one row that lists its occurrences, and of all equal
pieces one body travels, with their number. Results return to each occurrence.

A gram with very many distinct pieces (the edge of a popular passage) would fill a task; its pieces are
cut into short runs of strings and meet by a hash of the bytes that all strings of a run share. Equal
bodies that meet are sorted once.

Null text is an empty text; texts shorter than LENGTH keep all bytes; matches do not cross texts; very long
texts are handled whole. Rows with one doc_id are texts of their own; repeated rows are copies of each
other. Empty tables give no rows. Extra columns are kept whatever their names; the two columns added
get more underscores where theirs are taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.common import _EXACT, Scratch, chunks, mix64, powers, ragged, table, unused

LENGTH, GRAM = 200, 80
#: Distinct pieces of one gram beyond which they are cut, and strings per run then.
MANY, RUN = 2000, 8
#: Bytes of pieces sorted together, at least one gram's.
SORT_BYTES = 1 << 20

_U = np.uint64


# --- pieces ---------------------------------------------------------------------------------------


def _prefix_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, inv = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_EXACT[buf] * p[:-1], out=sums[1:])
    return sums, inv


def pieces(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Pieces of all texts: text index, start, number of strings, offset of the gram, and hashes of gram and piece."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.concatenate([[0], np.cumsum(lens)])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    counts = np.maximum(lens - LENGTH + 1, 0)
    if not counts.sum():
        return {k: np.zeros(0, np.int64) for k in ("text", "start", "strings", "offset", "gram", "piece")}
    sums, inv = _prefix_hashes(buf)
    n = len(buf) - GRAM + 1
    gram = mix64((sums[GRAM:] - sums[:n]) * inv[:n])
    bits = _U(max(1, int(n).bit_length()))
    low = (gram >> bits << bits) | np.arange(n, dtype=np.uint64)
    width, span = LENGTH - GRAM + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    at = ragged(base[:-1], counts)
    text = np.repeat(np.arange(len(texts)), counts)
    place = (low[at] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    strings = np.diff(np.append(first, len(at)))
    start, place, text = at[first], place[first], text[first]
    end = start + strings + LENGTH - 1
    return {"text": text, "start": start - base[text], "strings": strings, "offset": place - start, "gram": gram[place].view(np.int64), "piece": mix64((sums[end] - sums[start]) * inv[start] + strings.astype(np.uint64)).view(np.int64)}


# --- two-stage suffix sorting ------------------------------------------------------------------------


def _packed(t: np.ndarray) -> np.ndarray:
    """Seven symbols of 9 bits from each position on, zero after a separator."""
    n = len(t)
    sep = np.flatnonzero(t == 0)
    ahead = sep[np.searchsorted(sep, np.arange(n))] - np.arange(n)
    wide = np.concatenate([t, np.zeros(8, t.dtype)]).astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(7):
        out |= np.where(ahead >= k, wide[k : k + n], _U(0)) << _U(9 * (6 - k))
    return out


def _direct_sort(at: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """Sorts suffixes by their first symbols up to a separator or depth; ties are refined seven symbols at a time."""
    order = at[np.argsort(key[at], kind="stable")]
    same = np.zeros(len(order), bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    ended = key & _U(0x1FF)  # a zero last symbol: the suffix ended
    for d in range(7, depth, 7):
        same &= ended[np.minimum(order + d - 7, len(key) - 1)] != 0  # suffixes that ended stay as they are
        tied = same.copy()
        tied[:-1] |= same[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(~same[where])
        k = key[np.minimum(order[where] + d, len(key) - 1)]
        by = np.lexsort((k, group))
        order[where] = order[where[by]]
        k = k[by]
        fresh = np.ones(len(where), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (group[1:] != group[:-1])
        same[where] = ~fresh
    return order


def suffix_array(t: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of t (symbols 1 to 256, 0 ends a piece, last symbol 0) in the order of their first depth symbols."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    nxt = np.append(change, n - 1)
    run_end = nxt[np.searchsorted(nxt, np.arange(n))]
    after = np.append(t, 0)[run_end + 1]
    smaller = (after > t[run_end]) | (t == 0)  # than the successor; separators are sorted directly as well
    small = np.flatnonzero(smaller)
    direct = _direct_sort(small, _packed(t), depth)
    begin = np.searchsorted(t[direct], np.arange(258))
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for c in range(257):
        here = induced[c]
        cur = np.concatenate(here) if here else np.zeros(0, np.int64)
        parts = [cur]
        while len(cur):  # predecessors in the same bucket, in scan order
            cur = cur[cur > 0] - 1
            cur = cur[t[cur] == c]
            parts.append(cur)
        bucket = np.concatenate([*parts, direct[begin[c] : begin[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[t[before] > c]
        if len(before):
            sym = t[before]
            by = np.argsort(sym, kind="stable")
            before, sym = before[by], sym[by]
            cuts = np.flatnonzero(sym[1:] != sym[:-1]) + 1
            for part in np.split(before, cuts):
                induced[t[part[0]]].append(part)
    return np.concatenate(out)


def repeated_strings(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per text the starts whose next length bytes also start elsewhere in these texts."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.concatenate([[0], np.cumsum(lens + 1)])
    t = np.zeros(base[-1], np.uint16)
    t[ragged(base[:-1], lens)] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    order = suffix_array(t, length)
    left = np.zeros(len(t), np.int64)
    left[ragged(base[:-1], lens)] = np.repeat(base[:-1] + lens, lens) - ragged(base[:-1], lens)
    order = order[left[order] >= length]
    key = _packed(t)
    pairs = np.arange(len(order) - 1)
    for d in [*range(0, length - 7, 7), length - 7]:  # common prefixes of neighbours, as far as they matter
        pairs = pairs[key[order[pairs] + d] == key[order[pairs + 1] + d]]
    hit = np.zeros(len(t), bool)
    hit[order[pairs]] = hit[order[pairs + 1]] = True
    found = np.flatnonzero(hit)
    cut = np.searchsorted(found, base)
    return [found[cut[i] : cut[i + 1]] - base[i] for i in range(len(texts))]


def _runs(starts: np.ndarray) -> list[int]:
    """Sorted starts as a flat list: first, number, first, number, ..."""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return [int(x) for part in np.split(starts, cut) if len(part) for x in (part[0], len(part))]


# --- on Spark ----------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """Columns by number, c0, c1, ..., and two hashes _k1 and _k2 of the row."""
    place = docs.columns.index(text_col)
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text = F.coalesce(f"c{place}", F.lit(""))
    ids = [F.col(c) for c in named.columns if c != f"c{place}"]
    return named.withColumns({"_k1": F.xxhash64(*ids, text), "_k2": F.hash(text, *ids)})


def repeated(docs: DataFrame, text_col: str, scratch: Scratch) -> DataFrame:
    """(_k1, _k2, runs): per text the strings that start elsewhere as well, as first and number, repeating."""
    own = docs.where(F.octet_length(text_col) >= LENGTH).select("_k1", "_k2", F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, texts in chunks(b):
                p = pieces(texts)
                order = np.argsort(p["piece"], kind="stable")
                first = np.ones(len(order), bool)
                for k in ("piece", "gram", "strings"):
                    v = p[k][order]
                    first[1:] &= v[1:] == v[:-1]
                first[1:] = ~first[1:]
                if len(order):
                    first[0] = True
                head, n = order[first], np.diff(np.append(np.flatnonzero(first), len(order)))
                at = pa.array(p["text"][head] + lo)
                rest = order[~first]  # further occurrences of the same pieces, in the order of these
                ends = np.concatenate([[0], np.cumsum(n - 1)]).astype(np.int32)
                where = pa.array(p["text"][rest] + lo)
                more = pa.StructArray.from_arrays([b.column(0).take(where), b.column(1).take(where), pa.array(p["start"][rest].astype(np.int32))], names=["k1", "k2", "start"])
                yield pa.record_batch(
                    [b.column(0).take(at), b.column(1).take(at), *[pa.array(p[k][head].astype(np.int32)) for k in ("start", "strings", "offset")], pa.array(p["gram"][head]), pa.array(p["piece"][head]), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), more)],
                    names=["k1", "k2", "start", "strings", "offset", "gram", "piece", "n", "more"],
                )

    placed = scratch.save(own.mapInArrow(cut, "k1 long, k2 int, start int, strings int, offset int, gram long, piece long, n long, more array<struct<k1:long,k2:int,start:int>>"), "pieces")
    twice = placed.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    cand = scratch.save(placed.join(twice, "gram"), "candidates")
    scratch.drop(placed)
    scratch.release()
    distinct = cand.groupBy("gram", "piece", "strings").agg(F.sum("n").alias("copies"), F.min(F.struct("k1", "k2", "start", "offset")).alias("at"))
    distinct = scratch.save(distinct, "distinct")
    scratch.release()
    many = distinct.groupBy("gram").agg(F.count("*").alias("n")).where(f"n > {MANY}").select("gram", F.lit(True).alias("many"))
    lists = distinct.join(many, "gram", "left").groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("at.start", "strings", "at.offset", "gram", "piece", "copies", F.coalesce("many", F.lit(False)).alias("many"))).alias("p"))
    bodies = own.join(lists, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2"))).select("text", "p")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "gram", "piece", "strings", "first", "copies", "body")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        for b in batches:
            for text, listed in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for x in listed:
                    s, n, gram = x["start"], x["strings"], x["gram"]
                    if not x["many"]:
                        rows.append((gram, gram, x["piece"], n, 0, x["copies"], text[s : s + n + LENGTH - 1]))
                        continue
                    i = 0
                    while i < n:  # runs of strings whose gram offsets share a multiple of RUN
                        stop = min(n, i + (x["offset"] - i) % RUN + 1)
                        top = (x["offset"] - i) // RUN * RUN + RUN - 1  # the largest gram offset of such a run
                        core = text[max(0, s + x["offset"] - top + RUN - 1) : s + x["offset"] - top + LENGTH]
                        key = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=(gram & (2**64 - 1)).to_bytes(8, "little")).digest(), "little", signed=True)
                        rows.append((key, gram, x["piece"], n, i, x["copies"], text[s + i : s + stop + LENGTH - 1]))
                        i = stop
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    schema = "key long, gram long, piece long, strings int, first int, copies long, body binary"
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one text per distinct piece (a repeated row sends its own again, which its copies cover); keys stay together and arrive sorted
    parts = bodies.mapInArrow(extract, schema).repartition(width, "key").sortWithinPartitions("key", "body")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            out, bodies = [], {}  # equal bodies are sorted once
            for r in rows:
                bodies.setdefault(r[6], len(bodies))
            alike = np.bincount([bodies[r[6]] for r in rows])
            found = repeated_strings(list(bodies))
            for _, gram, piece, strings, first, copies, body in rows:
                i = bodies[body]
                runs = [0, len(body) - LENGTH + 1] if copies > 1 or alike[i] > 1 else _runs(found[i])
                if runs:
                    runs = list(runs)
                    runs[0::2] = [x + first for x in runs[0::2]]
                    out.append((gram, piece, strings, runs))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())), strict=True)], names=["gram", "piece", "strings", "runs"])

        held, size = [], 0
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if size >= SORT_BYTES and row[0] != held[-1][0]:
                    yield from solve(held)
                    held, size = [], 0
                if held and row[0] == held[-1][0] and row[6] == held[-1][6]:  # an equal body takes no space of its own
                    row = (*row[:6], held[-1][6])
                else:
                    size += len(row[6])
                held.append(row)
        if held:
            yield from solve(held)

    order = ["key", "gram", "piece", "strings", "first", "copies", "body"]
    found = scratch.save(parts.select(*order).mapInArrow(sort, "gram long, piece long, strings int, runs array<int>"), "found")
    scratch.release()
    found = found.groupBy("gram", "piece", "strings").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    back = cand.join(found, ["gram", "piece", "strings"])
    back = back.select("runs", F.explode(F.concat(F.array(F.struct("k1", "k2", "start")), "more")).alias("o"))
    shifted = F.transform("runs", lambda x, i: F.when(i % 2 == 0, x + F.col("o.start")).otherwise(x))
    out = back.select("o.k1", "o.k2", shifted.alias("runs")).groupBy("k1", "k2").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    out = scratch.save(out, "runs")
    scratch.release()
    return out.select(F.col("k1").alias("_r1"), F.col("k2").alias("_r2"), "runs")


def _covered(n: int, runs: list[int] | None) -> np.ndarray:
    """Starts and ends of the maximal runs of removed bytes, as two rows."""
    if not runs:
        return np.zeros((2, 0), np.int64)
    mark = np.zeros(n + 1, np.int64)
    first, number = np.array(runs[0::2]), np.array(runs[1::2])
    np.add.at(mark, first, 1)
    np.add.at(mark, first + number + LENGTH - 1, -1)
    gone = np.cumsum(mark) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
    return np.stack([edge[0::2], edge[1::2]])


def remove_repeats(docs: DataFrame, *, text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """docs with _kept (the remaining bytes) and _spans (removed byte ranges, as start and end, repeating) as last columns."""
    scratch = scratch or Scratch(docs.sparkSession, "suffixes")
    keyed = _keyed(docs, text_col)
    place = docs.columns.index(text_col)
    runs = repeated(keyed, f"c{place}", scratch)
    joined = keyed.join(runs, (F.col("_k1") == F.col("_r1")) & (F.col("_k2") == F.col("_r2")), "left").drop("_k1", "_k2", "_r1", "_r2").withColumnRenamed("runs", "_runs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, spans = [], []
            for text, listed in zip(b.column(place).cast(pa.binary()).to_pylist(), b.column(len(b.columns) - 1).to_pylist(), strict=True):
                text = text or b""
                s = _covered(len(text), listed)
                ends = [0, *s.T.ravel().tolist(), len(text)]
                kept.append(b"".join(text[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2)))
                spans.append(s.T.ravel())
            yield pa.record_batch([*b.columns[:-1], pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.int64()))], names=[*b.schema.names[:-1], "_kept", "_spans"])

    from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

    schema = StructType(keyed.drop("_k1", "_k2").schema.fields).add("_kept", BinaryType()).add("_spans", ArrayType(LongType()))
    out = joined.mapInArrow(work, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], *[F.col(c).alias(unused(docs.columns, c)) for c in ("_kept", "_spans")])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", n.alias("n_bytes"), (n - F.octet_length("_kept")).cast("long").alias("n_removed"), (F.size("_spans") / 2).cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
SQL: dict[str, str] = {}  # SQL has no suffix sorting; tested against brute force
