"""N-gram Jaccard join with several global token orders.

A document is its set of distinct word n-grams. Two sets whose Jaccard similarity reaches the threshold
share a token among their first tokens under any global order of all tokens. All orders here put
tokens of a single set first, so a set whose first tokens are all its own has no links and leaves at once.
Of the others, pairs that share one of the first tokens under the first order (rarest first) are
candidates; they must share one under each other order as well; only what passes all is verified,
on whole sets.

First, sets that cannot have links leave: two linked sets share many of their tokens of least hash, so a
set sends those only and stays if enough of them turn out to be shared. Of the sets that stay,
tokens are counted exactly: every task sends the tokens of its sets, packed, to the bucket of their
hash; a bucket returns those of two sets or more with their counts to the bucket of each set. Tokens
so frequent that a table of fixed size shows it are not sent; they come last in every order that goes by
counts. A set travels with the tokens it shares only, which is all that similarities need.

Nothing emits the pairs of a large group. Equal sets count once. A token with at most GROUP sets gives
its pairs; a more frequent one links its sets to one of them. The clusters of these links are
compared in tasks of at most about BLOCK sets, which apply the filters and then count exact
intersections; they return a spanning forest of their links. A larger cluster is cut into blocks, each
compared within itself and with some sets of the cluster that all blocks get; then the sets that
are not in the cluster's largest component meet all blocks. So no link between components is lost, and
the cost beyond one pass is (sets outside the largest component) x (sets of the cluster).

Null or empty text, and text without words, is an empty set and links with nothing; a text with fewer
words than n has its whole sequence as one n-gram. Repeated rows link (their sets are equal). Rows
that repeat a doc_id are compared each with its own text; a null doc_id is never the smallest of a
component with others. Very long texts are sets like any other. Empty tables give no rows. Extra
columns are ignored by jaccard_components() and kept by keep_one(), whatever their names. Sets and
tokens are known by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.common import Scratch, Words, chunks, connected_components, mix64, powers, ragged, table

#: Cells of the table of token counts, and of its slabs that are added up apart.
CELLS, SLAB = 1 << 20, 1 << 15
#: A token is frequent from so many rows above the mean of the cells (or eight deviations, if that is more).
FREQUENT = 4096
#: Tokens per bucket, and tokens a task holds before it sends them.
BUCKET, HOLD = 1 << 20, 1 << 20
#: Linked sets share one in so many of their tokens among those of least hash that they send.
SHARE = 5
#: Marks of texts (and ids of documents) that are broadcast at most (under 50 MB); more are joined by a shuffle.
BROADCAST_MARKS = 2_000_000
#: Sets that share a first token: up to so many give pairs, more are linked to one of them.
GROUP = 48
#: Sets per block of a cluster, and sets of a large cluster that all its blocks get.
BLOCK, PIVOTS = 1024, 32
#: Copies of the small side where one set may stand for very many rows.
SALT = 16
#: The first order gives candidates, the others filter.
ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707345, 0xA4093822299F31D1)

_U = np.uint64


class Shingles:
    """Distinct n-grams of some texts, sorted by text: hash, text index, and where each text's begin."""

    def __init__(self, texts: list[bytes], n: int):
        w = Words(texts)
        counts = np.diff(w.bounds)
        doc = w.doc()
        h = np.zeros(len(w.hash), np.uint64)
        mult = powers(n + 1)[0]
        room = np.arange(len(doc)) - w.bounds[:-1][doc] if len(doc) else np.zeros(0, np.int64)
        left = counts[doc] - room if len(doc) else room
        for k in range(n):
            ok = np.flatnonzero(left > k)
            h[ok] += w.hash[ok + k] * mult[k + 1]
        # an n-gram starts where n words are left; a shorter text has one, at its first word
        keep = (left >= n) | ((counts[doc] < n) & (room == 0)) if len(doc) else np.zeros(0, bool)
        short = counts[doc] < n if len(doc) else keep
        h = mix64(h + np.where(short, counts[doc].astype(np.uint64), _U(n)) if len(doc) else h)[keep]
        doc = doc[keep]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.hash, self.doc = h[new], doc[new]
        self.starts = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.n = np.diff(self.starts)

    def nodes(self) -> np.ndarray:
        """A hash of each whole set; 0 for an empty one."""
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(self.hash ^ _U(0x452821E638D01377)))])
        out = mix64(sums[self.starts[1:]] - sums[self.starts[:-1]] + self.n.astype(np.uint64))
        return np.where(self.n > 0, out, _U(0))


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """n - ceil(t * n) + 1: sets of similarity t or more share one of so many first tokens."""
    return np.where(n > 0, n - -(-n * num // den) + 1, 0)


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> _U(20)) & _U(CELLS - 1)


# --- sets that may have links -------------------------------------------------------------------------


def _sent(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many tokens of least hash a set sends: of two linked sets these have SHARE of the smaller set's tokens in common, or one."""
    return np.where(n > 0, n - -(-n * num // den) + np.maximum(1, n // SHARE), 0)


def possible(docs: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, mark, n, node) of every row, and texts of which every set with a link has one at least.

    Sets send their tokens of least hash, packed by bucket; a set that gets too few of them back as shared
    has no links. A token that several sets of a step share is sent once for all of them.
    """
    kind = dict(docs.dtypes)["doc_id"]
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * width
    names = ["bucket", "doc_id", "mark", "n", "node", "nodes", "lens", "tokens"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size, place = np.zeros(0, np.uint64), [], 0, 0

        def flush(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            node, token = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(token)
            node, token = node[order], token[order]
            head = np.ones(len(token), bool)
            head[1:] = token[1:] != token[:-1]
            many = np.diff(np.append(np.flatnonzero(head), len(token)))
            shared = np.repeat(many > 1, many)
            own, credit = np.unique(node[shared], return_counts=True)
            node[shared] = 0  # the sets here have their credit; others that hold the token get theirs
            use = head | ~shared
            rows = _pack((token[use] >> _U(40)).astype(np.int64) % buckets, node[use], token[use], None)
            rows.append((int(own[0] % _U(buckets)) if len(own) else 0, own.tobytes(), credit.astype(np.int32).tobytes(), None, None))
            k = len(rows)
            cols = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.nulls(k, id_type), *[pa.nulls(k, pa.int64())] * 3, *[pa.array(c, pa.binary()) for c in cols[1:4]]], names=names)

        id_type = pa.int64()
        for b in batches:
            id_type = b.column(0).type
            for lo, hi, texts in chunks(b):
                s, k = Shingles(texts, n), hi - lo
                nodes = s.nodes()
                deal = ((place + np.arange(k)) % buckets).astype(np.int32)
                place += k
                yield pa.record_batch([pa.array(deal), b.column(0).slice(lo, k), b.column(1).slice(lo, k), pa.array(s.n), pa.array(nodes.view(np.int64)), *[pa.nulls(k, pa.binary())] * 3], names=names)
                fresh, seen = _fresh(nodes, seen)
                lens = np.where(fresh, _sent(s.n, num, den), 0)
                at = ragged(s.starts[:-1], lens)  # tokens of a text are sorted by hash
                held.append((np.repeat(nodes, lens), s.hash[at]))
                size += len(at)
                if size > HOLD:
                    yield from flush(id_type)
                    held, size = [], 0
        if size:
            yield from flush(id_type)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ["doc_id", "mark", "n", "node", "credit"]
        id_type = None

        def credits(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            nodes, counts = [np.frombuffer(r[0], np.uint64) for r in rows if r[2] is None], [np.frombuffer(r[1], np.int32) for r in rows if r[2] is None]
            raw = [r for r in rows if r[2] is not None]
            if raw:
                token = np.concatenate([np.frombuffer(r[2], np.uint64) for r in raw])
                node = np.concatenate([np.repeat(np.frombuffer(r[0], np.uint64), np.frombuffer(r[1], np.int32)) for r in raw])
                order = np.argsort(token)
                t, v = token[order], node[order]
                twice = np.zeros(len(t), bool)
                twice[1:] = t[1:] == t[:-1]
                twice[:-1] |= twice[1:]
                t, v = t[twice], v[twice]
                by = np.lexsort((v, t))
                t, v = t[by], v[by]
                new = np.ones(len(t), bool)  # copies of a set in several tasks count once
                new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
                head = np.ones(len(t), bool)
                head[1:] = t[1:] != t[:-1]
                first = np.flatnonzero(head)
                # two sets, or one row for several
                several = (np.add.reduceat(new.astype(np.int64), first) > 1) | (v[first] == 0) if len(first) else np.zeros(0, bool)
                good = np.repeat(several, np.diff(np.append(first, len(t)))) & new & (v != 0)
                nodes.append(v[good])
                counts.append(np.ones(int(good.sum()), np.int32))
            own, back = np.unique(np.concatenate(nodes), return_inverse=True)
            if len(own):
                credit = np.bincount(back, np.concatenate(counts)).astype(np.int64)
                k = len(own)
                yield pa.record_batch([pa.nulls(k, id_type), *[pa.nulls(k, pa.int64())] * 2, pa.array(own.view(np.int64)), pa.array(credit)], names=out)

        bucket, held = None, []
        for b in batches:
            id_type = b.column(1).type
            plain = b.filter(b.column(5).is_null())
            if len(plain):
                yield pa.record_batch([*plain.columns[1:5], pa.nulls(len(plain), pa.int64())], names=out)
            packed = b.filter(b.column(5).is_valid())
            for at, *row in zip(*[packed.column(i).to_pylist() for i in (0, 5, 6, 7)], strict=True):
                if at != bucket and held:
                    yield from credits(held)
                    held = []
                bucket = at
                held.append(row)
        if held:
            yield from credits(held)

    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    sent = rows.mapInArrow(send, f"bucket int, doc_id {kind}, mark long, n long, node long, nodes binary, lens binary, tokens binary")
    sent = sent.repartition(width, "bucket").sortWithinPartitions("bucket")
    found = scratch.save(sent.mapInArrow(count, f"doc_id {kind}, mark long, n long, node long, credit long"), "members")
    members = found.where("credit is null").drop("credit")
    # enough shared tokens for the smallest set that a set can be linked to
    sets = members.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("mark").alias("mark"))
    credit = found.where("credit is not null").groupBy("node").agg(F.sum("credit").alias("credit"))
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * num / F.lit(den)) / SHARE))
    live = scratch.save(sets.join(credit, "node").where(F.col("credit") >= least).select("mark"), "live")
    live = F.broadcast(live) if live.count() <= BROADCAST_MARKS else live
    texts = docs.select(F.xxhash64("text").alias("mark"), "text").join(live, "mark", "left_semi").select("text")
    return members, scratch.save(texts, "possible")


# --- sets, and the counts of their tokens ----------------------------------------------------------


def _fresh(nodes: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which texts hold sets that this task has not sent, and the sets it has sent with them."""
    fresh = np.zeros(len(nodes), bool)
    fresh[np.unique(nodes, return_index=True)[1]] = True
    fresh &= (nodes != 0) & ~np.isin(nodes, seen)
    return fresh, np.concatenate([seen, nodes[fresh]])


def token_cells(texts: DataFrame, n: int) -> np.ndarray:
    """How many tokens fall into each cell of a table of fixed size."""

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for b in batches:
            for _, _, part in chunks(b):
                cells += np.bincount(_cell(Shingles(part, n).hash), minlength=CELLS).astype(np.uint32)
        slabs = [(i // SLAB, zlib.compress(cells[i : i + SLAB].tobytes(), 1)) for i in range(0, CELLS, SLAB) if cells[i : i + SLAB].any()]
        if slabs:
            yield pa.record_batch([pa.array([x[0] for x in slabs], pa.int32()), pa.array([x[1] for x in slabs], pa.binary())], names=["slab", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for slab, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = sums.setdefault(slab, np.zeros(SLAB, np.uint64))
                own += np.frombuffer(zlib.decompress(blob), np.uint32)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slab", "counts"])

    parts = texts.mapInArrow(cells_of, "slab int, counts binary").repartition(CELLS // SLAB, "slab").mapInArrow(add, "slab int, counts binary")
    cells = np.zeros(CELLS, np.uint64)
    for r in parts.toLocalIterator():
        cells[r["slab"] * SLAB : (r["slab"] + 1) * SLAB] = np.frombuffer(r["counts"], np.uint64)
    return cells


def frequent_cells(cells: np.ndarray) -> np.ndarray:
    """Counts of the cells that hold a frequent token, 0 for all others."""
    mean = float(cells.mean())
    return np.where(cells > mean + max(FREQUENT, 8 * mean**0.5), np.minimum(cells, 2**31 - 1), 0).astype(np.uint32)


_PACKED = "bucket int, counted boolean, nodes binary, sizes binary, lens binary, tokens binary, counts binary"
_NAMES = ["bucket", "counted", "nodes", "sizes", "lens", "tokens", "counts"]


def _pack(bucket: np.ndarray, node: np.ndarray, token: np.ndarray, count: np.ndarray | None) -> list[tuple]:
    """Per bucket: its sets, how many tokens each has there, the tokens and their counts."""
    order = np.lexsort((node, bucket))
    bucket, node, token = bucket[order], node[order], token[order]
    count = None if count is None else count[order].astype(np.int32)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    rows = []
    for s, e in zip(cut, np.append(cut[1:], len(bucket)), strict=True):
        nodes, lens = np.unique(node[s:e], return_counts=True)
        rows.append((int(bucket[s]), nodes.tobytes(), lens.astype(np.int32).tobytes(), token[s:e].tobytes(), None if count is None else count[s:e].tobytes()))
    return rows


def _packed(rows: list[tuple], counted: bool) -> Iterator[pa.RecordBatch]:
    """Rows of _pack() as a batch; sizes may come as a sixth place."""
    if rows:
        k, cols = len(rows), list(zip(*rows, strict=True))
        sizes = pa.array(cols[5], pa.binary()) if len(cols) > 5 else pa.nulls(k, pa.binary())
        yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array([counted] * k), pa.array(cols[1], pa.binary()), sizes, *[pa.array(c, pa.binary()) for c in cols[2:5]]], names=_NAMES)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows sorted by bucket, bucket by bucket, with their arrays."""
    kinds = {"nodes": np.uint64, "sizes": np.int64, "lens": np.int32, "tokens": np.uint64, "counts": np.int32}
    bucket, held = None, []
    for b in batches:
        for row in b.to_pylist():
            if row["bucket"] != bucket and held:
                yield bucket, held
                held = []
            bucket = row["bucket"]
            held.append({"counted": row["counted"], **{k: None if row[k] is None else np.frombuffer(row[k], t) for k, t in kinds.items()}})
    if held:
        yield bucket, held


def shared_tokens(texts: DataFrame, n: int, cells: np.ndarray) -> DataFrame:
    """Packed rows by bucket of the set: its size and frequent tokens, and the other tokens it shares, with counts."""
    spark = texts.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(width, int(cells.sum()) // BUCKET + 1)
    shared = spark.sparkContext.broadcast(frequent_cells(cells))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen, held, size = shared.value, np.zeros(0, np.uint64), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            node, token = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from _packed(_pack((token >> _U(40)).astype(np.int64) % buckets, node, token, None), False)

        for b in batches:
            for _, _, part in chunks(b):
                s = Shingles(part, n)
                nodes = s.nodes()
                fresh, seen = _fresh(nodes, seen)  # a task sends a set once
                of, often = nodes[s.doc], frequent[_cell(s.hash)]
                use = fresh[s.doc]
                hot = use & (often > 0)
                # sizes and frequent tokens by bucket of the set
                own, sizes = nodes[fresh], s.n[fresh]
                place = own % _U(buckets)
                lens = np.bincount(s.doc[hot], minlength=len(nodes))[fresh]
                starts = s.starts[:-1][fresh]
                rows = []
                for k in np.unique(place):
                    at = np.flatnonzero(place == k)
                    every = ragged(starts[at], sizes[at])
                    every = every[hot[every]]
                    rows.append((int(k), own[at].tobytes(), lens[at].astype(np.int32).tobytes(), s.hash[every].tobytes(), often[every].astype(np.int32).tobytes(), sizes[at].astype(np.int64).tobytes()))
                yield from _packed(rows, True)
                light = use & (often == 0)
                held.append((of[light], s.hash[light]))
                size += int(light.sum())
                if size > HOLD:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in _by_bucket(batches):
            raw = [r for r in rows if not r["counted"]]
            # on their way to the bucket of their sets
            yield from _packed([(at, *[r[k].tobytes() for k in ("nodes", "lens", "tokens", "counts", "sizes")]) for r in rows if r["counted"]], True)
            if not raw:
                continue
            token = np.concatenate([r["tokens"] for r in raw])
            node = np.concatenate([np.repeat(r["nodes"], r["lens"]) for r in raw])
            order = np.argsort(token)
            t = token[order]
            twice = np.zeros(len(t), bool)
            twice[1:] = t[1:] == t[:-1]
            twice[:-1] |= twice[1:]
            order = order[twice]
            t, v = token[order], node[order]
            by = np.lexsort((v, t))
            t, v = t[by], v[by]
            new = np.ones(len(t), bool)  # copies of a set in several tasks count once
            new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
            t, v = t[new], v[new]
            head = np.ones(len(t), bool)
            head[1:] = t[1:] != t[:-1]
            df = np.diff(np.append(np.flatnonzero(head), len(t)))
            df = np.repeat(df, df)
            keep = df > 1
            yield from _packed(_pack((v[keep] % _U(buckets)).astype(np.int64), v[keep], t[keep], df[keep]), True)

    sent = texts.mapInArrow(send, _PACKED).repartition(width, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(count, _PACKED)


_RECORD = "kind tinyint, node long, other long, token long, n long, tokens array<long>, first array<long>, second array<long>, third array<long>"


def _lists(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(values[ragged(starts, lens)].view(np.int64)))


def records(packed: DataFrame, num: int, den: int) -> DataFrame:
    """Sets that can have links, as rows of several kinds.

    0: set, size, its shared tokens and the first of them under each order; 1 and 3: one of its first tokens
    under the first order (3: it is frequent here and the set stands for others); 2: a set and the one it is linked to.
    """
    names = [x.split()[0] for x in _RECORD.split(", ")]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for _, rows in _by_bucket(batches):
            own = [r for r in rows if r["sizes"] is not None]
            nodes, at = np.unique(np.concatenate([r["nodes"] for r in own]), return_index=True)
            n = np.concatenate([r["sizes"] for r in own])[at]
            token = np.concatenate([r["tokens"] for r in rows])
            df = np.concatenate([r["counts"] for r in rows])
            of = np.searchsorted(nodes, np.concatenate([np.repeat(r["nodes"], r["lens"]) for r in rows]))
            order = np.lexsort((token, of))
            new = np.ones(len(order), bool)
            new[1:] = (token[order[1:]] != token[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
            order = order[new]
            token, df, of = token[order], df[order], of[order]
            shared = np.bincount(of, minlength=len(nodes))
            need = prefix_length(n, num, den) - (n - shared)
            live = np.flatnonzero((need > 0) & (shared > 0))
            if not len(live):
                continue
            use = need[of] > 0
            token, df, of = token[use], df[use], np.searchsorted(live, of[use])
            need, n, nodes = np.minimum(need[live], shared[live]), n[live], nodes[live]
            starts = np.searchsorted(of, np.arange(len(live)))
            many = np.diff(np.append(starts, len(of)))
            firsts = []
            for k, o in enumerate(ORDERS):
                h = mix64(token ^ _U(o))
                # by count, by its power of two, by the hash alone
                rank = (h, df) if k == 0 else (h, np.log2(df).astype(np.int64)) if k == 1 else (h,)
                firsts.append(token[np.lexsort((*rank, of))])
            held.append((firsts[0][ragged(starts, need)], np.repeat(nodes, need)))
            k = len(live)
            yield pa.record_batch(
                [pa.array(np.zeros(k, np.int8)), pa.array(nodes.view(np.int64)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(n), _lists(token, starts, many), *[_lists(f, starts, need) for f in firsts]], names=names
            )
            if sum(len(t) for t, _ in held) > HOLD:
                yield from _token_rows(held, names)
                held = []
        if held:
            yield from _token_rows(held, names)

    width = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(solve, _RECORD)


# --- candidates ---------------------------------------------------------------------------------------


def _token_rows(held: list[tuple[np.ndarray, np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 1, 2 and 3 from first tokens and their sets: a token of many sets here is sent for one of them only."""
    t, v = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((v, t))
    t, v = t[order], v[order]
    head = np.ones(len(t), bool)
    head[1:] = t[1:] != t[:-1]
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(t)))
    hot, centre = np.repeat(size > GROUP, size), np.repeat(v[at], size)
    kind = np.where(hot, np.where(v == centre, 3, 2), 1).astype(np.int8)
    m, null = len(t), lambda k: [pa.nulls(k, pa.int64()), *[pa.nulls(k, pa.list_(pa.int64()))] * 4]
    whole = kind != 2
    k = int(whole.sum())
    yield pa.record_batch([pa.array(kind[whole]), pa.array(v[whole].view(np.int64)), pa.nulls(k, pa.int64()), pa.array(t[whole].view(np.int64)), *null(k)], names=names)
    if k < m:
        links = np.unique(np.stack([v[~whole], centre[~whole]], 1), axis=0)
        k = len(links)
        yield pa.record_batch([pa.array(np.full(k, 2, np.int8)), pa.array(links[:, 0].copy().view(np.int64)), pa.array(links[:, 1].copy().view(np.int64)), pa.nulls(k, pa.int64()), *null(k)], names=names)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token and set: all pairs of the sets of a token if they are few, else links to the first."""

    def out(u: np.ndarray, v: np.ndarray, star: bool) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v)), pa.array(np.full(len(u), star))], names=["u", "v", "star"])

    def solve(t: np.ndarray, v: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(t):
            return
        new = np.ones(len(t), bool)
        new[1:] = t[1:] != t[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(t)))
        frequent = (size > GROUP) | (np.add.reduceat(hot.astype(np.int64), at) > 0)
        for k in np.unique(size[~frequent]):
            if k < 2:
                continue
            rows = v[at[~frequent & (size == k)][:, None] + np.arange(k)]
            i, j = np.triu_indices(k, 1)
            for part in np.array_split(rows, max(1, len(rows) * len(i) // 500_000)):
                yield out(part[:, i].ravel(), part[:, j].ravel(), False)
        long = np.flatnonzero(frequent & (size > 1))
        if len(long):
            u = ragged(at[long] + 1, size[long] - 1)
            yield out(v[u], np.repeat(v[at[long]], size[long] - 1), True)

    t, v, hot = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    for b in batches:
        t = np.concatenate([t, b.column(0).to_numpy()])
        v = np.concatenate([v, b.column(1).to_numpy()])
        hot = np.concatenate([hot, b.column(2).to_numpy() == 3])
        same = np.zeros(len(t), bool)
        same[1:] = (t[1:] == t[:-1]) & (v[1:] == v[:-1])
        if same.any():  # one row per token and set, frequent if any of them is
            first = np.flatnonzero(~same)
            hot = np.add.reduceat(hot.astype(np.int64), first) > 0
            t, v = t[first], v[first]
        cut = int(np.searchsorted(t, t[-1])) if len(t) and (t[:-1] <= t[1:]).all() else len(t)
        yield from solve(t[:cut], v[:cut], hot[:cut])
        t, v, hot = t[cut:], v[cut:], hot[cut:]
        if len(t) > 4 * GROUP:  # a frequent token so far: its sets are linked, one stands for them
            yield out(v[1:], np.repeat(v[0], len(v) - 1), True)
            t, v, hot = t[:1], v[:1], np.ones(1, bool)
    yield from solve(t, v, hot)


def _overlaps(doc: np.ndarray, token: np.ndarray, count: int, row_at: np.ndarray, col_at: np.ndarray) -> np.ndarray:
    """How many tokens each row set and each column set have in common, from (set, token) rows without repeats."""
    vocabulary, token = np.unique(token, return_inverse=True)
    df = np.bincount(token, minlength=len(vocabulary))
    rows, cols = np.flatnonzero(row_at >= 0), np.flatnonzero(col_at >= 0)
    common = np.zeros((len(rows), len(cols)), np.float32)
    # frequent tokens by matrix products, in steps; rare ones pair by pair
    limit = max(8, count // 64)
    frequent = np.flatnonzero(df > limit)
    step = max(1, (4 << 20) // max(1, count))
    column = np.full(len(vocabulary), -1)
    for i in range(0, len(frequent), step):
        column[:] = -1
        column[frequent[i : i + step]] = np.arange(len(frequent[i : i + step]))
        ok = column[token] >= 0
        m = np.zeros((count, min(step, len(frequent) - i)), np.float32)
        m[doc[ok], column[token[ok]]] = 1
        common += m[rows] @ m[cols].T
    ok = np.flatnonzero(((df > 1) & (df <= limit))[token])
    ok = ok[np.argsort(token[ok], kind="stable")]
    lens = df[np.unique(token[ok])]
    starts = np.cumsum(lens) - lens
    flat = common.ravel()
    for d in range(1, int(lens.max()) if len(lens) else 0):  # members of a token at distance d
        some = lens > d
        at = ragged(starts[some], lens[some] - d)
        x, y = doc[ok[at]], doc[ok[at + d]]
        for a, b in ((x, y), (y, x)):
            both = (row_at[a] >= 0) & (col_at[b] >= 0)
            flat += np.bincount(row_at[a[both]] * len(cols) + col_at[b[both]], minlength=len(flat)).astype(np.float32)
    return common


def compare(nodes: np.ndarray, n: np.ndarray, orders: list[list[np.ndarray]], tokens: list[np.ndarray], num: int, den: int, rows: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets at rows (all, if none is given) and all sets.

    Pairs must share a first token under every order; sets with such pairs are then compared whole.
    """
    count = len(nodes)
    row = np.ones(count, bool) if rows is None else rows

    def table_of(lists: list[np.ndarray], use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        row_at, col_at = np.full(count, -1), np.full(count, -1)
        col_at[use], row_at[use & row] = np.arange(use.sum()), np.arange((use & row).sum())
        lens = np.fromiter((len(x) if u else 0 for x, u in zip(lists, use, strict=True)), np.int64, count)
        flat = np.concatenate([x for x, u in zip(lists, use, strict=True) if u] or [np.zeros(0, np.int64)])
        return _overlaps(np.repeat(np.arange(count), lens), flat, count, row_at, col_at), np.flatnonzero(use & row), np.flatnonzero(use), use

    use = np.ones(count, bool)
    may = None
    for lists in orders:
        own, at, to, _ = table_of(lists, use)
        own = own > 0
        own &= at[:, None] != to[None, :]
        own &= den * np.minimum(n[at][:, None], n[to][None, :]) >= num * np.maximum(n[at][:, None], n[to][None, :])
        may = own if may is None else own & may
        # sets without a pair left go
        left = np.zeros(count, bool)
        left[at[may.any(1)]] = True
        left[to[may.any(0)]] = True
        may = may[np.ix_(left[at], left[to])]
        use = left
        if not use.any():
            return []
    both, at, to, _ = table_of(tokens, use)
    both = both.astype(np.int64)
    link = may & (den * both >= num * (n[at][:, None] + n[to][None, :] - both))
    label, forest = np.arange(count), []
    for i, r in enumerate(at):
        for c in to[np.flatnonzero(link[i])]:
            if label[r] != label[c]:
                label[label == label[c]] = label[r]
                forest.append((int(nodes[r]), int(nodes[c])))
    return forest


# --- components -----------------------------------------------------------------------------------------


def jaccard_components(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id) for docs with doc_id and text; similarity num/den or more links.

    mark is a hash of the text, which tells rows of one doc_id apart.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    docs = docs.select("doc_id", "text")
    members, texts = possible(docs, n, num, den, scratch)
    scratch.release()
    found = scratch.save(records(shared_tokens(texts, n, token_cells(texts, n)), num, den), "records")
    scratch.release()
    sets = found.where("kind = 0")

    shared = found.where("kind in (1, 3)").select("token", "node", "kind").repartition("token").sortWithinPartitions("token", "node")
    stars = found.where("kind = 2").select(F.col("node").alias("u"), F.col("other").alias("v"), F.lit(True).alias("star"))
    met = scratch.save(shared.mapInArrow(_meet, "u long, v long, star boolean").unionByName(stars).distinct(), "met")
    # pairs: sizes and the other orders
    side = lambda k: sets.select(F.col("node").alias(k), F.col("n").alias(f"{k}n"), F.col("second").alias(f"{k}2"), F.col("third").alias(f"{k}3"))
    pairs = met.where("not star").select("u", "v").join(side("u"), "u").join(side("v"), "v").where(den * F.least("un", "vn") >= num * F.greatest("un", "vn"))
    pairs = pairs.where(F.arrays_overlap("u2", "v2") & F.arrays_overlap("u3", "v3")).select("u", "v")
    clusters = scratch.save(connected_components(pairs.unionByName(met.where("star").select("u", "v")), scratch), "clusters")
    links = _links(sets, clusters, num, den, scratch)
    linked = connected_components(links, scratch)

    # equal sets, and linked ones: the smallest document; one set may stand for very many rows, so rows meet sets salted
    least = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    least = least.join(linked, "node", "left").where("rows > 1 or component is not null")
    named = least.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("least").alias("component_id"))
    named = least.select("node", F.coalesce("component", "node").alias("component")).join(named, "component").select("node", "component_id")
    named = scratch.save(named, "components").withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
    out = members.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(SALT)).cast("int")).join(named, ["node", "salt"], "left")
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _links(sets: DataFrame, clusters: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(u, v): edges that connect what is linked within each cluster."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        arrays = lambda c: [np.asarray(x, np.int64) for x in pdf[c]]
        rows = pdf["asks"].to_numpy(bool)
        edges = compare(pdf["node"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), [arrays(c) for c in ("first", "second", "third")], arrays("tokens"), num, den, rows)
        return pd.DataFrame(edges, columns=["u", "v"], dtype=np.int64)

    body = ["node", "n", "tokens", "first", "second", "third"]
    columns = ["component", "i", "j", "asks", *body]
    size = clusters.groupBy("component").agg(F.count("*").alias("size"))
    placed = clusters.join(size, "component").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    placed = scratch.save(placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("size"), "placed")
    large = placed.where("blocks > 1")
    low = large.groupBy("component", "blocks", "block").agg(F.min("node").alias("node"))  # one set per block stands for it, PIVOTS at most
    pivots = low.where(F.col("block") < PIVOTS).select("component", "node", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "block").where("i <> block")
    every = placed.select("component", "node", F.col("block").alias("i")).unionByName(pivots.select("component", "node", "i"))
    rows = sets.select(*body).join(every, "node").withColumns({"j": F.lit(0), "asks": F.lit(True)}).select(columns)
    links = scratch.save(rows.groupBy("component", "i", "j").applyInPandas(work, "u long, v long"), "links")
    if large.isEmpty():
        return links
    # large clusters: sets outside the largest component so far meet all blocks
    parts = connected_components(links, scratch).select("node", F.col("component").alias("part"))
    now = large.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    top = now.groupBy("component", "part").agg(F.count("*").alias("size")).groupBy("component").agg(F.max(F.struct("size", "part")).alias("top"))
    now = scratch.save(now.join(top, "component").withColumn("outside", F.col("part") != F.col("top.part")).drop("top"), "outside")
    asks = now.where("outside").groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("groups"))
    now = now.join(asks, "component")
    group = F.pmod(F.xxhash64("node", F.lit(1)), F.col("groups")).cast("int")
    to = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")
    ask = now.where("outside").select("component", "node", group.alias("i"), to).withColumn("asks", F.lit(True))
    answer = now.select("component", "node", F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("i")).withColumn("asks", F.lit(False))
    both = ask.unionByName(answer.select("component", "node", "i", "j", "asks")).groupBy("component", "node", "i", "j").agg(F.max("asks").alias("asks"))
    rows = sets.select(*body).join(both, "node").select(columns)
    more = scratch.save(rows.groupBy("component", "i", "j").applyInPandas(work, "u long, v long"), "links")
    return links.unionByName(more)


def keep_one(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id. Rows without doc_id stay."""
    found = jaccard_components(docs, n=n, num=num, den=den)
    gone = found.where("doc_id <> component_id").select("doc_id", "mark").distinct()
    gone = Scratch(docs.sparkSession, "jaccard").save(gone, "gone")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_MARKS else gone  # else whole texts travel
    a, b = docs.alias("a"), few.alias("b")
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.xxhash64("a.text") == F.col("b.mark")), "left_anti")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100).drop("mark")


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
SQL: dict[str, str] = {}  # whole tables are too slow in SQL; tested against brute force
