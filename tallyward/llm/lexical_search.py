"""Ranked lexical search over a tiered index.

Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lowered. One pass over the texts
counts each document's terms and keeps the postings of terms that some item asks for. Postings carry
their impact, (10^9 tf) div (1000 tf + 8 m); a document's score sums weight * impact over the item's terms.

The tiers of a term hold its postings by falling impact: tier 1 about TIERS[0] of them, tier 2 about
TIERS[1], the last all. Boundaries come from a histogram of impacts, and the greatest impact left below a
boundary is the term's residual bound. An item sees tier 1 first. A document's score then lies between what
was seen and that plus weight * residual for every term not seen for it. The item is proven if no document
outside those seen, and none whose upper bound is below the kth lower bound, can reach the first k;
exact scores of the few others come from the documents themselves. Items without proof fall through to the next tier,
and at last to all postings, document by document, where each task keeps k a item.

Items are taken in blocks, by a hash, of about BLOCK_TERMS terms, so that the terms each task holds have a
bounded size whatever the number of items. Terms are known by a 64-bit hash.

Every row of documents is a document and every row of items an item; equal rows rank each. A null or empty
text has no term: such a document is never found, such an item finds nothing. Equal scores go by ascending
doc_id, null last, repeated ids in any order. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyward.llm.common import Runs, Scratch, chunks, ragged, table

#: Postings of a term in the upper tiers, about; bins of impacts a term's boundaries are chosen from.
TIERS, BINS = (512, 8192), 256
#: Terms and items of one block, about; scores of documents by items that a task holds at once.
BLOCK_TERMS, BLOCK_ITEMS, GRID = 500_000, 2_000, 4_000_000
#: No impact reaches this.
SCALE = 1_000_000
FOUND = 10
LAST = 2**63 - 1

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_rng = np.random.default_rng(977)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE[65:91] = _CODE[97:123]


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, one text after the other, and where each text's begin."""
    found = Runs(texts, _TERM, _CODE)
    return found.hash.view(np.int64), found.bounds


def items_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, terms): a number for each row and its distinct term hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in chunks(b):
                h, at = term_hashes(texts)
                lists = [np.unique(h[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(lists, pa.list_(pa.int64()))], names=["item", "item_id", "terms"])

    kind = items.select(F.col(f"`{item_col}`")).schema[0].dataType.simpleString()
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(work, f"item long, item_id {kind}, terms array<long>").where(F.size("terms") > 0)


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row: n counts all its terms, terms are places in the sorted vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for lo, hi, texts in chunks(b):
                h, at = term_hashes(texts)
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[place] == h)
                doc = np.repeat(np.arange(len(texts)), np.diff(at))[hit]
                key, tf = np.unique(doc * np.int64(len(known)) + place[hit], return_counts=True)
                cut = np.searchsorted(key, np.arange(len(texts) + 1) * np.int64(len(known))).astype(np.int32)
                terms = pa.ListArray.from_arrays(pa.array(cut), pa.array((key % len(known)).astype(np.int32)))
                tfs = pa.ListArray.from_arrays(pa.array(cut), pa.array(tf.astype(np.int64)))
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(np.diff(at).astype(np.int64)), terms, tfs], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(work, "doc_id long, n long, terms array<int>, tfs array<long>")


class Index:
    """Impacts of one block's terms by document and in tiers; weights and residual bounds by term."""

    def __init__(self, docs: DataFrame, vocabulary: np.ndarray, scratch: Scratch):
        """docs: doc_id (long), text."""
        self.scratch, self.vocabulary = scratch, vocabulary
        counted = scratch.save(postings(docs, vocabulary).where("n > 0").withColumn("row", F.monotonically_increasing_id()), "postings")
        facts = counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        self.docs, total = facts["docs"], max(1, facts["terms"])
        m = f"(10 + (90 * n * {self.docs}L) div {total}L)"
        impact = F.expr(f"transform(tfs, tf -> (1000000000L * tf) div (1000L * tf + 8L * {m}))")
        self.by_doc = counted.where(F.size("terms") > 0).select("row", "doc_id", "terms", impact.alias("impacts"))
        self.single = self.by_doc.select("row", "doc_id", F.explode(F.arrays_zip("terms", "impacts")).alias("x")).select("row", "doc_id", F.col("x.terms").alias("term"), F.col("x.impacts").alias("impact"))
        # a row for each term and bin at most: the block's terms are bounded, and so is this
        hist = self._histogram()
        self.df = hist.sum(1)
        self.weight = np.floor(1000 * np.log((2.0 * self.docs + 2) / (2.0 * self.df + 1))).astype(np.int64)
        # greatest bin boundary with at most so many postings at or above it; 0 where all fit
        above = np.cumsum(hist[:, ::-1], 1)[:, ::-1]
        self.floors = [np.where(self.df <= t, 0, np.where(above <= t, np.arange(BINS)[None, :], BINS).min(1) * (SCALE // BINS + 1)) for t in TIERS]

    def _histogram(self) -> np.ndarray:
        """Postings by term and bin of impact. Tasks send a row per term and bin they hold."""
        bins = SCALE // BINS + 1

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for b in batches:
                key = b.column(0).flatten().to_numpy().astype(np.int64) * BINS + b.column(1).flatten().to_numpy() // bins
                key, n = np.unique(key, return_counts=True)
                keys, at = np.unique(np.concatenate([keys, key]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            yield pa.record_batch([pa.array(keys), pa.array(counts)], names=["key", "n"])

        found = self.by_doc.select("terms", "impacts").mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
        out = np.zeros((len(self.vocabulary), BINS), np.int64)
        out.reshape(-1)[found["key"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
        return out

    def residuals(self, tier: int) -> np.ndarray:
        """Greatest impact a posting below a tier's floor can have; 0 where none is left."""
        return np.maximum(self.floors[tier] - 1, 0)


def _seen(index: Index, asked: DataFrame, tier: int, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Proven results (item, row, doc_id, score) of items asked, and the items that fall through. asked: item, term, w."""
    spark = asked.sparkSession
    floors, rest = index.floors[tier], index.residuals(tier)
    facts = spark.createDataFrame(pa.table({"term": pa.array(np.arange(len(rest)), pa.int32()), "floor": pa.array(floors), "rest": pa.array(rest)}))
    facts = F.broadcast(facts)  # a row per term of the block
    mine = scratch.save(asked.join(facts, "term").withColumn("open", F.col("w") * F.col("rest")), f"asked{tier}")
    upper = index.single.join(F.broadcast(facts.join(mine.select("term").distinct(), "term", "left_semi").select("term", "floor")), "term").where(F.col("impact") >= F.col("floor")).select("term", "row", "doc_id", "impact")
    upper = scratch.save(upper, f"tier{tier}")
    whole = mine.groupBy("item").agg(F.sum("open").alias("all_open"))
    score = F.sum(F.col("w") * F.col("impact")).alias("low")
    held = upper.join(mine, "term").groupBy("item", "row", "doc_id").agg(score, F.sum("open").alias("closed"))
    held = held.join(F.broadcast(whole), "item").withColumn("high", F.col("low") + F.col("all_open") - F.col("closed")).drop("closed")
    held = scratch.save(held, f"held{tier}")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("low"), "row"))
    kth = held.where("low > 0").withColumn("rank", rank).where(F.col("rank") == k).select("item", F.col("low").alias("kth"))
    kth = scratch.save(whole.join(kth, "item", "left"), f"kth{tier}")
    # no unseen document reaches the kth score, or nothing is left below the tier
    proven = kth.where("all_open < kth or all_open = 0").select("item", F.coalesce("kth", F.lit(1)).alias("kth"))
    near = scratch.save(held.join(F.broadcast(proven), "item").where("high >= kth").select("item", "row"), f"near{tier}")
    # whole scores of the documents still in question, from their own postings
    exact = index.single.join(near, "row").join(mine.select("item", "term", "w"), ["item", "term"]).groupBy("item", "row", "doc_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))
    return scratch.save(exact, f"exact{tier}"), kth.join(proven, "item", "left_anti").select("item")


def _every(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score): all postings, document by document; a task keeps the best k of each item (few more in ties)."""
    rows = asked.toPandas()  # one block's items and terms: a bounded number
    names, item = np.unique(rows["item"].to_numpy(np.int64), return_inverse=True)
    order = np.argsort(rows["term"].to_numpy(), kind="stable")
    term = rows["term"].to_numpy(np.int64)[order]
    cut = np.searchsorted(term, np.arange(len(index.vocabulary) + 1))
    shared = asked.sparkSession.sparkContext.broadcast((names, cut, item[order].astype(np.int64), rows["w"].to_numpy(np.float64)[order]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, cut, item, weight = shared.value
        n = len(names)
        step = max(1, GRID // max(1, n))
        best = np.zeros((3, 0), np.int64)  # item, doc_id, score
        floor = np.ones(n, np.int64)
        for b in batches:
            ids = np.array([LAST if x is None else x for x in b.column(0).to_pylist()], np.int64)
            lists, impacts = b.column(1), b.column(2).flatten().to_numpy().astype(np.float64)
            terms, bounds = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            for at in range(0, len(ids), step):
                end = min(at + step, len(ids))
                own = slice(bounds[at], bounds[end])
                t, doc = terms[own], np.repeat(np.arange(end - at), np.diff(bounds[at : end + 1]))
                # sums stay whole numbers below 2**53, so doubles hold them exactly
                spread = cut[t + 1] - cut[t]
                pick = ragged(cut[t], spread)
                grid = np.bincount(np.repeat(doc, spread) * n + item[pick], np.repeat(impacts[own], spread) * weight[pick], (end - at) * n).reshape(-1, n)
                d, i = np.nonzero(grid >= floor)
                if not len(d):
                    continue
                best = np.concatenate([best, np.stack([i, ids[at + d], grid[d, i].astype(np.int64)])], 1)
                best = best[:, np.lexsort((best[1], -best[2], best[0]))]
                first = np.searchsorted(best[0], np.arange(n))
                rank = np.arange(best.shape[1]) - first[best[0]]
                best = best[:, rank < k]
                full = best[:, rank[rank < k] == k - 1]
                floor[full[0]] = full[2]
        yield pa.record_batch([pa.array(names[best[0]]), pa.array(best[1], mask=best[1] == LAST), pa.array(best[2])], names=["item", "doc_id", "score"])

    return index.by_doc.select("doc_id", "terms", "impacts").mapInArrow(work, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = FOUND, *, item_col: str = "item_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score, tier): the k best documents with score above 0 of each item and the tier that proved them (0: all postings)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "search")
    asked = scratch.save(items_terms(items, item_col, text_col), "items")
    facts = asked.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    blocks = max(1, -(-facts["terms"] // BLOCK_TERMS), -(-facts["items"] // BLOCK_ITEMS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    found = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", F.explode("terms").alias("hash"))
        vocabulary = own.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64)  # about BLOCK_TERMS at most
        if not len(vocabulary):
            continue
        out = _block(Index(texts, np.sort(vocabulary), scratch), own, k, scratch)
        found = out if found is None else found.unionByName(out)
    if found is None:
        kind = dict(asked.dtypes)["item_id"]
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long, tier int")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = found.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score", "tier")


def _block(index: Index, own: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    spark = own.sparkSession
    words = pa.table({"hash": pa.array(index.vocabulary), "term": pa.array(np.arange(len(index.vocabulary)), pa.int32()), "w": pa.array(index.weight)})
    asked = scratch.save(own.join(F.broadcast(spark.createDataFrame(words)), "hash").select("item", "term", "w"), "terms")
    found, left = None, asked
    for tier in range(len(TIERS)):
        exact, fallen = _seen(index, left, tier, k, scratch)
        out = exact.select("item", "doc_id", "score", F.lit(tier + 1).alias("tier"))
        found = out if found is None else found.unionByName(out)
        left = scratch.save(left.join(fallen, "item", "left_semi"), "left")
        if left.isEmpty():
            return found
    return found.unionByName(_every(index, left, k).withColumn("tier", F.lit(0)))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


QUERIES = {"op13_lexical_search": op13_lexical_search}
_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = {
    "op13_lexical_search": f"""
    WITH terms AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
    lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
    facts AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
    asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, facts GROUP BY term, docs),
    scored AS (
      SELECT a.item_id, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
      FROM asked a JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), facts GROUP BY ALL
    ), ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT * FROM ranked WHERE rank <= 10
    """
}
