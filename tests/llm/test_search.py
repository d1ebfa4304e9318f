"""Hard negatives, lexical search and language ID against brute force and held-out accuracy, and their edge cases."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyward.llm import common, hard_negatives, language_id, lexical_search

# --- hard negatives ------------------------------------------------------------------------------------


def mined(rows, anchor, positives=5, negatives=10):
    """The plain loop over all pairs."""
    sound = [(i, c, tuple(math.floor(256 * x) for x in v)) for i, v, c in rows if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sound = list(dict.fromkeys(sound))
    key = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = []
    for a in sound:
        if a[0] is None or not anchor(a[0]):
            continue
        near = [(b[0], sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[1] == a[1]) for b in sound if b is not a and len(b[2]) == len(a[2])]
        for p in sorted((x for x in near if x[2]), key=key)[:positives]:
            held = sorted((x for x in near if not x[2] and 30 * p[1] <= 100 * x[1] <= 90 * p[1]), key=key)[:negatives]
            out += [(a[0], p[0], r + 1, n[0], p[1], n[1]) for r, n in enumerate(held)]
    return collections.Counter(out)


def got(df):
    return collections.Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


VECTORS = "vec_id long, embedding array<double>, label int"


def clustered(n, dim=8, centers=12, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centers, dim)) * 3
    return [(i, [float(x) for x in c[rng.integers(centers)] + rng.normal(size=dim) * 0.2], int(rng.integers(4))) for i in range(n)]


@pytest.mark.parametrize("sizes", [(512, 256, 4), (7, 3, 1)])
def test_hard_negatives_match_brute_force(spark, sizes, monkeypatch):
    for name, x in zip(("PACK", "ANCHORS", "FIRST"), sizes, strict=True):
        monkeypatch.setattr(hard_negatives, name, x)
    rows = clustered(400)
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(150)]  # one very common vector
    rows += [(2000, None, 1), (2010, [1.0] * 8, None), (2020, [1.0, None] * 4, 1), (2030, [float("nan")] * 8, 1), (2040, [float("inf")] * 8, 1)]
    rows += [(3000, [0.5, 2.0], 1), (3001, [0.5, 2.5], 1), (3002, [0.25, 1.0], 2), (3010, [], 1), (3011, [], 1), (3012, [], 2)]
    rows += [rows[10], rows[10], (20, rows[30][1], 3), (None, rows[40][1], 1), (None, rows[41][1], 2)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5).withColumns({"pack": F.lit("x"), "n": F.lit(None)})
    assert got(hard_negatives.mine(df, F.col("vec_id") % 10 == 0)) == mined(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_large_components(spark):
    rows = [(i, [x * 2.0**19 for x in v], c) for i, v, c in clustered(60)] + [(100 + i, [2.0**23 + i, -(2.0**22)], i % 3) for i in range(9)]
    df = spark.createDataFrame(rows, VECTORS)
    assert got(hard_negatives.mine(df, F.col("vec_id") % 7 == 0)) == mined(rows, lambda i: i % 7 == 0)


def test_hard_negatives_empty(spark):
    df = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(df, F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2), (2, None, 1)], VECTORS)
    assert hard_negatives.mine(alone, F.col("vec_id") % 10 == 0).count() == 0


def test_lists_are_skipped_by_bounds(spark, monkeypatch):
    """On clustered vectors the two waves of the positive search leave most lists unvisited."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "FIRST", 1)
    rows = clustered(6000, dim=16, centers=30, seed=9)
    scratch = common.Scratch(spark, "t")
    df = spark.createDataFrame(rows, VECTORS).select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x * 256).cast("double")).alias("v"), (F.col("vec_id") % 100 == 0).alias("anchor"))
    lists = hard_negatives.Lists(df, scratch)
    anchors = hard_negatives.pack_anchors(lists.anchors, scratch)
    visited = []
    old = hard_negatives.visits

    def counted(a, x, wave):
        out = scratch.save(old(a, x, wave), "visits")
        visited.append(out.select("apack", "cluster").distinct().count())
        return out

    monkeypatch.setattr(hard_negatives, "visits", counted)
    hard_negatives.search(anchors, lists, 5, True, scratch).count()
    assert sum(visited) < 0.35 * anchors.count() * (lists.radii >= 0).sum()


# --- lexical search ----------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def ranked(docs, items, k=10):
    tf = [collections.Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    total, count = sum(n), sum(x > 0 for x in n)
    df = collections.Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, _), c, size in zip(docs, tf, n, strict=True):
            m = 10 + (90 * size * count) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return collections.Counter(out)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(5)
    vocabulary = [f"{rng.choice('abcdé')}{i}" for i in range(300)]
    common_words = ["The", "of", "AND", "Über"]
    text = lambda n: " ".join(rng.choice(common_words) if rng.random() < 0.5 else vocabulary[min(299, int(rng.expovariate(0.02)))] for _ in range(n))
    docs = [(i, text(rng.randint(1, 80))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(120)] + [(2000, None), (2001, ""), (2002, " .,;\x00"), (2003, text(9000)), (None, docs[3][1]), (5, "the a1_a2;b3"), (5, docs[3][1])]
    items = [(i, text(12)) for i in range(15)] + [(50, docs[3][1]), (51, None), (52, "?!"), (53, "nowhere found"), (54, "the of and"), (54, "the of and"), (None, vocabulary[4])]
    return docs, items


@pytest.mark.parametrize("tiers", [(512, 8192), (2, 6), (20, 90)])
@pytest.mark.parametrize("blocks", [1, 4])
def test_search_matches_brute_force(spark, library, tiers, blocks, monkeypatch):
    docs, items = library
    monkeypatch.setattr(lexical_search, "TIERS", tiers)
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", -(-len(items) // blocks))
    monkeypatch.setattr(lexical_search, "GRID", 200)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(6).withColumns({"terms": F.lit(1), "row": F.lit(2)})
    i = spark.createDataFrame(items, "item_id long, text string").repartition(2).withColumn("item", F.lit("x"))
    out = lexical_search.search(d, i).collect()
    assert collections.Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in out) == ranked(docs, items)
    assert ({r["tier"] for r in out} == {0}) == (tiers == (2, 6))
    assert tiers[0] < 512 or {r["tier"] for r in out} == {1}


def test_search_empty(spark):
    d, i = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical_search.search(d, i).count() == lexical_search.search(one, i).count() == 0
    assert lexical_search.search(d, one.withColumnRenamed("doc_id", "item_id")).count() == 0
    found = lexical_search.search(one, one.withColumnRenamed("doc_id", "item_id")).collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in found] == [(1, 1, 1)]


# --- language ID -----------------------------------------------------------------------------------------


def paths(e, moves, first):
    """Posteriors by summing over all label paths."""
    n, k = e.shape
    out = np.zeros((n, k))
    for p in itertools.product(range(k), repeat=n):
        w = math.exp(first[p[0]] + sum(e[i, x] for i, x in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p)))
        for i, x in enumerate(p):
            out[i, x] += w
    return out / out.sum(1, keepdims=True)


@pytest.mark.parametrize("block", [64, 1, 3])
def test_forward_backward_sums_over_paths(block, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", block)
    rng = np.random.default_rng(0)
    bounds = np.array([0, 0, 5, 6, 13, 13])
    e, moves, first = rng.normal(size=(13, 3)) * 3, rng.normal(size=(3, 3)), rng.normal(size=3)
    got_ = language_id.posteriors(e, bounds, moves, first)
    for a, b in itertools.pairwise(bounds):
        if b > a:
            assert np.allclose(got_[a:b], paths(e[a:b], moves, first))
    long = language_id.posteriors(rng.normal(size=(5000, 3)) * 50, np.array([0, 5000]), moves * 20, first)
    assert np.isfinite(long).all() and np.allclose(long.sum(1), 1)
    assert language_id.posteriors(np.zeros((0, 3)), np.array([0, 0]), moves, first).shape == (0, 3)


SYLLABLES = {"aa": "ba be bi bo bu da de".split(), "bb": "ko ka ke sk st sp".split(), "cc": "éa éo ua uo ie ié".split()}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(2)
    rows = [(i, speech(rng, lang, rng.randint(1, 60)), lang) for i, lang in enumerate(rng.choice("aa bb cc".split()) for _ in range(300))]
    rows += [(900, None, "aa"), (901, "ba be", None), (902, "", "bb"), (903, "12 34", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return language_id.train(docs, bound=60), rows


def test_language_of_new_texts(spark, trained):
    model, _ = trained
    rng = random.Random(77)
    rows = [(i, speech(rng, lang, rng.randint(2, 30)).title(), lang) for i, lang in enumerate("aa bb cc".split() * 40)]
    rows += [(500, None, "und"), (501, "", "und"), (502, "12, 3 — 4!", "und"), (503, speech(rng, "bb", 30000), "bb"), (504, "БГ 日本", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, want string").withColumns({"_lang": F.lit(1), "lang": F.lit(2), "number": F.lit(3)})
    out = language_id.predict(df, model)
    assert out.columns == [*df.columns, "__lang", "_lang_score"]
    out = out.collect()
    assert np.mean([r["want"] == r["__lang"] for r in out if r["doc_id"] < 500]) > 0.98
    assert all(0 <= r["_lang_score"] <= 1 for r in out)
    assert all(r["__lang"] == r["want"] for r in out if 500 <= r["doc_id"] < 504)
    assert next(r for r in out if r["doc_id"] == 504)["__lang"] in SYLLABLES


def test_code_switched_text_is_labelled_word_by_word(spark, trained):
    model, _ = trained
    rng = random.Random(8)
    a, b, c = speech(rng, "aa", 25), speech(rng, "cc", 30), speech(rng, "bb", 25)
    text = f"… {a}, {b}! {c} 7"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "--")], "doc_id long, text string")
    got_ = {r["doc_id"]: r["_spans"] for r in language_id.spans(rows, model).collect()}
    assert got_[2] == got_[3] == []
    runs = [s for s in got_[1] if s["end"] - s["start"] > 10]
    assert [s["lang"] for s in runs] == ["aa", "cc", "bb"]
    assert abs(runs[1]["start"] - text.index(b)) <= 12 and abs(runs[2]["end"] - (len(text) - 2)) <= 12
    assert all(a["end"] <= b["start"] for a, b in itertools.pairwise(got_[1]))


def test_language_without_labels_or_with_one(spark):
    docs = spark.createDataFrame([(1, "ba be", None), (2, None, "aa")], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model is None
    out = language_id.predict(docs, model).collect()
    assert all((r["_lang"], r["_lang_score"]) == ("und", 0.0) for r in out)
    assert language_id.spans(docs, model).first()["_spans"] == []
    one = language_id.train(spark.createDataFrame([(1, "ba be", "aa"), (1, "ba be", "aa")], docs.schema))
    assert [(r["_lang"], round(r["_lang_score"], 6)) for r in language_id.predict(docs, one).orderBy("doc_id").collect()] == [("aa", 1.0), ("und", 0.0)]
    assert language_id.predict(docs.limit(0), one).count() == 0
    assert language_id.train(docs.limit(0)) is None


def test_language_training_is_repeatable_and_bounded(spark, trained):
    model, rows = trained
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    again = language_id.train(docs, bound=60)
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.moves, again.moves)
    assert (np.diag(model.moves) > model.moves.mean(1)).all()  # a language seldom changes


def test_lexicon_counts_every_word(spark, trained):
    model, rows = trained
    counts = collections.defaultdict(collections.Counter)
    for _, t, lang in rows:
        if t is not None and lang is not None:
            w = language_id.words([t.encode()])
            counts[lang].update((w.hash >> np.uint64(64 - language_id.LEXICON_BITS)).tolist())
    total = {x: sum(c.values()) for x, c in counts.items()}
    for cell in set().union(*counts.values()):
        share = np.array([counts[x][cell] / max(1, total[x]) for x in model.languages])
        share /= share.sum()
        want = 1 + 2 * int(share.argmax()) + (share.max() >= 0.9) if share.max() >= 0.5 and sum(c[cell] for c in counts.values()) >= 5 else 0
        assert model.lexicon[cell] == want
