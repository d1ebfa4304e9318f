"""Corpus operators against brute force, round trips and held-out accuracy, and their edge cases."""

import collections
import hashlib
import io
import math
import os
import random
import re
import struct
import tracemalloc
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyward.llm import chat, common, decontaminate, embeddings, language_model, line_dedup, mixing, ngram_join, quality, suffix_dedup, warc

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").encode().translate(LOW))


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, repeated lines and passages, junk, nulls, empty and long texts."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, rows = text(80), []
    base = text(200)
    for i in range(60):
        rows.append((i, f"Shared line of the site\n{text(rng.randint(1, 150))}"))
    for i in range(60, 75):
        w = base.split()
        for _ in range(i - 60):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(75 + i, base) for i in range(60)]
    rows += [(140, f"{text(40)} {passage} {text(40)}"), (141, f"{text(30)} {passage}"), (142, None), (143, ""), (144, "   \n "), (145, "one"), (146, "one"), (147, "One Two"), (148, text(6000)), (149, passage)]
    return [(i, t, "en", f"s{i % 3}" if i % 10 else None, len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- common -------------------------------------------------------------------------------------------


def test_components(spark):
    scratch = common.Scratch(spark, "t")
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "u long, v long"), scratch).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = components(nodes, [e for e in edges if e[0] != e[1]])
    assert got == want
    assert common.connected_components(spark.createDataFrame([], "u long, v long"), scratch).count() == 0


def test_words_hash():
    a = common.Words([b"The cat", b"", b" x the\tCAT\x0bcat "])
    assert list(np.diff(a.bounds)) == [2, 0, 4]
    h = a.hash
    assert h[0] == h[3] and h[1] == h[4] == h[5] and len(set(h.tolist())) == 3
    assert common.Words([b"The the"], fold=False).hash[0] != common.Words([b"The the"], fold=False).hash[1]


# --- decontamination ---------------------------------------------------------------------------------


def test_reparameterised_questions(spark):
    b = spark.createDataFrame([(10, "On Friday John bought 5 apples and 3 kg of flour for 20 dollars while John sold 5 pears to Paul"), (11, None), (12, "too short")], "item_id long, text string")
    d = spark.createDataFrame(
        [(1, "Well. On Monday Maria bought 7 apples and 12 kg of flour for 30 dollars while Maria sold 7 pears to Peter"), (2, "x"), (None, None), (3, ""),
         (4, "On Monday Ann bought 9 apples and 3 kg of flour for 31 dollars while Bob sold 5 pears to Tom and 8 to Al"), (5, "On Monday A bought nothing and B sold nothing at all to anybody here today in the town")],
        "doc_id long, text string",
    ).withColumn("h", F.lit(1))
    got = {r["doc_id"]: r for r in decontaminate.contaminated(d, b).collect()}
    assert set(got) == {1, 4} or set(got) == {1}
    assert got[1]["consistency"] == 1.0 and got[1]["n_slots"] == 10
    assert {r["doc_id"] for r in decontaminate.decontaminate(d, b).collect()} >= {2, None, 3, 5}
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0


def test_occurrences_are_judged_one_by_one(spark):
    item = "On Friday John bought 5 apples and 3 kg of flour for 20 dollars while John sold 5 pears to Paul"
    other = "On Monday Maria bought 7 apples and 12 kg of flour for 30 dollars while Maria sold 7 pears to Peter"
    third = "On Sunday Clara bought 8 apples and 14 kg of flour for 40 dollars while Clara sold 8 pears to Simon"
    split = lambda t: t.replace("for", "that was sold there for")
    again = "then the man sold # pears to @ and then the man sold # plums to @ and then the man sold # pears to @ and then the man sold # plums to @"
    fill = lambda t, v: "so " + "".join(next(v) if c in "#@" else c for c in t)
    b = spark.createDataFrame([(1, item), (2, fill(again, iter(["1", "Ann", "2", "Bob", "3", "Carl", "4", "Dora"])))], "item_id long, text string")
    loose = "then @ gave the red box with # coins to @ before @ took the blue box with # coins from @ and @ ran home with # coins"
    b = b.unionByName(spark.createDataFrame([(3, fill(loose, iter("Ann 5 Bob Ann 5 Bob Ann 5".split())))], b.schema))
    rows = [
        (1, f"Well. {item}. {other}."), (2, f"Well. {other}. {third}. {item}."), (3, f"Well. {split(item)}. {split(other)}. {split(third)}."),
        (4, "Well. " + fill(again, iter(["1", "Ann", "2", "Bob", "3", "Carl", "4", "Dora"]))), (5, ". ".join(fill(loose, iter(v.split())) for v in ("Tom 1 Al Max 2 Jim Ted 3", "Eva 4 Ida Lea 6 Mia Zoe 7"))),
    ]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), b).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2)}
    assert all(r["consistency"] == 1.0 for r in got.values()) and got[1, 1]["n_slots"] == 10 and got[1, 1]["coverage"] == 1.0
    assert got[3, 1]["coverage"] == 1.0


def test_short_and_dense_items_match_verbatim(spark):
    dense = "Compute 3 4 5 plus 6 7 8 9 minus 10 11 12 13 14"
    items = [(1, "What is the capital of France?"), (2, dense), (3, "Why so?"), (4, "Please name the tallest tower of old Paris"), (5, " .,;")]
    rows = [
        (1, "They asked What is the capital of France? Nobody knew."), (2, f"so {dense} and go"), (3, "So compute 3 4 5 plus 6 7 8 9 minus 10 11 12 13 15 or less"), (4, "Compute 1 2 9 plus 4 4 4 9 minus 77 11 62 33 14"),
        (5, "Why are they so?"), (6, "And why so late"), (7, "We said Please name the tallest tower of old Paris"), (8, "What is the capital of Spain?"), (9, "- ,"), (10, None),
    ]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r for r in got.collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 2), (6, 3), (7, 4), (8, 1)}
    assert got[2, 2]["coverage"] == 1.0 and got[2, 2]["n_tokens"] == 15 and got[2, 2]["consistency"] == 1.0 and got[6, 3]["n_tokens"] == 2


def test_template_tokens(spark):
    d = spark.createDataFrame([("It was 5 km. Ann ran twenty miles in Rome, and m is 1,000.5 kg",)], "t string")
    got = d.select(decontaminate.raw_tokens(F.col("t")).alias("r")).select(decontaminate.template(F.col("r")).alias("x")).first()["x"]
    assert got == ["it", "was", "#", "~", "ann", "ran", "#", "~", "in", "@", "and", "m", "is", "#", "~"]


# --- mixing --------------------------------------------------------------------------------------------


def test_mix_meets_targets(spark, corpus, docs):
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    size = {r[0]: len(words(r[1])) for r in corpus}
    source = {r[0]: r[3] for r in corpus}
    sizes = collections.Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    names = sorted(x for x in sizes if x is not None) + [None]
    weight = dict(zip(names, [5, 2, 1, 5], strict=True))
    total, capped = sum(sizes.values()), {}
    while True:  # the plain loop: reshare by weight until none is above its limit
        rest = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * level > 3 * sizes[s]]
        if not over:
            break
        capped |= {s: 3.0 * sizes[s] for s in over}
    want = {s: capped.get(s, weight[s] * level) for s in names}
    taken = collections.Counter()
    for i, r in got.items():
        assert r["_size"] == size[i] and math.isclose(r["_target"], want[source[i]], rel_tol=1e-9) and 0 <= r["_copies"] <= 3
        taken[source[i]] += r["_copies"] * size[i]
    for s in names:
        assert abs(taken[s] - want[s]) <= max(10, 0.02 * want[s]), s
    again = {r["doc_id"]: r["_copies"] for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {i: r["_copies"] for i, r in got.items()}
    assert mixing.expand(mixing.mix(docs)).count() == sum(again.values())


def test_mix_rates_solve_the_dual(spark, docs):
    """Rates are min(3, exp(m * size)) with one m per source, and meet the constraint before rounding."""
    rows = mixing.mix(docs).where("_size > 0").collect()
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert math.isclose(sum(r["_rate"] * r["_size"] for r in own), own[0]["_target"], rel_tol=1e-4)
        free = [math.log(r["_rate"]) / r["_size"] for r in own if 1e-12 < r["_rate"] < 3 and r["_size"]]
        assert not free or max(free) - min(free) < 1e-9


def test_mix_edges(spark, empty):
    assert mixing.mix(empty).count() == 0
    one = spark.createDataFrame([(1, None, "x", None, 0, 9), (1, "a b", "x", None, 0, 9)], f"{DOCS}, size int")
    assert sorted(r["_copies"] for r in mixing.mix(one).where("_size > 0").collect()) == [1]
    assert "size" in mixing.mix(one).columns
    clash = one.withColumns({"_size": F.lit(1), "_copies": F.lit("c"), "copy": F.lit(8), "key": F.lit(2), "body": F.lit(3), "number": F.lit(4), "id": F.lit(5), "row": F.lit(6)})
    row = mixing.expand(mixing.mix(clash)).where("text = 'a b'").first()
    assert (row["_size"], row["_copies"], row["copy"], row["_copy"], row["key"], row["number"]) == (1, "c", 8, 1, 2, 4)


def test_mix_rounds_repeated_rows_one_by_one(spark):
    rows = [(1, " ".join(["a"] * 7), "s0")] * 30 + [(2, " ".join(["b"] * 6), "s1")] * 40 + [(None, "c d", "s2")] * 25
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, goal = collections.Counter(), {}
    for r in mixing.mix(d).collect():
        taken[r["source"]] += r["_size"] * r["_copies"]
        goal[r["source"]] = r["_target"]
    assert all(abs(taken[s] - goal[s]) <= 7 for s in goal), (taken, goal)


# --- Jaccard join -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_matches_brute_force(spark, corpus, docs, n, num):
    sets = {}
    for i, t, *_ in corpus:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = components(ids, linked)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, n=n, num=num, den=100).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in ids}
    kept = {r["doc_id"] for r in ngram_join.keep_one(docs, n=n, num=num, den=100).collect()}
    assert kept == set(want.values())


def test_jaccard_blocks_and_frequent_tokens(spark, monkeypatch):
    """Small groups and blocks take every path: links through a centre, several blocks, both sides of a pair."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in rows for w in [t.split()]}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(d, n=3, num=90, den=100).collect()}
    assert got == components(list(sets), linked)


def test_jaccard_empty(empty):
    assert ngram_join.jaccard_components(empty).count() == 0


def test_compare_keeps_every_link():
    """The filters under several orders lose no pair, whichever rows ask."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        base, sets = rng.choice(500, 60, replace=False), []
        for _ in range(40):
            keep = rng.random(60) > rng.choice([0.02, 0.1, 0.3])
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(500, 2000, int(rng.integers(0, 9)))])))
        n = np.array([len(x) for x in sets])
        p = ngram_join.prefix_length(n, 80, 100)
        ranks = [rng.permutation(2000) for _ in range(3)]
        orders = [[x[np.argsort(r[x])][:k] for x, k in zip(sets, p, strict=True)] for r in ranks]
        asks = rng.random(40) < 0.5
        want = [(i, j) for i in range(40) for j in range(40) if i != j and asks[i] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        got = ngram_join.compare(np.arange(40), n, orders, sets, 80, 100, asks)
        assert set(got) <= set(want) and components(range(40), got) == components(range(40), want)


def test_jaccard_repeated_and_null_ids(spark):
    """Every row is compared with its own text, whatever its id."""
    rng = random.Random(8)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(100)]
    a, b, c = text(), text(), text()
    near = lambda t: [*t[:-1], "other"]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (3, " ".join(near(b))), (None, " ".join(c)), (7, " ".join(near(c))), (9, None), (None, ""), (4, " ".join(text()))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"mark": F.lit(1), "_gone": F.lit(2)})
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(d).collect()}
    assert got == {(1, 96, 1), (3, 96, 1), (None, 96, 7), (7, 96, 7), (9, 0, 9), (None, 0, None), (4, 96, 4)}
    kept = ngram_join.keep_one(d)
    assert kept.columns == d.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "4", "7", "9", "None", "None"]


def test_jaccard_frequent_tokens(spark, monkeypatch):
    """Tokens that the table of counts shows as frequent are not sent, and lose no link."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 6)
    rng = random.Random(11)
    head = [f"h{i}" for i in range(40)]
    rows = []
    for i in range(40):
        own = [f"x{rng.randrange(10**6)}" for _ in range(8)]
        rows += [(3 * i, " ".join(head + own)), (3 * i + 1, " ".join(head + own[:-1] + [f"y{i}"])), (3 * i + 2, " ".join(head[:-9] + own + own[::-1] + [f"z{i}"] * 9))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in rows for w in [t.split()]}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(d, n=3, num=80, den=100).collect()}
    assert got == components(list(sets), linked) and len(set(got.values())) < len(sets)


# --- lines -------------------------------------------------------------------------------------------------


def test_lines(spark):
    rows = [(i, f"menu\nbody {i}\n\nmenu " if i % 2 else f"body {i}", "en", "h", 0) for i in range(40)] + [(50, None, "en", "h", 0), (51, "menu", "en", "h", 0), (52, "menu", "en", None, 0), (53, "", "en", None, 0)]
    d = spark.createDataFrame(rows, DOCS).withColumn("_x", F.lit(1))
    got = {r["doc_id"]: r for r in line_dedup.drop_lines(d).collect()}
    assert got[1]["text"] == "body 1\n" and got[1]["_n_dropped"] == 2 and got[1]["_n_lines"] == 4
    assert got[2]["text"] == "body 2" and got[50]["text"] is None and got[52]["text"] == "menu" and got[53]["text"] == ""
    assert got[51]["text"] == "" and got[51]["_n_dropped"] == 1
    assert {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(d, keep_whole=True).collect()}[51] == "menu"
    clash = d.withColumns({"_host": F.lit("mine"), "_n_lines": F.lit(7), "marks": F.lit(3), "kept": F.lit(4), "page": F.lit(5), "site": F.lit(6)})
    row = line_dedup.drop_lines(clash).where("doc_id = 1").first()
    assert (row["_host"], row["_n_lines"], row["marks"], row["kept"], row["page"], row["site"], row["__n_lines"], row["text"]) == ("mine", 7, 3, 4, 5, 6, 4, "body 1\n")
    sites = spark.createDataFrame([(i, f"http://a.org/{i}", f"top\n{i}") for i in range(8)] + [(9, "http://b.org/", "top\n9"), (10, None, "top")], "page_id long, url string, html string")
    by_url = {r["page_id"]: r["html"] for r in line_dedup.drop_lines(sites, host=line_dedup.host_of_url(F.col("url")), text_col="html").collect()}
    assert by_url[3] == "3" and by_url[9] == "top\n9" and by_url[10] == "top"
    assert line_dedup.drop_lines(d.limit(0)).count() == 0
    assert spark.createDataFrame([("HTTP://u:p@A.b.c:80/x",), (None,)], "u string").select(line_dedup.host_of_url(F.col("u")).alias("h")).first()["h"] == "a.b.c"


# --- quality -----------------------------------------------------------------------------------------------


def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "mats", "and", "ran"]) + str(rng.randrange(9)) for _ in range(40))
    bad = lambda: " ".join(w.upper() + "!!" for w in good().split())
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(400)] + [(900, None), (901, ""), (902, "x" * 50_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)] + [(1000, 1), (None, 1), (5, None)], "doc_id long, label int")
    out = {r["doc_id"]: r["_score"] for r in quality.score(d, quality.train(d, y)).collect()}
    assert len(out) == 403 and all(0 <= s <= 1 for s in out.values())
    assert np.mean([(out[i] >= 0.3) == (i % 4 != 0) for i in range(300, 400)]) > 0.97
    none = quality.score(d, quality.train(d, y.limit(0)))
    assert {round(r["_score"], 6) for r in none.collect()} == {0.5}
    assert quality.score(d.limit(0), quality.train(d, y)).count() == 0
    named = quality.score(d.withColumn("_score", F.lit("mine")), quality.train(d, y))
    assert named.columns[-2:] == ["_score", "__score"] and {r["_score"] for r in named.select("_score").collect()} == {"mine"}


def test_quality_counts_and_scores_match_brute_force(spark):
    """Class counts of every row, and the score from weights and curve, against plain loops."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("the cat Sat 12 on, mats".split()) for _ in range(rng.randint(0, 20)))) for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    y = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, label int")
    features = {}
    for i, t in rows:
        f, starts = quality.features([t.encode()])
        assert list(starts) == [0, len(f)] and len(set(f.tolist())) == len(f)
        features[i] = f.tolist()
    got = {r["feature"]: (r["pos"], r["neg"]) for r in quality.class_counts(d.join(y, "doc_id")).collect()}
    want = {quality.SPACE: (30, 30)}
    for i in range(60):
        for f in features[i]:
            pos, neg = want.get(f, (0, 0))
            want[f] = (pos + i % 2, neg + (i + 1) % 2)
    assert got == want
    weights, a, c = quality.train(d, y)
    for r in quality.score(d, (weights, a, c)).collect():
        f = features[r["doc_id"]]
        margin = (sum(weights[x] for x in f) + weights[quality.SPACE]) / math.sqrt(len(f) + 1)
        assert math.isclose(r["_score"], 1 / (1 + math.exp(-(a * margin + c))), rel_tol=1e-9)


def test_quality_learns_from_a_bounded_sample(spark):
    y = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, label int")
    got = quality._chosen(y, 100, 30).collect()
    assert len(got) == 100 and sum(r["fit"] for r in got) == 30 and sorted(map(tuple, got)) == sorted(map(tuple, quality._chosen(y.repartition(3), 100, 30).collect()))


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(80)]
    y = np.array([1.0 if 3 in r or 5 in r else -1.0 for r in rows])
    scale = np.ones(quality.SPACE + 1)
    w = quality.dual_coordinate_descent(rows, y, scale, 1.0, 400)
    x = np.zeros((80, quality.SPACE + 1), np.float32)[:, :31]
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(len(r) + 1)
        x[i, 30] = 1 / np.sqrt(len(r) + 1)
    v = np.append(w[:30], w[quality.SPACE])
    c = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())
    loss = lambda v: 0.5 * v @ v + (c * np.maximum(0, 1 - y * (x @ v))).sum()
    best = loss(v)
    assert all(loss(v + rng.normal(0, s, 31)) >= best - 1e-2 for s in (0.001, 0.01, 0.1) for _ in range(50))


# --- suffixes ----------------------------------------------------------------------------------------------


def test_suffix_sort():
    rng = random.Random(1)
    for trial in range(150):
        n = rng.choice([8, 10, 14, 20])
        texts = [bytes(rng.choice(b"ab\x00" if trial % 2 else b"aab") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 5))]
        count = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
        assert [list(x) for x in suffix_dedup.repeated_strings(texts, n)] == [[i for i in range(len(t) - n + 1) if count[t[i : i + n]] > 1] for t in texts]


@pytest.mark.parametrize("many", [2000, 1])
def test_suffix_dedup_matches_brute_force(spark, corpus, docs, many, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", many)  # 1: every gram with two pieces takes the cut path
    extra = spark.createDataFrame([(200, "é" * 300 + "x" * 500, "en", "s", 0), (201, "ab" * 400, "en", "s", 0), (201, "ab" * 400, "en", "s", 0)], DOCS)
    d = docs.unionByName(extra)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in d.collect()]
    count = collections.Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    want = collections.Counter()
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\x01" * 200
        want[(i, sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest())] += 1
    got = suffix_dedup.remove_repeats(d.select("doc_id", "text")).collect()
    assert collections.Counter((r["doc_id"], len((r["text"] or "").encode()) - len(r["_kept"]), len(r["_spans"]) // 2, hashlib.sha256(r["_kept"]).hexdigest()) for r in got) == want


def test_suffix_dedup_empty(empty):
    assert suffix_dedup.remove_repeats(empty.select("doc_id", "text")).count() == 0


# --- language model -----------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.exists(language_model.TOKENIZER), reason="no tokenizer")
def test_language_model(spark, corpus, docs):
    train = docs.where("doc_id % 5 <> 0")
    got = {r["doc_id"]: r for r in language_model.score_texts(docs.select("doc_id", "text"), train).collect()}
    c = collections.Counter()
    for i, t, *_ in corpus:
        if i % 5:
            c.update(words(t))
            c["end"] += 1
    n, v = sum(c.values()), len(c)
    for i, t, *_ in corpus:
        w = [*words(t), "end"]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        r = got[i]
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["n_tokens"] == len(w) and r["n_known"] == sum(c[x] > 0 for x in w) and r["train_tokens"] == n
        assert r["score"] < 0
    assert language_model.score_texts(docs.limit(0).select("doc_id", "text"), train).count() == 0


@pytest.mark.skipif(not os.path.exists(language_model.TOKENIZER), reason="no tokenizer")
def test_language_model_learns_from_every_token(spark, docs):
    kept = {}

    class Kept(common.Scratch):
        def save(self, df, name):
            kept[name] = super().save(df, name)
            return kept[name]

    train, scratch = docs.select("doc_id", "text"), Kept(spark, "kept")
    subs = language_model._counts(train, language_model.TOKENIZER, scratch)[1].toPandas()
    ids = np.zeros(language_model.VOCABULARY)
    ids[subs.item] = subs.n
    language_model.train_attention(train, language_model.class_map(ids, language_model.word_starts(language_model.TOKENIZER))[0], ids, language_model.TOKENIZER, scratch)
    assert {r["seen"] for r in kept["weights"].collect()} == {ids.sum()}


def test_attention_is_a_causal_distribution():
    rng = np.random.default_rng(2)
    flat = (rng.standard_normal(sum(language_model._SIZES.values())) * 0.3).astype(np.float64)
    cls, per = rng.integers(0, 127, 70), np.array([50, 1, 19])
    x, t, text, _ = language_model.windows(cls, per)
    assert sorted(t[t >= 0].tolist()) == list(range(70)) and (np.bincount(text, (t >= 0).sum(1)) == per).all()
    w = language_model.unpack(flat)
    logits = language_model.forward(w, x)
    changed = x.copy()
    changed[:, -3:] = (changed[:, -3:] + 1) % 127
    assert np.allclose(logits.reshape(len(x), 16, -1)[:, :13], language_model.forward(w, changed).reshape(len(x), 16, -1)[:, :13])
    y = np.where(t >= 0, cls[np.maximum(t, 0)], -1)
    p = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    rows = np.flatnonzero(y.ravel() >= 0)
    # training sees the same model: the second halves of rows of two blocks have the same probabilities
    whole = (x[:, :16] != language_model.CLASSES - 1).all(1)
    later = np.concatenate([np.full_like(y, -1), y], 1)[whole]
    own = rows[np.isin(rows // 16, np.flatnonzero(whole))]
    assert whole.sum() == 4 and np.isclose(language_model.gradient(flat, x[whole], later)[1], -p[own, y.ravel()[own]].sum())
    x, y = language_model.sequences(cls, per)
    assert sorted(y[y >= 0].tolist()) == sorted(cls.tolist()) and x[0, 0] == -1 and x[0, 1] == cls[0] and y[0, 0] == cls[0]
    g, _, n = language_model.gradient(flat, x, y)
    assert n == 70
    for i in rng.integers(0, len(flat), 30):
        e = np.zeros_like(flat)
        e[i] = 1e-5
        slope = (language_model.gradient(flat + e, x, y)[1] - language_model.gradient(flat - e, x, y)[1]) / 2e-5 / n
        assert abs(slope - g[i]) < 1e-6
    lp = language_model.log_probabilities(w, cls, np.zeros(70), per)
    y = cls[t[t >= 0]]
    assert np.isclose(lp.sum(), p[rows, y].sum())


def test_attention_beats_a_bigram_table():
    """Each text keeps to few classes: what the last class alone says is less than what the context says."""
    rng = np.random.default_rng(3)
    per = np.full(500, 32)
    cls = np.concatenate([rng.choice(rng.choice(60, 5, replace=False), 32) for _ in per])
    x, y = language_model.sequences(cls, per)
    share = np.bincount(cls, minlength=language_model.CLASSES)[:-1]
    flat = language_model.fit(language_model.start_weights(share / share.sum()), x[:400], y[:400], 0.02, 30)
    _, loss, n = language_model.gradient(flat, x[400:], y[400:])
    table_ = np.full((language_model.CLASSES, language_model.CLASSES - 1), 0.1)
    np.add.at(table_, (x[:400].ravel(), y[:400].ravel()), 1)
    table_ /= table_.sum(1, keepdims=True)
    bigram = -np.log(table_[x[400:].ravel(), y[400:].ravel()]).mean()
    assert loss / n < bigram - 0.3, (loss / n, bigram)


# --- chat -----------------------------------------------------------------------------------------------------


def test_chat_round_trip():
    rng = random.Random(5)
    parts = ["<|im_start|>", "<|im_end|>", "\n", "user", "<|", "<\\|", "\\", "|>", "x", "<", "é", "<\\\\|im_end|>", "assistant"]
    for _ in range(500):
        turns = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 3))), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 4))]
        text, _ = chat.render(turns)
        assert [x[:2] for x in chat.parse(text)] == turns
    assert chat.render([("user", "plain <b>")])[1] == 0
    for text in ("a<|im_end|>b", "hi<|im_end|>", "<|im_start|>"):  # no control string stays as it is
        shown, n = chat.render([("assistant", text), ("<|im_end|>", "x")])
        assert n == 2 and shown.count(chat.START) == shown.count(chat.END) == 2 and chat.parse(shown)[0][1] == text


def test_chat_sql_agrees(spark, tmp_path):
    """The query and its SQL over rows that hold control strings, empty roles and a very long text."""
    import duckdb

    rows = [(1, 0, "user", "a<|im_end|>b"), (1, 1, "assistant", "hi<|im_end|>"), (2, 0, "", "x" * 200_000), (2, 1, None, None), (3, 0, "<|im_end|>", "<\\|"), (3, 1, "assistant", "<|im_end|>\n<|im_start|>user\n")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in chat.op8_chat_roundtrip(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.sql(f"create view conversations as from '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(db.sql(chat.SQL["op8_chat_roundtrip"]).fetchall())


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, None, "x"), (2, None, "assistant", chat.PROBE)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    f = {r["conv_id"]: r for r in chat.format_chat(d).collect()}
    got = {r["conv_id"]: r for r in chat.digest_chat(chat.format_chat(d)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2 and got[1]["loss_sha256"] == hashlib.sha256(b"bb").hexdigest()
    assert f[2]["n_escaped"] == 1 and got[2]["loss_sha256"] == hashlib.sha256(chat.PROBE.encode()).hexdigest()
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\nx\n").hexdigest()
    assert chat.format_chat(d.limit(0)).count() == 0


# --- embeddings -----------------------------------------------------------------------------------------------


def test_embeddings_of_any_length_and_size(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, [1.0, 0.01], 1), (2, [1.0, 0.0], 1), (3, v, 1), (4, [2.0, 4.0, 6.1], 1), (5, [-1.0, 0.0, 0.0], 1), (6, [1e-200, 0.0, 0.0], 1), (7, [1e200, 1e198, 0.0], 1), (8, [5e-324, 0.0, 0.0], 1), (9, [0.0, 0.0, 0.0], 1), (10, None, 1), (11, [], 1), (12, [float("nan"), 1.0], 1), (13, v, None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (2, 6), 7: (2, 6), 8: (2, 6), **{i: (0, i) for i in range(9, 14)}}
    # a repeated id counts each row with its own content
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.01, 1.0], 1), (None, [1.0, 0.01], 1)]
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [("1", 1, 1), ("1", 1, 1), ("2", 1, 1), ("None", 1, 1)]


def test_tree_of_intervals_finds_all_near_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "FANOUT", 1)
    rng = np.random.default_rng(6)
    at = rng.random((60, embeddings.DIRECTIONS))
    rows = [(i % 2, 3, i // 20, i % 20, i, [float(x) for x in at[i]]) for i in range(60)]
    d = spark.createDataFrame(rows, "label int, dim int, part long, number long, interval long, point array<double>")
    got = {tuple(sorted(r)) for r in embeddings.near_intervals(d, 0.8).collect()}
    want = {(i, j) for i in range(60) for j in range(i, 60) if i % 2 == j % 2 and ((at[i] - at[j]) ** 2).sum() <= 0.64}
    assert got == want


def test_embeddings_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "INTERVAL", 16)
    monkeypatch.setattr(embeddings, "LEAF", 4)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(240):
        v = centres[rng.integers(12)] + rng.normal(scale=rng.choice([0.05, 0.3]), size=8)
        rows.append((i, [float(np.float32(x)) for x in v * rng.uniform(0.5, 3)], int(i % 3) if i % 17 else None))
    rows += [(300 + k, rows[5][1], rows[5][2]) for k in range(6)]
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] + [1.0] * 7, 1), (403, [None] + [1.0] * 7, 1), (404, [1.0] * 3, 1), (405, [float("inf")] * 8, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(0))
    good = {i: np.array(v, float) for i, v, y in rows if y is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: y for i, _, y in rows}
    linked = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and good[a] @ good[b] / (np.linalg.norm(good[a]) * np.linalg.norm(good[b])) >= 0.93]
    n = collections.Counter(x for e in linked for x in e)
    want = components([r[0] for r in rows], linked)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(d).collect()}
    assert got == {i: (n[i], want[i], want[i] == i) for i in want}
    assert embeddings.near_vectors(d.limit(0)).count() == 0


# --- WARC -------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "solo"), (None, "u", "<p>é</p>"), (5, "u", "x" * 3_000_000), (5, "u", "x" * 3_000_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(0))
    m = common.Scratch(spark, "t").save(warc.write_packages(d, f"file://{tmp_path}/w"), "m")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_packages(m).collect()), key=str)
    p = len("<p>é</p>".encode())
    assert got == sorted([(1, p, "revisit", 2), (2, p, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (None, 4, "response", None), (None, p, "revisit", 2), (5, 3_000_000, "response", None), (5, 3_000_000, "response", None)], key=str)
    plain = common.Scratch(spark, "t").save(warc.write_packages(d, f"file://{tmp_path}/v", min_bytes=10**9), "m")
    assert warc.read_packages(plain).where("record_type = 'revisit'").count() == 0
    none = common.Scratch(spark, "t").save(warc.write_packages(d.limit(0), f"file://{tmp_path}/n"), "m")
    assert warc.read_packages(none).count() == 0


def test_zip_reader_without_index_and_zip64(tmp_path):
    records = [zlib.compress(b"", 9) for _ in range(0)] or [warc._gzip(warc.record(i, "http://a/", b"x" * i, None)[0]) for i in (1, 5000)]
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("archive/data.warc.gz", b"".join(records))
        z.writestr("packed.txt", "y" * 1000, zipfile.ZIP_DEFLATED)
    raw = body.getvalue()
    m = {x["name"]: x for x in warc.members(pa.PythonFile(io.BytesIO(raw)) if False else pa.BufferReader(raw))}
    assert m["packed.txt"]["method"] == 8
    a = m["archive/data.warc.gz"]
    places = list(warc._walk(pa.BufferReader(raw), a["offset"], a["offset"] + a["size"]))
    assert [warc.parse_record(zlib.decompress(raw[s : s + n], 31))["page_id"] for s, n in places] == [1, 5000]
    # the same package with ZIP64 directories: sizes and offsets moved to the extra field
    name, data = b"archive/data.warc.gz", b"".join(records)
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, zlib.crc32(data), len(data), len(data), len(name), 0) + name
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local) + len(data)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    raw = local + data + central + end64 + locator + end
    (x,) = warc.members(pa.BufferReader(raw))
    assert raw[x["offset"] : x["offset"] + x["size"]] == data


# --- pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch, columns, counts = common.Scratch(spark, "t"), docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, sf), name)
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] <= counts[3]
    assert corpus_pipeline.run(spark, sf).count() == counts[-1]


@pytest.mark.skipif(not os.path.exists(language_model.TOKENIZER), reason="no tokenizer")
def test_language_model_keeps_clashing_columns(spark, docs):
    d = docs.select("doc_id", "text").where("doc_id < 5").selectExpr("*", "doc_id as _k1", "doc_id as k1", "doc_id as row", "doc_id as `a.b`", "'old' as score")
    got = language_model.score_texts(d, docs.select("doc_id", "text")).collect()
    assert len(got) == d.count()
    assert all(r["_k1"] == r["k1"] == r["row"] == r["a.b"] == r["doc_id"] and r["score"] < 0 for r in got)


def _made_up_texts(n, seed):
    """Texts in either of two vocabularies of words of two to five syllables, some words far more frequent than others."""
    rng = np.random.default_rng(9)
    syllables = ["".join(rng.choice(list(c)) for c in ("bdfgklmnprst", "aeiou", "lnrs")) for _ in range(60)]
    words = [["".join(rng.choice(syllables, rng.integers(2, 6))) for _ in range(300)] for _ in range(2)]
    p = 1 / np.arange(1, 301)
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(words[i % 2], 120, p=p / p.sum())) for i in range(n)]


@pytest.mark.skipif(not os.path.exists(language_model.TOKENIZER), reason="no tokenizer")
def test_language_model_beats_word_counts_on_unseen_texts(spark):
    train = spark.createDataFrame(list(enumerate(_made_up_texts(400, 1))), "doc_id long, text string")
    unseen = spark.createDataFrame(list(enumerate(_made_up_texts(40, 2))), "doc_id long, text string")
    got = language_model.score_texts(unseen, train).toPandas()
    assert got.score.sum() > got.base_score.sum()


@pytest.mark.skipif(not os.path.exists(language_model.TOKENIZER), reason="no tokenizer")
def test_language_model_mixed_with_spelling_is_a_distribution():
    lm = language_model
    plain = lm.subwords(lm.TOKENIZER)
    own, per, _, events = plain.followers([t.encode() for t in _made_up_texts(30, 3)])
    spelled = lm.Subwords(lm.TOKENIZER, lm.Spelling.of(*events))
    first = lm.word_starts(lm.TOKENIZER)
    cls, share = lm.class_map(np.bincount(own, minlength=lm.VOCABULARY).astype(float), first)
    starts = np.isin(np.arange(lm.CLASSES - 1), cls[first])
    assert not np.isin(cls[~first], np.flatnonzero(starts)).any()
    w = lm.unpack((np.random.default_rng(4).standard_normal(sum(lm._SIZES.values())) * 0.3).astype(np.float32))
    # shares of the ids of a text agree with a plain count
    text = b"baldinbal dinfurbal"
    ids, _, _, shares = spelled.spelled([text])
    assert len(ids) == len(shares) and tuple(shares[0]) == (1, 0) and ids[-1] == lm.END
    # whatever id comes second, after one that begins a frequent word: chances sum to one
    a = int(own[0])
    begin = np.full(lm.VOCABULARY, lm._mix(np.zeros(1, np.uint64), np.array([a + 1]))[0])
    second = np.arange(lm.VOCABULARY)
    table_ = spelled.spelling(begin, np.where(first, lm.NEXT_WORD, second))
    assert 0 < table_[0, 1] < 1
    pairs = np.stack([np.full(lm.VOCABULARY, a), second], 1).ravel()
    both = np.stack([np.tile(np.float32([1, 0]), (lm.VOCABULARY, 1)), table_], 1).reshape(-1, 2)
    lp = lm.log_probabilities(w, cls[pairs], share[pairs], np.full(lm.VOCABULARY, 2), both, starts.astype(np.float32))
    one = lm.log_probabilities(w, cls[[a]], share[[a]], np.array([1]), np.float32([[1, 0]]), starts.astype(np.float32))
    assert abs(np.exp(lp - one[0]).sum() - 1) < 1e-3


def test_largest_counts_stay_within_the_bound(spark):
    t = spark.createDataFrame([(i, 1 + i // 10, 2) for i in range(100)], "item long, n long, size long")
    for bound in (0, 5, 50, 150, 1000):
        kept = language_model.largest(t, "n", bound, "size").toPandas()
        assert 2 * len(kept) <= bound and (len(kept) == 100 or kept.n.min() > t.toPandas().query("item not in @kept.item").n.max() if len(kept) else True)
    assert language_model.largest(t, "n", 200, "size").count() == 100 and language_model.largest(t.limit(0), "n", 10).count() == 0


@pytest.mark.skipif(not os.path.exists(language_model.TOKENIZER), reason="no tokenizer")
def test_spelling_counts_match_brute_force(spark, docs, monkeypatch):
    lm = language_model
    train = docs.select("doc_id", "text")
    scratch = common.Scratch(spark, "spelling-test")
    got = {(r["item"], r["part"]): r["n"] for r in lm._counts(train, lm.TOKENIZER, scratch)[2].collect()}
    want = {}
    sub = lm.subwords(lm.TOKENIZER)
    for text in (r["text"] for r in train.collect()):
        for word in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
            ids = sub.encode(" " + word.translate(lm._LOWER).decode("utf-8", "replace"))
            h = np.zeros(1, np.uint64)
            for place, x in enumerate([*ids, lm.NEXT_WORD]):
                if place:
                    key = int(h.view(np.int64)[0]), x
                    want[key] = want.get(key, 0) + 1
                h = lm._mix(h, np.array([x + 1]))
    assert got == want
    # beginnings beyond the bound are left to the attention
    whole = lm.spelling(lm._counts(train, lm.TOKENIZER, scratch)[2], scratch)
    monkeypatch.setattr(lm, "FOLLOWERS", len(whole.key) // 2)
    assert 0 < len(lm.spelling(lm._counts(train, lm.TOKENIZER, scratch)[2], scratch).key) <= len(whole.key) // 2
    scratch.release()


@pytest.mark.skipif(not os.path.exists(language_model.TOKENIZER), reason="no tokenizer")
def test_beginnings_beyond_the_broadcast_count_as_much(spark, monkeypatch):
    """Scores do not depend on how many followers of beginnings are broadcast."""
    lm = language_model
    train = spark.createDataFrame(list(enumerate(_made_up_texts(200, 1))), "doc_id long, text string")
    texts = spark.createDataFrame(list(enumerate([*_made_up_texts(20, 2), "", None, "unseen wörds"])), "doc_id long, text string")
    whole = {r["doc_id"]: r["score"] for r in lm.score_texts(texts, train).collect()}
    for bound in (0, 500):
        monkeypatch.setattr(lm, "FOLLOWERS", bound)
        got = {r["doc_id"]: r["score"] for r in lm.score_texts(texts, train).collect()}
        assert got == pytest.approx(whole, rel=1e-5)


@pytest.mark.skipif(not os.path.exists(language_model.TOKENIZER), reason="no tokenizer")
def test_joined_counts_travel_once_and_leave_unknown_beginnings_alone(spark, monkeypatch):
    """The most frequent counts are broadcast, the tables written stay small, and scores agree with the shares of all counts."""
    lm, kept, save = language_model, {}, common.Scratch.save
    monkeypatch.setattr(common.Scratch, "save", lambda self, df, name: [out := save(self, df, name), kept.setdefault(name, out)][0])
    train = spark.createDataFrame(list(enumerate(_made_up_texts(200, 1))), "doc_id long, text string")
    unseen = [*_made_up_texts(20, 2), "unseen wörds of whatever kind", "zzqx " * 50, "Baldinbalx dinfurb"]
    texts = spark.createDataFrame(list(enumerate(unseen)), "doc_id long, text string")
    monkeypatch.setattr(lm, "FOLLOWERS", 500)
    sent, fit = {}, lm.train_attention
    monkeypatch.setattr(lm, "train_attention", lambda *a: sent.setdefault("w", (a[1], a[2], fit(*a)))[2])
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(texts, train).collect()}
    # the whole table of counts on one side
    scratch = common.Scratch(spark, "brute")
    events = lm._counts(train, lm.TOKENIZER, scratch)[2].toPandas()
    whole = lm.Subwords(lm.TOKENIZER, lm.Spelling.of(*(events[x].to_numpy() for x in ("item", "part", "n"))))
    own, per, _, shares = whole.spelled([x.encode() for x in unseen])
    cls, ids, flat = sent["w"]
    first = lm.word_starts(lm.TOKENIZER)
    new = np.zeros(lm.CLASSES - 1, np.float32)
    new[cls[first]] = 1
    want = lm.log_probabilities(lm.unpack(flat), cls[own], lm.class_map(ids, first)[1][own], per, shares, new) / np.log(10)
    assert [got[i] for i in range(len(unseen))] == pytest.approx(want.tolist(), rel=1e-4)
    # no pair that is broadcast is rarer than one that is joined
    spelled, rare = lm.spelling_parts(kept["counts"].where("kind = 2").drop("kind"))
    n = sorted(events.n)
    assert 0 < len(spelled.key) <= 500 and rare.agg(F.max("n")).first()[0] <= n[-len(spelled.key)]
    # one row of numbers a text, whatever is joined
    assert kept["scored"].count() == len(unseen) and not [t for _, t in kept["scored"].dtypes if t.startswith("array")]


@pytest.mark.skipif(not os.path.exists(language_model.TOKENIZER), reason="no tokenizer")
def test_counting_holds_no_more_of_longer_batches(monkeypatch):
    """What a counting task holds is bounded, however much text a batch has, and its sums are those of all texts."""
    lm, rng = language_model, np.random.default_rng(6)
    texts = [" ".join([*(np.base_repr(x, 36) for x in rng.integers(0, 1 << 40, 300)), "the same words"]) for _ in range(1200)]
    batch = lambda n: pa.record_batch([pa.array(texts[:n]), pa.array([i % 7 != 2 for i in range(n)])], names=["text", "learn"])

    def sums(n):
        found = collections.Counter()
        for b in lm.counted(iter([batch(n)]), lm.TOKENIZER):
            for *key, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found[tuple(key)] += times
        return found

    def peak(n):
        b = batch(n)
        tracemalloc.start()
        try:
            assert sum(x.num_rows for x in lm.counted(iter([b]), lm.TOKENIZER)) > 100 * n
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    want = sums(400)
    for module in (common, lm):
        monkeypatch.setattr(module, "CHUNK_BYTES", 1 << 14)
    for name, bound in (("KNOWN", 2000), ("POOL", 20_000), ("HELD", 30_000), ("SENT", 5000)):
        monkeypatch.setattr(lm, name, bound)
    assert max(b.num_rows for b in lm.counted(iter([batch(400)]), lm.TOKENIZER)) <= 5000
    assert sums(400) == want
    assert peak(1200) < 1.3 * peak(400)


def test_pieces_of_batches_are_the_chunks_of_whole_ones(monkeypatch):
    for module in (common, language_model):
        monkeypatch.setattr(module, "CHUNK_BYTES", 20)
    rng = np.random.default_rng(7)
    texts = [None if n == 40 else "ä" * (n // 2) + "x" * (n % 2) for n in (*rng.integers(0, 41, 300).tolist(), 0, 19, 0, 20, 21, 0, 200, 0, 0)]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    assert [t for b in language_model.pieces(iter([batch])) for _, _, t in common.chunks(b)] == [t for _, _, t in common.chunks(batch)]
    assert [len(list(common.chunks(b))) for b in language_model.pieces(iter([batch, batch.slice(0, 0)]))] == [1] * len(list(common.chunks(batch)))


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Rounds end when all edges are those of stars; no round follows to see that nothing changes."""
    saved, save = [], common.Scratch.save
    monkeypatch.setattr(common.Scratch, "save", lambda self, df, name: saved.append(name) or save(self, df, name))
    scratch = common.Scratch(spark, "stars")
    for edges, rounds in (([(2, 1), (1, 3), (7, 5), (5, 5)], 0), ([(4, 3), (3, 2), (2, 1), (9, 8)], None), ([], 0)):
        saved.clear()
        got = dict(map(tuple, common.connected_components(spark.createDataFrame(edges, "u long, v long"), scratch).collect()))
        want = {2: 1, 1: 1, 3: 1, 7: 5, 5: 5} if rounds == 0 and edges else {4: 1, 3: 1, 2: 1, 1: 1, 9: 8, 8: 8} if edges else {}
        assert got == want
        if rounds is not None:
            assert saved.count("large") == rounds
