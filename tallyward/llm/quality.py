"""Quality classifier: naive Bayes support vectors.

Indicators of hashed word, shape and character n-grams are scaled by the log-count ratio of the two classes
and a linear hinge-loss model is fitted on them by dual coordinate descent; a logistic curve of the
margin, fitted on rows the model has not seen, gives the score. The classifier learns from a bounded
sample of the labelled rows, chosen by a hash of the id: class counts from COUNT_ROWS rows, the
hinge-loss model from FIT_ROWS of them, the curve from the CURVE-th part of those. So only
ids of bounded number are broadcast and no text travels but theirs. Every text is scored whole.

Null text counts as empty; an empty text has the score of the bias alone, like any other. Rows whose
label is null or that have no text row teach nothing; a doc_id with several labels has the lower.
Without labels of both classes every score is the share of label 1 (0.5 without labels). Repeated
rows are scored each. Empty tables give no rows. Extra columns are kept by score(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyward.llm.common import Scratch, Words, chunks, mix64, table, unused

#: Size of the feature space; the model is one number per feature whatever the corpus.
BITS = 18
SPACE = 1 << BITS
#: Labelled rows that class counts come from, and that the hinge-loss model is fitted on, at most.
COUNT_ROWS, FIT_ROWS = 60_000, 12_000
#: Every so manieth row of the fit shapes the logistic curve instead of the model; tasks that count.
CURVE, TASKS = 5, 8
EPOCHS, COST, SMOOTH = 8, 0.05, 1.0
THRESHOLD = 0.3

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")
_BASE = np.uint64(0xD6E8FEB86659FD93)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text: all of them in a row, and where each text's begin.

    Word uni- and bigrams, whether a word repeats the one before, shape uni- and bigrams (runs of
    one character class are one), and the last three bytes of words.
    """
    w = Words(texts, fold=False)
    b = w.buf
    n = len(w.hash)
    shape = _CLASS[b]
    head = np.ones(len(b), bool)
    head[1:] = shape[1:] != shape[:-1]
    head[w.start] = True
    # hash of the run heads of each word
    at = np.flatnonzero(head & ~np.isin(b, (32, 9, 10, 11, 12, 13)))
    of = np.searchsorted(w.start, at, "right") - 1
    first = np.searchsorted(of, np.arange(n))
    step = np.minimum(np.arange(len(at)) - first[of], 40) if n else np.zeros(0, np.int64)
    term = mix64(shape[at].astype(np.uint64) * np.uint64(64) + step.astype(np.uint64) + np.uint64(1))
    shapes = np.add.reduceat(term, first) if n else np.zeros(0, np.uint64)
    last = w.end - 1
    tail = b[last].astype(np.uint64)
    for k in (1, 2):
        tail = tail * np.uint64(257) + np.where(last - k >= w.start, b[np.maximum(last - k, 0)], 0).astype(np.uint64)
    doc = w.doc()
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    kinds = [
        (w.hash, doc), (w.hash[pair] * _BASE + w.hash[pair + 1], doc[pair]), ((w.hash[pair] == w.hash[pair + 1]).astype(np.uint64), doc[pair]),
        (shapes, doc), (shapes[pair] * _BASE + shapes[pair + 1], doc[pair]), (tail, doc),
    ]
    parts, docs = [], []
    for i, (h, d) in enumerate(kinds):
        f = mix64(h + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - BITS)
        parts.append(f)
        docs.append(d)
    key = np.unique((np.concatenate(docs).astype(np.uint64) << np.uint64(BITS)) | np.concatenate(parts))
    starts = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(BITS))
    return (key & np.uint64(SPACE - 1)).astype(np.int64), starts


def class_counts(rows: DataFrame) -> DataFrame:
    """(feature, pos, neg): rows of each label with the feature; rows has text and label. One row per feature and task is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SPACE + 1), np.int64)
        for b in batches:
            labels = np.array(b.column(1).to_pylist(), np.int64)
            for lo, hi, texts in chunks(b):
                f, starts = features(texts)
                y = np.repeat(labels[lo:hi], np.diff(starts))
                for c in (0, 1):
                    sums[c, :SPACE] += np.bincount(f[y == c], minlength=SPACE)
                    sums[c, SPACE] += (labels[lo:hi] == c).sum()
        used = np.flatnonzero(sums.any(0))
        yield pa.record_batch([pa.array(used), pa.array(sums[1, used]), pa.array(sums[0, used])], names=["feature", "pos", "neg"])

    return rows.select("text", "label").mapInArrow(work, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, epochs: int, seed: int = 1) -> np.ndarray:
    """Weights of min 0.5*|w|^2 + sum of c_i * hinge over features scale[f], with a bias in the last place.

    Both classes weigh the same in total.
    """
    share = np.array([(y < 0).mean(), (y > 0).mean()])
    upper = cost * np.where(y > 0, 0.5 / share[1], 0.5 / share[0])
    x = [np.append(f, SPACE) for f in rows]
    v = [scale[f] / max(1.0, np.sqrt(len(f))) for f in x]
    square = np.array([float(a @ a) for a in v])
    w, alpha = np.zeros(SPACE + 1), np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            if square[i] == 0:
                continue
            g = y[i] * float(w[x[i]] @ v[i]) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), upper[i])
            if new != alpha[i]:
                w[x[i]] += (new - alpha[i]) * y[i] * v[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4 * cost:
            break
    return w


def margins(f: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    n = np.diff(starts)
    sums = np.concatenate([[0.0], np.cumsum(weights[f])])
    return (sums[starts[1:]] - sums[starts[:-1]] + weights[SPACE]) / np.maximum(1.0, np.sqrt(n + 1))


def fit_logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's curve by Newton steps, with smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - t) * m).sum(), (p - t).sum()])
        q = p * (1 - p)
        h = np.array([[(q * m * m).sum(), (q * m).sum()], [(q * m).sum(), q.sum()]]) + 1e-6 * np.eye(2)
        step = np.clip(np.linalg.solve(h, g), -5, 5)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(a, 1e-6), b


def _chosen(y: DataFrame, bound: int, fit_rows: int) -> DataFrame:
    """(doc_id, label, fit) of at most bound rows, the first by a hash of the id, of them fit_rows to fit; few more than these are sorted."""
    cells = 1 << 20
    share = min(1.0, 1.2 * bound / max(1, y.count()) + 0.001)
    rank = F.xxhash64("doc_id", F.lit("quality"))
    few = y.where(F.pmod(rank, F.lit(cells)) < int(share * cells)) if share < 1 else y
    few = few.withColumn("place", F.pmod(rank, F.lit(cells))).orderBy("place", "doc_id").limit(bound)
    return few.select("doc_id", "label", (F.row_number().over(W.orderBy("place", "doc_id")) <= fit_rows).alias("fit"))


def train(docs: DataFrame, labels: DataFrame, *, count_rows: int = COUNT_ROWS, fit_rows: int = FIT_ROWS, scratch: Scratch | None = None) -> tuple[np.ndarray, float, float]:
    """Weights (ratios folded in, bias last) and the logistic curve. labels has doc_id and label (0 or 1)."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    y = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    # a bounded number of ids is broadcast, and so many texts travel at most
    chosen = scratch.save(_chosen(y, max(count_rows, fit_rows), fit_rows), "chosen")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(TASKS, "doc_id").dropDuplicates(["doc_id"])
    rows = scratch.save(rows.select("doc_id", "text", "label", "fit"), "labelled")
    counts = scratch.save(class_counts(rows), "counts")
    table_ = counts.toPandas()  # at most one row per feature: a fixed bound
    pos, neg = np.zeros(SPACE + 1), np.zeros(SPACE + 1)
    pos[table_.feature], neg[table_.feature] = table_.pos, table_.neg
    n_pos, n_neg = pos[SPACE], neg[SPACE]
    if not n_pos or not n_neg:
        share = (n_pos + 1) / (n_pos + n_neg + 2) if n_pos + n_neg else 0.5
        return np.zeros(SPACE + 1), 1.0, float(np.log(share / (1 - share)))
    p, q = (pos[:SPACE] + SMOOTH) / (n_pos + 2 * SMOOTH), (neg[:SPACE] + SMOOTH) / (n_neg + 2 * SMOOTH)
    ratio = np.append(np.log(p / q), 1.0)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ratio)

    # a bounded number of rows, so one task fits the model
    sample = rows.where("fit").select("doc_id", "text", "label").repartition(1).sortWithinPartitions("doc_id")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for b in batches:
            own = b.column(2).to_pylist()
            for lo, hi, texts in chunks(b):
                f, starts = features(texts)
                rows += [f[s:e].astype(np.int32) for s, e in zip(starts[:-1], starts[1:], strict=True)]
                labels += own[lo:hi]
        y = np.where(np.array(labels) > 0, 1.0, -1.0)
        if len(y) and 0 < (y > 0).sum() < len(y):
            apart = np.arange(len(y)) % CURVE == 0
            if not all(0 < (y[x] > 0).sum() < x.sum() for x in (apart, ~apart)):
                apart = np.zeros(len(y), bool)  # too few rows: model and curve share them
            w = dual_coordinate_descent([r for r, x in zip(rows, apart, strict=True) if not x], y[~apart], shared.value, COST, EPOCHS) * shared.value
            shape = apart if apart.any() else ~apart
            held = [r for r, x in zip(rows, shape, strict=True) if x]
            starts = np.concatenate([[0], np.cumsum([len(r) for r in held])])
            a, c = fit_logistic(margins(np.concatenate(held), starts, w), y[shape])
            yield pa.record_batch([pa.array([w.tobytes()]), pa.array([a]), pa.array([c])], names=["w", "a", "c"])

    found = scratch.save(sample.mapInArrow(fit, "w binary, a double, c double"), "model").first()
    if found is None:  # the bounded sample has one class only: the counts alone decide
        return np.append(ratio[:SPACE], 0.0), 1.0, float(np.log(n_pos / n_neg))
    return np.frombuffer(found["w"], np.float64), found["a"], found["c"]


def score(docs: DataFrame, model: tuple[np.ndarray, float, float], text_col: str = "text") -> DataFrame:
    """docs with the probability of label 1 in a last column, _score (or with more underscores, where that is taken)."""
    weights, a, c = model
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float64), a, c))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, a, c = shared.value
        for s in batches:
            out = np.zeros(len(s))
            b = pa.record_batch([pa.array(s, pa.string(), from_pandas=True)], names=["text"])
            for lo, hi, texts in chunks(b):
                out[lo:hi] = 1 / (1 + np.exp(-np.clip(a * margins(*features(texts), w) + c, -500, 500)))
            yield pd.Series(out)

    return docs.withColumn(unused(docs.columns, "_score"), scored(F.col(f"`{text_col}`")))


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(folds))


def op5_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(fold(F.col("doc_id"), 5) != 0)
    model = train(docs.where(fold(F.col("doc_id"), 5) != 0), labels)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_nbsvm_quality": op5_nbsvm_quality}
SQL: dict[str, str] = {}  # the fitted model is not expressible; tested by held-out accuracy
