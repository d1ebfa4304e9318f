"""Statistical audit sampling, projection and ranking quality."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyward.operators.ordering import prefix_sum, row_numbers

# --- scalars ------------------------------------------------------------------------------------------

#: Expansion factors by confidence.
EXPANSION = ((0.50, 1.00), (0.75, 1.25), (0.80, 1.30), (0.85, 1.40), (0.90, 1.50), (0.95, 1.60), (0.99, 1.90))
PROJECTABLE = ("certainty", "monetary_unit")


def reliability_factors(k: np.ndarray, confidence: float) -> np.ndarray:
    """The Poisson means at which k or fewer events have probability 1 - confidence, for any k: Newton steps on the logarithm of that probability."""
    k = np.asarray(k, float)
    if not len(k):
        return k
    fact = np.array([math.lgamma(x + 1) for x in k])
    mean = k + 1
    for _ in range(100):
        # the probability over that of exactly k, from k events downwards
        total, term, i = np.ones_like(k), np.ones_like(k), 0
        while True:
            term = term * np.maximum(k - i, 0) / mean
            total += term
            i += 1
            if ((term <= 1e-17 * total) & (k - i <= mean)).all():
                break
        step = total * (k * np.log(mean) - mean - fact + np.log(total) - math.log(1 - confidence))
        new = np.maximum(mean + step, mean / 10)
        done = np.abs(new - mean) <= 1e-14 * mean
        mean = new
        if done.all():
            break
    return mean


def reliability_factor(k: int, confidence: float) -> float:
    return float(reliability_factors(np.array([k]), confidence)[0])


def reliability_factor_column(k: Column, confidence: Column) -> Column:
    """reliability_factors() of columns, in Arrow batches: one solve for each confidence of a batch."""

    @F.pandas_udf("double")
    def solved(k: pd.Series, confidence: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=k.index)
        for c, own in k.dropna().groupby(confidence):
            out[own.index] = reliability_factors(own.to_numpy(), float(c))
        return out

    return solved(k, confidence)


def expansion_factor(confidence: float) -> float:
    """Linear between the points of the table, constant beyond them."""
    return float(np.interp(confidence, [c for c, _ in EXPANSION], [f for _, f in EXPANSION]))


def expansion_factor_column(confidence: Column) -> Column:
    """expansion_factor() of a column of confidences."""
    out = F.when(confidence <= EXPANSION[0][0], F.lit(EXPANSION[0][1]))
    for (c, f), (c2, f2) in zip(EXPANSION, EXPANSION[1:], strict=False):
        out = out.when(confidence <= c2, f + (f2 - f) * (confidence - c) / (c2 - c))
    return F.when(confidence.isNotNull(), out.otherwise(F.lit(EXPANSION[-1][1])))


def projectable(basis: Column) -> Column:
    """Whether errors found under a selection basis may be projected."""
    return basis.isin(*PROJECTABLE)


def mus_sample_size(book: float, tolerable: float, expected: float, confidence: float, least: int = 1, most: int | None = None) -> tuple[int, float]:
    """Sample size and interval of monetary-unit sampling."""
    room = tolerable - expected * expansion_factor(confidence)
    if room <= 0:
        raise ValueError("expected misstatement leaves no room below the tolerable one")
    n = max(least, math.ceil(book * reliability_factor(0, confidence) / room))
    n = min(n, most) if most else n
    return n, book / n


def attribute_sample_size(tolerable_rate: float, expected_rate: float, confidence: float, population: int) -> int:
    """Fixed point of n = RF(expected errors in n) / tolerable rate, at most the population."""
    n = math.ceil(reliability_factor(0, confidence) / tolerable_rate)
    for _ in range(200):
        new = min(population, math.ceil(reliability_factor(math.ceil(n * expected_rate), confidence) / tolerable_rate))
        if new == n:
            break
        n = new
    return min(n, population)


def basic_precision(interval: float, confidence: float) -> float:
    return reliability_factor(0, confidence) * interval


def derive_seed(**parts) -> int:
    raw = json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big") >> 1


# --- selection ----------------------------------------------------------------------------------------


def sign_stratum(amount: Column) -> Column:
    """positive, negative or zero on the amount in cents; null amounts fall in none."""
    cents = F.round(amount, 2)
    return F.when(cents > 0, "positive").when(cents < 0, "negative").when(cents == 0, "zero")


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def select_monetary_unit(df: DataFrame, key: str, amount: str, interval: int, start: int, size: int) -> DataFrame:
    """Systematic selection proportional to size, amounts in cents: an item is hit once per target start + k * interval.

    With inclusive prefix sums C in key order, g(x) = targets at or below x, and hits = g(C) - g(C - amount).
    """
    positive = df.where(cents(F.col(amount)) > 0).withColumn("_c", cents(F.col(amount)))
    d = prefix_sum(positive, [F.col(key)], F.col("_c"), "_cum")
    g = lambda x: F.least(F.lit(size), F.greatest(F.lit(0), F.floor((x - start) / interval) + 1))
    d = d.withColumn("hits", (g(F.col("_cum")) - g(F.col("_cum") - F.col("_c"))).cast("long"))
    basis = F.when(F.col("_c") >= interval, "certainty").otherwise("monetary_unit")
    return d.where("hits > 0").select(*df.columns, "hits", basis.alias("selection_basis"), F.round(F.least(F.col("_c") / interval, F.lit(1.0)), 6).alias("inclusion_probability"))


def select_random(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A simple random sample that depends on key and seed alone."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def select_high_risk(df: DataFrame, key: str, risk: str, *, threshold: float | None = None, top: int | None = None) -> DataFrame:
    """Items at or above a threshold, or the top ones by falling risk and rising key."""
    return df.where(F.col(risk) >= threshold) if threshold is not None else df.orderBy(F.desc(risk), key).limit(top)


def build_sample(df: DataFrame, key: str, amount: str, risk: str, *, interval: int, start: int, size: int, threshold: float, n_random: int, seed: int) -> DataFrame:
    """(key, stratum, selection_basis): high risk; monetary unit; random from the rest; all negatives."""
    mus = select_monetary_unit(df, key, amount, interval, start, size).select(key, F.lit("monetary_unit").alias("stratum"), "selection_basis")
    high = select_high_risk(df, key, risk, threshold=threshold).select(key)
    negative = df.where(sign_stratum(F.col(amount)) == "negative").select(key)
    high = high.join(mus.select(key), key, "left_anti").join(negative, key, "left_anti")
    rest = df.where(sign_stratum(F.col(amount)) == "positive").join(mus.select(key), key, "left_anti").join(high, key, "left_anti")
    named = lambda d, s: d.select(key, F.lit(s).alias("stratum"), F.lit(s).alias("selection_basis"))
    return mus.unionByName(named(high, "high_risk")).unionByName(named(select_random(rest, key, n_random, seed), "random")).unionByName(named(negative, "negative"))


def dataset_fingerprint(df: DataFrame, key: str, amount: str) -> DataFrame:
    """An order-independent fingerprint: count and sums of per-row hashes, hashed."""
    row = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.format_string("%.2f", F.col(amount).cast("double"))), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, i, 12), 16, 10).cast("decimal(38,0)"))
    s = df.agg(F.count("*").alias("n"), *[part(1 + 12 * i).alias(f"s{i}") for i in range(5)])
    return s.select(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in s.columns]), 256).alias("fingerprint"))


# --- projection ---------------------------------------------------------------------------------------


def tainting(book: Column, audit: Column) -> Column:
    return F.when(book == 0, 0.0).otherwise((book - audit) / book)


def project_misstatement(tested: DataFrame, *, interval: float, confidence: float, tolerable: float) -> DataFrame:
    """Projection of tested items (book, audit, selection_basis): known and projected misstatement, allowance, limit, conclusion."""
    t = tested.withColumn("taint", tainting(F.col("book"), F.col("audit")))
    certain = F.col("selection_basis") == "certainty"
    t = t.withColumn("over", (F.col("taint") > 0) & F.col("selection_basis").isin(*PROJECTABLE))
    ranked = t.where(F.col("over") & ~certain).withColumn("capped", F.least("taint", F.lit(1.0)))
    ranked = row_numbers(ranked, [F.desc("capped"), F.col("book"), F.col("audit")], "rank")

    @F.pandas_udf("double")
    def increment(rank: pd.Series) -> pd.Series:
        k = rank.to_numpy()
        return pd.Series(np.maximum(reliability_factors(k, confidence) - reliability_factors(k - 1, confidence) - 1, 0.0))

    extra = ranked.withColumn("extra", increment("rank")).agg(F.coalesce(F.sum("capped"), F.lit(0.0)).alias("taints"), F.coalesce(F.sum(F.col("extra") * F.col("capped")), F.lit(0.0)).alias("increments"))
    known = t.agg(
        F.coalesce(F.sum(F.when(certain & F.col("over"), F.col("book") - F.col("audit"))), F.lit(0.0)).alias("known"),
        F.coalesce(F.sum(F.when(F.col("taint") < 0, F.col("audit") - F.col("book"))), F.lit(0.0)).alias("understated"),
        F.count("*").alias("tested"),
    )
    basic = basic_precision(interval, confidence)
    p = known.crossJoin(extra).withColumns({"projected": F.col("known") + F.col("taints") * interval, "allowance": F.lit(basic) + F.col("increments") * interval})
    limit = F.col("projected") + F.col("allowance")
    conclusion = F.when(limit <= tolerable, "ACCEPT").when(F.col("projected") > tolerable, "REJECT").otherwise("INCONCLUSIVE")
    return p.select("tested", F.round("known", 2).alias("known"), F.round("projected", 2).alias("projected"), F.round("allowance", 2).alias("allowance"), F.round(limit, 2).alias("upper_limit"), F.round("understated", 2).alias("understated"), conclusion.alias("conclusion"))


# --- ranking quality ----------------------------------------------------------------------------------


def precision_at(scored: DataFrame, key: str, score: str, label: str, ks: list[int]) -> DataFrame:
    """Precision, recall and lift among the k highest scores, ties by key."""
    top = scored.orderBy(F.desc(score), key).limit(max(ks)).select(F.row_number().over(W.orderBy(F.desc(score), key)).alias("rank"), F.col(label).alias("y"))  # at most max(ks) rows
    base = scored.agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    want = scored.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    hits = F.broadcast(want).join(top, F.col("rank") <= F.col("k")).groupBy("k").agg(F.sum("y").alias("hits"), F.count("*").alias("seen"))
    p = F.col("hits") / F.col("seen")
    return hits.crossJoin(base).select(F.col("k").cast("long").alias("k"), F.round(p, 6).alias("precision"), F.round(F.col("hits") / F.col("pos"), 6).alias("recall"), F.round(p / (F.col("pos") / F.col("n")), 6).alias("lift"))


def bootstrap_lift(scored: DataFrame, score: str, label: str, k: int, rounds: int = 2000, seed: int = 7, least: int = 30) -> DataFrame:
    """Percentile interval of the lift at k, and whether the ranking beats a random one.

    Only the score order and labels matter, so each replicate draws from counts by distinct score;
    replicates are spread over tasks and depend on their number alone. The scores below those that a
    replicate's top k can reach (twice k and 1,000 rows, at least) count together.
    """
    groups = scored.groupBy(score).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("pos")).orderBy(F.desc(score)).limit(max(100_000, 2 * k + 1000)).toPandas()
    n, pos = groups["n"].to_numpy(), groups["pos"].to_numpy()
    every = scored.agg(F.count("*").alias("n"), F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("pos")).first()
    if every["n"] > n.sum():
        n, pos = np.append(n, every["n"] - n.sum()), np.append(pos, every["pos"] - pos.sum())
    shared = scored.sparkSession.sparkContext.broadcast((n, pos))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, pos = shared.value
        cells = np.stack([pos, n - pos], 1).ravel().astype(float)
        for b in batches:
            out = []
            for i in b["id"]:
                rng = np.random.default_rng([seed, int(i)])
                c = rng.multinomial(int(cells.sum()), cells / cells.sum()).reshape(-1, 2)
                before = np.concatenate([[0], np.cumsum(c.sum(1))[:-1]])
                take = np.clip(k - before, 0, c.sum(1))
                hit = (c[:, 0] * np.where(c.sum(1) > 0, take / np.maximum(1, c.sum(1)), 0)).sum()
                rate = c[:, 0].sum() / c.sum()
                out.append(hit / k / rate if rate else np.nan)
            yield pd.DataFrame({"lift": out})

    lifts = scored.sparkSession.range(rounds).mapInPandas(draw, "lift double").where("not isnan(lift)")
    low, high = F.percentile("lift", F.lit(0.025)), F.percentile("lift", F.lit(0.975))
    verdict = F.when(F.lit(int(pos.sum()) < least), "INSUFFICIENT").when(low > 1, "BEATS_RANDOM").otherwise("NOT_DISTINGUISHABLE")
    return lifts.agg(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.count("*").alias("rounds"), verdict.alias("verdict"))
