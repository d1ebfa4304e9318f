"""Audit risk flags, ensemble scores and their aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyward.operators.frequency import rare_entities, with_duplicate_flag
from tallyward.operators.quantiles import attach, medians


def amount_flags(amount: Column) -> dict[str, Column]:
    no = F.lit(False)
    return {"flag_missing": amount.isNull(), "flag_negative": F.coalesce(amount < 0, no), "flag_zero": F.coalesce(amount == 0, no), "flag_round": F.coalesce((amount != 0) & (amount % 1000 == 0), no)}


def time_flags(ts: Column) -> dict[str, Column]:
    no = F.lit(False)
    return {"flag_unparseable": ts.isNull(), "flag_night": F.coalesce(F.hour(ts) <= 5, no), "flag_weekend": F.coalesce(F.dayofweek(ts).isin(1, 7), no)}


def robust_flag(df: DataFrame, amount: str, name: str = "flag_outlier", least: float = 3.5) -> DataFrame:
    """|x - median| / (1.4826 * MAD) > least; false where the MAD is 0."""
    d = attach(df, medians(df, {"_med": F.col(amount)}))
    mad = medians(d, {"_mad": F.abs(F.col(amount) - F.col("_med"))})
    z = F.abs(F.col(amount) - F.col("_med")) / (1.4826 * F.col("_mad"))
    return attach(d, mad).withColumn(name, F.coalesce((F.col("_mad") > 0) & (z > least), F.lit(False))).drop("_med", "_mad")


def add_flags(df: DataFrame, amount: str, ts: str | None = None, entity: str | None = None) -> DataFrame:
    """All flags of one population."""
    d = df.withColumns(amount_flags(F.col(amount)))
    if ts:
        d = d.withColumns(time_flags(F.col(ts)))
    d = with_duplicate_flag(robust_flag(d, amount), amount, "flag_duplicate_amount")
    if entity:
        rare = rare_entities(df, entity).select(F.col(entity).alias("_e"), F.lit(True).alias("flag_rare_entity"))
        d = d.join(rare, F.col(entity) == F.col("_e"), "left").drop("_e").withColumn("flag_rare_entity", F.coalesce("flag_rare_entity", F.lit(False)))
    return d


def missing_rate(columns: list[str]) -> Column:
    return sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) / len(columns)


def robust_z(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with _z: per column |x - median| / (1.4826 * MAD), all columns at once."""
    d = attach(df, medians(df, {f"_m{i}": F.col(c) for i, c in enumerate(columns)}))
    d = attach(d, medians(d, {f"_d{i}": F.abs(F.col(c) - F.col(f"_m{i}")) for i, c in enumerate(columns)}))
    z = [F.struct(F.coalesce(F.when(F.col(f"_d{i}") > 0, F.abs(F.col(c) - F.col(f"_m{i}")) / (1.4826 * F.col(f"_d{i}"))), F.lit(0.0)).alias("z"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)]
    return d.withColumn("_z", F.array(*z)).drop(*[f"_{k}{i}" for i in range(len(columns)) for k in "md"])


def max_robust_z(df: DataFrame, columns: list[str], name: str = "robust_z") -> DataFrame:
    return robust_z(df, columns).withColumn(name, F.array_max(F.transform("_z", lambda x: x["z"]))).drop("_z")


def attribution(df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """df with the k features of the largest robust z."""
    return robust_z(df, columns).withColumn("top", F.slice(F.array_sort("_z", lambda a, b: F.when(a["z"] > b["z"], -1).when(a["z"] < b["z"], 1).when(a["feature"] < b["feature"], -1).otherwise(1)), 1, k)).drop("_z")


def rank_percent(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the average-tie percent rank * 100, by ranks of distinct values: ties cost one row."""
    from tallyward.operators.ordering import prefix_sum

    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranks = prefix_sum(counts, [F.col("_v")], F.col("_c"), "_cum")
    n = counts.agg(F.sum("_c").alias("_n"))
    ranks = ranks.crossJoin(F.broadcast(n)).select("_v", (100 * (F.col("_cum") - (F.col("_c") - 1) / 2) / F.col("_n")).alias(name))
    return df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")


def weighted(components: dict[str, tuple[Column, float]]) -> Column:
    """A weighted mean in which null components give their weight to the others."""
    num = sum((F.when(c.isNotNull(), c * w).otherwise(0.0) for c, w in components.values()), F.lit(0.0))
    den = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in components.values()), F.lit(0.0))
    return F.when(den > 0, num / den)


#: Weights of statistics, rules, model, history, and data quality; and without labels.
WEIGHTS = {"statistics": 0.25, "rules": 0.20, "model": 0.35, "history": 0.15, "quality": 0.05}
LABEL_FREE = {"statistics": 0.45, "rules": 0.35, "model": 0.0, "history": 0.15, "quality": 0.05}


def aggregate_risk(df: DataFrame, columns: dict[str, str], weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """df with risk (0 to 100). A component on a 0-to-1 scale or outside 0 to 100 is an error."""
    facts = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(k) for k, c in columns.items()]).first()
    for k in columns:
        lo, hi = facts[k]["lo"], facts[k]["hi"]
        if hi is not None and (lo < 0 or hi > 100 or 0 < hi <= 1):
            raise ValueError(f"{k} must be on a scale of 0 to 100, not {lo} to {hi}")
    return df.withColumn("risk", weighted({k: (F.col(c), weights[k]) for k, c in columns.items()}))


# --- isolation forest and local outlier factor -------------------------------------------------------


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    if depth == 0 or len(x) <= 1 or (x.max(0) == x.min(0)).all():
        return (len(x),)
    cols = np.flatnonzero(x.max(0) > x.min(0))
    c = int(rng.choice(cols))
    cut = float(rng.uniform(x[:, c].min(), x[:, c].max()))
    left = x[:, c] < cut
    return (c, cut, _tree(x[left], rng, depth - 1), _tree(x[~left], rng, depth - 1))


def _expected(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _path(tree: tuple, x: np.ndarray, at: np.ndarray, depth: int, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[at] += depth + _expected(tree[0])
        return
    left = x[at, tree[0]] < tree[1]
    _path(tree[2], x, at[left], depth + 1, out)
    _path(tree[3], x, at[~left], depth + 1, out)


def isolation_scores(df: DataFrame, columns: list[str], key: str, trees: int = 100, sample: int = 256, seed: int = 7) -> DataFrame:
    """df with iso_score. The trees are fitted on a bounded sample (trees * sample rows at most) chosen by hash."""
    pool = df.select(*columns).na.drop().orderBy(F.xxhash64(F.lit(seed), *columns)).limit(trees * sample).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    size = min(sample, len(pool))
    forest = [_tree(pool[rng.choice(len(pool), size, replace=False)], rng, int(np.ceil(np.log2(max(2, size))))) for _ in range(trees)] if size >= 2 else []
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            x = np.stack([c.to_numpy(float) for c in cols], 1)
            total = np.zeros(len(x))
            for t in shared.value:
                _path(t, x, np.arange(len(x)), 0, total)
            yield pd.Series(2 ** (-total / max(1, len(shared.value)) / max(1e-9, _expected(size))))

    return df.withColumn("iso_score", score(*[F.col(c).cast("double") for c in columns]))


def in_subsample(key: Column, population: int, most: int, seed: int = 11) -> Column:
    """Whether a row is in the seeded subset that a population above `most` rows is scored on."""
    if population <= most:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(1_000_000 * most / population)


def latest_rank(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
