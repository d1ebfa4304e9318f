"""Duplicates, frequencies and rarity. Counts come from aggregations, so a hot value costs a row per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_groups(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).where("n > 1")


def canonical_order(df: DataFrame, key: str) -> DataFrame:
    """df ordered by key; null or repeated keys are an error."""
    bad = df.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(1).count()
    if bad:
        raise ValueError(f"{key} has nulls or repeats")
    return df.orderBy(key)


def rare_categories(df: DataFrame, column: str, least: int = 10, most_unique: float = 0.8) -> DataFrame:
    """Values that occur once in a column of repeated values, with their score."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    facts = counts.agg(F.sum("n").alias("present"), F.count("*").alias("distinct_values"))
    fit = (F.col("present") >= least) & (F.col("distinct_values") / F.col("present") < most_unique)
    return counts.where("n = 1").crossJoin(F.broadcast(facts)).where(fit).select("value", F.greatest(F.lit(42.0), F.least(F.lit(58.0), 34 + 100 / F.col("n"))).alias("score"))


def rare_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that occur once while both values repeat, unless the columns are mostly such pairs."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    na = pairs.groupBy(a).agg(F.sum("n").alias("na"))
    nb = pairs.groupBy(b).agg(F.sum("n").alias("nb"))
    g = pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("n") == 1).alias("single"), F.sum("n").alias("paired"))
    noisy = (F.col("single") / F.col("pairs") > 0.45) & (F.col("pairs") > F.greatest(F.lit(10.0), 0.6 * F.col("paired")))
    out = pairs.where("n = 1").join(na, a).join(nb, b).crossJoin(F.broadcast(g))
    return out.where((F.col("na") > 1) & (F.col("nb") > 1) & (F.col("pairs") >= 3) & ~noisy).select(a, b, F.lit(54.0).alias("score"))


def with_duplicate_flag(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with whether another row has the same non-null value."""
    twice = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n")).where("_n > 1").select("_v")
    return df.join(twice.withColumn(name, F.lit(True)), F.col(column) == F.col("_v"), "left").drop("_v").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def rare_entities(df: DataFrame, entity: str, fraction: float = 0.05) -> DataFrame:
    """Entities with at most max(1, int(percentile of counts)) rows."""
    counts = df.groupBy(entity).agg(F.count("*").alias("n"))
    most = counts.agg(F.greatest(F.lit(1), F.floor(F.percentile("n", F.lit(fraction)))).alias("most"))
    return counts.crossJoin(F.broadcast(most)).where("n <= most").select(entity, "n")


def missing_columns(df: DataFrame, columns: list[str], least: float = 0.2) -> DataFrame:
    rates = df.agg(*[(F.count_if(F.col(c).isNull()) / F.count("*")).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("rate")) for c in columns])
    return rates.select(F.explode(rows).alias("r")).where(F.col("r.rate") >= least).select("r.column", F.round("r.rate", 4).alias("missing_rate"), F.round(F.least(F.lit(100.0), F.col("r.rate") * 120), 4).alias("score"))
