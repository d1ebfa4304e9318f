"""Profiles, histograms and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyward.operators.quantiles import attach, distinct_counts, medians, quantiles


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_profile(df: DataFrame, numeric: list[str], other: list[str] = ()) -> DataFrame:
    """One row per column: presence, distinct values, and for numbers min, max, mean, median, population std and MAD.

    The number of passes does not depend on the number of columns: sums, distinct values, medians, then deviations from them.
    """
    cols = [*numeric, *other]
    aggs = [F.count("*").alias("n")] + [F.count(c).alias(f"{c}|present") for c in cols]
    for c in numeric:
        x = F.col(c).cast("double")
        aggs += [f(x).alias(f"{c}|{k}") for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))]
    wide = df.agg(*aggs).crossJoin(_distinct_wide(df, cols))
    if numeric:
        # one row each
        meds = medians(df, {f"_med_{i}": F.col(c) for i, c in enumerate(numeric)})
        mads = medians(attach(df, meds), {f"{c}|mad": F.abs(F.col(c).cast("double") - F.col(f"_med_{i}")) for i, c in enumerate(numeric)})
        wide = wide.crossJoin(meds.withColumnsRenamed({f"_med_{i}": f"{c}|median" for i, c in enumerate(numeric)})).crossJoin(mads)

    def of(c: str) -> Column:
        pick = lambda k: F.round(F.col(f"`{c}|{k}`"), 4) if c in numeric else F.lit(None).cast("double")
        present = F.col(f"`{c}|present`")
        return F.struct(
            F.lit(c).alias("column"), present.alias("present"), (F.col("n") - present).alias("missing"), F.round((F.col("n") - present) / F.col("n"), 4).alias("missing_rate"),
            F.col(f"`{c}|distinct`").alias("distinct_values"), F.round(F.col(f"`{c}|distinct`") / F.when(present > 0, present), 4).alias("unique_rate"),
            *[pick(k).alias(f"{k}_value") for k in ("min", "max", "mean", "median", "std", "mad")],
        )

    return wide.select(F.explode(F.array(*[of(c) for c in cols])).alias("r")).select("r.*")


def _distinct_wide(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of distinct values of each column, as column|distinct."""
    long = distinct_counts(df, columns)
    return long.agg(*[F.coalesce(F.max(F.when(F.col("column") == c, F.col("distinct_values"))), F.lit(0)).alias(f"{c}|distinct") for c in columns])


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k most frequent values of each column, ties by value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("r")).select("r.*").where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def histogram(df: DataFrame, column: str, bins: int = 8) -> DataFrame:
    """Equal-width bins, the last one closed; a constant column has one bin; empty bins count 0."""
    v = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    span = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    bins_of = F.when(F.col("hi") > F.col("lo"), F.lit(bins)).otherwise(F.lit(1))
    spine = span.where("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0), bins_of - 1)).alias("bin"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)))).otherwise(0)
    counts = v.crossJoin(F.broadcast(span)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return spine.join(counts, "bin", "left").select(F.col("bin").cast("long").alias("bin"), F.round(F.col("lo") + F.col("bin") * width, 4).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlations of complete pairs; null below 3 pairs or for a constant column. One pass for all pairs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    aggs = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
        aggs.append(F.struct(F.count(F.when(both, 1)).alias("pairs"), F.when((F.count(x) >= 3) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.round(F.corr(x, y), 4)).alias("r")).alias(f"{a}|{b}"))
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{a}|{b}`.pairs").alias("pairs"), F.col(f"`{a}|{b}`.r").alias("r")) for a, b in pairs])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def box_stats(df: DataFrame, column: str) -> DataFrame:
    """Quartiles (nearest rank), fences at 1.5 IQR, whiskers inside the fences, and outliers."""
    v = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    q = quantiles(v, {"q": F.col("v")}, [0.25, 0.75], nearest=(0.25, 0.75)).select(F.col("q_0").alias("q1"), F.col("q_1").alias("q3"))
    q = q.withColumns({"low": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "high": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    d = v.crossJoin(F.broadcast(q))
    inside = F.col("v").between(F.col("low"), F.col("high"))
    return d.groupBy("q1", "q3", "low", "high").agg(F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"), F.count_if(~inside).alias("outliers"), F.count("*").alias("n"))


def schema_profile(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Audit profile: nulls, distinct values, min, max, mean, median, p95 (linear), negative and zero counts."""
    aggs = [F.count("*").alias("n")]
    for c in numeric:
        x = F.col(c).cast("double")
        kinds = (("nulls", F.count_if(x.isNull())), ("min_value", F.min(x)), ("max_value", F.max(x)), ("mean_value", F.round(F.avg(x), 4)), ("negative", F.count_if(x < 0)), ("zero", F.count_if(x == 0)))
        aggs += [f.alias(f"{c}|{k}") for k, f in kinds]
    ranks = quantiles(df, {c: F.col(c) for c in numeric}, [0.5, 0.95])
    wide = df.agg(*aggs).crossJoin(_distinct_wide(df, numeric)).crossJoin(ranks)  # one row each
    order = ("nulls", "distinct", "min_value", "max_value", "mean_value", "median", "p95", "negative", "zero")
    name = lambda c, k: f"`{c}_0`" if k == "median" else f"`{c}_1`" if k == "p95" else f"`{c}|{k}`"
    shown = {"distinct": "distinct_values", "median": "median_value"}
    of = lambda c, k: (F.round(F.col(name(c, k)), 4) if k in ("median", "p95") else F.col(name(c, k))).alias(shown.get(k, k))
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n"), *[of(c, k) for k in order]) for c in numeric])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def running_stats(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Mergeable statistics: count, nulls, min, max, sum, negatives, zeros."""
    x = F.col(column)
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.count_if(x.isNull()).alias("nulls"), F.min(x).alias("min_value"), F.max(x).alias("max_value"), F.round(F.sum(x.cast("decimal(38,4)")), 2).cast("double").alias("total"), F.count_if(x < 0).alias("negative"), F.count_if(x == 0).alias("zero"))


def label_state(df: DataFrame, label: str) -> DataFrame:
    """GOOD_DATA: 200 rows or more with two classes of 30 or more; PARTIAL_DATA: fewer; NO_LABELS."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    s = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("classes"), F.min("n").alias("smallest"), F.max("n").alias("largest"))
    state = F.when(F.col("n_rows") == 0, "NO_LABELS").when((F.col("n_rows") >= 200) & (F.col("classes") == 2) & (F.col("smallest") >= 30), "GOOD_DATA").otherwise("PARTIAL_DATA")
    return s.select("n_rows", "classes", state.alias("state"), F.round(F.col("largest") / F.col("smallest"), 4).alias("imbalance"))


def control_totals(df: DataFrame, currency: str, direction: Column, amount: Column) -> DataFrame:
    """Per currency: rows, debit and credit sums as decimals."""
    a = amount.cast("decimal(28,8)")
    dr, cr = F.sum(F.when(direction == "DR", a)), F.sum(F.when(direction == "CR", a))
    zero = F.lit(0).cast("decimal(38,8)")
    return df.groupBy(currency).agg(F.count("*").alias("n_rows"), F.coalesce(dr, zero).alias("debits"), F.coalesce(cr, zero).alias("credits"))


def bands(score: Column) -> Column:
    """Risk bands with inclusive integer edges."""
    return F.when(score < 35, "0-34").when(score < 55, "35-54").when(score < 65, "55-64").when(score < 85, "65-84").otherwise("85-100")


def ageing_bucket(days: Column) -> Column:
    return F.when(days <= 30, "0-30").when(days <= 60, "31-60").when(days <= 90, "61-90").otherwise("90+")
