"""Outlier and relationship detectors, and how their findings combine.

Baselines are one row of aggregates that a broadcast brings to every task; with batch keys the same
plans run per batch. Findings are rows (row, column, model, layer, score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyward.operators.neighbours import PACK, neighbours
from tallyward.operators.quantiles import attach, medians, quantiles
from tallyward.session import materialize


def severity(score: Column) -> Column:
    return F.when(score >= 85, "critical").when(score >= 65, "high").when(score >= 40, "medium").otherwise("low")


def confidence(score: Column) -> Column:
    return F.greatest(F.lit(0.55), F.least(F.lit(0.99), 0.5 + score / 200))


def _baseline(df: DataFrame, x: Column, keys: list[str]) -> DataFrame:
    """Median, MAD, mean, population deviation and nearest-rank quartiles per batch (all rows without keys); all but the quartiles rounded to 4 places."""
    v = df.select(*keys, x.alias("_x")).where("_x is not null")
    first = v.groupBy(*keys).agg(F.count("*").alias("_n"), F.round(F.avg("_x"), 4).alias("_mean"), F.round(F.stddev_pop("_x"), 4).alias("_std"))
    ranks = quantiles(v, {"_q": F.col("_x")}, [0.5, 0.25, 0.75], keys, nearest=(0.25, 0.75))
    ranks = ranks.select(*keys, F.col("_q_0").alias("_m"), F.round("_q_0", 4).alias("_med"), F.col("_q_1").alias("_q1"), F.col("_q_2").alias("_q3"))
    dev = medians(attach(v, ranks, keys), {"_d": F.abs(F.col("_x") - F.col("_m"))}, keys).select(*keys, F.round("_d", 4).alias("_mad"))
    if keys:
        return first.join(ranks.drop("_m"), keys).join(dev, keys)
    return first.crossJoin(ranks.drop("_m")).crossJoin(dev)  # one row each


def numeric_outliers(df: DataFrame, row: str, column: str, least: float = 40, keys: tuple[str, ...] = ()) -> DataFrame:
    """Score min(100, 18 * max(robust z, z, 3 if outside the 1.5 IQR fence))."""
    k = list(keys)
    x = F.col(column).cast("double")
    d = attach(df, _baseline(df, x, k), k)
    rz = F.when(F.col("_mad") > 0, F.abs(0.6745 * (x - F.col("_med")) / F.col("_mad"))).otherwise(0.0)
    z = F.when(F.col("_std") > 0, F.abs((x - F.col("_mean")) / F.col("_std"))).otherwise(0.0)
    iqr = F.col("_q3") - F.col("_q1")
    fence = F.when((iqr > 0) & ((x < F.col("_q1") - 1.5 * iqr) | (x > F.col("_q3") + 1.5 * iqr)), 3.0).otherwise(0.0)
    score = F.least(F.lit(100.0), 18 * F.greatest(rz, z, fence))
    out = d.where(x.isNotNull()).select(*k, F.col(row).alias("row"), F.lit(column).alias("column"), F.lit("numeric_outlier").alias("model"), F.lit("L2").alias("layer"), F.round(score, 4).alias("score"))
    return out.where(F.col("score") >= least)


def ratio_breaks(df: DataFrame, row: str, x: str, y: str) -> DataFrame:
    """Ratios y / x far from their median; needs 8 rows with x not zero."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != 0)).withColumn("_r", F.col(y) / F.col(x))
    facts = pairs.agg(F.count("*").alias("_n"), (F.max("_r") - F.min("_r")).alias("_range")).crossJoin(medians(pairs, {"_med": F.col("_r")}))  # one row each
    d = attach(pairs, facts).withColumn("_dev", F.abs(F.col("_r") - F.col("_med")))
    d = attach(d, medians(d, {"_mad": F.col("_dev")}))
    z = F.when(F.col("_mad") > 0, 0.6745 * F.col("_dev") / F.col("_mad")).otherwise(0.0)
    flat = (F.col("_mad") == 0) & (F.col("_range") > 0) & (F.col("_dev") > F.greatest(0.25 * F.abs("_med"), F.lit(1e-4)))
    out = d.where((F.col("_n") >= 8) & ((z >= 3) | flat))
    score = F.least(F.lit(100.0), F.greatest(18 * z, F.when(flat, 74.0).otherwise(0.0)))
    return out.select(F.col(row).alias("row"), F.lit(f"{y}/{x}").alias("column"), F.lit("ratio_break").alias("model"), F.lit("L2").alias("layer"), F.round(score, 4).alias("score"))


def correlation_residuals(df: DataFrame, row: str, x: str, y: str, least_r: float = 0.8) -> DataFrame:
    """Absolute residuals of the least-squares line far from their median, where |r| reaches least_r."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = pairs.agg(F.count("*").alias("_n"), F.corr(y, x).alias("_r"), F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_icept"), (F.max(y) - F.min(y)).alias("_range"))
    d = attach(pairs, fit).withColumn("_res", F.abs(F.col(y) - (F.col("_slope") * F.col(x) + F.col("_icept"))))
    d = attach(d, medians(d, {"_med": F.col("_res")})).withColumn("_dev", F.abs(F.col("_res") - F.col("_med")))
    d = attach(d, medians(d, {"_mad": F.col("_dev")}))
    z = F.when(F.col("_mad") > 0, 0.6745 * F.col("_dev") / F.col("_mad")).otherwise(0.0)
    flat = (F.col("_mad") == 0) & (F.col("_range") > 0) & (F.col("_res") > 0.2 * F.col("_range"))
    out = d.where((F.col("_n") >= 8) & (F.abs("_r") >= least_r) & ((z >= 3) | flat))
    score = F.least(F.lit(100.0), F.greatest(16 * z, F.when(flat, 72.0).otherwise(0.0)))
    return out.select(F.col(row).alias("row"), F.lit(f"{x}~{y}").alias("column"), F.lit("correlation_residual").alias("model"), F.lit("L2").alias("layer"), F.round(score, 4).alias("score"))


def knn_distances(df: DataFrame, row: str, columns: list[str], k: int = 5, block: int = PACK) -> DataFrame:
    """(row, distance): mean distance to the k nearest other rows, columns scaled by median and MAD. Exact.

    Rows with a null in a column take no part, nor do columns whose MAD is 0 or null.
    """
    complete = df.where(" and ".join(f"`{c}` is not null" for c in columns))
    d = attach(complete, medians(complete, {f"_m_{i}": F.col(c) for i, c in enumerate(columns)}))
    d = attach(d, medians(d, {f"_d_{i}": F.abs(F.col(c) - F.col(f"_m_{i}")) for i, c in enumerate(columns)}))
    axes = [F.when(F.col(f"_d_{i}") > 0, ((F.col(c) - F.col(f"_m_{i}")) / F.col(f"_d_{i}")).cast("double")).otherwise(0.0).alias(f"_s_{i}") for i, c in enumerate(columns)]
    scaled = d.select(F.col(row).alias("row"), *axes)
    near = neighbours(scaled, "row", [f"_s_{i}" for i in range(len(columns))], k, block)
    return near.groupBy("row").agg(F.avg("d").alias("distance"))


def knn_outliers(df: DataFrame, row: str, columns: list[str], k: int = 5) -> DataFrame:
    """Rows whose neighbour distance reaches the nearest-rank 95th percentile and a robust z of 2.5; needs 8 rows."""
    d = materialize(knn_distances(df, row, columns, k))
    high = quantiles(d, {"_p": F.col("distance")}, [0.95, 0.5], nearest=(0.95,)).select(F.col("n__p").alias("_n"), F.col("_p_0").alias("_p95"), F.col("_p_1").alias("_med"))
    d = attach(d, high)
    d = attach(d, medians(d, {"_mad": F.abs(F.col("distance") - F.col("_med"))}))
    z = F.when(F.col("_mad") > 0, 0.6745 * F.abs(F.col("distance") - F.col("_med")) / F.col("_mad")).otherwise(0.0)
    out = d.where((F.col("_n") >= 8) & (F.col("distance") >= F.col("_p95")) & (z >= 2.5))
    return out.select("row", F.lit("knn").alias("column"), F.lit("knn_distance").alias("model"), F.lit("L2").alias("layer"), F.round(F.least(F.lit(100.0), F.greatest(15 * z, F.lit(68.0))), 4).alias("score"))


def row_scores(findings: DataFrame) -> DataFrame:
    """Per row: the largest score of each detector family, and the largest of all."""
    per = findings.groupBy("row", "model").agg(F.max("score").alias("score"))
    return per.groupBy("row").agg(F.max("score").alias("score"), F.count("*").alias("families"), F.max_by("model", F.struct("score", "model")).alias("leading"))


def escalated(rows: DataFrame, least: float = 55) -> DataFrame:
    return rows.where(F.col("score") >= least).withColumn("layer", F.lit("L4"))


def ordered(findings: DataFrame, most: int = 300) -> DataFrame:
    """Findings by severity, layer (L4, L2, L1, L3), falling score, row."""
    s = F.element_at(F.create_map(*[F.lit(x) for p in (("critical", 0), ("high", 1), ("medium", 2), ("low", 3)) for x in p]), severity(F.col("score")))
    layer = F.element_at(F.create_map(*[F.lit(x) for p in (("L4", 0), ("L2", 1), ("L1", 2), ("L3", 3)) for x in p]), F.col("layer"))
    return findings.orderBy(s, layer, F.desc("score"), "row", "model").limit(most)


def decision(findings: DataFrame) -> DataFrame:
    """One label from the severity counts."""
    s = severity(F.col("score"))
    c = findings.agg(F.count_if(s == "critical").alias("critical"), F.count_if(s == "high").alias("high"), F.count_if(s == "medium").alias("medium"))
    label = F.when(F.col("critical") > 0, "INVESTIGATE").when(F.col("high") > 0, "REVIEW").when(F.col("medium") > 0, "MONITOR").otherwise("CLEAR")
    return c.withColumn("decision", label)


def numbered(findings: DataFrame, prefix: str = "A") -> DataFrame:
    """Finding ids in emission order: by stage (model), row, column."""
    from tallyward.operators.ordering import row_numbers

    return row_numbers(findings, [F.col("model"), F.col("row"), F.col("column")], "_n").withColumn("id", F.format_string(f"{prefix}-%04d", F.col("_n"))).drop("_n")


def reservoir(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """A uniform sample of k rows that depends on the key and seed alone."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(k)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
