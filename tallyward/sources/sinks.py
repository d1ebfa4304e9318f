"""Sinks: JSON lines, Parquet, CSV with money as text, evidence packs, exports with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_findings(findings: DataFrame, path: str) -> None:
    """JSON lines under Spark's commit protocol: readers see all of it or none."""
    findings.write.mode("overwrite").json(path)


def write_scores(scores: DataFrame, path: str, *partition: str) -> None:
    scores.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_sample(items: DataFrame, path: str, run_id: str) -> None:
    """The items of a sampling run, in folders of their run and stratum; writing a run again replaces that run alone."""
    rows = items.withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "stratum").parquet(path)


def save_analysis(result: DataFrame, path: str) -> None:
    """A small result (a row a group) as one JSON file; readers see the former one or the new one."""
    result.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, money: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> None:
    d = df.withColumns({c: F.col(c).cast("decimal(20,2)").cast("string") for c in money}) if money else df
    (d.orderBy(*order) if order else d).write.mode("overwrite").csv(path, header=True)


def evidence_pack(runs: DataFrame, items: DataFrame, run_id: str) -> DataFrame:
    """One JSON text per run with its items; a sample is bounded by design, so its rows fit one cell."""
    packed = items.groupBy(run_id).agg(F.sort_array(F.collect_list(F.struct(*[c for c in items.columns if c != run_id]))).alias("items"))
    joined = runs.join(packed, run_id, "left")
    return joined.select(run_id, F.to_json(F.struct(*[F.col(c) for c in joined.columns])).alias("pack"))


def manifest(df: DataFrame, key: str) -> DataFrame:
    """Rows and an order-independent SHA-256 digest of an export."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256)
    part = F.sum(F.conv(F.substring(row, 1, 14), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), part.cast("string")), 256).alias("digest"))
