"""Bulk files as a stream: each micro-batch is scored on its own baseline and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyward.operators.detect import numeric_outliers


def score_files(spark: SparkSession, source: str, schema: str, row: str, column: str, sink: str, checkpoint: str, files_per_batch: int = 10) -> StreamingQuery:
    """Findings of all files that are at source now, batch by batch; a restart goes on where it stopped.

    A batch's rows go to a folder of their own, so a repeated batch overwrites itself.
    """

    def work(batch: DataFrame, number: int) -> None:
        numeric_outliers(batch, row, column).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_counts(events: DataFrame, key: str, ts: str, seconds: int = 60, late: str = "5 minutes") -> DataFrame:
    """Requests per key in fixed windows of a stream, with a watermark for late ones."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds").alias("w"), key).agg(F.count("*").alias("n"))
