"""Scheduled cycles as a stream of ticks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyward.operators.cycle import run_cycle


def scheduled_cycles(ticks: DataFrame, records: Callable[[], DataFrame], periods: Callable[[], DataFrame], period: Column, out: str, checkpoint: str, *, days: int, absolute: float, every: str | None = None) -> StreamingQuery:
    """A cycle for each batch of ticks with rows: matches, breaks and summary go to folders of out, a part cycle=N for each.

    records and periods are read anew by each cycle. A cycle sees the matches of cycles before it only and overwrites its own parts,
    so a batch that is repeated after a failure, or a source that is replayed from the start, gives the same
    cycles. every is the trigger's interval; without it all ticks that are there run, and the stream ends.
    """
    spark = ticks.sparkSession
    # an empty part, so that the first cycle reads a table
    spark.createDataFrame([], "period string, id string, rule string").write.mode("overwrite").parquet(f"{out}/matches/cycle=-1")

    def work(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        before = spark.read.schema("period string, id string, rule string, cycle long").parquet(f"{out}/matches").where(F.col("cycle") < number)
        found, stay, summary = run_cycle(records(), before, periods(), period, days=days, absolute=absolute)
        for name, df in (("matches", found), ("breaks", stay), ("summary", summary)):
            df.write.mode("overwrite").parquet(f"{out}/{name}/cycle={number}")

    writer = ticks.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
