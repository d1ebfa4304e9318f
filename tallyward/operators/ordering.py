"""Order statistics and prefix sums without a single-partition sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyward.session import materialize


def prefix_sum(df: DataFrame, order: list[Column], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """df with the inclusive running sum of value in the given total order.

    Rows are range-partitioned and summed within each partition; the partitions' totals, one row
    each, give the offsets. The partitioned rows are written once, so that both uses see the same cut.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = materialize(df.withColumn("__ps_v", value).repartitionByRange(n, *order).withColumn("__ps_part", F.spark_partition_id()))
    totals = tagged.groupBy("__ps_part").agg(F.sum("__ps_v").alias("__ps_sum"))
    before = F.coalesce(F.sum("__ps_sum").over(W.orderBy("__ps_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.withColumn("__ps_before", before).select("__ps_part", "__ps_before")
    within = F.sum("__ps_v").over(W.partitionBy("__ps_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return tagged.withColumn("__ps_within", within).join(F.broadcast(offsets), "__ps_part").withColumn(name, F.col("__ps_within") + F.col("__ps_before")).drop("__ps_v", "__ps_part", "__ps_within", "__ps_before")


def row_numbers(df: DataFrame, order: list[Column], name: str = "row_id") -> DataFrame:
    """df numbered from 1 in a total order."""
    return prefix_sum(df, order, F.lit(1).cast("long"), name)


def with_previous(df: DataFrame, keys: list[str], seq: str, columns: dict[str, str], partitions: int | None = None) -> DataFrame:
    """df with columns of the row before it in its key, by seq (name of the new column: column of the row before); null for the first.

    Rows are range-partitioned by key and seq, so one long key spreads over many tasks; the last row of each
    partition, one row each, is what the next one's first row looks back to. Rows of a key have distinct seq.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(k) for k in [*keys, seq]]
    tagged = materialize(df.repartitionByRange(n, *order).withColumn("__pv_part", F.spark_partition_id()))
    row = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns.values())])
    last = tagged.groupBy("__pv_part").agg(F.max_by(row, F.struct(*order)).alias("__pv_last"))
    # a row per partition; a partition may be empty, so its neighbour is the one before it that is not
    last = last.withColumn("__pv_border", F.lag("__pv_last").over(W.orderBy("__pv_part"))).drop("__pv_last")
    own = F.lag(row).over(W.partitionBy("__pv_part").orderBy(*order))
    looked = tagged.withColumn("__pv_own", own).join(F.broadcast(last), "__pv_part").withColumn("__pv_row", F.coalesce("__pv_own", "__pv_border"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col("__pv_row")[f"k{i}"].eqNullSafe(F.col(k))
    out = looked.withColumns({name: F.when(F.col("__pv_row").isNotNull() & same, F.col("__pv_row")[f"c{i}"]) for i, name in enumerate(columns)})
    return out.drop("__pv_part", "__pv_own", "__pv_border", "__pv_row")


def thin(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """Every k-th row in order, k the least stride that leaves at most about `most` rows."""
    numbered = row_numbers(df, order, "_rn")
    n = numbered.count()
    stride = max(1, -(-n // most))
    return numbered.where((F.col("_rn") - 1) % stride == 0).drop("_rn")


def nearest_rank(values: DataFrame, column: str, fractions: list[float]) -> DataFrame:
    """Values at position round((n - 1) * f), half to even, of the sorted non-null values."""
    v = values.where(F.col(column).isNotNull()).select(column)
    numbered = row_numbers(v, [F.col(column)], "_rn")
    n = v.agg(F.count("*").alias("_n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), (F.bround((F.col("_n") - 1) * F.lit(f)) + 1).cast("long").alias("_rn")) for f in fractions]))
    picks = n.select(wanted.alias("w")).select("w.fraction", "w._rn")
    return numbered.join(F.broadcast(picks), "_rn").select("fraction", F.col(column).alias("value"))
