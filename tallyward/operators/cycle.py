"""One cycle over all open periods: reconcile what is unmatched, then classify what stays open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.operators.matching import breaks, cascade
from tallyward.session import materialize


def run_cycle(records: DataFrame, matched: DataFrame, periods: DataFrame, period: Column, *, days: int, absolute: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches (period, id, rule), breaks (period, id, code), summary (period, n_open, n_matched, n_breaks, status)) of one cycle.

    records are those of matching.py; matched (id) holds what earlier cycles matched; periods (period, status) names the certified ones, which
    are left alone. All open periods run in one plan: the period is a part of the matching block, so records of
    different periods never meet. A period whose records are all matched is SKIPPED, the others are RECONCILED. Null periods take no part.
    """
    own = records.withColumn("_period", period).where("_period is not null")
    own = own.join(periods.where("status = 'CERTIFIED'").select(F.col("period").alias("_period")).distinct(), "_period", "left_anti")
    left = own.join(matched.select("id").distinct(), "id", "left_anti")
    # written once: matches, breaks and counts read it, instead of each finding the open records anew
    blocked = materialize(left.withColumn("account", F.concat_ws("|", "_period", F.col("account").cast("string"))))
    home = blocked.select("id", F.col("_period").alias("period"))
    found = materialize(cascade(blocked, days=days, absolute=absolute).join(home, "id").select("period", "id", "rule"))
    stay = materialize(breaks(blocked, found).join(home, "id").select("period", "id", "code"))
    parts = [own.select(F.col("_period").alias("period")).distinct().select("period", F.lit(None).cast("string").alias("of"), F.lit(0).cast("long").alias("n"))]
    parts += [df.groupBy("period").agg(F.count("*").alias("n")).select("period", F.lit(name).alias("of"), "n") for df, name in ((home, "n_open"), (found, "n_matched"), (stay, "n_breaks"))]
    counts = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    of = lambda name: F.coalesce(F.sum(F.when(F.col("of") == name, F.col("n"))), F.lit(0)).alias(name)
    summary = counts.groupBy("period").agg(of("n_open"), of("n_matched"), of("n_breaks"))
    return found, stay, summary.withColumn("status", F.when(F.col("n_open") == 0, "SKIPPED").otherwise("RECONCILED"))
