"""Cleaning and type derivation of raw string tables."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyward.functions import parsing


#: Columns that are targets unless the policy names others.
TARGETS = ("target", "label", "is_anomaly", "is_fraud")


@dataclass(frozen=True)
class Policy:
    """What is kept out of the detectors, the targets, and configured ratio pairs (28 at most)."""

    excluded: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    ratio_pairs: tuple[tuple[str, str], ...] = ()
    context: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if len(self.ratio_pairs) > 28:
            raise ValueError("at most 28 ratio pairs")
        if any(len(p) != 2 or not all(isinstance(c, str) for c in p) or p[0] == p[1] for p in self.ratio_pairs):
            raise ValueError("a ratio pair is two different column names")

    @classmethod
    def from_environment(cls, env: Mapping[str, str] = os.environ, prefix: str = "TALLYWARD_") -> Policy:
        """EXCLUDED_COLUMNS and TARGET_COLUMNS separated by commas, RATIO_PAIRS as a JSON list of pairs."""
        names = lambda key, default="": tuple(c.strip() for c in env.get(prefix + key, default).split(",") if c.strip())
        pairs = json.loads(env.get(prefix + "RATIO_PAIRS", "[]"))
        if not isinstance(pairs, list) or not all(isinstance(p, list) for p in pairs):
            raise ValueError("RATIO_PAIRS must be a list of pairs")
        return cls(excluded=names("EXCLUDED_COLUMNS"), targets=names("TARGET_COLUMNS", ",".join(TARGETS)), ratio_pairs=tuple(map(tuple, pairs)))

    def features(self, df: DataFrame) -> list[str]:
        """Columns of df that are neither excluded nor targets."""
        return [c for c in df.columns if c not in self.excluded and c not in self.targets]


def clean_headers(df: DataFrame) -> DataFrame:
    """Trimmed headers without byte-order marks; blank or equal ones are an error."""
    names = [c.lstrip("﻿").strip() for c in df.columns]
    if any(not n for n in names) or len(set(names)) < len(names):
        raise ValueError(f"headers must be distinct and not blank: {names}")
    return df.toDF(*names)


def cells(df: DataFrame, row_id: str) -> DataFrame:
    """Long form (row, column, raw), one pass."""
    cols = [c for c in df.columns if c != row_id]
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("raw")) for c in cols])).alias("x")
    return df.select(F.col(row_id).alias("row"), long).select("row", "x.column", "x.raw")


def prepared_cells(df: DataFrame, row_id: str, dates: tuple[str, ...] = (), numbers: tuple[str, ...] = ()) -> DataFrame:
    """Long form with the prepared value and, where a value was lost, the reason."""
    c = cells(df, row_id)
    t = F.trim("raw")
    reason = parsing.missing_reason(F.col("raw"))
    date, number = parsing.strict_date(t), parsing.parse_number(F.col("raw"))
    is_date, is_number = F.col("column").isin(list(dates) or [""]), F.col("column").isin(list(numbers) or [""])
    lost = F.when(is_date & date.isNull(), "invalid_date").when(is_number & number.isNull(), "not_a_number")
    value = F.when(reason.isNotNull(), None).when(is_date, date.cast("string")).when(is_number, number.cast("string")).otherwise(t)
    return c.withColumn("reason", F.coalesce(reason, lost)).withColumn("value", value)


def examples(issues: DataFrame, per_reason: int = 5, most: int = 40) -> DataFrame:
    """The first issues of each reason, in row order."""
    rank = F.row_number().over(W.partitionBy("reason").orderBy("row", "column"))
    return issues.withColumn("rank", rank).where(F.col("rank") <= per_reason).orderBy("reason", "row", "column").limit(most)


def cell_quality(prepared: DataFrame) -> DataFrame:
    """100 * (1 - unavailable cells / all cells), two decimals."""
    return prepared.agg(F.count("*").alias("cells"), F.count("reason").alias("unavailable")).select("cells", "unavailable", F.round(100 * (1 - F.col("unavailable") / F.col("cells")), 2).alias("quality"))


def inferred_types(prepared: DataFrame) -> DataFrame:
    """Per column: numeric or date where 75% of present values parse, identifier by name and 90% unique, else category."""
    present = prepared.where("raw is not null and trim(raw) <> ''")
    s = present.groupBy("column").agg(
        F.count("*").alias("present"), F.countDistinct("raw").alias("distinct_values"),
        F.count_if(parsing.parse_number(F.col("raw")).isNotNull()).alias("numbers"), F.count_if(parsing.is_date(F.col("raw"))).alias("dates"),
    )
    named = F.lower("column").rlike(r"(^|[_ ])(id|key|code|no|number)$|id$|key$")
    kind = F.when(named & (F.col("distinct_values") >= 0.9 * F.col("present")), "identifier").when(F.col("numbers") >= 0.75 * F.col("present"), "numeric").when(F.col("dates") >= 0.75 * F.col("present"), "date").otherwise("category")
    return s.withColumn("kind", kind)


def roles(types: DataFrame, policy: Policy, units: DataFrame | None = None) -> DataFrame:
    """Role per column: excluded, target, identifier, context, mixed_units, or the inferred type."""
    of = lambda names: F.col("column").isin(list(names) or [""])
    role = F.when(of(policy.excluded), "excluded").when(of(policy.targets), "target").when(F.col("kind") == "identifier", "identifier").when((F.col("kind") == "date") | of(policy.context), "context")
    if units is None:
        return types.withColumn("role", role.otherwise(F.col("kind")))
    mixed = units.where("n_units > 1").select("column", F.lit(True).alias("mixed"))
    return types.join(mixed, "column", "left").withColumn("role", role.when(F.col("mixed") & (F.col("kind") == "numeric"), "mixed_units").otherwise(F.col("kind"))).drop("mixed")


def unit_sets(prepared: DataFrame) -> DataFrame:
    return prepared.where("reason is null").groupBy("column").agg(F.sort_array(F.collect_set(parsing.unit_of(F.col("raw")))).alias("units")).withColumn("n_units", F.size("units").cast("long"))


def eligible(df: DataFrame, columns: list[str], least_observed: float = 0.8) -> DataFrame:
    """Per column: distinct values, share observed, and whether detectors and neighbours may use it."""
    aggs = [F.struct(F.countDistinct(c).alias("d"), (F.count(c) / F.count("*")).alias("o")).alias(c) for c in columns]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`.d").alias("distinct_values"), F.round(F.col(f"`{c}`.o"), 4).alias("observed")) for c in columns])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*").withColumns({"usable": F.col("distinct_values") > 1, "neighbours": (F.col("distinct_values") > 1) & (F.col("observed") >= least_observed)})
