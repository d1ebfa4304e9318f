"""Manifests of domain packs: their required fields and the engine versions they fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions import normalize

ENGINE_VERSION = "1.4.0"
_SCHEMA = "pack struct<id: string, version: string, engine_compat: string>, break_types array<struct<code: string>>, dimensions array<struct<key: string>>"
CORE = "core"


def manifest_problem(raw: Column, engine: str = ENGINE_VERSION) -> Column:
    """INVALID for a text that is no manifest, INCOMPATIBLE for one of another engine, else null. A null text is INVALID."""
    pack = F.from_json(raw, _SCHEMA)["pack"]
    whole = pack["id"].isNotNull() & pack["version"].isNotNull() & pack["engine_compat"].isNotNull()
    fits = normalize.meets_column(engine, pack["engine_compat"])
    return F.when(~F.coalesce(whole, F.lit(False)), "INVALID").when(~F.coalesce(fits, F.lit(False)), "INCOMPATIBLE")


def load_manifests(spark: SparkSession, path: str, engine: str = ENGINE_VERSION):
    """(file, pack, problem) of the manifests at a path, a JSON document a file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    return files.select("file", F.from_json("value", _SCHEMA)["pack"].alias("pack"), manifest_problem(F.col("value"), engine).alias("problem"))


def installation_problems(manifests: DataFrame, installed: DataFrame, engine: str = ENGINE_VERSION) -> DataFrame:
    """manifests (key, raw) with problem and items: the first reason not to install each, null for none.

    INVALID and INCOMPATIBLE as in manifest_problem, then BREAK_CODE and DIMENSION with the sorted codes or
    keys that installed packs own. installed has (kind BREAK_CODE or DIMENSION, name), repeats allowed; keys are unique.
    Names are compared by an equi-join, so neither side need be small; null names own and clash with nothing.
    """
    read = manifests.select("key", F.from_json("raw", _SCHEMA).alias("m"), manifest_problem(F.col("raw"), engine).alias("own"))
    names = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    listed = F.array_compact(F.array(names("BREAK_CODE", F.col("m.break_types.code")), names("DIMENSION", F.col("m.dimensions.key"))))
    defined = read.where("own is null").select("key", F.inline(F.flatten(listed))).where("name is not null").distinct()
    clashes = defined.join(installed.select("kind", "name").distinct(), ["kind", "name"]).groupBy("key", "kind").agg(F.sort_array(F.collect_list("name")).alias("items"))
    first = clashes.groupBy("key").agg(F.min_by(F.struct("kind", "items"), "kind").alias("c"))  # BREAK_CODE comes before DIMENSION
    return read.join(first, "key", "left").select("key", F.coalesce("own", "c.kind").alias("problem"), F.coalesce("c.items", F.array().cast("array<string>")).alias("items"))


def removal_problem(pack: Column) -> Column:
    """CORE_PACK for the one pack that stays installed, else null."""
    return F.when(pack == CORE, "CORE_PACK")
