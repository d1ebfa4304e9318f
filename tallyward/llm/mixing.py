"""Mixing sources to target token shares by entropy balancing.

Rates r(d) minimise the entropy distance to one copy of each document, under one token constraint
per source, sum of r(d)*size(d) = target, and 0 <= r(d) <= the copy limit. The dual has one
multiplier per source and r(d) = min(limit, exp(multiplier * size(d))). Safeguarded Newton
iterations on the dual run as aggregations over the (source, size) histogram, which holds every
document once; the rates are then rounded to copies by a hash of the document's id, and a ladder
of documents of falling size takes up what the rounding leaves over.

Null text counts 0 words; a null source is a source of its own, the last; documents without words
stay at the rate 1 and take nothing. Repeated rows are documents of their own: rows of one id and
text are numbered, and each is rounded by itself. Very long texts count whole. Empty tables give no rows.
Extra columns are kept by mix(), whatever their names; the five columns added get more
underscores where theirs are taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyward.llm.common import WORD, Scratch, table, unused

#: Newton steps at most, and the relative distance from a target at which they end.
STEPS, CLOSE = 60, 1e-6
#: Documents kept per source, power of two of the size, and direction, to take up what rounding leaves.
LADDER = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A source as a join key without nulls."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[float, ...], limit: float) -> DataFrame:
    """Per source (key, source, source_size): its target, by water filling over the table of sources.

    The windows sort one row per source, never documents.
    """
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(limit)))
    order = W.orderBy(F.col("most") / F.col("weight"), "key")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - before) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    t = t.withColumn("level", level)
    level = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "level"))).over(everything)["level"]
    return t.withColumn("target", F.least("most", F.col("weight") * F.coalesce(level, F.lit(0.0)))).select("key", "source_size", "target")


def _newton(hist: DataFrame, goal: DataFrame, limit: float, scratch: Scratch) -> DataFrame:
    """Per source the multiplier of its token constraint."""
    full = F.col("target") >= F.col("source_size") * limit * (1 - 1e-12)
    state = goal.withColumns({"mult": F.lit(0.0), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "done": full | (F.col("target") <= 0)})
    state = scratch.save(state, "dual")
    for _ in range(STEPS):
        if state.where(~F.col("done")).isEmpty():
            break
        active = state.where(~F.col("done"))
        tilt = F.exp(F.least(F.col("mult") * F.col("size"), F.lit(50.0)))
        tokens = F.col("n") * F.col("size") * F.least(F.lit(float(limit)), tilt)
        curve = F.when(tilt < limit, F.col("n") * F.col("size") * F.col("size") * tilt).otherwise(0.0)
        sums = hist.join(active.select("key", "mult"), "key").groupBy("key").agg(F.sum(tokens).alias("tokens"), F.sum(curve).alias("curve"))
        s = state.join(sums, "key", "left")
        over = F.col("tokens") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.col("mult"))
        high = F.when(over, F.col("mult")).otherwise(F.col("high"))
        # the Newton step of the logarithm of the constraint: its slope is the mean size under the tilt
        step = F.when(F.col("curve") > 0, F.col("mult") - F.log(F.col("tokens") / F.col("target")) * F.col("tokens") / F.col("curve"))
        mid = F.coalesce((low + high) / 2, F.when(over, F.least(F.col("mult") * 4, F.lit(-1e-6))).otherwise(F.greatest(F.col("mult") * 4, F.lit(1e-6))))
        inside = step.isNotNull() & (low.isNull() | (step > low)) & (high.isNull() | (step < high))
        close = F.abs(F.col("tokens") - F.col("target")) <= CLOSE * F.col("target")
        new = s.select(
            "key", "source_size", "target",
            F.when(F.col("done") | close, F.col("mult")).when(inside, step).otherwise(mid).alias("mult"),
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
            (F.col("done") | F.coalesce(close, F.lit(True))).alias("done"),
        )
        new = scratch.save(new, "dual")
        scratch.drop(state)
        state = new
    return state.select("key", "source_size", "target", "mult")


def mix(
    docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), limit: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    size: Callable[[Column], Column] = word_count,
) -> DataFrame:
    """docs with _size, _source_size, _target, _rate and _copies as last columns: how often the mix takes each row.

    Weights go to the sources in code-point order, repeating; the targets share the sum of all
    sizes, none above limit times its source's size. Results depend on the rows alone.
    """
    spark, keep = docs.sparkSession, docs.columns
    scratch = Scratch(spark, "mixing")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), _key(F.col(f"`{source_col}`")).alias("key"),
        F.xxhash64(f"`{text_col}`").alias("body"), size(F.col(f"`{text_col}`")).alias("size"),
    )
    base = scratch.save(rows.drop("row"), "sizes")
    again = base.where("size > 0").groupBy("key", "id", "body").agg(F.count("*").alias("times")).where("times > 1")
    again = scratch.save(again.drop("times"), "repeated")
    number = _numbered(again) if not again.isEmpty() else lambda df: df.withColumn("number", F.lit(1))
    base = number(base)
    hist = scratch.save(base.groupBy("key", "source", "size").agg(F.count("*").alias("n")), "histogram")
    sizes = hist.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("source_size"))
    goal = scratch.save(targets(sizes, weights, limit), "targets")
    dual = _newton(hist.where("size > 0"), goal, limit, scratch)

    full, none = F.col("target") >= F.col("source_size") * limit * (1 - 1e-12), F.col("target") <= 0
    tilted = F.least(F.lit(float(limit)), F.exp(F.least(F.col("mult") * F.col("size"), F.lit(50.0))))
    rate = F.when(F.col("size") == 0, 1.0).when(full, float(limit)).when(none, 0.0).otherwise(tilted)
    uniform = F.pmod(F.xxhash64("id", "size", F.lit("mix"), "body", "number"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rounded = F.least(F.lit(limit), F.floor("rate") + (uniform < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    drawn = base.join(dual, "key").withColumn("rate", rate).withColumn("copies", rounded)

    # what rounding leaves over: per source a bounded ladder of documents, largest first
    rungs = (
        drawn.where("size > 0")
        .withColumn("way", F.explode(F.array(F.when(F.col("copies") < limit, 1), F.when(F.col("copies") > 0, -1))))
        .where("way is not null")
        .groupBy("key", F.floor(F.log2("size")).alias("octave"), F.pmod(F.xxhash64("id", "body", "number"), F.lit(LADDER)).alias("part"), "way")
        .agg(F.max(F.struct("size", F.struct("id", "body", "number").alias("which"))).alias("top"))
    )
    taken = drawn.groupBy("key", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
    ladder = rungs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("top.size").alias("size"), "way", F.col("top.which").alias("which"))), asc=False).alias("rungs"))
    empty = F.array().cast(f"array<struct<which:struct<id:{dict(base.dtypes)['id']},body:bigint,number:int>,way:int>>")
    start = F.struct((F.col("target") - F.col("taken")).alias("left"), empty.alias("picked"))

    def climb(acc: Column, x: Column) -> Column:
        use = F.when(x["way"] > 0, acc["left"] >= x["size"] / 2).otherwise(acc["left"] <= -x["size"] / 2)
        return F.when(use, F.struct((acc["left"] - x["way"] * x["size"]).alias("left"), F.concat(acc["picked"], F.array(F.struct(x["which"].alias("which"), x["way"].alias("way")))).alias("picked"))).otherwise(acc)

    picked = taken.join(ladder, "key").select("key", F.explode(F.aggregate("rungs", start, climb)["picked"]).alias("p"))
    mends = scratch.save(picked.groupBy(F.col("key").alias("m_key"), F.col("p.which").alias("which")).agg(F.sum("p.way").cast("int").alias("way")), "mends")

    d = number(rows).join(dual, "key").withColumn("rate", rate).withColumn("copies", rounded)
    d = d.join(mends, (F.col("key") == F.col("m_key")) & F.struct("id", "body", "number").eqNullSafe(F.col("which")), "left")
    copies = F.when(F.col("size") == 0, F.col("copies")).otherwise(F.greatest(F.lit(0), F.least(F.lit(limit), F.col("copies") + F.coalesce("way", F.lit(0)))))
    added = {"_size": F.col("size"), "_source_size": F.col("source_size"), "_target": F.col("target"), "_rate": F.col("rate"), "_copies": copies.cast("int")}
    return d.select(*[F.col("row").getField(c).alias(c) for c in keep], *[v.alias(unused(keep, k)) for k, v in added.items()])


def _numbered(again: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function that numbers rows of one id and text from 1 on; only the rows listed in again are sorted for that."""

    def number(df: DataFrame) -> DataFrame:
        a = again.select(F.struct("key", "id", "body").alias("same"))
        marked = df.join(a, F.struct("key", "id", "body").eqNullSafe(F.col("same")), "left")
        once = marked.where("same is null").withColumn("number", F.lit(1))
        order = W.partitionBy("key", "id", "body").orderBy("size")
        return once.unionByName(marked.where("same is not null").withColumn("number", F.row_number().over(order))).drop("same")

    return number


def expand(mixed: DataFrame) -> DataFrame:
    """The mix itself, from what mix() returns: each row as often as it is taken, with its number among the copies in the last column."""
    keep, copies = mixed.columns[:-5], F.col(f"`{mixed.columns[-1]}`")
    copy = F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))).alias(unused(keep, "copy"))
    return mixed.select(*[F.col(f"`{c}`") for c in keep], copy)


def op2_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").cast("long").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).cast("long").alias("taken"), F.col("_copies").alias("copies"), F.col("_rate").alias("rate")
    )


QUERIES = {"op2_entropy_mixing": op2_entropy_mixing}
SQL: dict[str, str] = {}  # the Newton iterations and the hash are not expressible; tested against brute force
