"""Exact quantiles of many columns at once, by refining a sketch.

A first pass keeps a mergeable sketch per column, whose rank error has a proven bound; it brackets every
wanted rank by two values. A second pass counts what lies below each bracket, and a third counts the distinct
values inside, a few rows in ten thousand and all repeats of one value as one row. Cells of
the bracket lead to the wanted rank, so no task sorts a column and no map holds its distinct values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tallyward.session import materialize

#: A sketch's ranks are right to one in so many; a bracket reaches MARGIN of these to both sides.
ACCURACY, MARGIN = 10_000, 5
#: Cells of a bracket.
CELLS = 1024
#: Tables of so many rows at most are sorted as they are, with the same result.
SMALL = 200_000


def _frame(columns: int, fractions: list[float], box) -> tuple[list, dict, dict]:
    """Targets (column, fraction), and the ends of their brackets from box(column, place), open where a sketch's first or last value would be the end."""
    ends = _ends(fractions)
    targets = [(i, j) for i in range(columns) for j in range(len(fractions))]
    lo = {(i, j): F.lit(float("-inf")) if ends[2 * j] * ACCURACY <= MARGIN else box(i, 2 * j) for i, j in targets}
    hi = {(i, j): F.lit(float("inf")) if ends[2 * j + 1] * ACCURACY >= ACCURACY - MARGIN else box(i, 2 * j + 1) for i, j in targets}
    return targets, lo, hi


def _ends(fractions: list[float]) -> list[float]:
    return [min(1.0, max(0.0, f + s * MARGIN / ACCURACY)) for f in fractions for s in (-1, 1)]


def _outside(targets: list, lo: dict, hi: dict) -> list[Column]:
    """What lies below each bracket, and the values next to it."""
    out = []
    for t, (i, j) in enumerate(targets):
        x = F.col(f"_x{i}")
        out += [F.count_if(x < lo[i, j]).alias(f"_below{t}"), F.max(F.when(x < lo[i, j], x)).alias(f"_under{t}"), F.min(F.when(x > hi[i, j], x)).alias(f"_over{t}")]
    return out


def _inside(framed: DataFrame, keys: list[str], targets: list, lo: dict, hi: dict) -> DataFrame:
    """(keys, t, cell, x, n): distinct values inside each target's bracket, by cell."""
    inside, infinite = [], F.lit(float("inf"))
    for t, (i, j) in enumerate(targets):
        x, a, b = F.col(f"_x{i}"), lo[i, j], hi[i, j]
        cell = F.when((b > a) & (b < infinite) & (a > -infinite), F.least(F.lit(CELLS - 1), F.floor((x - a) / (b - a) * CELLS).cast("int"))).otherwise(0)
        inside.append(F.when((x >= a) & (x <= b), F.struct(F.lit(t).alias("t"), F.coalesce(cell, F.lit(0)).alias("cell"), x.alias("x"))))
    found = framed.select(*keys, F.explode(F.array_compact(F.array(*inside))).alias("r")).select(*keys, "r.*")
    return found.groupBy(*keys, "t", "cell", "x").agg(F.count("*").alias("n"))


def _ranked(found: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, held, x_low, x_high): values at the wanted ranks (low, high, below by target) and how many values the bracket holds."""
    cells = found.groupBy(*keys, "t", "cell").agg(F.sum("n").alias("n"))
    running = W.partitionBy(*keys, "t").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)  # CELLS rows at most
    cells = cells.withColumns({"upto": F.sum("n").over(running), "held": F.sum("n").over(W.partitionBy(*keys, "t"))})
    hits = cells.join(F.broadcast(wanted) if not keys else wanted, [*keys, "t"])
    hits = hits.withColumn("start", F.col("below") + F.col("upto") - F.col("n"))
    holds = lambda r: (F.col(r) >= F.col("start")) & (F.col(r) < F.col("start") + F.col("n"))
    exact = found.join(hits.where(holds("low") | holds("high")).drop("n"), [*keys, "t", "cell"])
    within = W.partitionBy(*keys, "t", "cell").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow)
    exact = exact.withColumn("end", F.col("start") + F.sum("n").over(within)).withColumn("begin", F.col("end") - F.col("n"))
    at = lambda r: F.max(F.when((F.col(r) >= F.col("begin")) & (F.col(r) < F.col("end")), F.col("x")))
    exact = exact.groupBy(*keys, "t").agg(at("low").alias("x_low"), at("high").alias("x_high"))
    return cells.groupBy(*keys, "t").agg(F.max("held").alias("held")).join(exact, [*keys, "t"], "left")


def quantiles(df: DataFrame, columns: dict[str, Column], fractions: list[float], keys: list[str] | tuple[str, ...] = (), *, nearest: tuple[float, ...] = ()) -> DataFrame:
    """One row per key (one row without keys): n_<name>, the values of each column, and <name>_<i> for fraction i.

    A quantile is linear between the ranks around (n - 1) * fraction; for fractions named in nearest it is the value at that
    rank, rounded half to even. Nulls and NaN are left out; a column without values has null quantiles. Rows with
    a null key have no result. Without keys the sketch, counts and result are single rows, which the driver
    reads at once; with keys they are tables.
    """
    keys, names = list(keys), list(columns)
    keep = lambda c: F.when(~F.isnan(c), c)
    base = df.select(*keys, *[keep(x.cast("double")).alias(f"_x{i}") for i, x in enumerate(columns.values())])
    if keys:
        base = base.where(" and ".join(f"`{k}` is not null" for k in keys))
    if base.limit(SMALL + 1).count() <= SMALL:
        return _sorted(base, names, fractions, keys, nearest)
    sketch = base.groupBy(*keys).agg(
        *[F.count(f"_x{i}").alias(f"_n{i}") for i in range(len(names))],
        *[F.percentile_approx(f"_x{i}", F.array(*[F.lit(e) for e in _ends(fractions)]), F.lit(ACCURACY)).alias(f"_b{i}") for i in range(len(names))],
    )
    return _keyed(base, sketch, names, fractions, keys, nearest) if keys else _whole(base, sketch, names, fractions, nearest)


def _sorted(base: DataFrame, names: list[str], fractions: list[float], keys: list[str], nearest: tuple[float, ...]) -> DataFrame:
    """The same from sorted lists; the table has SMALL rows at most."""
    lists = base.groupBy(*keys).agg(*[F.array_sort(F.collect_list(f"_x{i}")).alias(f"_l{i}") for i in range(len(names))])

    def value(i: int, f: float) -> Column:
        values = F.col(f"_l{i}")
        at = (F.size(values) - 1) * F.lit(f)
        pick = lambda r: F.get(values, r.cast("int"))
        if f in nearest:
            return pick(F.bround(at))
        part = at - F.floor(at)
        return F.when(part == 0, pick(at)).otherwise(pick(F.floor(at)) * (1 - part) + pick(F.ceil(at)) * part)

    counts = [F.size(f"_l{i}").cast("long").alias(f"n_{x}") for i, x in enumerate(names)]
    return lists.select(*keys, *counts, *[value(i, f).alias(f"{x}_{j}") for i, x in enumerate(names) for j, f in enumerate(fractions)])


def _whole(base: DataFrame, sketch: DataFrame, names: list[str], fractions: list[float], nearest: tuple[float, ...]) -> DataFrame:
    spark, s = base.sparkSession, sketch.first()
    n = [s[f"_n{i}"] for i in range(len(names))]
    targets, lo, hi = _frame(len(names), fractions, lambda i, e: F.lit(s[f"_b{i}"][e] if n[i] else None).cast("double"))
    facts = base.agg(*_outside(targets, lo, hi)).first()
    ranks = {}
    for t, (i, j) in enumerate(targets):
        if n[i]:
            at = (n[i] - 1) * fractions[j]
            ranks[t] = (round(at), round(at), 0.0) if fractions[j] in nearest else (math.floor(at), math.ceil(at), at - math.floor(at))
    wanted = spark.createDataFrame([(t, a, b, facts[f"_below{t}"]) for t, (a, b, _) in ranks.items()], "t int, low long, high long, below long")
    held = {r["t"]: r for r in _ranked(_inside(base, [], targets, lo, hi), wanted, []).collect()} if ranks else {}  # a row per target
    values = {}
    for t, (low, high, part) in ranks.items():
        below, r = facts[f"_below{t}"], held.get(t)
        over = below + (r["held"] if r else 0)
        value = lambda rank, x, t=t, below=below, over=over, r=r: facts[f"_under{t}"] if rank == below - 1 else facts[f"_over{t}"] if rank == over else r[x]
        a, b = value(low, "x_low"), value(high, "x_high")
        if a is None or b is None:
            raise ValueError("a rank lies outside its bracket")
        values[t] = a if low == high else a * (1 - part) + b * part
    row = (*n, *[values.get(t) for t in range(len(targets))])
    schema = T.StructType([T.StructField(f"n_{x}", T.LongType()) for x in names] + [T.StructField(f"{names[i]}_{j}", T.DoubleType()) for i, j in targets])
    return spark.createDataFrame([row], schema)


def _keyed(base: DataFrame, sketch: DataFrame, names: list[str], fractions: list[float], keys: list[str], nearest: tuple[float, ...]) -> DataFrame:
    sketch = materialize(sketch)  # a row per key; what follows reads it in three places
    targets, lo, hi = _frame(len(names), fractions, lambda i, e: F.col(f"_b{i}")[e])
    framed = base.join(sketch, keys)
    facts = framed.groupBy(*keys).agg(*[F.first(f"_n{i}").alias(f"_n{i}") for i in range(len(names))], *_outside(targets, lo, hi))
    at = lambda i, j: (F.col(f"_n{i}") - 1) * F.lit(fractions[j])
    low = lambda i, j: F.bround(at(i, j)) if fractions[j] in nearest else F.floor(at(i, j))
    high = lambda i, j: F.bround(at(i, j)) if fractions[j] in nearest else F.ceil(at(i, j))
    ranks = F.array(*[
        F.struct(F.lit(t).alias("t"), low(i, j).cast("long").alias("low"), high(i, j).cast("long").alias("high"), (at(i, j) - F.floor(at(i, j))).alias("part"), F.col(f"_below{t}").alias("below"), F.col(f"_under{t}").alias("under"), F.col(f"_over{t}").alias("over"))
        for t, (i, j) in enumerate(targets)
    ])
    wanted = facts.select(*keys, F.explode(ranks).alias("r")).select(*keys, "r.*").where("low is not null and low >= 0")
    wanted = materialize(wanted)
    out = wanted.join(_ranked(_inside(framed, keys, targets, lo, hi), wanted.select(*keys, "t", "low", "high", "below"), keys), [*keys, "t"], "left")
    beyond = F.col("below") + F.coalesce("held", F.lit(0))
    value = lambda r, x: F.coalesce(F.col(x), F.when(F.col(r) == F.col("below") - 1, F.col("under")), F.when(F.col(r) == beyond, F.col("over")), F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))
    a, b = value("low", "x_low"), value("high", "x_high")
    out = out.withColumn("q", F.when(F.col("low") == F.col("high"), a).otherwise(a * (1 - F.col("part")) + b * F.col("part")))
    wide = out.groupBy(*keys).agg(*[F.max(F.when(F.col("t") == t, F.col("q"))).alias(f"{names[i]}_{j}") for t, (i, j) in enumerate(targets)])
    return sketch.select(*keys, *[F.col(f"_n{i}").alias(f"n_{x}") for i, x in enumerate(names)]).join(wide, keys, "left")


def medians(df: DataFrame, columns: dict[str, Column], keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row per key: the median of each column under its name."""
    q = quantiles(df, columns, [0.5], keys)
    return q.select(*keys, *[F.col(f"`{x}_0`").alias(x) for x in columns])


def attach(df: DataFrame, facts: DataFrame, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """df with the facts of its key; without keys, facts is one row, whose values become constants of the plan."""
    if keys:
        return df.join(facts, list(keys))
    row = facts.first()
    return df.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in facts.schema})


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distinct_values): non-null distinct values of each column, by one aggregation of (column, value)."""
    whole, real = {"tinyint", "smallint", "int", "bigint"}, {"float", "double"}
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        kind, x = kinds[c], F.col(f"`{c}`")
        return F.when(x.isNotNull(), F.struct(
            F.lit(c).alias("column"), (x.cast("long") if kind in whole else F.lit(None).cast("long")).alias("i"), (x.cast("double") if kind in real else F.lit(None).cast("double")).alias("d"),
            (F.lit(None).cast("string") if kind in whole | real else x.cast("string")).alias("s"),
        ))

    long = df.select(F.explode(F.array_compact(F.array(*[cell(c) for c in columns]))).alias("r")).select("r.*")
    return long.groupBy("column", "i", "d", "s").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count("*").alias("distinct_values"))
