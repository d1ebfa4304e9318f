"""Benchmark decontamination by template canonicalisation.

Texts become tokens; numbers, names and units of measure become typed placeholders, other words
their lower case. Windows of template tokens are hash-joined with those of the benchmark. Matched
windows of a document and an item that lie on one diagonal are aligned, and the values behind the
placeholders are compared: each benchmark value has to map to one value of the document all along
one occurrence of the item. So a question whose numbers and names were swapped is still caught, also
beside others with other values, while texts that only share a frame of placeholders are not.

An occurrence is one diagonal, or one with what neighbouring diagonals (less than half an item away,
nearest first) cover besides, as after an insertion, or all diagonals together, as when an item is
spread over a document. A pair is known by its best occurrence.

A number is a run of digits with separators or a spelled number; a name is a capitalised word that
does not begin a sentence; a unit is a listed word after a number. An item with fewer tokens than a
window is one window of its whole length. Windows with few ordinary words are no evidence of a template
and match by their raw values, as do first windows, whose first token depends on what stands before it:
verbatim copies are found whatever they consist of. Texts without tokens match nothing. Rows with one doc_id count as one
document; equal benchmark texts under several ids all match. Extra columns are ignored by
contaminated() and kept by decontaminate(). Empty tables give no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.common import Scratch, table

#: Template tokens per window; of them at least so many are words, else a window matches verbatim only.
WINDOW, WORDS = 8, 4
SLOTS = ("#", "~", "@")
#: Share of an item's tokens that matched windows cover, and of its slots that map consistently.
COVERAGE, CONSISTENT = 0.5, 0.8
#: Benchmark windows up to this number are broadcast (under 50 MB); beyond it the join shuffles.
BROADCAST_WINDOWS = 1_000_000

# Spelled numbers and units of measure.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = (
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes oz ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur gbp percent degree degrees kmh mph watt watts volt volts"
).split()

_TOKEN = r"""(?:[.!?:;"\n]\s*)?(?:\p{L}[\p{L}\p{M}']*|[0-9](?:[0-9,.]*[0-9])?)"""
_LEAD = ' \t\r\x0b\x0c\n.!?:;"'


def raw_tokens(text: Column) -> Column:
    """Tokens, each with the sentence mark before it."""
    return F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(_TOKEN), F.lit(0))


def value(token: Column) -> Column:
    return F.lower(F.ltrim(token, F.lit(_LEAD)))


def template(tokens: Column) -> Column:
    """Template tokens: '#' for numbers, '~' for units, '@' for names, else the word in lower case."""

    def canonical(x: Column, i: Column) -> Column:
        low, first = value(x), F.substring(x, 1, 1)
        digit = first.between("0", "9")
        before = F.when(i > 0, value(F.get(tokens, i - 1)))
        after_number = F.coalesce(F.substring(before, 1, 1).between("0", "9") | before.isin(NUMBERS), F.lit(False))
        # a mark before the token makes its first character neither a letter nor a digit
        name = (first != F.lower(first)) & (x != F.upper(x))
        return F.when(digit | F.substring(low, 1, 1).between("0", "9") | low.isin(NUMBERS), "#").when(low.isin(UNITS) & after_number, "~").when(name, "@").otherwise(low)

    return F.transform(tokens, canonical)


def _shifted(h: Column, k: int) -> Column:
    n = F.greatest(F.size(h) - k, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(k + 1), n), lambda a, b: F.xxhash64(a, b))


def _windows(df: DataFrame, keep: list[str], tokens: str, lengths: list[int]) -> DataFrame:
    """(keep, pos, length, verbatim, window hash) of all windows of template tokens and of raw values.

    Raw values hash whatever stands before them; where they are no placeholders, their template tokens are the same strings.
    """
    df = df.select(*keep, F.col(tokens).alias("raw"), template(F.col(tokens)).alias("t"))
    df = df.select(*keep, "raw", "t", F.transform("t", lambda x: F.xxhash64(x)).alias("h0"))
    exact = F.transform("t", lambda x, i: F.when(x.isin(*SLOTS), F.xxhash64(value(F.get("raw", i)))).otherwise(F.get("h0", i)))
    df = df.select(*keep, "h0", exact.alias("h1"), F.size("raw").alias("n"))
    names = []
    for v in ("0", "1"):
        for length in lengths:
            name = f"w{length}_{v}"
            # by doubling for whole windows, token by token for shorter ones
            steps = [1, 2, 4] if length == WINDOW else range(1, length)
            df = df.withColumn(name, F.col(f"h{v}"))
            for k in steps:
                df = df.withColumn(name, _shifted(F.col(name), k) if length == WINDOW else _longer(F.col(name), F.col(f"h{v}"), k))
            names.append(name)
    # all lists in one, each filled up to the number of tokens
    padded = [F.concat(F.col(c), F.array_repeat(F.lit(None).cast("long"), F.col("n") - F.size(c))) for c in names]
    df = df.where("n > 0").select(*keep, "n", F.concat(*padded).alias("h"))
    # outer: else Catalyst filters on the size of h first and computes it once more for that
    df = df.select(*keep, "n", F.posexplode_outer("h").alias("at", "h")).where(F.col("h").isNotNull())
    part = F.floor(F.col("at") / F.col("n")).cast("int")
    return df.select(*keep, (F.col("at") % F.col("n")).alias("pos"), F.get(F.lit(lengths * 2), part).alias("length"), (part >= len(lengths)).alias("verbatim"), "h")


def _longer(h: Column, base: Column, k: int) -> Column:
    n = F.greatest(F.size(base) - k, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(base, F.lit(k + 1), n), lambda a, b: F.xxhash64(a, b))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, scratch: Scratch | None = None) -> DataFrame:
    """Pairs (doc_id, item_id) with tokens covered, coverage, slots, and the share of slots that map consistently."""
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    items = benchmark.select("item_id", raw_tokens(F.col("text")).alias("raw"))
    items = scratch.save(items.select("item_id", "raw", template(F.col("raw")).alias("tpl")).where(F.size("raw") > 0), "items")
    length = F.least(F.size("tpl"), F.lit(WINDOW))
    lengths = sorted(r[0] for r in items.select(length).distinct().collect()) or [WINDOW]  # of 1 to 8
    words = F.size(F.filter(F.slice("tpl", F.col("pos") + 1, F.col("length")), lambda x: ~x.isin(*SLOTS)))
    marks = _windows(items, ["item_id", "tpl"], "raw", lengths).where((F.col("length") == length) & F.when(F.col("verbatim"), (words < WORDS) | (F.col("pos") == 0)).otherwise(words >= WORDS))
    marks = marks.select("item_id", F.col("pos").alias("item_pos"), "length", "h").distinct()
    marks = scratch.save(marks, "windows")
    small = F.broadcast(marks) if marks.count() <= BROADCAST_WINDOWS else marks
    own = docs.select("doc_id", raw_tokens(F.col("text")).alias("raw"))
    hits = _windows(own, ["doc_id"], "raw", lengths).join(small, ["length", "h"]).select("doc_id", "item_id", "item_pos", "length", (F.col("pos") - F.col("item_pos")).alias("shift"))
    # windows at one shift: the item's positions they cover
    runs = hits.groupBy("doc_id", "item_id", "shift").agg(F.collect_set("item_pos").alias("starts"), F.max("length").alias("length"))
    runs = runs.withColumn("covered", F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("length") - 1))))).drop("starts", "length")
    runs = scratch.save(runs, "runs")

    # values behind the slots at the covered positions, of the few documents with hits
    r = runs.select(F.col("doc_id").alias("r_doc"), "item_id", "shift", "covered")
    aligned = docs.select("doc_id", "text").join(r, F.col("doc_id").eqNullSafe(F.col("r_doc")))
    aligned = aligned.withColumn("raw", raw_tokens(F.col("text"))).drop("text", "r_doc").join(items.withColumnRenamed("raw", "item_raw"), "item_id")
    slot = F.filter(F.transform("covered", lambda p: F.struct(p.alias("at"), F.get("tpl", p).alias("kind"), value(F.get("item_raw", p)).alias("item"), value(F.get("raw", p + F.col("shift"))).alias("doc"))), lambda s: s["kind"].isin(*SLOTS))
    pairs = aligned.select("doc_id", "item_id", "shift", F.size("tpl").alias("n_item"), "covered", slot.alias("slots"))
    everything = pairs.groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.array_distinct(F.flatten(F.collect_set("covered"))).alias("covered"), F.flatten(F.collect_set("slots")).alias("slots"))
    found = pairs.drop("shift").unionByName(everything).unionByName(_neighbours(pairs))
    # of each benchmark value, the share of slots with its most frequent document value
    mapped = F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"].alias("kind"), s["item"].alias("item"))))
    doc_values = lambda k: F.transform(F.filter("slots", lambda s: (s["kind"] == k["kind"]) & (s["item"] == k["item"])), lambda s: s["doc"])
    agree = lambda v: F.array_max(F.transform(F.array_distinct(v), lambda x: F.size(F.filter(v, lambda y: y == x))))
    n_agree = F.aggregate(mapped, F.lit(0), lambda acc, k: acc + F.coalesce(agree(doc_values(k)), F.lit(0)))
    out = found.select(
        "doc_id", "item_id", F.size("covered").cast("long").alias("n_tokens"), F.round(F.size("covered") / F.col("n_item"), 4).alias("coverage"),
        F.size("slots").cast("long").alias("n_slots"), F.round(F.when(F.size("slots") > 0, n_agree / F.size("slots")).otherwise(1.0), 4).alias("consistency"),
    )
    out = out.where((F.col("coverage") >= COVERAGE) & (F.col("consistency") >= CONSISTENT))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "consistency", "n_tokens", "n_slots")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_tokens", "b.coverage", "b.n_slots", "b.consistency")


def _neighbours(pairs: DataFrame) -> DataFrame:
    """Of each diagonal that has neighbours: its positions, and those it lacks from the nearest neighbour that has them.

    Diagonals meet by ranges of an item's length, so a group has at most three lengths of diagonals however long the document.
    """
    run = F.struct("shift", "covered", "slots")
    spread = pairs.withColumn("cell", F.floor(F.col("shift") / F.col("n_item"))).withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    groups = spread.groupBy("doc_id", "item_id", (F.col("cell") + F.col("step")).alias("cell")).agg(F.max("n_item").alias("n_item"), F.collect_set(F.when(F.col("step") == 0, run)).alias("own"), F.collect_set(run).alias("runs"))
    each = groups.where((F.size("own") > 0) & (F.size("runs") > 1)).select("doc_id", "item_id", "n_item", "runs", F.explode("own").alias("a"))
    far = lambda r: F.abs(r["shift"] - F.col("a.shift"))
    near = F.array_sort(F.transform(F.filter("runs", lambda r: far(r) * 2 < F.col("n_item")), lambda r: F.struct(far(r).alias("far"), r["shift"].alias("shift"), r["covered"].alias("covered"), r["slots"].alias("slots"))))
    each = each.select("doc_id", "item_id", "n_item", "a", near.alias("near")).where(F.size("near") > 1)

    def add(acc: Column, r: Column) -> Column:
        new = F.array_except(r["covered"], acc["covered"])
        return F.struct(F.concat(acc["covered"], new).alias("covered"), F.concat(acc["slots"], F.filter(r["slots"], lambda s: F.array_contains(new, s["at"]))).alias("slots"))

    chain = F.aggregate("near", F.struct(F.col("a.covered").alias("covered"), F.col("a.slots").alias("slots")), add)
    return each.select("doc_id", "item_id", "n_item", chain.alias("c")).select("doc_id", "item_id", "n_item", "c.covered", "c.slots")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; repeated rows go or stay together."""
    bad = contaminated(docs.select("doc_id", "text"), benchmark).select("doc_id").distinct()
    bad = Scratch(docs.sparkSession, "decontaminate").save(bad, "bad")
    return docs.alias("a").join(bad.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left_anti")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_template_decontamination": op1_template_decontamination}
SQL: dict[str, str] = {}
