"""Two-sided reconciliation: exact, tolerance and group matching, and breaks on what is left.

Records have id, side (SOURCE_A or SOURCE_B), account, currency, amount, direction, value_date, reference.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import merge
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.session import materialize

A, B = "SOURCE_A", "SOURCE_B"
BLOCK = ["account", "currency", "direction"]

#: Sums of half a set that one search lists, at most.
HALVES = 3_000_000
#: Accounts whose records are Python objects at one time.
ACCOUNTS = 256


def exact_pairs(records: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(a_id, b_id): keys with exactly one record on each side. One aggregation, no join; blank references never match."""
    key = [*BLOCK, "amount", "value_date", "reference", *extra]
    is_a, is_b = F.col("side") == A, F.col("side") == B
    g = records.where("trim(coalesce(reference, '')) <> ''").groupBy(*key).agg(F.count_if(is_a).alias("na"), F.count_if(is_b).alias("nb"), F.max(F.when(is_a, F.col("id"))).alias("a_id"), F.max(F.when(is_b, F.col("id"))).alias("b_id"))
    return g.where("na = 1 and nb = 1").select("a_id", "b_id")


def within_days(a: Column, b: Column, days: int) -> Column:
    return F.abs(F.datediff(a, b)) <= days


def within_band(a: Column, b: Column, absolute: float | None = None, percent: float | None = None) -> Column:
    """|a - b| <= max(absolute, max(a, b) * percent); equality without either."""
    gap = F.abs(a - b)
    limits = [F.lit(absolute).cast("decimal(28,8)")] if absolute is not None else []
    limits += [F.greatest(a, b) * F.lit(percent).cast("decimal(10,8)")] if percent is not None else []
    return gap == 0 if not limits else gap <= (F.greatest(*limits) if len(limits) > 1 else limits[0])


def tolerance_pairs(records: DataFrame, *, days: int, absolute: float | None = None, percent: float | None = None, isolating: tuple[str, ...] = ()) -> DataFrame:
    """(a_id, b_id) within a block under all tolerances: A records with one candidate, then B records claimed once."""
    r = records.where("trim(coalesce(reference, '')) <> ''")
    a, b = r.where(F.col("side") == A).alias("a"), r.where(F.col("side") == B).alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in BLOCK] + [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in isolating]
    on += [within_days(F.col("a.value_date"), F.col("b.value_date"), days), within_band(F.col("a.amount"), F.col("b.amount"), absolute, percent)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    pairs = a.join(b, cond).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))
    one = pairs.groupBy("a_id").agg(F.count("*").alias("n"), F.max("b_id").alias("b_id")).where("n = 1")
    return one.groupBy("b_id").agg(F.count("*").alias("n"), F.max("a_id").alias("a_id")).where("n = 1").select("a_id", "b_id")


def _sums(values: np.ndarray, k: int) -> np.ndarray:
    """Sums of all sets of k values, sorted."""
    sums, last = values, np.arange(len(values))
    for _ in range(k - 1):
        parts = [(sums[last < j] + values[j], j) for j in range(len(values))]
        sums = np.concatenate([p for p, _ in parts])
        last = np.repeat([j for _, j in parts], [len(p) for p, _ in parts])
    return np.sort(sums)


def _may_net(values: np.ndarray, sides: list[str], size: int, tolerance: float) -> bool:
    """False if no set of size values of both sides adds up to zero within tolerance, by meeting sums of its halves; True if one may, or the halves have too many sums to list."""
    if len(values) < size or len(set(sides)) < 2 or math.comb(len(values), size - size // 2) > HALVES:
        return len(values) >= size and len(set(sides)) > 1
    a, b = _sums(values, size // 2), _sums(values, size - size // 2)
    at = np.searchsorted(a, -b - tolerance)
    return bool((a[np.minimum(at, len(a) - 1)] <= -b + tolerance)[at < len(a)].any())


def _smallest_sets(rows: list[tuple[str, str, int]], most_size: int, tolerance: float, steps: int) -> tuple[list[list[int]], bool]:
    """Sets of rows (id, side, cents) of both sides that net to zero, smallest first, then in the order of rows; and whether the steps ran out.

    The last two members of a set are looked up by the sum they have to have, so a size costs the combinations of two members less;
    sizes of two and three, with no more heads than rows, need no proof first.
    """
    n, used, found, tried = len(rows), set(), [], 0
    sums: dict[int, list[tuple[int, int]]] = {}
    for i, j in combinations(range(n), 2):
        sums.setdefault(rows[i][2] + rows[j][2], []).append((i, j))
    keys = sorted(sums) if tolerance >= 1 else []
    for size in range(2, most_size + 1):
        free = [i for i in range(n) if i not in used]
        if len(free) < size or len({rows[i][1] for i in free}) < 2:
            break  # nor has any larger size a set of both sides
        if size > 3 and not _may_net(np.array([rows[i][2] for i in free], np.int64), [rows[i][1] for i in free], size, tolerance):
            continue  # proven: no set of this size nets to zero
        for head in combinations(free, size - 2):
            tried += size > 3
            if tried > steps:
                return found, True
            if used.intersection(head):
                continue
            goal, last = -sum(rows[i][2] for i in head), head[-1] if head else -1
            if tolerance < 1:
                pairs = sums.get(goal, ())
            else:
                pairs = merge(*(sums[k] for k in keys[bisect_left(keys, goal - tolerance) : bisect_right(keys, goal + tolerance)]))
            for pair in pairs:
                tried += 1
                if pair[0] <= last or used.intersection(pair) or len({rows[i][1] for i in (*head, *pair)}) < 2:
                    continue
                found.append([*head, *pair])
                used.update(found[-1])
                if head:
                    break
    return found, False


def group_matches(records: DataFrame, *, tolerance: float = 0.0, most_size: int = 8, pool: int = 200, steps: int = 2_000_000) -> DataFrame:
    """(account, currency, group_no, ids, net, capped): smallest sets of both sides that net to zero within tolerance.

    Sizes rise from two, sets are tried in id order, no record is used twice. Pools above the cap, and
    searches that reach the step budget, return one row with capped set, so that nothing is dropped silently.
    """
    signed = F.when(F.col("direction") == "CR", F.col("amount")).otherwise(-F.col("amount")).cast("double")
    own = records.select("account", "currency", "id", "side", F.rint(signed * 100).cast("long").alias("cents"))
    sizes = own.groupBy("account", "currency").agg(F.count("*").alias("n"))
    over = sizes.where(F.col("n") > pool).select("account", "currency", F.lit(0).alias("group_no"), F.array().cast("array<string>").alias("ids"), F.lit(None).cast("double").alias("net"), F.lit(True).alias("capped"))
    own = own.join(sizes.where(F.col("n") <= pool).select("account", "currency"), ["account", "currency"])
    # an account is one row from here on, so Python is called for many accounts at a time; a record without an amount is in no set
    member = F.when(F.col("cents").isNotNull(), F.struct("id", "side", "cents"))
    pools = own.groupBy("account", "currency").agg(F.collect_list(member).alias("members"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), ACCOUNTS):
                part = batch.slice(lo, ACCOUNTS)
                lists = part.column("members")
                ids, sides, cents = (x.to_pylist() for x in lists.flatten().flatten())
                out, at = [], 0
                for account, n in enumerate(pc.list_value_length(lists).to_pylist()):
                    rows = sorted(zip(ids[at : at + n], sides[at : at + n], cents[at : at + n], strict=True), key=lambda r: (r[0] is None, r[0]))
                    at += n
                    found, capped = _smallest_sets(rows, most_size, tolerance * 100, steps)
                    out += [(account, no, [str(rows[i][0]) for i in c], sum(rows[i][2] for i in c) / 100, False) for no, c in enumerate(found, 1)]
                    out += [(account, 0, [], None, True)] * capped
                which, *columns = zip(*out, strict=True) if out else [()] * 5
                which = pa.array(which, pa.int32())
                kinds = (pa.int32(), pa.list_(pa.string()), pa.float64(), pa.bool_())
                found = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.record_batch([part.column("account").take(which), part.column("currency").take(which), *found], names=["account", "currency", "group_no", "ids", "net", "capped"])

    kinds = dict(records.dtypes)
    found = pools.mapInArrow(work, f"account {kinds['account']}, currency {kinds['currency']}, group_no int, ids array<string>, net double, capped boolean")
    return found.unionByName(over)


def cascade(records: DataFrame, *, days: int, absolute: float) -> DataFrame:
    """(id, rule): exact pairs, then tolerance pairs of what is left."""
    l1 = exact_pairs(records)
    ids = lambda p, rule: p.select(F.explode(F.array("a_id", "b_id")).alias("id"), F.lit(rule).alias("rule"))
    m1 = materialize(ids(l1, "L1"))  # read twice
    m2 = ids(tolerance_pairs(records.join(m1.select("id"), "id", "left_anti"), days=days, absolute=absolute), "L2")
    return m1.unionByName(m2)


def breaks(records: DataFrame, matched: DataFrame) -> DataFrame:
    """(id, code) of unmatched records: DUP-01 for a repeated fingerprint on a side, AMT-02 if a partner differs in amount, else TIM-01."""
    left = materialize(records.join(matched.select("id"), "id", "left_anti"))  # read three times
    twin = left.groupBy("side", *BLOCK, "amount", "value_date", "reference").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    twin = twin.select("side", *BLOCK, "amount", "value_date", "reference", F.lit(True).alias("twice"))
    d = left.join(twin, ["side", *BLOCK, "amount", "value_date", "reference"], "left")
    # the largest amount of each side by aggregation, so that a common reference gathers in no task
    key = ("account", "currency", "reference")
    top = left.groupBy(*key).agg(F.max(F.when(F.col("side") == A, F.col("amount"))).alias("_top_a"), F.max(F.when(F.col("side") == B, F.col("amount"))).alias("_top_b"))
    top = top.select(*[F.col(c).alias(f"_{c}") for c in key], "_top_a", "_top_b")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    d = d.join(top, same, "left")
    partner = F.when(F.col("side") == A, F.col("_top_b")).otherwise(F.col("_top_a"))
    code = F.when(F.col("twice"), "DUP-01").when(partner.isNotNull() & (partner != F.col("amount")), "AMT-02").otherwise("TIM-01")
    return d.select("id", code.alias("code"))


def unexplained(opening: Column, movement: Column, closing: Column, explained: Column) -> Column:
    return F.round(closing - (opening + movement) - explained, 2).cast("decimal(38,2)")


def mixed_groups(members: DataFrame, group: str, dimension: str) -> DataFrame:
    """Groups with more than one distinct non-null value of an isolating dimension."""
    return members.groupBy(group).agg(F.countDistinct(dimension).alias("n_values")).where("n_values > 1")


def incomplete_accounts(records: DataFrame) -> DataFrame:
    """Accounts that lack one side."""
    g = records.groupBy("account").agg(F.count_if(F.col("side") == A).alias("na"), F.count_if(F.col("side") == B).alias("nb"))
    return g.where("na = 0 or nb = 0").select("account", F.when(F.col("na") == 0, A).otherwise(B).alias("missing_side"))


def resolved_cases(cases: DataFrame, matched: DataFrame) -> DataFrame:
    """Cases all of whose records (record_ids) are matched now."""
    long = cases.select("case_id", F.explode("record_ids").alias("id"))
    return long.join(matched.select("id", F.lit(1).alias("m")), "id", "left").groupBy("case_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("m", F.lit(0))).alias("done")).where("n = done").select("case_id")


def manual_match_problems(chosen: DataFrame, *by: str) -> DataFrame:
    """Why a manual match of the chosen records is not allowed, for each match where by names its columns; no rows if it is."""
    signed = F.when(F.col("direction") == "CR", F.col("amount")).otherwise(-F.col("amount"))
    s = chosen.groupBy(*by).agg(F.countDistinct("id").alias("n"), F.countDistinct("currency").alias("c"), F.countDistinct("side").alias("s"), F.abs(F.sum(signed)).alias("net"))
    checks = [(F.col("n") < 2, "fewer than two records"), (F.col("c") > 1, "several currencies"), (F.col("s") < 2, "one side only"), (F.col("net") > 0.01, "does not net to zero")]
    return s.select(*by, F.explode(F.array_compact(F.array(*[F.when(c, m) for c, m in checks]))).alias("problem"))


def resolve_routing(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """(case_id, role, auto_match): the tightest amount band of the case's family decides, ties by rule order."""
    low, high = F.coalesce("gte", F.lit(float("-inf"))), F.coalesce("lt", F.lit(float("inf")))
    m = cases.join(F.broadcast(rules), "family").where((F.col("amount") >= low) & (F.col("amount") < high))  # rules: a short literal table
    return m.groupBy("case_id").agg(F.max_by("role", F.struct(low, -F.col("ord"))).alias("role"), F.bool_and("allow_auto").alias("auto_match"))


def eligible_policies(cases: DataFrame, policies: DataFrame) -> DataFrame:
    """Policies a declared case may use: active, its category listed, days past due within the limit."""
    on = F.array_contains(F.col("categories"), F.col("category")) & F.col("dpd").between(0, F.col("most_dpd"))
    return cases.where("declared").join(F.broadcast(policies.where("active")), on).select("case_id", "policy_id")  # policies: a short literal table


def evidence_difference(a: Column, b: Column) -> Column:
    return F.struct(F.sort_array(F.array_except(a, b)).alias("only_a"), F.sort_array(F.array_except(b, a)).alias("only_b"), F.sort_array(F.array_intersect(a, b)).alias("common"))


def unmatch(requests: DataFrame, matches: DataFrame, open_periods: DataFrame) -> DataFrame:
    """requests (request_id, match_id, role, reason) with problem: null where the match is reversed.

    Problems in this order: ROLE (only a MAKER unmatches), REASON (none but spaces), NOT_FOUND, ALREADY_REVERSED, PERIOD_CLOSED.
    matches has (match_id, period, reversed), open_periods (period). Of several good requests for a match the one of
    smallest request_id counts; the others find it reversed. Repeated rows of one request_id fare alike.
    """
    m = matches.groupBy("match_id").agg(F.max(F.coalesce("reversed", F.lit(False))).alias("_reversed"), F.max("period").alias("period"))
    m = m.join(open_periods.select("period", F.lit(True).alias("_open")).distinct(), "period", "left").drop("period")
    r = requests.join(m, "match_id", "left")
    own = (
        F.when(~F.col("role").eqNullSafe("MAKER"), "ROLE").when(F.trim(F.coalesce("reason", F.lit(""))) == "", "REASON").when(F.col("_reversed").isNull(), "NOT_FOUND")
        .when(F.col("_reversed"), "ALREADY_REVERSED").when(F.col("_open").isNull(), "PERIOD_CLOSED")
    )
    r = r.withColumn("problem", own).drop("_reversed", "_open")
    first = r.where("problem is null").groupBy("match_id").agg(F.min("request_id").alias("_first"))
    r = r.join(first, "match_id", "left")
    late = F.col("problem").isNull() & (F.col("request_id") > F.col("_first"))
    return r.withColumn("problem", F.when(late, "ALREADY_REVERSED").otherwise(F.col("problem"))).drop("_first")


def after_unmatch(members: DataFrame, answers: DataFrame) -> DataFrame:
    """members (match_id, record_id, status) as they stand after unmatch(): records of reversed matches that were MATCHED are UNMATCHED; no row goes."""
    gone = answers.where("problem is null").select("match_id", F.lit(True).alias("_gone")).distinct()
    status = F.when(F.col("_gone") & (F.col("status") == "MATCHED"), "UNMATCHED").otherwise(F.col("status"))
    return members.join(gone, "match_id", "left").withColumn("status", status).drop("_gone")
