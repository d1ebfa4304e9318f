"""Case lifecycle, certification, approvals, journals, audit chains and request limits over event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyward.operators.ordering import prefix_sum, with_previous

# Allowed moves of the case machine, states that a period's close may carry forward, and moves that need a reason.
MOVES = {
    "OPEN": ["TRIAGED"], "TRIAGED": ["PROPOSED"], "PROPOSED": ["UNDER_REVIEW"], "UNDER_REVIEW": ["APPROVED", "REJECTED", "RETURNED"], "REJECTED": ["TRIAGED"], "RETURNED": ["TRIAGED"], "APPROVED": ["ACTION_PENDING"],
    "ACTION_PENDING": ["RESOLVED"], "RESOLVED": ["CLOSED"], "CLOSED": ["REOPENED"], "REOPENED": ["TRIAGED"], "CARRIED_FORWARD": ["TRIAGED"],
}
CARRIED = ["OPEN", "TRIAGED", "PROPOSED", "UNDER_REVIEW", "REJECTED", "RETURNED", "APPROVED", "ACTION_PENDING"]
REASON_NEEDED = ["REOPENED"]


def move_problem(before: Column, target: Column, reason: Column, period_close: Column) -> Column:
    """Why a case may not move, or null: ONLY_CARRY_FORWARD and NOT_ELIGIBLE at a period's close, else ILLEGAL or NO_REASON."""
    allowed = F.lit(False)
    for status, targets in MOVES.items():
        allowed = F.when(before == status, target.isin(targets)).otherwise(allowed)
    close = F.when(target != "CARRIED_FORWARD", "ONLY_CARRY_FORWARD").when(~before.isin(CARRIED), "NOT_ELIGIBLE")
    usual = F.when(~allowed, "ILLEGAL").when(target.isin(REASON_NEEDED) & (F.coalesce(reason, F.lit("")) == ""), "NO_REASON")
    return F.when(period_close, close).otherwise(usual)


def invalid_moves(events: DataFrame, case: str, order: list[Column], status: str = "status", reason: str | None = None, period_close: str | None = None) -> DataFrame:
    """(…, before, problem): events whose move from the case's previous status is not allowed; cases have few events each. Without a reason column every reason is given."""
    steps = events.withColumn("before", F.lag(status).over(W.partitionBy(case).orderBy(*order))).where("before is not null")
    why = F.col(reason) if reason else F.lit("given")
    close = F.coalesce(F.col(period_close), F.lit(False)) if period_close else F.lit(False)
    return steps.withColumn("problem", move_problem(F.col("before"), F.col(status), why, close)).where("problem is not null")


def current_status(events: DataFrame, case: str, order: list[Column], status: str = "status") -> DataFrame:
    """The last status of each case, by aggregation."""
    return events.groupBy(case).agg(F.max_by(status, F.struct(*order)).alias(status))


def roll_forward(cases: DataFrame, *, most_rolls: int, most_age: int) -> DataFrame:
    """Open cases move on: one more roll; escalated beyond most_rolls, high risk beyond most_age days."""
    rolls = F.col("rolls") + 1
    return cases.withColumns({"rolls": rolls, "escalated": rolls > most_rolls, "is_high_risk": (F.col("risk") == "High") & (F.col("age_days") > most_age)})


def certification_blockers(periods: DataFrame, most_age: int = 90) -> DataFrame:
    """(period, blocker): every reason why a period cannot be certified."""
    checks = [(F.abs("unexplained") > 0.01, "UNEXPLAINED"), (F.col("high_open") > 0, "HIGH_RISK_OPEN"), (F.col("oldest_days") > most_age, "AGED_OPEN")]
    return periods.select("period", F.explode(F.array_compact(F.array(*[F.when(c, m) for c, m in checks]))).alias("blocker"))


def triage_queue(cases: DataFrame, budget: int) -> DataFrame:
    return cases.orderBy(F.when(F.col("risk") == "High", 0).otherwise(1), F.desc("amount"), "case_id").limit(budget)


def approval_problem(maker: Column, checker: Column, has_role: Column, is_reopen: Column, may_reopen: Column, reason: Column) -> Column:
    """Null if the approval is allowed, else why not: MAKER_IS_CHECKER, ROLE, and for a reopening REOPEN_PERMISSION or REASON."""
    reopen = F.when(~may_reopen, "REOPEN_PERMISSION").when(F.coalesce(reason, F.lit("")) == "", "REASON")
    return F.when(maker == checker, "MAKER_IS_CHECKER").when(~has_role, "ROLE").when(is_reopen, reopen)


def journal_problems(lines: DataFrame) -> DataFrame:
    """(draft, problem) of journals with under two lines, one side only, amounts not positive, or out of balance."""
    dr, cr = F.col("direction") == "DR", F.col("direction") == "CR"
    a = F.col("amount").cast("decimal(20,2)")
    g = lines.groupBy("draft").agg(F.count("*").alias("n"), F.count_if(dr).alias("ndr"), F.count_if(cr).alias("ncr"), F.count_if(a <= 0).alias("bad"), F.sum(F.when(dr, a).otherwise(0)).alias("sdr"), F.sum(F.when(cr, a).otherwise(0)).alias("scr"))
    checks = [(F.col("n") < 2, "TOO_FEW_LINES"), ((F.col("ndr") == 0) | (F.col("ncr") == 0), "ONE_SIDED"), (F.col("bad") > 0, "NOT_POSITIVE"), (F.col("sdr") != F.col("scr"), "UNBALANCED")]
    return g.select("draft", F.explode(F.array_compact(F.array(*[F.when(c, m) for c, m in checks]))).alias("problem"))


def confidence_band(p: Column, sure_layer: Column, full_autonomy: Column, sensitive: Column, *, auto: float = 0.98, suggest: float = 0.85, investigate: float = 0.60) -> Column:
    """AUTO, SUGGEST, INVESTIGATE or NONE. AUTO needs a deterministic layer (L1 or L2) and a universe of full autonomy (A3); sensitive breaks reach SUGGEST at most."""
    return F.when((p >= auto) & sure_layer & full_autonomy & ~sensitive, "AUTO").when(p >= suggest, "SUGGEST").when(p >= investigate, "INVESTIGATE").otherwise("NONE")


# Metrics of the circuit breaker in the order they are checked, and the most each may be.
BUDGET = (("auto_match_false_rate", 0.0001), ("calibration_ece", 0.05), ("suggest_false_accept_rate", 0.005))


def breaker_state(events: DataFrame, key: str, at: str, budget: tuple[tuple[str, float], ...] = BUDGET) -> DataFrame:
    """events with tripped and the breach that tripped the breaker: struct(metric, observed, target, at).

    An event observes the budget's metrics (a null one is not observed) or is a reset (reset_by, reset_reason). The first
    metric above its target trips; the breach stays until a person resets with a reason. A reset without reason or person
    changes nothing, nor do later breaches. A breaker's events may be very many: its resets are
    counted by prefix sums over ranges, its first breaches by aggregation. Events of a key have distinct times.
    """
    reset = (F.coalesce(F.col("reset_by"), F.lit("")) != "") & (F.coalesce(F.col("reset_reason"), F.lit("")) != "")
    breach = F.coalesce(*[F.when(F.col(m) > most, F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("observed"), F.lit(most).alias("target"), F.col(at).alias("at"))) for m, most in budget])
    marked = events.withColumns({"_reset": reset, "_breach": F.when(~reset, breach)})
    counted = prefix_sum(marked, [F.col(key), F.col(at)], F.col("_reset").cast("long"), "_epoch")
    first = counted.where("_breach is not null").groupBy(key, "_epoch").agg(F.min_by("_breach", F.col("_breach")["at"]).alias("breach"))
    out = counted.join(first, [key, "_epoch"], "left")
    out = out.withColumn("breach", F.when(F.col(at) >= F.col("breach")["at"], F.col("breach")))
    return out.withColumn("tripped", F.col("breach").isNotNull()).drop("_reset", "_breach", "_epoch")


def _link(stream: str, seq: str, payload: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.col(stream).cast("string"), F.col(seq).cast("string"), payload), 256)


def chained(events: DataFrame, stream: str, seq: str, payload: Column) -> DataFrame:
    """events with link, the hash of each payload, and previous, that of the one before: what verification compares."""
    d = with_previous(events.withColumn("link", _link(stream, seq, payload)), [stream], seq, {"_p": "link"})
    return d.withColumn("previous", F.coalesce("_p", F.lit("0" * 64))).drop("_p")


def broken_links(chain: DataFrame, stream: str, seq: str, payload: Column) -> DataFrame:
    """(stream, seq, problem): altered payloads, wrong predecessors, and gaps in the sequence. A stream may spread over many tasks."""
    d = with_previous(chain.withColumn("_fresh", _link(stream, seq, payload)), [stream], seq, {"_want": "link", "_before": seq})
    problem = F.when(F.col("_fresh") != F.col("link"), "ALTERED").when(F.col("_before").isNotNull() & (F.col(seq) != F.col("_before") + 1), "GAP").when(F.col("previous") != F.coalesce("_want", F.lit("0" * 64)), "BROKEN")
    return d.select(stream, seq, problem.alias("problem")).where("problem is not null")


def over_limit(requests: DataFrame, key: str, ts: str, most: int, seconds: int = 60) -> DataFrame:
    """Requests beyond `most` in the last `seconds` of their key."""
    n = F.count("*").over(W.partitionBy(key).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-seconds, 0))
    return requests.withColumn("recent", n).where(F.col("recent") > most)


def stale(runs: DataFrame, started: Column, now: Column, minutes: int = 30) -> DataFrame:
    return runs.where((F.col("status") == "running") & (now.cast("timestamp").cast("long") - started.cast("timestamp").cast("long") > minutes * 60))


# Fields that a proposal may not set.
FORBIDDEN_FIELDS = ("approved", "posted", "certified", "write_off_executed")


def proposal_problems(proposals: DataFrame, records: DataFrame, breaks: DataFrame, retrieved: DataFrame, forbidden: tuple[str, ...] = FORBIDDEN_FIELDS) -> DataFrame:
    """(proposal_id, problem, item) of proposals (proposal_id, case_date, record_ids, break_ids, citations, fields).

    Ids must exist in records (id) and breaks (id); citations must stand in the proposal's trace, retrieved (proposal_id, chunk_id,
    effective_from, effective_to), and their window, open where an end is null, must hold the case's date; fields may
    not be forbidden. Every failure is a row.
    """
    def unknown(column: str, known: DataFrame, name: str) -> DataFrame:
        cited = proposals.select("proposal_id", F.explode(column).alias("item")).distinct()
        return cited.join(known.select(F.col("id").alias("item")).distinct(), "item", "left_anti").select("proposal_id", F.lit(name).alias("problem"), F.col("item").cast("string").alias("item"))

    trace = retrieved.select("proposal_id", F.col("chunk_id").alias("item"), "effective_from", "effective_to", F.lit(True).alias("there"))
    cited = proposals.select("proposal_id", "case_date", F.explode("citations").alias("item")).distinct().join(trace, ["proposal_id", "item"], "left")
    day, first, last = F.col("case_date"), F.col("effective_from"), F.col("effective_to")
    checks = F.array(F.when(F.col("there").isNull(), "NOT_RETRIEVED"), F.when(day < first, "NOT_YET_EFFECTIVE"), F.when(day > last, "NO_LONGER_EFFECTIVE"))
    windows = cited.select("proposal_id", F.explode(F.array_compact(checks)).alias("problem"), F.col("item").cast("string").alias("item"))
    fields = proposals.select("proposal_id", F.lit("FORBIDDEN_FIELD").alias("problem"), F.explode(F.array_intersect("fields", F.array(*[F.lit(x) for x in forbidden]))).alias("item"))
    return unknown("record_ids", records, "UNKNOWN_RECORD").unionByName(unknown("break_ids", breaks, "UNKNOWN_BREAK")).unionByName(windows).unionByName(fields)


def within_budget(steps: DataFrame, run: str, order: str, cost: str, budget: float) -> DataFrame:
    """Steps of a run as long as their running cost stays within the budget."""
    used = F.sum(cost).over(W.partitionBy(run).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return steps.withColumn("used", used).where(F.col("used") <= budget)


def decide(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Cases with the status after their latest decision (approve, reject, return, close, reopen); others unchanged."""
    after = F.element_at(F.create_map(*[F.lit(x) for p in (("approve", "APPROVED"), ("reject", "REJECTED"), ("return", "RETURNED"), ("close", "CLOSED"), ("reopen", "REOPENED")) for x in p]), F.col("action"))
    last = decisions.groupBy("case_id").agg(F.max_by(after, "at").alias("_s"))
    return cases.join(last, "case_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


# Preprocessing steps that a plan may hold with their parameters, and steps that would remove or change data.
STEPS = {
    "parse_type": ["column", "target_type"], "parse_datetime": ["column", "format"], "strip_whitespace": ["column"], "normalize_currency": ["column", "target_currency"], "map_schema": ["source_column", "target_field"],
    "encode_categorical": ["column", "method"], "scale_numeric": ["column", "method"], "engineer_feature": ["name", "source_columns", "formula"], "flag_condition": ["name", "column", "condition"],
}
FORBIDDEN_STEPS = ["drop_outliers", "drop_duplicates", "drop_missing", "drop_rare_categories", "filter_rows", "execute_sql", "execute_python", "delete", "update"]


def plan_step_problems(steps: DataFrame, columns: list[str]) -> DataFrame:
    """(…, problem, items): steps (step, params map of texts, source_columns array or null) that a plan may not hold, with the first reason.

    FORBIDDEN_STEP, UNKNOWN_STEP, UNKNOWN_PARAMETER (items: which) or UNKNOWN_COLUMN (items: which of column, source_column and
    source_columns are none of columns). The named source_columns count as a parameter where they are not null.
    """
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    given = F.array_compact(F.concat(F.coalesce(F.map_keys("params"), texts([])), F.array(F.when(F.col("source_columns").isNotNull(), "source_columns"))))
    allowed = texts([])
    for name, params in STEPS.items():
        allowed = F.when(F.col("step") == name, texts(params)).otherwise(allowed)
    named = F.array_compact(F.concat(F.array(F.col("params")["column"], F.col("params")["source_column"]), F.coalesce("source_columns", texts([]))))
    odd, missing = F.array_sort(F.array_except(given, allowed)), F.array_sort(F.array_except(named, texts(columns)))
    known, bad = F.coalesce(F.col("step").isin(list(STEPS)), F.lit(False)), F.coalesce(F.col("step").isin(FORBIDDEN_STEPS), F.lit(False))
    problem = F.when(bad, "FORBIDDEN_STEP").when(~known, "UNKNOWN_STEP").when(F.size(odd) > 0, "UNKNOWN_PARAMETER").when(F.size(missing) > 0, "UNKNOWN_COLUMN")
    items = F.when(problem == "UNKNOWN_PARAMETER", odd).when(problem == "UNKNOWN_COLUMN", missing).otherwise(texts([]))
    return steps.withColumn("items", items).withColumn("problem", problem).where("problem is not null")


def valid_steps(steps: DataFrame, columns: list[str]) -> DataFrame:
    """Steps without a problem: the validated plan, in which a bad step does not void the others."""
    return steps.join(plan_step_problems(steps, columns).select("plan_id", "number"), ["plan_id", "number"], "left_anti")


def promote(versions: DataFrame, model: str, version: str, chosen: DataFrame) -> DataFrame:
    """versions with one production version per model: the chosen one, where there is one."""
    c = chosen.select(F.col(model).alias("_m"), F.col(version).alias("_v"))
    d = versions.join(F.broadcast(c), F.col(model) == F.col("_m"), "left")  # chosen: one row per model
    return d.withColumn("stage", F.when(F.col("_v").isNull(), F.col("stage")).when(F.col(version) == F.col("_v"), "production").when(F.col("stage") == "production", "archived").otherwise(F.col("stage"))).drop("_m", "_v")


def conflicts_with_installed(codes: DataFrame, installed: DataFrame) -> DataFrame:
    """(pack, kind, code, owner): break codes and dimension keys (pack, kind, code) of new packs that another installed pack owns already."""
    owned = installed.select(F.col("pack").alias("owner"), F.col("kind"), F.col("code"))
    return codes.select("pack", "kind", "code").distinct().join(owned, ["kind", "code"]).where(F.col("pack") != F.col("owner")).select("pack", "kind", "code", "owner")


def pack_conflicts(codes: DataFrame) -> DataFrame:
    """(code, pack_a, pack_b): codes that several packs define, from (pack, code); a code has as many rows as pairs of its packs."""
    packs = codes.groupBy("code").agg(F.sort_array(F.collect_set("pack")).alias("packs")).where(F.size("packs") > 1)
    left = packs.select("code", "packs", F.posexplode("packs").alias("i", "pack_a"))
    return left.select("code", "pack_a", F.explode(F.slice("packs", F.col("i") + 2, F.size("packs"))).alias("pack_b"))
