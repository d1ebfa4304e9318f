"""Queries: lifecycle, certification, approvals, chains, limits, lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.operators import lifecycle
from tallyward.plans.registry import query
from tallyward.session import table

_ST = "OPEN TRIAGED PROPOSED UNDER_REVIEW APPROVED REJECTED RETURNED ACTION_PENDING RESOLVED CLOSED REOPENED CARRIED_FORWARD".split()
_EV = "with e as (select user_id as case_id, event_id, ([" + ", ".join(f"'{x}'" for x in _ST) + "])[(event_id * 7 + user_id) % 12 + 1] as status, event_id % 9 = 0 as closing, case when event_id % 2 = 0 then 'why' else '' end as reason from events)"
_LEGAL = (
    "(before = 'OPEN' and status = 'TRIAGED' or before = 'TRIAGED' and status = 'PROPOSED' or before = 'PROPOSED' and status = 'UNDER_REVIEW' or before = 'UNDER_REVIEW' and status in ('APPROVED', 'REJECTED', 'RETURNED') or before in ('REJECTED', 'RETURNED', 'REOPENED', 'CARRIED_FORWARD') and status = 'TRIAGED' "
    "or before = 'APPROVED' and status = 'ACTION_PENDING' or before = 'ACTION_PENDING' and status = 'RESOLVED' or before = 'RESOLVED' and status = 'CLOSED' or before = 'CLOSED' and status = 'REOPENED')"
)


def _events(spark, sf_dir):
    k = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(s) for s in _ST]), ((k * 7 + F.col("user_id")) % 12 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), "event_id", status.alias("status"), (k % 9 == 0).alias("closing"), F.when(k % 2 == 0, "why").otherwise("").alias("reason"))


@query(
    "wf_01_invalid_moves",
    _EV + ", l as (select *, lag(status) over (partition by case_id order by event_id) as before from e), p as (select event_id, before, status, case when closing then case when status <> 'CARRIED_FORWARD' then 'ONLY_CARRY_FORWARD' when before in ('RESOLVED', 'CLOSED', 'REOPENED', 'CARRIED_FORWARD') then 'NOT_ELIGIBLE' end "
    f"when not {_LEGAL} then 'ILLEGAL' when status = 'REOPENED' and reason = '' then 'NO_REASON' end as problem from l where before is not null) select * from p where problem is not null",
)
def wf_01(spark, sf_dir):
    return lifecycle.invalid_moves(_events(spark, sf_dir), "case_id", [F.col("event_id")], reason="reason", period_close="closing").select("event_id", "before", "status", "problem")


@query("wf_01_current_status", _EV + " select case_id, arg_max(status, event_id) as status from e group by 1")
def wf_01_current(spark, sf_dir):
    return lifecycle.current_status(_events(spark, sf_dir), "case_id", [F.col("event_id")])


_CASES = "with c as (select o_orderkey as case_id, o_totalprice as amount, case when o_totalprice > 350000 then 'High' else 'Low' end as risk, date_diff('day', o_orderdate::date, date '2001-09-01') as age_days, (o_orderkey % 5)::int as rolls, o_orderstatus as status from orders)"


def _cases(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("amount"), F.when(F.col("o_totalprice") > 350000, "High").otherwise("Low").alias("risk"), F.datediff(F.lit("2001-09-01").cast("date"), F.to_date("o_orderdate")).cast("long").alias("age_days"), (F.col("o_orderkey") % 5).cast("int").alias("rolls"), F.col("o_orderstatus").alias("status"))


@query("wf_02_roll_forward", _CASES + " select case_id, rolls + 1 as rolls, rolls + 1 > 3 as escalated, risk = 'High' and age_days > 365 as is_high_risk from c where status <> 'F'")
def wf_02(spark, sf_dir):
    return lifecycle.roll_forward(_cases(spark, sf_dir).where("status <> 'F'"), most_rolls=3, most_age=365).select("case_id", "rolls", "escalated", "is_high_risk")


_PERIODS = "with p as (select strftime(o_orderdate, '%Y-%m') as period, sum(case when o_orderkey % 97 = 0 then 1 else 0 end) as unexplained, count(*) filter (where o_orderstatus = 'O' and o_totalprice > 495000) as high_open, max(case when o_orderstatus = 'P' then date_diff('day', o_orderdate::date, date '2001-09-01') end) as oldest_days from orders group by 1)"


@query("wf_03_certification_blockers", _PERIODS + " select period, 'UNEXPLAINED' as blocker from p where abs(unexplained) > 0.01 union all select period, 'HIGH_RISK_OPEN' from p where high_open > 0 union all select period, 'AGED_OPEN' from p where oldest_days > 90")
def wf_03(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    days = F.datediff(F.lit("2001-09-01").cast("date"), F.to_date("o_orderdate"))
    p = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.sum((F.col("o_orderkey") % 97 == 0).cast("int")).alias("unexplained"), F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 495000)).alias("high_open"), F.max(F.when(F.col("o_orderstatus") == "P", days)).alias("oldest_days"))
    return lifecycle.certification_blockers(p)


@query("wf_04_certifiable_periods", _PERIODS + " select period from p where abs(unexplained) <= 0.01 and high_open = 0 and coalesce(oldest_days, 0) <= 900")
def wf_04(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    days = F.datediff(F.lit("2001-09-01").cast("date"), F.to_date("o_orderdate"))
    p = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.sum((F.col("o_orderkey") % 97 == 0).cast("int")).alias("unexplained"), F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 495000)).alias("high_open"), F.max(F.when(F.col("o_orderstatus") == "P", days)).alias("oldest_days"))
    return p.select("period").join(lifecycle.certification_blockers(p, 900).select("period").distinct(), "period", "left_anti")


@query("wf_05_triage_queue", _CASES + " select case_id, risk, amount from c where status = 'O' order by case when risk = 'High' then 0 else 1 end, amount desc, case_id limit 100")
def wf_05(spark, sf_dir):
    return lifecycle.triage_queue(_cases(spark, sf_dir).where("status = 'O'"), 100).select("case_id", "risk", "amount")


@query("wf_06_maker_checker", "select o_orderkey, case when o_orderkey % 4 = o_custkey % 4 then 'MAKER_IS_CHECKER' when o_orderkey % 3 = 0 then 'ROLE' when o_orderstatus = 'P' and o_custkey % 5 = 0 then 'REOPEN_PERMISSION' when o_orderstatus = 'P' and o_custkey % 2 = 0 then 'REASON' end as problem from orders")
def wf_06(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    problem = lifecycle.approval_problem(k % 4, c % 4, k % 3 != 0, F.col("o_orderstatus") == "P", c % 5 != 0, F.when(c % 2 != 0, "why"))
    return table(spark, sf_dir, "orders").select(k, problem.alias("problem"))


_J = "with l as (select l_orderkey as draft, case when l_linenumber % 2 = 0 then 'DR' else 'CR' end as direction, l_discount::decimal(20,2) as amount from lineitem), g as (select draft, count(*) as n, count(*) filter (where direction = 'DR') as ndr, count(*) filter (where direction = 'CR') as ncr, count(*) filter (where amount <= 0) as bad, coalesce(sum(amount) filter (where direction = 'DR'), 0) as sdr, coalesce(sum(amount) filter (where direction = 'CR'), 0) as scr from l group by 1)"


@query("wf_07_journal_problems", _J + " select draft, 'TOO_FEW_LINES' as problem from g where n < 2 union all select draft, 'ONE_SIDED' from g where ndr = 0 or ncr = 0 union all select draft, 'NOT_POSITIVE' from g where bad > 0 union all select draft, 'UNBALANCED' from g where sdr <> scr")
def wf_07(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draft"), F.when(F.col("l_linenumber") % 2 == 0, "DR").otherwise("CR").alias("direction"), F.col("l_discount").alias("amount"))
    return lifecycle.journal_problems(l)


@query("wf_09_confidence_band", "select o_orderkey, case when o_totalprice / 500000 >= 0.98 and o_custkey % 4 in (1, 2) and o_orderkey % 3 > 0 and o_orderkey % 5 <> 0 then 'AUTO' when o_totalprice / 500000 >= 0.85 then 'SUGGEST' when o_totalprice / 500000 >= 0.6 then 'INVESTIGATE' else 'NONE' end as band from orders")
def wf_09(spark, sf_dir):
    k, layer = F.col("o_orderkey"), F.col("o_custkey") % 4
    return table(spark, sf_dir, "orders").select(k, lifecycle.confidence_band(F.col("o_totalprice") / 500000, layer.isin(1, 2), k % 3 > 0, k % 5 == 0).alias("band"))


@query(
    "wf_10_circuit_breaker",
    "with m as (select event_id, event_type, event_id % 50 = 0 as control, event_id % 100 = 0 as valid, value / 3000000 as a, (user_id % 100) / 1960.0 as c, (event_id % 613) / 122000.0 as s from events where value is not null), "
    "b as (select *, case when control then null when a > 0.0001 then 'auto_match_false_rate' when c > 0.05 then 'calibration_ece' when s > 0.005 then 'suggest_false_accept_rate' end as metric, sum(valid::int) over (partition by event_type order by event_id) as epoch from m), "
    "f as (select event_type, epoch, min(event_id) as at, arg_min(metric, event_id) as metric from b where metric is not null group by 1, 2) "
    "select event_id, coalesce(event_id >= f.at, false) as tripped, case when event_id >= f.at then f.metric end as metric, case when event_id >= f.at then f.at end as at from b left join f using (event_type, epoch)",
)
def wf_10(spark, sf_dir):
    k = F.col("event_id")
    seen = lambda x: F.when(k % 50 != 0, x)
    m = table(spark, sf_dir, "events").where("value is not null").select(
        "event_id", "event_type", seen(F.col("value") / 3000000).alias("auto_match_false_rate"), seen((F.col("user_id") % 100) / 1960.0).alias("calibration_ece"), seen((k % 613) / 122000.0).alias("suggest_false_accept_rate"),
        F.when(k % 50 == 0, "ann").alias("reset_by"), F.when(k % 100 == 0, "checked").alias("reset_reason"),
    )
    return lifecycle.breaker_state(m, "event_type", "event_id").select("event_id", "tripped", "breach.metric", "breach.at")


def _chain_problems(e, stream):
    chain = lifecycle.chained(e, stream, "seq", F.col("event_type"))
    key = F.col("event_id") % 500
    kept = chain.where(key != 11).withColumn("event_type", F.when(key == 7, "forged").otherwise(F.col("event_type")))
    kept = kept.withColumn("previous", F.when(key == 9, F.lit("0" * 64)).otherwise(F.col("previous")))
    return lifecycle.broken_links(kept, stream, "seq", F.col("event_type")).select(stream, "seq", "problem")


_CHAIN = (
    "k as (select *, lag(seq) over (partition by {s} order by seq) as before from n where event_id % 500 <> 11), p as (select {s}, seq, case when event_id % 500 = 7 then 'ALTERED' when before is not null and seq <> before + 1 then 'GAP' "
    "when event_id % 500 = 9 and before is not null then 'BROKEN' when before is null and seq <> 1 then 'BROKEN' end as problem from k) select * from p where problem is not null"
)


@query("wf_11_chain_verification", "with n as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as seq from events), " + _CHAIN.format(s="user_id"))
def wf_11(spark, sf_dir):
    from pyspark.sql.window import Window as W

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long").alias("seq"))
    return _chain_problems(e, "user_id")


@query("wf_11_single_stream", "with n as (select 1 as stream, event_id, row_number() over (order by event_id) as seq from events), " + _CHAIN.format(s="stream"))
def wf_11_single(spark, sf_dir):
    from tallyward.operators.ordering import row_numbers

    e = row_numbers(table(spark, sf_dir, "events").select(F.lit(1).alias("stream"), "event_id", "event_type"), [F.col("event_id")], "seq")
    return _chain_problems(e, "stream")


@query("wf_12_audit_list", "select event_id, user_id, count(*) over () as total from events where event_type = 'purchase' and user_id % 3 = 0 order by event_id desc limit 20 offset 20")
def wf_12(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase' and user_id % 3 = 0").select("event_id", "user_id")
    total = e.agg(F.count("*").alias("total"))
    return e.orderBy(F.desc("event_id")).offset(20).limit(20).crossJoin(F.broadcast(total))


@query("wf_13_stale_runs", "select event_id from events where event_type = 'click' and date_diff('second', ts, (select max(ts) from events)) > 1800")
def wf_13(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    runs = e.withColumn("status", F.when(F.col("event_type") == "click", "running").otherwise("done")).crossJoin(F.broadcast(now))
    return lifecycle.stale(runs, F.col("ts"), F.col("now")).select("event_id")


@query("wf_14_chain_heads", "select user_id, max(event_id) as sequence, arg_max(md5(event_type || event_id), event_id) as head from events group by 1")
def wf_14(spark, sf_dir):
    h = F.md5(F.concat(F.col("event_type"), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("sequence"), F.max_by(h, "event_id").alias("head"))


@query("wf_15_overrides", "select conv_id, turn from conversations where role = 'user' and length(trim(coalesce(text, ''))) >= 10")
def wf_15(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where((F.col("role") == "user") & (F.length(F.trim(F.coalesce("text", F.lit("")))) >= 10)).select("conv_id", "turn")


@query(
    "wf_17_proposal_problems",
    "with o as (select o_orderkey as k, o_custkey as c, o_orderdate::date as day, o_orderkey % 10 as chunk from orders) select k as proposal_id, 'UNKNOWN_RECORD' as problem, (-k)::varchar as item from o where k % 100 = 0 and k <> 0 union all select k, 'UNKNOWN_BREAK', '-1' from o where k % 77 = 0 "
    "union all select k, 'NOT_RETRIEVED', '99' from o where k % 50 = 1 union all select k, 'NOT_YET_EFFECTIVE', chunk::varchar from o where chunk % 2 = 0 and day < date '1993-01-01' union all select k, 'NO_LONGER_EFFECTIVE', chunk::varchar from o where chunk % 3 = 0 and day > date '1997-01-01' "
    "union all select k, 'FORBIDDEN_FIELD', 'approved' from o where k % 100 = 50",
)
def wf_17(spark, sf_dir):
    k, c, chunk = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey") % 10
    o = table(spark, sf_dir, "orders")
    day = lambda x: F.lit(x).cast("date")
    p = o.select(
        k.alias("proposal_id"), F.to_date("o_orderdate").alias("case_date"), F.when(k % 100 == 0, F.array(k, -k)).otherwise(F.array(k)).alias("record_ids"), F.when(k % 77 == 0, F.array(c, F.lit(-1).cast("long"))).otherwise(F.array(c)).alias("break_ids"),
        F.when(k % 50 == 1, F.array(chunk, F.lit(99).cast("long"))).otherwise(F.array(chunk)).alias("citations"), F.when(k % 100 == 50, F.array(F.lit("note"), F.lit("approved"))).otherwise(F.array(F.lit("note"))).alias("fields"),
    )
    trace = o.select(k.alias("proposal_id"), chunk.alias("chunk_id"), F.when(chunk % 2 == 0, day("1993-01-01")).alias("effective_from"), F.when(chunk % 3 == 0, day("1997-01-01")).alias("effective_to"))
    return lifecycle.proposal_problems(p, o.select(k.alias("id")), o.select(c.alias("id")), trace)


@query("wf_17_step_budget", "with s as (select user_id, event_id, value, sum(value) over (partition by user_id order by event_id) as used from events where value is not null) select event_id from s where used <= 500")
def wf_17_budget(spark, sf_dir):
    return lifecycle.within_budget(table(spark, sf_dir, "events").where("value is not null"), "user_id", "event_id", "value", 500).select("event_id")


@query("wf_18_pack_conflicts", "with c as (select distinct o_orderpriority as pack, o_custkey as code from orders) select a.pack as pack_a, b.pack as pack_b, count(*) as codes from c a join c b on a.code = b.code and a.pack < b.pack group by 1, 2")
def wf_18(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("pack"), F.col("o_custkey").alias("code"))
    return lifecycle.pack_conflicts(c).groupBy("pack_a", "pack_b").agg(F.count("*").alias("codes"))


@query("wf_21_list_page", "select o_orderkey, o_orderdate::date::varchar as day from orders order by o_orderdate desc nulls last, o_orderkey limit 25 offset 50")
def wf_21(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey").offset(50).limit(25).select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))


@query("wf_22_merged_history", "with u as (select c_custkey as id, 'memory' as place, 0 as p from customer union all select c_custkey, 'disk', 1 from customer where c_acctbal > 0), l as (select id, arg_max(place, p) as place from u group by 1) select * from l order by id desc limit 25")
def wf_22(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    u = c.drop("c_acctbal").withColumns({"place": F.lit("memory"), "p": F.lit(0)}).unionByName(c.where("c_acctbal > 0").drop("c_acctbal").withColumns({"place": F.lit("disk"), "p": F.lit(1)}))
    return u.groupBy("id").agg(F.max_by("place", "p").alias("place")).orderBy(F.desc("id")).limit(25)


@query("wf_23_queue_claim", "select event_type, arg_min(event_id, (ts, event_id)) as job from events where value > 10 group by 1")
def wf_23(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value > 10").groupBy("event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("job"))


@query("wf_24_sliding_limit", "with c as (select event_id, count(*) over (partition by event_type order by epoch(date_trunc('second', ts)) range between 60 preceding and current row) as recent from events) select event_id, recent from c where recent > 1")
def wf_24(spark, sf_dir):
    return lifecycle.over_limit(table(spark, sf_dir, "events"), "event_type", "ts", 1).select("event_id", "recent")


@query("wf_24_fixed_windows", "select event_type, epoch(time_bucket(interval 60 second, ts))::bigint as start, count(*) as n from events group by 1, 2")
def wf_24_fixed(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("t", "60 seconds").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("long").alias("start"), "n")


@query("wf_25_latest_per_run", "select user_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(value, (ts, event_id)) as value from events where value is not null group by 1")
def wf_25(spark, sf_dir):
    last = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("x")
    return table(spark, sf_dir, "events").where("value is not null").groupBy("user_id").agg(last).select("user_id", "x.event_type", "x.value")


@query("wf_26_newest_events", "select event_id, event_type from events order by event_id desc limit 200")
def wf_26(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(200)


@query("flt_02_break_filter", _CASES + " select case_id from c where (risk = 'High' or status = 'O') and contains(case_id::varchar, '77')")
def flt_02(spark, sf_dir):
    c = _cases(spark, sf_dir)
    return c.where(((F.col("risk") == "High") | (F.col("status") == "O")) & F.col("case_id").cast("string").contains("77")).select("case_id")


@query("flt_03_audit_filter", "select event_id from events where user_id = 7 and event_type in ('click', 'view')")
def flt_03(spark, sf_dir):
    return table(spark, sf_dir, "events").where((F.col("user_id") == 7) & F.col("event_type").isin("click", "view")).select("event_id")


@query("flt_04_approval_queue", _EV + " select event_id, status from e where status in ('PROPOSED', 'ACTION_PENDING') order by event_id limit 100")
def flt_04(spark, sf_dir):
    return _events(spark, sf_dir).where(F.col("status").isin("PROPOSED", "ACTION_PENDING")).orderBy("event_id").limit(100).select("event_id", "status")


@query("flt_05_blocking_breaks", _CASES + " select case_id from c where (risk = 'High' or age_days > 2000) and status <> 'F'")
def flt_05(spark, sf_dir):
    return _cases(spark, sf_dir).where("(risk = 'High' or age_days > 2000) and status <> 'F'").select("case_id")


@query("flt_06_open_periods", "select distinct strftime(o_orderdate, '%Y-%m') as period from orders where strftime(o_orderdate, '%Y-%m') not in (select strftime(l_shipdate, '%Y-%m') from lineitem where l_shipdate < timestamp '1996-01-01')")
def flt_06(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("period")).distinct()
    done = table(spark, sf_dir, "lineitem").where("l_shipdate < timestamp_ntz '1996-01-01'").select(F.date_format("l_shipdate", "yyyy-MM").alias("period")).distinct()
    return p.join(done, "period", "left_anti")


@query("agg_24_activity_counts", "select count(*) filter (where event_type = 'click') as clicks, count(distinct user_id) as users, count(*) filter (where value is null) as empty from events")
def agg_24(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value").isNull()).alias("empty"))


@query("agg_28_period_dashboard", "select strftime(o_orderdate, '%Y') as period, round(100 * count(*) filter (where o_orderstatus = 'F') / count(*), 2) as matched_pct, count(*) filter (where o_orderkey % 2 = 0) as side_a, count(*) filter (where o_orderkey % 2 = 1) as side_b from orders group by 1")
def agg_28(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy").alias("period")).agg(F.round(100 * F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 2).alias("matched_pct"), F.count_if(k % 2 == 0).alias("side_a"), F.count_if(k % 2 == 1).alias("side_b"))


@query("agg_29_reserved_bytes", "select coalesce(sum(p_size - p_partkey % 7), 0)::bigint as reserved from part where p_size > 40")
def agg_29(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size > 40").agg(F.coalesce(F.sum(F.col("p_size") - F.col("p_partkey") % 7), F.lit(0)).alias("reserved"))
