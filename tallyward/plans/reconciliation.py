"""Queries: matching, breaks, routing, normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.functions import explain, normalize, parsing
from tallyward.operators import imports, matching
from tallyward.plans.registry import query
from tallyward.session import table

# SOURCE_A is orders; SOURCE_B is orders with some rows dropped, shifted in time or amount, or repeated.
_REC = """with r as (
  select 'A' || o_orderkey as id, 'SOURCE_A' as side, o_custkey as account, case when o_custkey % 2 = 0 then 'USD' else 'EUR' end as currency, round(o_totalprice, 2)::decimal(28,8) as amount,
    case when o_orderkey % 2 = 0 then 'DR' else 'CR' end as direction, o_orderdate::date as value_date, 'R' || o_orderkey as reference from orders
  union all
  select 'B' || o_orderkey, 'SOURCE_B', o_custkey, case when o_custkey % 2 = 0 then 'USD' else 'EUR' end, (round(o_totalprice, 2)::decimal(28,8) + case when o_orderkey % 11 = 0 then 25 when o_orderkey % 13 = 0 then 0.5 else 0 end)::decimal(28,8),
    case when o_orderkey % 2 = 0 then 'DR' else 'CR' end, o_orderdate::date + (case when o_orderkey % 7 = 0 then 2 else 0 end)::int, case when o_orderkey % 17 = 0 then '' else 'R' || o_orderkey end from orders where o_orderkey % 10 <> 3
) """
_L1 = ", g as (select count(*) filter (where side = 'SOURCE_A') as na, count(*) filter (where side = 'SOURCE_B') as nb, max(case when side = 'SOURCE_A' then id end) as a_id, max(case when side = 'SOURCE_B' then id end) as b_id from r where trim(coalesce(reference, '')) <> '' group by account, currency, direction, amount, value_date, reference), l1 as (select a_id, b_id from g where na = 1 and nb = 1)"
_L2 = ", m1 as (select a_id as id from l1 union all select b_id from l1), rest as (select * from r where id not in (select id from m1) and trim(reference) <> ''), p as (select a.id as a_id, b.id as b_id from rest a join rest b on a.side = 'SOURCE_A' and b.side = 'SOURCE_B' and a.account = b.account and a.currency = b.currency and a.direction = b.direction and abs(date_diff('day', a.value_date, b.value_date)) <= 2 and abs(a.amount - b.amount) <= 1), u as (select a_id, max(b_id) as b_id from p group by a_id having count(*) = 1), l2 as (select max(a_id) as a_id, b_id from u group by b_id having count(*) = 1)"
_M = ", m as (select a_id as id, 'L1' as rule from l1 union all select b_id, 'L1' from l1 union all select a_id, 'L2' from l2 union all select b_id, 'L2' from l2)"


def _records(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    price = F.round("o_totalprice", 2).cast("decimal(28,8)")
    shift = F.when(k % 11 == 0, 25).when(k % 13 == 0, 0.5).otherwise(0)
    common = [F.col("o_custkey").alias("account"), F.when(F.col("o_custkey") % 2 == 0, "USD").otherwise("EUR").alias("currency"), F.when(k % 2 == 0, "DR").otherwise("CR").alias("direction")]
    ref = F.concat(F.lit("R"), k.cast("string"))
    day = F.to_date("o_orderdate")
    a = o.select(F.concat(F.lit("A"), k.cast("string")).alias("id"), F.lit("SOURCE_A").alias("side"), *common, price.alias("amount"), day.alias("value_date"), ref.alias("reference"))
    b = o.where(k % 10 != 3).select(F.concat(F.lit("B"), k.cast("string")).alias("id"), F.lit("SOURCE_B").alias("side"), *common, (price + shift.cast("decimal(10,2)")).cast("decimal(28,8)").alias("amount"), F.date_add(day, F.when(k % 7 == 0, 2).otherwise(0)).alias("value_date"), F.when(k % 17 == 0, "").otherwise(ref).alias("reference"))
    return a.unionByName(b)


@query("join_01_exact_pairs", _REC + _L1 + " select * from l1")
def join_01(spark, sf_dir):
    return matching.exact_pairs(_records(spark, sf_dir))


@query("join_02_tolerance_pairs", _REC + _L1 + _L2 + " select * from l2")
def join_02(spark, sf_dir):
    r = _records(spark, sf_dir)
    done = matching.exact_pairs(r).select(F.explode(F.array("a_id", "b_id")).alias("id"))
    return matching.tolerance_pairs(r.join(done, "id", "left_anti"), days=2, absolute=1)


@query("join_03_day_window", "select count(*) as n from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and abs(date_diff('day', a.o_orderdate::date, b.o_orderdate::date)) <= 3")
def join_03(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"))
    a, b = o.alias("a"), o.alias("b")
    return a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")) & matching.within_days(F.col("a.d"), F.col("b.d"), 3)).agg(F.count("*").alias("n"))


@query("join_04_amount_band", "with p as (select a.o_orderkey as x, b.o_orderkey as y, round(a.o_totalprice, 2)::decimal(28,8) as ax, round(b.o_totalprice, 2)::decimal(28,8) as bx from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey) select x, y from p where abs(ax - bx) <= greatest(100::decimal(28,8), greatest(ax, bx) * 0.005)")
def join_04(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).cast("decimal(28,8)").alias("p"))
    a, b = o.alias("a"), o.alias("b")
    on = (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")) & matching.within_band(F.col("a.p"), F.col("b.p"), 100, 0.005)
    return a.join(b, on).select(F.col("a.o_orderkey").alias("x"), F.col("b.o_orderkey").alias("y"))


@query("join_05_group_matches")
def join_05(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    base = o.select(F.col("o_custkey").alias("account"), F.lit("USD").alias("currency"), k, F.round("o_totalprice", 0).alias("p"))
    whole = base.select("account", "currency", F.concat(F.lit("A"), k.cast("string")).alias("id"), F.lit("SOURCE_A").alias("side"), F.lit("CR").alias("direction"), F.col("p").alias("amount"))
    part = lambda i, share: base.where(k % 3 == 0).select("account", "currency", F.concat(F.lit(f"B{i}-"), k.cast("string")).alias("id"), F.lit("SOURCE_B").alias("side"), F.lit("DR").alias("direction"), share.alias("amount"))
    records = whole.unionByName(part(1, F.floor(F.col("p") / 2).cast("double"))).unionByName(part(2, F.col("p") - F.floor(F.col("p") / 2)))
    return matching.group_matches(records)


@query("join_06_isolating_guard", _REC + ", d as (select *, case when account % 3 = 0 then null else account % 4 end as fund from r) select a.id as a_id, b.id as b_id from d a join d b on a.side = 'SOURCE_A' and b.side = 'SOURCE_B' and a.reference = b.reference and a.fund is not distinct from b.fund where a.reference <> ''")
def join_06(spark, sf_dir):
    d = _records(spark, sf_dir).where("reference <> ''").withColumn("fund", F.when(F.col("account") % 3 != 0, F.col("account") % 4))
    a, b = d.where("side = 'SOURCE_A'").alias("a"), d.where("side = 'SOURCE_B'").alias("b")
    return a.join(b, (F.col("a.reference") == F.col("b.reference")) & F.col("a.fund").eqNullSafe(F.col("b.fund"))).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


@query("join_07_mixed_groups", "select o_custkey as g, count(distinct o_orderstatus) as n_values from orders group by 1 having count(distinct o_orderstatus) > 1")
def join_07(spark, sf_dir):
    return matching.mixed_groups(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "g"), "g", "o_orderstatus")


@query("join_08_cascade", _REC + _L1 + _L2 + _M + " select rule, count(*) as n from m group by 1")
def join_08(spark, sf_dir):
    return matching.cascade(_records(spark, sf_dir), days=2, absolute=1).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "join_09_breaks",
    _REC + _L1 + _L2 + _M + ", l as (select * from r where id not in (select id from m)), t as (select *, count(*) over (partition by side, account, currency, direction, amount, value_date, reference) as same, max(case when side = 'SOURCE_A' then amount end) over (partition by account, currency, reference) as am, max(case when side = 'SOURCE_B' then amount end) over (partition by account, currency, reference) as bm from l) "
    "select id, case when same > 1 then 'DUP-01' when case when side = 'SOURCE_A' then bm else am end is not null and case when side = 'SOURCE_A' then bm else am end <> amount then 'AMT-02' else 'TIM-01' end as code from t",
)
def join_09(spark, sf_dir):
    r = _records(spark, sf_dir)
    return matching.breaks(r, matching.cascade(r, days=2, absolute=1))


_CYCLE = (
    _REC.replace("with r as (", "with r0 as (") + ", own as (select *, strftime(value_date, '%Y-%m') as period from r0 where strftime(value_date, '%m') <> '01'), r as (select id, side, period || '|' || account as account, currency, amount, direction, value_date, reference, period from own where not (id like 'A%' and period < '1993-01') and not period = '1995-06')"
    + _L1 + _L2 + _M
)


@query(
    "wf_19_scheduled_cycle",
    _CYCLE + ", o as (select period, count(*) as n_open from r group by 1), n as (select period, count(*) as n_matched from m join r using (id) group by 1), a as (select distinct period from own) "
    "select a.period, coalesce(n_open, 0) as n_open, coalesce(n_matched, 0) as n_matched, coalesce(n_open, 0) - coalesce(n_matched, 0) as n_breaks, case when n_open is null then 'SKIPPED' else 'RECONCILED' end as status from a left join o using (period) left join n using (period)",
)
def wf_19(spark, sf_dir):
    """January periods are certified; records of source A before 1993 and all of June 1995 were matched by earlier cycles."""
    from tallyward.operators.cycle import run_cycle

    r = _records(spark, sf_dir)
    period = F.date_format("value_date", "yyyy-MM")
    matched = r.where((F.col("id").startswith("A") & (period < "1993-01")) | (period == "1995-06")).select("id")
    periods = r.select(period.alias("period")).distinct().withColumn("status", F.when(F.col("period").endswith("-01"), "CERTIFIED").otherwise("OPEN"))
    return run_cycle(r, matched, periods, period, days=2, absolute=1)[2]


@query("join_10_resolved_cases", _REC + _L1 + ", m as (select a_id as id from l1 union all select b_id from l1), c as (select o_custkey as case_id, 'A' || o_orderkey as id from orders) select case_id from c left join m using (id) group by 1 having count(*) = count(m.id)")
def join_10(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.collect_list(F.concat(F.lit("A"), F.col("o_orderkey").cast("string"))).alias("record_ids"))
    m = matching.exact_pairs(_records(spark, sf_dir)).select(F.explode(F.array("a_id", "b_id")).alias("id"))
    return matching.resolved_cases(c, m)


_CHOSEN = "select o_orderkey // 4 as g, o_orderkey::varchar as id, o_custkey % 9 = 0 as other, case when o_orderkey % 2 = 0 then 'SOURCE_A' else 'SOURCE_B' end as side, case when o_orderkey % 2 = 0 then 1 else -1 end * floor(o_totalprice / 20000) as signed from orders"


@query(
    "join_11_manual_match",
    f"with c as ({_CHOSEN}), s as (select g, count(distinct id) as n, count(distinct other) as c, count(distinct side) as s, abs(sum(signed)) as net from c group by g) "
    "select g, 'fewer than two records' as problem from s where n < 2 union all select g, 'several currencies' from s where c > 1 union all select g, 'one side only' from s where s < 2 union all select g, 'does not net to zero' from s where net > 0.01",
)
def join_11(spark, sf_dir):
    k = F.col("o_orderkey")
    chosen = table(spark, sf_dir, "orders").select(
        F.floor(k / 4).alias("g"), k.cast("string").alias("id"), F.when(F.col("o_custkey") % 9 == 0, "EUR").otherwise("USD").alias("currency"), F.when(k % 2 == 0, "SOURCE_A").otherwise("SOURCE_B").alias("side"),
        F.when(k % 2 == 0, "CR").otherwise("DR").alias("direction"), F.floor(F.col("o_totalprice") / 20000).alias("amount"),
    )
    return matching.manual_match_problems(chosen, "g")


@query("join_12_unmatch", "with e as (select o_orderkey as match_id, o_orderkey % 3 = 0 as reversed from orders) select count(*) filter (where not reversed) as active, count(*) filter (where reversed) as reversed from e")
def join_12(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), F.lit("MATCHED").alias("status"), F.lit(1).alias("seq"))
    history = m.unionByName(m.where("match_id % 3 = 0").withColumns({"status": F.lit("REVERSED"), "seq": F.lit(2)}))
    last = history.groupBy("match_id").agg(F.max_by("status", "seq").alias("status"))
    return last.agg(F.count_if(F.col("status") == "MATCHED").alias("active"), F.count_if(F.col("status") == "REVERSED").alias("reversed"))


_UNMATCH = (
    "with q as (select l_orderkey * 10 + l_linenumber as request_id, l_orderkey as match_id, case when l_linenumber = 2 then 'CHECKER' else 'MAKER' end as role, case when l_linenumber = 1 and l_orderkey % 3 = 0 then '  ' else l_linestatus end as reason from lineitem), "
    "m as (select o_orderkey as match_id, o_orderkey % 5 = 0 as reversed, o_orderdate >= timestamp '1995-01-01' as opened from orders where o_orderkey % 7 <> 0), "
    "p as (select q.request_id, q.match_id, case when role <> 'MAKER' then 'ROLE' when trim(reason) = '' then 'REASON' when m.match_id is null then 'NOT_FOUND' when reversed then 'ALREADY_REVERSED' when not opened then 'PERIOD_CLOSED' end as problem from q left join m using (match_id)), "
    "a as (select request_id, match_id, case when problem is null and request_id > min(case when problem is null then request_id end) over (partition by match_id) then 'ALREADY_REVERSED' else problem end as problem from p) "
)


def _unmatch(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    requests = l.select((k * 10 + n).alias("request_id"), k.alias("match_id"), F.when(n == 2, "CHECKER").otherwise("MAKER").alias("role"), F.when((n == 1) & (k % 3 == 0), "  ").otherwise(F.col("l_linestatus")).alias("reason"))
    period = F.date_format("o_orderdate", "yyyy-MM").alias("period")
    matches = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("match_id"), period, (F.col("o_orderkey") % 5 == 0).alias("reversed"))
    return matching.unmatch(requests, matches, o.select(period).where("period >= '1995-01'"))


@query("join_12_unmatch_requests", _UNMATCH + "select * from a")
def join_12_requests(spark, sf_dir):
    return _unmatch(spark, sf_dir).select("request_id", "match_id", "problem")


@query("join_12_records_after", _UNMATCH + ", g as (select distinct match_id from a where problem is null) select o_orderkey as match_id, case when o_orderstatus = 'P' then 'HELD' when g.match_id is not null then 'UNMATCHED' else 'MATCHED' end as status from orders left join g on g.match_id = o_orderkey")
def join_12_after(spark, sf_dir):
    members = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderstatus") == "P", "HELD").otherwise("MATCHED").alias("status"))
    return matching.after_unmatch(members, _unmatch(spark, sf_dir)).select("match_id", "status")


_ROUTES = [(1, "AMT", None, 100000.0, "analyst", True), (2, "AMT", 100000.0, 300000.0, "senior", False), (3, "AMT", 300000.0, None, "controller", False), (4, "TIM", None, None, "analyst", True), (5, "TIM", 400000.0, None, "senior", False)]
_ROUTE_SQL = "(values " + ", ".join(f"({o}, '{f}', {'null' if g is None else g}, {'null' if l is None else l}, '{r}', {str(a).lower()})" for o, f, g, l, r, a in _ROUTES) + ") rules(ord, family, gte, lt, role, allow_auto)"


@query("join_16_routing", f"with c as (select o_orderkey as case_id, case when o_orderkey % 2 = 0 then 'AMT' else 'TIM' end as family, o_totalprice as amount from orders) select case_id, arg_max(role, coalesce(gte, -1e308) - ord * 1e-6) as role, bool_and(allow_auto) as auto_match from c join {_ROUTE_SQL} using (family) where amount >= coalesce(gte, -1e308) and amount < coalesce(lt, 1e308) group by 1")
def join_16(spark, sf_dir):
    rules = spark.createDataFrame(_ROUTES, "ord int, family string, gte double, lt double, role string, allow_auto boolean")
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 2 == 0, "AMT").otherwise("TIM").alias("family"), F.col("o_totalprice").alias("amount"))
    return matching.resolve_routing(c, rules)


@query("join_17_policy_eligibility", "with c as (select o_orderkey as case_id, o_orderstatus as category, o_orderkey % 120 as dpd, o_orderkey % 3 <> 0 as declared from orders), p as (select * from (values ('P1', ['F', 'O'], 60, true), ('P2', ['P'], 90, true), ('P3', ['F'], 200, false)) t(policy_id, categories, most_dpd, active)) select case_id, policy_id from c join p on active and list_contains(categories, category) and dpd between 0 and most_dpd where declared")
def join_17(spark, sf_dir):
    p = spark.createDataFrame([("P1", ["F", "O"], 60, True), ("P2", ["P"], 90, True), ("P3", ["F"], 200, False)], "policy_id string, categories array<string>, most_dpd int, active boolean")
    k = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").select(k.alias("case_id"), F.col("o_orderstatus").alias("category"), (k % 120).alias("dpd"), (k % 3 != 0).alias("declared"))
    return matching.eligible_policies(c, p)


_FIRED = "list_sort(list_distinct(list(o_orderpriority) filter (where o_orderstatus = '{}')))"


@query(
    "join_18_evidence_difference",
    f"with e as (select o_custkey, coalesce({_FIRED.format('F')}, []) as x, coalesce({_FIRED.format('O')}, []) as y from orders group by 1) "
    "select o_custkey, array_to_string(list_filter(x, lambda v: not list_contains(y, v)), ',') as only_a, array_to_string(list_filter(y, lambda v: not list_contains(x, v)), ',') as only_b, array_to_string(list_filter(x, lambda v: list_contains(y, v)), ',') as common from e",
)
def join_18(spark, sf_dir):
    fired = lambda status: F.collect_set(F.when(F.col("o_orderstatus") == status, F.col("o_orderpriority")))
    d = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(fired("F").alias("x"), fired("O").alias("y"))
    d = d.select("o_custkey", matching.evidence_difference(F.col("x"), F.col("y")).alias("e"))
    return d.select("o_custkey", *[F.array_join(f"e.{c}", ",").alias(c) for c in ("only_a", "only_b", "common")])


@query("join_20_incomplete_accounts", _REC + " select account, case when count(*) filter (where side = 'SOURCE_A') = 0 then 'SOURCE_A' else 'SOURCE_B' end as missing_side from r where account % 3 = 0 or side = 'SOURCE_A' group by 1 having count(distinct side) < 2")
def join_20(spark, sf_dir):
    return matching.incomplete_accounts(_records(spark, sf_dir).where("account % 3 = 0 or side = 'SOURCE_A'"))


@query("join_21_draft_eligible", "select o_orderkey from orders where o_orderstatus = 'O' and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def join_21(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(d, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


# --- scalar functions -----------------------------------------------------------------------------


_KIND = "case o_orderkey % 7 when 0 then null when 1 then '  ' when 2 then 'N/A' when 3 then ' Unknown' when 4 then '-' when 5 then 'none' else o_orderstatus end"


@query("fn_01_null_kind", f"select o_orderkey, {_KIND} as raw, case o_orderkey % 7 when 0 then 'NULL' when 1 then 'EMPTY' when 2 then 'UNKNOWN_LITERAL' when 3 then 'UNKNOWN_LITERAL' else 'VALUE' end as kind from orders")
def fn_01(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_KIND).alias("raw"))
    return o.withColumn("kind", parsing.null_kind(F.col("raw")))


#: Shapes of a date by key % 12; what a reader with the month first, or the day first, makes of each.
_SHAPES = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "yyyyMMdd", "d MMM yyyy", "MMMM d, yyyy", "dd-MMM-yy", "EEE, dd MMM yyyy HH:mm:ss '+0500'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy MMM dd 'at' hh:mm a", "yyyy-MM-dd 'foo'")
_DAY = "o_orderdate::date"
_SWAPPED = f"case when day(o_orderdate) <= 12 then make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) else {_DAY} end"


def _dates(spark, sf_dir, dayfirst):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % len(_SHAPES)
    raw = F.lit(None).cast("string")
    for i, shape in enumerate(_SHAPES):
        raw = F.when(k == i, F.date_format("o_orderdate", shape)).otherwise(raw)
    return o.select("o_orderkey", normalize.normalize_date(raw, dayfirst).cast("string").alias("day"))


@query("fn_02_normalize_date", f"select o_orderkey, (case o_orderkey % 12 when 1 then {_SWAPPED} when 3 then {_SWAPPED} when 11 then null else {_DAY} end)::varchar as day from orders")
def fn_02(spark, sf_dir):
    return _dates(spark, sf_dir, False)


@query("fn_02_day_first", f"select o_orderkey, (case o_orderkey % 12 when 0 then {_SWAPPED} when 2 then {_SWAPPED} when 4 then {_SWAPPED} when 9 then {_SWAPPED} when 11 then null else {_DAY} end)::varchar as day from orders")
def fn_02_day_first(spark, sf_dir):
    return _dates(spark, sf_dir, True)


@query(
    "fn_03_normalize_amount",
    "with a as (select o_orderkey, o_orderkey % 9 as shape, case o_orderkey % 9 when 5 then floor(o_totalprice) when 8 then null else round(o_totalprice, 2) end::decimal(28,8) as amount from orders) "
    "select o_orderkey, amount::varchar as amount, case when shape in (1, 3, 4) then 'DR' when amount is not null then 'CR' end as direction from a",
)
def fn_03(spark, sf_dir):
    k, x = F.col("o_orderkey") % 9, F.col("o_totalprice")
    grouped, plain = F.format_number(x, 2), F.format_string("%.2f", x)
    shapes = [grouped, F.concat(F.lit("("), grouped, F.lit(")")), F.translate(grouped, ",.", ".,"), F.concat(plain, F.lit("-")), F.concat(F.lit("-"), F.translate(plain, ".", ",")), F.format_number(F.floor(x), 0), F.concat(F.lit("USD "), plain), F.concat(grouped, F.lit(" +")), F.lit("1-2.x")]
    raw = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        raw = F.when(k == i, shape).otherwise(raw)
    d = table(spark, sf_dir, "orders").select("o_orderkey", normalize.normalize_amount(raw).alias("a"))
    return d.select("o_orderkey", F.col("a.amount").cast("string").alias("amount"), "a.direction")


_CODES = "case c_custkey % 7 when 0 then ' usd ' when 1 then 'EUR' when 2 then 'ang' when 3 then 'SVC' when 4 then 'XDR' when 5 then 'US' else c_mktsegment end"


@query("fn_04_normalize_currency", "select c_custkey, case c_custkey % 7 when 0 then 'USD' when 1 then 'EUR' when 2 then 'ANG' when 4 then 'XDR' end as currency from customer")
def fn_04(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", normalize.normalize_currency(F.expr(_CODES)).alias("currency"))


@query("fn_05_normalize_reference", "select s_suppkey, upper(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) as reference from supplier")
def fn_05(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", normalize.normalize_reference(F.col("s_name")).alias("reference"))


_NAMES = "case s_suppkey % 7 when 0 then s_name || ' Ltd.' when 1 then s_name || ' Co., LTD' when 2 then s_name || '  Private   limited' when 3 then s_name || ' & Company' when 4 then ' ' || s_name || ' GmbH ' when 5 then s_name || ' LLP,' else s_name || ' LtdCo' end"


@query("fn_06_normalize_counterparty", "select s_suppkey, case s_suppkey % 7 when 3 then s_name || ' & Company' when 6 then s_name || ' LtdCo' else s_name end as name from supplier")
def fn_06(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", normalize.normalize_counterparty(F.expr(_NAMES)).alias("name"))


@query("fn_07_normalize_description", "select conv_id, turn, md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) as digest from conversations where coalesce(text, '') = nfc_normalize(coalesce(text, '')) and not regexp_matches(coalesce(text, ''), '[^\\x20-\\x7E\\n\\t\\r]')")
def fn_07(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("t", F.coalesce("text", F.lit(""))).where(~F.col("t").rlike(r"[^\x20-\x7E\n\t\r]"))
    return c.select("conv_id", "turn", F.md5(normalize.normalize_description(F.col("t"))).alias("digest"))


_RAW_IMPORT = "o_orderkey, strftime(o_orderdate, '%Y-%m') as batch, case when o_orderkey % 1009 = 0 then 1 when o_orderkey % 1013 = 0 then 2 when o_orderkey % 1019 = 0 then 3 when o_orderkey % 1021 = 0 then 4 when o_orderkey % 1031 = 0 then 5 when o_orderkey % 1033 = 0 then 6 when o_orderkey % 1039 = 0 then 7 else 0 end as fault"
_FAULTS = "case fault when 1 then 'AMOUNT_FORMAT' when 2 then 'AMOUNT_RANGE' when 3 then 'DIRECTION' when 4 then 'VALUE_DATE' when 5 then 'OUTSIDE_PERIOD' when 6 then 'CURRENCY' when 7 then 'REFERENCE' end"


def _imported(spark, sf_dir):
    k, plain = F.col("o_orderkey"), F.format_string("%.2f", "o_totalprice")
    fault = F.lit(0)
    for code, prime in reversed(list(enumerate((1009, 1013, 1019, 1021, 1031, 1033, 1039), 1))):
        fault = F.when(k % prime == 0, code).otherwise(fault)
    o = table(spark, sf_dir, "orders").withColumn("fault", fault)
    at = lambda code, bad, good: F.when(F.col("fault") == code, bad).otherwise(good)
    amount = F.when(F.col("fault") == 1, F.concat(plain, F.lit("1234567"))).when(F.col("fault") == 2, "100000000000000000000").otherwise(F.concat(F.lit(" "), plain))
    day = F.when(F.col("fault") == 4, F.date_format("o_orderdate", "yyyy-MM-dd HH")).when(F.col("fault") == 5, F.date_format(F.add_months("o_orderdate", 1), "yyyy-MM-dd")).when(k % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    raw = o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("batch"), amount.alias("Amt"), at(6, "SVC", " usd").alias("Ccy"), at(3, "X", "dr ").alias("Side"), day.alias("Day"), at(7, "--", F.concat(F.lit("ref-"), k.cast("string"))).alias("Ref"))
    mapping = {"amount": "Amt", "currency": "Ccy", "direction": "Side", "value_date": "Day", "reference": "Ref"}
    return imports.validated(imports.apply_mapping(raw, mapping, ("o_orderkey", "batch")), "batch")


@query("fn_08_import_validation", f"select o_orderkey, {_FAULTS} as problem from (select {_RAW_IMPORT} from orders) where fault > 0")
def fn_08(spark, sf_dir):
    return _imported(spark, sf_dir).where("problem is not null").select("o_orderkey", "problem")


_BATCHES = f"with r as (select {_RAW_IMPORT} from orders), b as (select batch, count(*) as n_rows, count(*) filter (where fault > 0) as n_errors, count(*) + (batch like '%-03')::int as expected from r group by 1), s as (select *, n_rows - n_errors <> expected as row_count_error from b)"


def _reports(spark, sf_dir):
    rows = _imported(spark, sf_dir)
    expected = rows.groupBy("batch").agg(F.count("*").alias("n")).select("batch", (F.col("n") + F.col("batch").endswith("-03").cast("int")).alias("expected"))
    return rows, imports.batch_reports(rows, "batch", expected)


@query("fn_08_held_batches", _BATCHES + " select batch, n_rows, n_errors, row_count_error, case when n_errors > 0 or row_count_error then 'HELD' else 'ACCEPTED' end as status from s")
def fn_08_batches(spark, sf_dir):
    return _reports(spark, sf_dir)[1]


@query("fn_08_accepted_rows", _BATCHES + " select o_orderkey, reference as reference_canonical, amount from (select r.o_orderkey, 'REF' || r.o_orderkey as reference, round(o.o_totalprice, 2)::decimal(28,8)::varchar as amount from r join s using (batch) join orders o on o.o_orderkey = r.o_orderkey where s.n_errors = 0 and not s.row_count_error)")
def fn_08_accepted(spark, sf_dir):
    rows, reports = _reports(spark, sf_dir)
    return imports.accepted(rows, reports, "batch").select("o_orderkey", "reference_canonical", F.col("typed_amount").cast("string").alias("amount"))


@query("fn_09_apply_mapping", "select o_orderkey::varchar as reference, o_totalprice::varchar as amount, o_orderstatus as direction, o_orderpriority as currency, o_orderdate::date::varchar as value_date from orders")
def fn_09(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return imports.apply_mapping(o, {"reference": "o_orderkey", "amount": "o_totalprice", "direction": "o_orderstatus", "currency": "o_orderpriority", "value_date": "day"})


_PHRASES = "case o_orderkey % 8 when 0 then 'My salary has been delayed' when 1 then 'I cannot afford this' when 2 then 'we never paid' when 3 then 'Order ' || o_orderstatus when 4 then 'Income reduced; unable to pay' when 5 then 'wages were stopped' when 6 then 'It is resolved, I cannot pay' else 'We can''t manage it' end"


@query(
    "fn_12_hardship",
    "with c as (select o_orderkey, o_orderkey % 8 as shape, o_orderkey % 11 = 0 as declared from orders) select o_orderkey, case when declared then 'DECLARED' when shape in (0, 1, 4, 7) then 'INFERRED_SIGNAL' else 'UNKNOWN' end as status, "
    "case when declared then 'job_loss' when shape in (0, 4) then 'temporary_income_disruption' when shape in (1, 7) then 'payment_difficulty' end as category, "
    "case when declared then 'member_declared_form' when shape in (2, 6) then 'text_requires_review' when shape in (3, 5) then 'unknown' else 'member_text' end as source, "
    "case when declared then null when shape = 0 then 'my salary has been delayed' when shape = 1 then 'cannot afford' when shape = 4 then 'income reduced' when shape = 7 then 'can''t manage' end as evidence from c",
)
def fn_12(spark, sf_dir):
    k = F.col("o_orderkey")
    h = normalize.hardship(F.expr(_PHRASES), F.when(k % 11 == 0, "job_loss"))
    return table(spark, sf_dir, "orders").select(k, h.alias("h")).select("o_orderkey", "h.status", "h.category", "h.source", "h.evidence")


@query("fn_13_period_and_age", "select o_orderkey, strftime(o_orderdate + interval 1 month, '%Y-%m') as next_period, date_diff('day', o_orderdate::date, date '2002-01-01') as age_days from orders where day(o_orderdate) <= 28")
def fn_13(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.dayofmonth("o_orderdate") <= 28)
    return o.select("o_orderkey", normalize.next_period(F.date_format("o_orderdate", "yyyy-MM")).alias("next_period"), F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate")).cast("long").alias("age_days"))


@query("fn_14_money_string", "select c_custkey, c_acctbal::decimal(20,2)::varchar as money from customer")
def fn_14(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(20,2)").cast("string").alias("money"))


@query("fn_15_risk_label", "select p_partkey, case when p_size % 10 >= 6 then 'High' when p_size % 10 >= 3 then 'Medium' else 'Low' end as risk from part")
def fn_15(spark, sf_dir):
    w = F.col("p_size") % 10
    return table(spark, sf_dir, "part").select("p_partkey", F.when(w >= 6, "High").when(w >= 3, "Medium").otherwise("Low").alias("risk"))


_NARRATIVE = "'Total ' || format_string('%.2f', o_totalprice) || ' for ' || o_custkey || ' of 1,000 rows, ' || (o_orderkey % 40) || ' late, 12.5% open'"


@query(
    "fn_16_numeric_grounding",
    "with c as (select o_orderkey, round(o_totalprice, 2) as e, [o_custkey::varchar, '1,000', (o_orderkey % 40)::varchar, '12.5%'] as said, [o_custkey::double, 1000.0, (o_orderkey % 40)::double, 12.5] as v from orders), "
    "x as (select o_orderkey, unnest(said) as said, unnest(v) as v, unnest([1, 2, 3, 4]) as place, e from c) "
    "select o.o_orderkey, coalesce(string_agg(said, ' ' order by place), '') as loose from orders o left join (select * from x where not (v = floor(v) and abs(v) <= 20) and abs(v - e) > greatest(0.01, abs(e) * 0.01)) x on x.o_orderkey = o.o_orderkey group by 1",
)
def fn_16(spark, sf_dir):
    loose = normalize.ungrounded_numbers(F.expr(_NARRATIVE), F.array("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(loose, " ").alias("loose"))


@query("fn_19_explanation_text", "select event_id, 'Value ' || printf('%.2f', value) || ' of user ' || user_id || ' is ' || case when value > 150 then 'high' else 'usual' end as message from events where value is not null")
def fn_19(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.select("event_id", F.format_string("Value %.2f of user %d is %s", F.col("value"), F.col("user_id"), F.when(F.col("value") > 150, "high").otherwise("usual")).alias("message"))


_FINDING = (
    "with f as (select e.event_id, case when e.event_id % 9 = 0 then 'column-level' else e.event_id::varchar end as r, e.event_type as model, floor(e.value)::bigint::varchar as score, (0.55 + e.event_id % 45 / 100)::decimal(4,2)::varchar as conf, 'value above ' || e.user_id as threshold, "
    "case when e.event_id % 4 > 0 then 'value' end as feature, 'far from ' || e.user_id as reason, 'Value of user ' || e.user_id as message, case when e.event_id % 2 = 0 then 'Check ' || e.event_type end as act, "
    "lower(coalesce(c.text, '')) || case c.turn % 4 when 0 then ' why?' when 1 then ' which score?' when 2 then ' karna?' else '' end as q, c.turn from events e join conversations c on c.conv_id = e.event_id where e.value is not null and c.role = 'user') "
)
_has = lambda words: "(" + " or ".join(f"contains(q, '{w}')" for w in words.split()) + ")"


def _findings(spark, sf_dir):
    k, u = F.col("event_id"), F.col("user_id").cast("string")
    driver = F.struct(F.lit("value").alias("feature"), F.concat(F.lit("far from "), u).alias("reason"))
    finding = F.struct(
        F.when(k % 9 != 0, k).alias("row"), F.col("event_type").alias("model"), F.lit("median").alias("method"), F.lit("L2").alias("layer"), F.floor("value").alias("score"), F.lit("high").alias("severity"), (0.55 + k % 45 / 100).cast("decimal(4,2)").alias("confidence"),
        F.concat(F.lit("value above "), u).alias("threshold"), F.concat(F.lit("Value of user "), u).alias("message"), F.when(k % 4 > 0, F.array(driver)).otherwise(F.array().cast("array<struct<feature:string,reason:string>>")).alias("drivers"),
        F.when(k % 2 == 0, F.concat(F.lit("Check "), "event_type")).alias("recommended_action"),
    )
    asked = F.concat(F.coalesce("text", F.lit("")), F.element_at(F.array(F.lit(" WHY?"), F.lit(" which Score?"), F.lit(" karna?"), F.lit("")), (F.col("turn") % 4 + 1).cast("int")))
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("event_id"), "turn", asked.alias("asked"))
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", finding.alias("finding")).join(c, "event_id")


@query(
    "fn_19_intent_reply",
    _FINDING + "select event_id, turn, case when " + _has("why kyun kyo reason waja") + " then 'This anomaly was flagged because ' || case when feature is null then message else feature || ' (' || reason || ')' end || '. The detector was ' || model || ' using median.' "
    "when " + _has("threshold score confidence risk") + " then 'The score is ' || score || ' on a capped 0-100 risk index, with confidence ' || conf || '. The threshold was: ' || threshold || '.' "
    "when " + _has("fix action karna next review") + " then coalesce(act, 'Review the row values and verify the source record.') "
    "else 'For row ' || r || ', the main finding is: ' || message || ' Main drivers: ' || case when feature is null then 'model threshold evidence' else feature || ' (' || reason || ')' end || '.' end as reply from f",
)
def fn_19_reply(spark, sf_dir):
    return _findings(spark, sf_dir).select("event_id", "turn", explain.reply(F.col("asked"), F.col("finding")).alias("reply"))


@query(
    "fn_19_finding_explanation",
    _FINDING + "select distinct event_id, 'Row ' || r || ' was flagged by ' || model || ' in L2. The score is ' || score || ' (high) because ' || case when feature is null then message else feature || ': ' || reason end || '. Threshold used: ' || threshold || '. Recommended next step: ' || coalesce(act, 'Review the source record.') as text from f",
)
def fn_19_explanation(spark, sf_dir):
    return _findings(spark, sf_dir).select("event_id", explain.explanation(F.col("finding")).alias("text")).distinct()
