"""Queries: risk flags, rules, scoring, sampling, projection and ranking."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tallyward.operators import ordering, risk, rules, sampling
from tallyward.plans.registry import query
from tallyward.session import table

_DAY = date(2024, 6, 30)
_PACK = rules.RulePack(
    "payments", "1.0.0",
    (
        rules.Rule("big_refund", "value > 200 and event_type == 'purchase'", "critical"),
        rules.Rule("odd_user", "user_id % 7 == 3 and not value < 20", "medium"),
        rules.Rule("log_scale", "round(log(value + 1), 1) >= 4.5", "high"),
        rules.Rule("old", "value > 0", "low", effective_to=date(2020, 1, 1)),
        rules.Rule("no_column", "approvers < 2", "critical"),
    ),
)
_HITS = "coalesce(value > 200 and event_type = 'purchase', false) as big_refund, coalesce(user_id % 7 = 3, false) and not coalesce(value < 20, false) as odd_user, coalesce(round_even(ln(value + 1), 1) >= 4.5, false) as log_scale"
_RULES = f"with h as (select *, {_HITS} from events), r as (select *, greatest(0, case when big_refund then 100 else 0 end, case when odd_user then 45 else 0 end, case when log_scale then 75 else 0 end) as rule_score from h) "


@query("rsk_01_amount_flags", "select count(*) filter (where c_acctbal is null) as missing, count(*) filter (where c_acctbal < 0) as negative, count(*) filter (where c_acctbal = 0) as zero, count(*) filter (where c_acctbal <> 0 and c_acctbal % 1000 = 0) as round_amount from customer")
def rsk_01(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumns(risk.amount_flags(F.col("c_acctbal")))
    return c.agg(*[F.count_if(f"flag_{k}").alias(n) for k, n in (("missing", "missing"), ("negative", "negative"), ("zero", "zero"), ("round", "round_amount"))])


_MADZ = "with m as (select median(value) as med from events), d as (select median(abs(value - med)) as mad from events, m) "


@query("rsk_02_robust_flag", _MADZ + "select event_id from events, m, d where mad > 0 and abs(value - med) / (1.4826 * mad) > 3.5")
def rsk_02(spark, sf_dir):
    return risk.robust_flag(table(spark, sf_dir, "events"), "value").where("flag_outlier").select("event_id")


@query("rsk_03_time_flags", "select count(*) filter (where ts is null) as unparseable, count(*) filter (where hour(ts) <= 5) as night, count(*) filter (where dayofweek(ts) in (0, 6)) as weekend from events")
def rsk_03(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns(risk.time_flags(F.col("ts")))
    return e.agg(F.count_if("flag_unparseable").alias("unparseable"), F.count_if("flag_night").alias("night"), F.count_if("flag_weekend").alias("weekend"))


@query("rsk_04_entity_counts", "with c as (select user_id, count(*) as n from events group by 1), t as (select greatest(1, floor(quantile_cont(n, 0.05))) as most from c) select event_id, n as entity_count, n <= most as rare, round((case when value is null then 1 else 0 end + case when props is null then 1 else 0 end) / 2, 4) as missing_rate from events join c using (user_id), t")
def rsk_04(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    counts = e.groupBy("user_id").agg(F.count("*").alias("entity_count"))
    most = counts.agg(F.greatest(F.lit(1), F.floor(F.percentile("entity_count", F.lit(0.05)))).alias("most"))
    return e.join(counts, "user_id").crossJoin(F.broadcast(most)).select("event_id", "entity_count", (F.col("entity_count") <= F.col("most")).alias("rare"), F.round(risk.missing_rate(["value", "props"]), 4).alias("missing_rate"))


@query("rsk_05_rule_expressions", f"select event_id, {_HITS} from events")
def rsk_05(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    types = dict(e.dtypes)
    return e.select("event_id", *[rules.compile_rule(r.expression, types).alias(r.id) for r in _PACK.rules[:3]])


@query("rsk_06_rule_pack", _RULES + "select event_id, rule_score, array_to_string(list_filter([case when big_refund then 'big_refund' end, case when odd_user then 'odd_user' end, case when log_scale then 'log_scale' end], lambda x: x is not null), ',') as fired from r where rule_score > 0")
def rsk_06(spark, sf_dir):
    return rules.evaluate(table(spark, sf_dir, "events"), _PACK, _DAY).where("rule_score > 0").select("event_id", "rule_score", F.array_join("fired", ",").alias("fired"))


@query("agg_15_rule_dry_run", f"with h as (select {_HITS} from events) select 'big_refund' as rule, count(*) filter (where big_refund) as hits from h union all select 'odd_user', count(*) filter (where odd_user) from h union all select 'log_scale', count(*) filter (where log_scale) from h")
def agg_15(spark, sf_dir):
    return rules.dry_run(table(spark, sf_dir, "events"), _PACK, _DAY)


_Z2 = "with m as (select median(value) as mv, median(user_id) as mu from events), d as (select median(abs(value - mv)) as dv, median(abs(user_id - mu)) as du from events, m), z as (select event_id, coalesce(abs(value - mv) / (1.4826 * dv), 0) as zv, coalesce(abs(user_id - mu) / (1.4826 * du), 0) as zu from events, m, d) "


@query("rsk_08_max_robust_z", _Z2 + "select event_id, round(greatest(zv, zu), 6) as robust_z from z")
def rsk_08(spark, sf_dir):
    return risk.max_robust_z(table(spark, sf_dir, "events"), ["value", "user_id"]).select("event_id", F.round("robust_z", 6).alias("robust_z"))


@query("rsk_09_rank_percent", "select o_orderkey, round(100 * (rank() over (order by o_orderpriority) + (count(*) over (partition by o_orderpriority) - 1) / 2) / count(*) over (), 6) as pct from orders where o_orderpriority is not null")
def rsk_09(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority is not null")
    return risk.rank_percent(o, "o_orderpriority", "pct").select("o_orderkey", F.round("pct", 6).alias("pct"))


@query("rsk_10_isolation_forest")
def rsk_10(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select("event_id", "value", F.hour("ts").alias("hour"))
    return risk.isolation_scores(e, ["value", "hour"], "event_id").select("event_id", F.round("iso_score", 6).alias("iso_score"))


_LOF = (
    "with v as (select vec_id, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c from embeddings), p as (select x.vec_id as r, y.vec_id as o, sqrt((x.a - y.a) ^ 2 + (x.b - y.b) ^ 2 + (x.c - y.c) ^ 2) as d from v x join v y on x.vec_id <> y.vec_id), "
    "n as (select * from p qualify row_number() over (partition by r order by d, o) <= 20), kd as (select r as o, max(d) as kd from n group by 1), lrd as (select n.r, 1 / greatest(avg(greatest(n.d, kd.kd)), 1e-10) as lrd from n join kd using (o) group by 1) "
    "select n.r as \"row\", round(avg(x.lrd) / any_value(y.lrd), 6) as lof from n join lrd x on x.r = n.o join lrd y on y.r = n.r group by 1"
)


@query("rsk_11_local_outlier", _LOF)
def rsk_11(spark, sf_dir):
    from tallyward.operators.neighbours import local_outlier_factor
    from tallyward.plans.detection import _vectors

    return local_outlier_factor(_vectors(spark, sf_dir), "vec_id", ["e0", "e1", "e2"], 20).select("row", F.round("lof", 6).alias("lof"))


@query("rsk_12_weighted_ensemble", _RULES + ", z as (select event_id, least(100, value / 5) as s from events), x as (select event_id, case when user_id % 2 = 0 then rule_score end as r from r) select event_id, round((coalesce(s * 0.35, 0) + coalesce(r * 0.25, 0)) / (case when s is not null then 0.35 else 0 end + case when r is not null then 0.25 else 0 end), 6) as ensemble from z join x using (event_id) where s is not null or r is not null")
def rsk_12(spark, sf_dir):
    e = rules.evaluate(table(spark, sf_dir, "events"), _PACK, _DAY)
    s, r = F.least(F.lit(100.0), F.col("value") / 5), F.when(F.col("user_id") % 2 == 0, F.col("rule_score"))
    return e.select("event_id", F.round(risk.weighted({"s": (F.when(F.col("value").isNotNull(), s), 0.35), "r": (r, 0.25)}), 6).alias("ensemble")).where("ensemble is not null")


@query("rsk_13_attribution", _Z2 + "select event_id, case when zu > zv or (zu = zv) then 'user_id' else 'value' end as leading, round(greatest(zu, zv), 6) as z from z")
def rsk_13(spark, sf_dir):
    a = risk.attribution(table(spark, sf_dir, "events"), ["value", "user_id"])
    return a.select("event_id", F.col("top")[0]["feature"].alias("leading"), F.round(F.col("top")[0]["z"], 6).alias("z"))


@query("rsk_14_risk_aggregation", _RULES + "select event_id, round(case when value is null then rule_score else (least(100, value / 5) * 0.25 + rule_score * 0.2) / 0.45 end, 6) as risk from r")
def rsk_14(spark, sf_dir):
    e = rules.evaluate(table(spark, sf_dir, "events"), _PACK, _DAY).withColumn("stat", F.when(F.col("value").isNotNull(), F.least(F.lit(100.0), F.col("value") / 5)))
    return risk.aggregate_risk(e, {"statistics": "stat", "rules": "rule_score"}).select("event_id", F.round("risk", 6).alias("risk"))


@query("rsk_15_subsample")
def rsk_15(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.when(risk.in_subsample(F.col("event_id"), e.count(), 5000), F.col("value")).alias("scored_value"))


@query("rsk_16_risk_pipeline", _RULES + ", m as (select median(value) as med from events), d as (select median(abs(value - med)) as mad from events, m), f as (select event_id, rule_score, least(100, 20 * (case when abs(value - med) / (1.4826 * mad) > 3.5 then 1 else 0 end + case when hour(ts) <= 5 then 1 else 0 end + case when dayofweek(ts) in (0, 6) then 1 else 0 end)) as flags from r, m, d) select event_id, round((flags * 0.25 + rule_score * 0.2) / 0.45, 6) as risk from f order by risk desc, event_id limit 100")
def rsk_16(spark, sf_dir):
    e = risk.robust_flag(rules.evaluate(table(spark, sf_dir, "events"), _PACK, _DAY), "value").withColumns(risk.time_flags(F.col("ts")))
    flags = F.least(F.lit(100), 20 * sum((F.col(f).cast("int") for f in ("flag_outlier", "flag_night", "flag_weekend")), F.lit(0)))
    scored = risk.aggregate_risk(e.withColumn("flags", flags), {"statistics": "flags", "rules": "rule_score"})
    return scored.select("event_id", F.round("risk", 6).alias("risk")).orderBy(F.desc("risk"), "event_id").limit(100)


# --- sampling -------------------------------------------------------------------------------------


@query("smp_01_reliability_factors", "select p_partkey, (p_size % 12)::int as k, case p_partkey % 3 when 0 then 0.9 when 1 then 0.95 else 0.99 end::double as confidence, case p_partkey % 3 when 0 then 0.1 when 1 then 0.05 else 0.01 end::double as tail from part")
def smp_01(spark, sf_dir):
    """tail is the probability of k or fewer events at the factor, by its Poisson sum."""
    part = F.col("p_partkey") % 3
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 12).cast("int").alias("k"), F.when(part == 0, 0.9).when(part == 1, 0.95).otherwise(0.99).alias("confidence"))
    p = p.withColumn("factor", sampling.reliability_factor_column(F.col("k"), F.col("confidence")))
    terms = F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.pow("factor", i) / F.factorial(i))
    tail = F.exp(-F.col("factor")) * F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return p.select("p_partkey", "k", "confidence", F.round(tail, 9).alias("tail"))


@query("smp_03_sample_size", "with b as (select sum((round(o_totalprice * 100))::bigint)::double / 100 as book from orders) select ceil(book * 2.995732273553991 / (book * 0.02 - book * 0.002 * 1.6))::bigint as n, round(book / ceil(book * 2.995732273553991 / (book * 0.02 - book * 0.002 * 1.6)), 2) as interval from b")
def smp_03(spark, sf_dir):
    book = table(spark, sf_dir, "orders").agg(F.sum(sampling.cents(F.col("o_totalprice"))).alias("b")).first()["b"] / 100
    n, interval = sampling.mus_sample_size(book, book * 0.02, book * 0.002, 0.95)
    return spark.createDataFrame([(n, round(interval, 2))], "n long, interval double")


@query("smp_06_sign_partition", "select case when round(c_acctbal, 2) > 0 then 'positive' when round(c_acctbal, 2) < 0 then 'negative' else 'zero' end as stratum, count(*) as n from customer where c_acctbal is not null group by 1")
def smp_06(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(sampling.sign_stratum(F.col("c_acctbal")).alias("stratum")).agg(F.count("*").alias("n")).where("stratum is not null")


_INTERVAL, _START, _SIZE = 2_000_000_00, 12_345_67, 100_000
_MUS = f"with c as (select o_orderkey, round(o_totalprice * 100)::bigint as c from orders where round(o_totalprice * 100) > 0), s as (select *, sum(c) over (order by o_orderkey rows unbounded preceding) as cum from c), h as (select *, (least({_SIZE}, greatest(0, floor((cum - {_START}) / {_INTERVAL}) + 1)) - least({_SIZE}, greatest(0, floor((cum - c - {_START}) / {_INTERVAL}) + 1)))::bigint as hits from s) "


@query("smp_07_monetary_unit", _MUS + f"select o_orderkey, hits, case when c >= {_INTERVAL} then 'certainty' else 'monetary_unit' end as selection_basis, round(least(c / {_INTERVAL}, 1.0), 6) as inclusion_probability from h where hits > 0")
def smp_07(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sampling.select_monetary_unit(o, "o_orderkey", "o_totalprice", _INTERVAL, _START, _SIZE).drop("o_totalprice")


@query("smp_08_random_control", "select o_orderkey from orders order by md5('17|' || o_orderkey), o_orderkey limit 50")
def smp_08(spark, sf_dir):
    return sampling.select_random(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 50, 17)


@query("smp_09_high_risk", "select event_id, value from events order by value desc, event_id limit 40")
def smp_09(spark, sf_dir):
    return sampling.select_high_risk(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", "value", top=40)


_C = "select c_custkey, c_acctbal, (c_custkey * 37 % 100)::double as risk from customer"
_CI, _CS = 250_000_00, 4_000_00


@query(
    "smp_10_stratified_sample",
    f"with p as ({_C}), c as (select c_custkey, round(c_acctbal * 100)::bigint as c from p where round(c_acctbal * 100) > 0), s as (select *, sum(c) over (order by c_custkey rows unbounded preceding) as cum from c), mus as (select c_custkey from s where least(1000, greatest(0, floor((cum - {_CS}) / {_CI}) + 1)) > least(1000, greatest(0, floor((cum - c - {_CS}) / {_CI}) + 1))), "
    "neg as (select c_custkey from p where round(c_acctbal, 2) < 0), high as (select c_custkey from p where risk >= 98 and c_custkey not in (select c_custkey from mus) and c_custkey not in (select c_custkey from neg)), "
    "rnd as (select c_custkey from p where round(c_acctbal, 2) > 0 and c_custkey not in (select c_custkey from mus) and c_custkey not in (select c_custkey from high) order by md5('5|' || c_custkey), c_custkey limit 25) "
    "select c_custkey, 'monetary_unit' as stratum from mus union all select c_custkey, 'high_risk' from high union all select c_custkey, 'random' from rnd union all select c_custkey, 'negative' from neg",
)
def smp_10(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") * 37 % 100).cast("double").alias("risk"))
    return sampling.build_sample(c, "c_custkey", "c_acctbal", "risk", interval=_CI, start=_CS, size=1000, threshold=98, n_random=25, seed=5).select("c_custkey", "stratum")


_TESTED = "select l_extendedprice as book, case when l_partkey % 200 = 3 then l_extendedprice * 0.6 when l_partkey % 200 = 4 then l_extendedprice * 1.1 else l_extendedprice end as audit, case when l_partkey % 50 = 3 then 'certainty' when l_partkey % 9 = 1 then 'high_risk' else 'monetary_unit' end as selection_basis from lineitem"


@query("smp_12_tainting", f"with t as ({_TESTED}) select count(*) as n, round(sum((book - audit) / book), 4) as taint, count(*) filter (where audit < book) as overstated from t where book <> 0")
def smp_12(spark, sf_dir):
    t = _tested(spark, sf_dir).withColumn("taint", sampling.tainting(F.col("book"), F.col("audit")))
    return t.agg(F.count("*").alias("n"), F.round(F.sum("taint"), 4).alias("taint"), F.count_if(F.col("audit") < F.col("book")).alias("overstated"))


def _tested(spark, sf_dir):
    p, x = F.col("l_partkey"), F.col("l_extendedprice")
    audit = F.when(p % 200 == 3, x * 0.6).when(p % 200 == 4, x * 1.1).otherwise(x)
    basis = F.when(p % 50 == 3, "certainty").when(p % 9 == 1, "high_risk").otherwise("monetary_unit")
    return table(spark, sf_dir, "lineitem").select(x.alias("book"), audit.alias("audit"), basis.alias("selection_basis"))


@query("smp_13_projection")
def smp_13(spark, sf_dir):
    return sampling.project_misstatement(_tested(spark, sf_dir), interval=100_000.0, confidence=0.95, tolerable=1_000_000.0)


_SC = "with s as (select d.doc_id, d.n_chars, coalesce(l.toxic, 0) as y from documents d left join labels l using (doc_id)) "


def _scored(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return d.join(l, "doc_id", "left").withColumn("y", F.coalesce("toxic", F.lit(0)))


@query("smp_15_precision_recall", _SC + ", r as (select *, row_number() over (order by n_chars desc, doc_id) as rank from s), k as (select unnest([10, 50, 100])::bigint as k), b as (select count(*) as n, sum(y) as pos from s) select k, round(sum(y) / count(*), 6) as precision, round(sum(y) / max(pos), 6) as recall, round(sum(y) / count(*) / max(pos / n), 6) as lift from k join r on rank <= k, b group by k")
def smp_15(spark, sf_dir):
    return sampling.precision_at(_scored(spark, sf_dir), "doc_id", "n_chars", "y", [10, 50, 100])


@query("smp_16_bootstrap_lift")
def smp_16(spark, sf_dir):
    return sampling.bootstrap_lift(_scored(spark, sf_dir), "n_chars", "y", 100)


_PARTS = [f"sum(('0x' || substr(h, {1 + 12 * i}, 12))::ubigint::hugeint)" for i in range(5)]


@query("smp_18_fingerprint", "with r as (select sha256(o_orderkey || '|' || printf('%.2f', o_totalprice)) as h from orders) select sha256(concat_ws('|', count(*), " + ", ".join(_PARTS) + ")) as fingerprint from r")
def smp_18(spark, sf_dir):
    return sampling.dataset_fingerprint(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice")


@query("agg_30_sample_groups", _MUS + f"select case when c >= {_INTERVAL} then 'certainty' else 'monetary_unit' end as stratum, count(*) as n, true as statistical from h where hits > 0 group by 1")
def agg_30(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    s = sampling.select_monetary_unit(o, "o_orderkey", "o_totalprice", _INTERVAL, _START, _SIZE)
    return s.groupBy(F.col("selection_basis").alias("stratum")).agg(F.count("*").alias("n")).withColumn("statistical", F.col("stratum").isin(*sampling.PROJECTABLE))


@query("join_13_transaction_explorer", "select o.o_orderkey, o.o_totalprice, s.c_custkey is not null as sampled from orders o left join (select c_custkey from customer where c_custkey % 10 = 0) s on o.o_custkey = s.c_custkey order by o.o_totalprice desc, o.o_orderkey limit 50 offset 100")
def join_13(spark, sf_dir):
    s = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select("c_custkey")
    o = table(spark, sf_dir, "orders").join(s, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_totalprice", F.col("c_custkey").isNotNull().alias("sampled"))


@query("join_14_tested_untested", "select 'tested' as part, count(*) as n from documents where doc_id in (select doc_id from labels) union all select 'untested', count(*) from documents where doc_id not in (select doc_id from labels)")
def join_14(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    part = lambda how, name: d.join(l, "doc_id", how).agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return part("left_semi", "tested").unionByName(part("left_anti", "untested"))


@query("join_15_lookup_default", "select d.doc_id, coalesce(l.toxic, 0)::int as label from documents d left join labels l using (doc_id)")
def join_15(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", F.col("y").cast("int").alias("label"))


@query("row_numbers_total_order", "select event_id, row_number() over (order by value, event_id) as rn from events where value is not null")
def row_numbers(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select("event_id", "value")
    return ordering.row_numbers(e, [F.col("value"), F.col("event_id")], "rn").select("event_id", "rn")
