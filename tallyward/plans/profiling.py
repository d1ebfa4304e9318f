"""Queries: profiles and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.operators import ordering, profile
from tallyward.plans.registry import query
from tallyward.session import table

_NUM = ["l_quantity", "l_extendedprice", "l_discount"]


def _profile_sql(tbl: str, numeric: list[str], other: list[str]) -> str:
    parts = []
    for c in [*numeric, *other]:
        num = c in numeric
        stats = (
            f"round(min({c}), 4) as min_value, round(max({c}), 4) as max_value, round(avg({c}), 4) as mean_value, round(median({c}), 4) as median_value, round(stddev_pop({c}), 4) as std_value, round((select median(abs({c} - (select median({c}) from {tbl}))) from {tbl}), 4) as mad_value"
            if num
            else "null::double as min_value, null::double as max_value, null::double as mean_value, null::double as median_value, null::double as std_value, null::double as mad_value"
        )
        parts.append(f"select '{c}' as \"column\", count({c}) as present, count(*) - count({c}) as missing, round((count(*) - count({c})) / count(*), 4) as missing_rate, count(distinct {c}) as distinct_values, round(count(distinct {c}) / count({c}), 4) as unique_rate, {stats} from {tbl}")
    return " union all ".join(parts)


@query("agg_01_column_profile", _profile_sql("events", ["value", "user_id"], ["event_type"]))
def agg_01(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "events"), ["value", "user_id"], ["event_type"])


@query("agg_01_top_values", "with l as (select 'o_orderstatus' as c, o_orderstatus as v from orders union all select 'o_orderpriority', o_orderpriority from orders), k as (select c, v, count(*) as n from l where v is not null group by c, v) select c as \"column\", v as value, n, row_number() over (partition by c order by n desc, v) as rank from k qualify rank <= 5")
def agg_01_top(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("agg_02_nearest_rank_quantile", "with v as (select value, row_number() over (order by value) as rn, count(*) over () as n from events where value is not null), f as (select unnest([0.25, 0.5, 0.75, 0.95]::double[]) as fraction) select fraction, value from v join f on rn = round_even((n - 1) * fraction, 0)::bigint + 1")
def agg_02(spark, sf_dir):
    return ordering.nearest_rank(table(spark, sf_dir, "events"), "value", [0.25, 0.5, 0.75, 0.95])


@query("agg_03_date_detection", "select o_orderkey, o_orderkey % 9 < 6 as is_date from orders")
def agg_03(spark, sf_dir):
    from tallyward.functions.parsing import is_date

    day = lambda f: F.date_format("o_orderdate", f)
    shapes = [day("yyyy-MM-dd"), day("yyyy/MM/dd"), day("dd-MM-yyyy"), day("dd/MM/yyyy"), day("MM/dd/yyyy"), day("yyyy-MM-dd'T'HH:mm"), F.col("o_orderstatus"), F.concat(day("yyyy"), F.lit("-13-01")), day("yyyyMMdd")]
    raw = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        raw = F.when(F.col("o_orderkey") % 9 == i, shape).otherwise(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", is_date(raw).alias("is_date"))


@query("agg_04_histogram", "with b as (select min(value) as lo, max(value) as hi from events), c as (select least(7, floor((value - lo) / ((hi - lo) / 8)))::bigint as bin, count(*) as n from events, b where value is not null group by 1) select s.bin, round(lo + s.bin * ((hi - lo) / 8), 4) as low, coalesce(c.n, 0) as n from (select unnest(range(8)) as bin) s cross join b left join c using (bin)")
def agg_04(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "events"), "value")


@query("agg_05_box_stats", "with q as (select list_sort(list(value))[round_even((count(value) - 1) * 0.25, 0)::bigint + 1] as q1, list_sort(list(value))[round_even((count(value) - 1) * 0.75, 0)::bigint + 1] as q3 from events), f as (select *, q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high from q) select q1, q3, low, high, min(value) filter (where value between low and high) as whisker_low, max(value) filter (where value between low and high) as whisker_high, count(*) filter (where value not between low and high) as outliers, count(*) as n from events, f where value is not null group by all")
def agg_05(spark, sf_dir):
    return profile.box_stats(table(spark, sf_dir, "events"), "value")


@query("agg_06_pearson_matrix", " union all ".join(f"select '{a}' as x, '{b}' as y, count(*) filter (where {a} is not null and {b} is not null) as pairs, round(corr({a}, {b}), 4) as r from lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]))
def agg_06(spark, sf_dir):
    return profile.pearson_matrix(table(spark, sf_dir, "lineitem"), _NUM)


@query("agg_07_schema_profile", " union all ".join(f"select '{c}' as \"column\", count(*) as n, count(*) - count({c}) as nulls, count(distinct {c}) as distinct_values, min({c}) as min_value, max({c}) as max_value, round(avg({c}), 4) as mean_value, round(median({c}), 4) as median_value, round(quantile_cont({c}, 0.95), 4) as p95, count(*) filter (where {c} < 0) as negative, count(*) filter (where {c} = 0) as zero from lineitem" for c in _NUM))
def agg_07(spark, sf_dir):
    return profile.schema_profile(table(spark, sf_dir, "lineitem"), _NUM)


@query("agg_08_running_stats", "select l_returnflag, count(l_discount) as n, count(*) - count(l_discount) as nulls, min(l_discount) as min_value, max(l_discount) as max_value, round(sum(l_discount::decimal(38,4)), 2)::double as total, count(*) filter (where l_discount < 0) as negative, count(*) filter (where l_discount = 0) as zero from lineitem group by 1")
def agg_08(spark, sf_dir):
    return profile.running_stats(table(spark, sf_dir, "lineitem"), "l_discount", "l_returnflag")


@query(
    "agg_09_history_profile",
    "with h as (select o_custkey, count(*) as n from orders group by 1), q as (select quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.75) as q3 from orders) select (select median(n) from h)::double as median_history, (select max(n) >= 6 from h) as has_sequences, count(*) as n_rows, count(*) - count(distinct (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)) as duplicates, min(o_orderdate)::date::varchar as first_date, max(o_orderdate)::date::varchar as last_date, count(*) filter (where o_totalprice < q1 - 1.5 * (q3 - q1) or o_totalprice > q3 + 1.5 * (q3 - q1)) as outliers from orders, q",
)
def agg_09(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    h = o.groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.median("n").alias("median_history"), (F.max("n") >= 6).alias("has_sequences"))
    q = o.agg(F.percentile("o_totalprice", F.lit(0.25)).alias("q1"), F.percentile("o_totalprice", F.lit(0.75)).alias("q3"))
    iqr = 1.5 * (F.col("q3") - F.col("q1"))
    s = o.crossJoin(F.broadcast(q)).agg(F.count("*").alias("n_rows"), F.min("o_orderdate").cast("date").cast("string").alias("first_date"), F.max("o_orderdate").cast("date").cast("string").alias("last_date"), F.count_if((F.col("o_totalprice") < F.col("q1") - iqr) | (F.col("o_totalprice") > F.col("q3") + iqr)).alias("outliers"))
    d = o.groupBy(*o.columns).agg((F.count("*") - 1).alias("extra")).agg(F.sum("extra").alias("duplicates"))
    return h.crossJoin(s).crossJoin(d)  # one row each


@query("agg_10_label_state", "with c as (select toxic, count(*) as n from labels where toxic is not null group by 1) select sum(n)::bigint as n_rows, count(*) as classes, case when sum(n) is null then 'NO_LABELS' when sum(n) >= 200 and count(*) = 2 and min(n) >= 30 then 'GOOD_DATA' else 'PARTIAL_DATA' end as state, round(max(n) / min(n), 4) as imbalance from c")
def agg_10(spark, sf_dir):
    return profile.label_state(table(spark, sf_dir, "labels"), "toxic")


@query("agg_11_control_totals", "select o_orderstatus as currency, count(*) as n_rows, coalesce(sum(o_totalprice::decimal(28,8)) filter (where o_orderkey % 2 = 0), 0)::decimal(38,8) as debits, coalesce(sum(o_totalprice::decimal(28,8)) filter (where o_orderkey % 2 <> 0), 0)::decimal(38,8) as credits from orders group by 1")
def agg_11(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "currency")
    return profile.control_totals(o, "currency", F.when(F.col("o_orderkey") % 2 == 0, "DR").otherwise("CR"), F.col("o_totalprice"))


@query("agg_12_unexplained", "with m as (select o_orderstatus as account, sum(case when o_orderkey % 2 = 0 then -o_totalprice::decimal(28,8) else o_totalprice::decimal(28,8) end) as movement, sum(case when o_orderkey % 10 = 0 then o_totalprice::decimal(28,8) else 0::decimal(28,8) end) as explained, max(o_totalprice::decimal(28,8)) as closing from orders group by 1) select account, round(closing - movement - explained, 2)::decimal(38,2) as unexplained from m")
def agg_12(spark, sf_dir):
    from tallyward.operators.matching import unexplained

    a = F.col("o_totalprice").cast("decimal(28,8)")
    zero = F.lit(0).cast("decimal(28,8)")
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("account")).agg(F.sum(F.when(F.col("o_orderkey") % 2 == 0, -a).otherwise(a)).alias("movement"), F.sum(F.when(F.col("o_orderkey") % 10 == 0, a).otherwise(zero)).alias("explained"), F.max(a).alias("closing"))
    return m.select("account", unexplained(zero, F.col("movement"), F.col("closing"), F.col("explained")).alias("unexplained"))


@query("agg_13_strata_summary", "select case when c_acctbal > 0 then 'positive' when c_acctbal < 0 then 'negative' when c_acctbal = 0 then 'zero' end as stratum, count(*) as n, round(sum(c_acctbal::decimal(20,2)), 2)::double as amount from customer group by 1")
def agg_13(spark, sf_dir):
    from tallyward.operators.sampling import sign_stratum

    return table(spark, sf_dir, "customer").groupBy(sign_stratum(F.col("c_acctbal")).alias("stratum")).agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(20,2)")).cast("double").alias("amount"))


@query("agg_14_testing_progress", "select count(*) as total, count(l.doc_id) as tested, count(*) - count(l.doc_id) as untested, round(100 * count(l.doc_id) / count(*), 2) as pct from documents d left join labels l using (doc_id)")
def agg_14(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("done"))
    n = F.count("done")
    return d.join(l, "doc_id", "left").agg(F.count("*").alias("total"), n.alias("tested"), (F.count("*") - n).alias("untested"), F.round(100 * n / F.count("*"), 2).alias("pct"))


@query("agg_16_severity_counts", "with s as (select case when value >= 300 then 'critical' when value >= 150 then 'high' when value >= 60 then 'medium' else 'low' end as severity, value from events) select severity, count(*) as n, max(value) as max_score from s group by 1")
def agg_16(spark, sf_dir):
    v = F.col("value")
    sev = F.when(v >= 300, "critical").when(v >= 150, "high").when(v >= 60, "medium").otherwise("low")
    return table(spark, sf_dir, "events").groupBy(sev.alias("severity")).agg(F.count("*").alias("n"), F.max("value").alias("max_score"))


@query("agg_17_risk_bands", "with s as (select case when x < 35 then '0-34' when x < 55 then '35-54' when x < 65 then '55-64' when x < 85 then '65-84' else '85-100' end as band from (select least(100, value / 5) as x from events)) select b.band, count(s.band) as n from (select unnest(['0-34', '35-54', '55-64', '65-84', '85-100']) as band) b left join s using (band) group by 1")
def agg_17(spark, sf_dir):
    spine = spark.sql("select explode(array('0-34', '35-54', '55-64', '65-84', '85-100')) band")
    counts = table(spark, sf_dir, "events").groupBy(profile.bands(F.coalesce(F.least(F.lit(100.0), F.col("value") / 5), F.lit(0.0))).alias("band")).agg(F.count("*").alias("n"))
    return spine.join(counts, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_18_model_inventory", "with c as (select unnest(['click', 'view', 'purchase', 'refund_audit']) as model), h as (select event_type as model, count(*) as hits, max(value) as max_score, round(avg(value), 4) as mean_confidence from events group by 1) select model, coalesce(hits, 0) as hits, max_score, mean_confidence from c left join h using (model)")
def agg_18(spark, sf_dir):
    catalog = spark.sql("select explode(array('click', 'view', 'purchase', 'refund_audit')) model")
    hits = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("hits"), F.max("value").alias("max_score"), F.round(F.avg("value"), 4).alias("mean_confidence"))
    return catalog.join(hits, "model", "left").select("model", F.coalesce("hits", F.lit(0)).alias("hits"), "max_score", "mean_confidence")


@query("agg_19_ageing_buckets", "with a as (select o_orderstatus as currency, o_totalprice, date_diff('day', o_orderdate::date, (select max(o_orderdate)::date from orders)) as days from orders) select case when days <= 30 then '0-30' when days <= 60 then '31-60' when days <= 90 then '61-90' else '90+' end as bucket, currency, count(*) as n, sum(o_totalprice::decimal(20,2))::double as amount from a group by 1, 2")
def agg_19(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    today = o.agg(F.max("o_orderdate").cast("date").alias("today"))
    days = F.datediff("today", F.col("o_orderdate").cast("date"))
    return o.crossJoin(F.broadcast(today)).groupBy(profile.ageing_bucket(days).alias("bucket"), F.col("o_orderstatus").alias("currency")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("amount"))


@query("agg_20_period_board", "select strftime(o_orderdate, '%Y-%m') as period, count(*) as records, round(100 * count(*) filter (where o_orderstatus = 'F') / count(*), 2) as matched_pct, count(*) filter (where o_orderstatus = 'O') as open_breaks, coalesce(sum(o_totalprice::decimal(20,2)) filter (where o_orderstatus = 'O'), 0)::double as open_value, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last_run from orders group by 1")
def agg_20(spark, sf_dir):
    is_open, is_done = F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F"
    value = F.sum(F.when(is_open, F.col("o_totalprice").cast("decimal(20,2)")))
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count("*").alias("records"), F.round(100 * F.count_if(is_done) / F.count("*"), 2).alias("matched_pct"), F.count_if(is_open).alias("open_breaks"), F.coalesce(value.cast("double"), F.lit(0.0)).alias("open_value"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_run"))


@query("agg_21_rule_breakdown", "select strftime(o_orderdate, '%Y-%m') as period, o_orderpriority as rule, count(*) as n from orders group by 1, 2")
def agg_21(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderpriority").alias("rule")).agg(F.count("*").alias("n"))


@query("agg_22_daily_counts", "with l as (select max(ts)::date as d from events), s as (select unnest(generate_series(d - 6, d, interval 1 day))::date as day from l), c as (select ts::date as day, count(*) as n from events group by 1) select day::varchar as day, coalesce(n, 0) as n from s left join c using (day)")
def agg_22(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    spine = e.agg(F.max("day").alias("d")).select(F.explode(F.expr("sequence(date_sub(d, 6), d)")).alias("day"))
    return spine.join(e.groupBy("day").agg(F.count("*").alias("n")), "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_22_top_datasets", "select user_id, count(*) as n from events group by 1 order by n desc, user_id limit 6")
def agg_22_top(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(6)


@query("agg_23_touched_share", "select round(count(*) filter (where event_type = 'purchase') / count(*), 6) as share, count(*) filter (where event_type = 'purchase') / count(*) > 0.15 as breached from events")
def agg_23(spark, sf_dir):
    share = F.count_if(F.col("event_type") == "purchase") / F.count("*")
    return table(spark, sf_dir, "events").agg(F.round(share, 6).alias("share"), (share > 0.15).alias("breached"))
