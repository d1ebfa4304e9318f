"""Queries: cleaning, types, duplicates and rarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.functions import normalize, parsing
from tallyward.operators import frequency, prepare
from tallyward.plans.registry import query
from tallyward.session import table

def _by_key(shapes, key):
    """The shape a row's key deals it."""
    raw = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        raw = F.when(key == i, shape).otherwise(raw)
    return raw


@query("pre_02_parse_number", "select o_orderkey, case o_orderkey % 12 when 0 then round(o_totalprice, 2) when 1 then round(o_totalprice, 2) when 2 then round(o_totalprice, 2) when 3 then round(o_totalprice, 2) when 4 then round(o_totalprice, 2) when 5 then -round(o_totalprice, 2) when 10 then 1000.0 end as number from orders")
def pre_02(spark, sf_dir):
    x = F.col("o_totalprice")
    plain, grouped = F.format_string("%.2f", x), F.format_number(x, 2)
    shapes = [plain, F.concat(F.lit("PKR "), grouped), F.concat(F.lit("USD"), plain), F.concat(plain, F.lit("%")), F.concat(F.lit("$ "), grouped), F.concat(F.lit("-"), plain), F.lit("1,23"), F.lit("unknown"), F.lit("inf"), F.lit("abc"), F.lit("1e3"), F.lit("")]
    return table(spark, sf_dir, "orders").select("o_orderkey", parsing.parse_number(_by_key(shapes, F.col("o_orderkey") % 12)).alias("number"))


@query("pre_03_missing_reason", "select o_orderkey, case o_orderkey % 8 when 0 then 'null' when 1 then 'blank' when 2 then 'token' when 3 then 'token' when 4 then 'non_finite' when 5 then 'non_finite' when 6 then 'token' end as reason from orders")
def pre_03(spark, sf_dir):
    shapes = [F.lit(None).cast("string"), F.lit("  "), F.lit("Unknown"), F.lit("n/a"), F.lit("inf"), F.lit("-Infinity"), F.lit("NaN"), F.col("o_totalprice").cast("string")]
    return table(spark, sf_dir, "orders").select("o_orderkey", parsing.missing_reason(_by_key(shapes, F.col("o_orderkey") % 8)).alias("reason"))


@query("pre_05_strict_date", "select o_orderkey, case o_orderkey % 6 when 0 then o_orderdate::date when 1 then o_orderdate::date end::varchar as day from orders")
def pre_05(spark, sf_dir):
    day = lambda f: F.date_format("o_orderdate", f)
    shapes = [day("yyyy-MM-dd"), day("yyyy/MM/dd"), day("dd-MM-yyyy"), F.concat(day("yyyy"), F.lit("-02-30")), day("yyyy-MM/dd"), F.lit("2024-1-1")]
    return table(spark, sf_dir, "orders").select("o_orderkey", parsing.strict_date(_by_key(shapes, F.col("o_orderkey") % 6)).cast("string").alias("day"))


def _orders_cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 10 == 0, "unknown").when(F.col("o_orderkey") % 13 == 0, "bad").otherwise(F.col("o_totalprice").cast("string"))
    day = F.when(F.col("o_orderkey") % 7 == 0, "2023-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", price.alias("price"), day.alias("day"), F.col("o_orderstatus").alias("status"))


@query(
    "pre_08_prepared_issues",
    "select case when col = 'price' and k % 10 = 0 then 'token' when col = 'price' and k % 13 = 0 then 'not_a_number' when col = 'day' and k % 7 = 0 then 'invalid_date' end as reason, col as \"column\", count(*) as n from (select o_orderkey as k, unnest(['price', 'day', 'status']) as col from orders) group by 1, 2 having reason is not null",
)
def pre_08(spark, sf_dir):
    p = prepare.prepared_cells(_orders_cells(spark, sf_dir), "o_orderkey", dates=("day",), numbers=("price",))
    return p.where("reason is not null").groupBy("reason", "column").agg(F.count("*").alias("n"))


@query("pre_11_cell_quality", "with b as (select count(*) * 3 as cells, count(*) filter (where o_orderkey % 10 = 0 or o_orderkey % 13 = 0) + count(*) filter (where o_orderkey % 7 = 0) as unavailable from orders) select cells, unavailable, round(100 * (1 - unavailable / cells), 2) as quality from b")
def pre_11(spark, sf_dir):
    return prepare.cell_quality(prepare.prepared_cells(_orders_cells(spark, sf_dir), "o_orderkey", dates=("day",), numbers=("price",)))


@query("pre_12_examples", "with i as (select case when k % 10 = 0 then 'token' else 'not_a_number' end as reason, k as \"row\", 'price' as \"column\" from (select o_orderkey as k from orders) where k % 10 = 0 or k % 13 = 0) select reason, \"row\", \"column\", row_number() over (partition by reason order by \"row\", \"column\") as rank from i qualify rank <= 5")
def pre_12(spark, sf_dir):
    p = prepare.prepared_cells(_orders_cells(spark, sf_dir).select("o_orderkey", "price"), "o_orderkey", numbers=("price",))
    return prepare.examples(p.where("reason is not null")).select("reason", "row", "column", "rank")


@query("pre_06_unit_sets", "with s as (select o_orderkey as k, case when o_orderkey % 3 = 0 then 'USD' || o_orderkey when o_orderkey % 3 = 1 then o_orderkey || '%' else o_orderkey::varchar end as v from orders) select 'v' as \"column\", ['%', 'USD', 'plain'] as units, 3::bigint as n_units")
def pre_06(spark, sf_dir):
    k = F.col("o_orderkey")
    v = F.when(k % 3 == 0, F.concat(F.lit("USD"), k.cast("string"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("%"))).otherwise(k.cast("string"))
    return prepare.unit_sets(prepare.prepared_cells(table(spark, sf_dir, "orders").select(k, v.alias("v")), "o_orderkey"))


@query(
    "pre_07_roles",
    "select * from (values ('o_custkey', 'numeric'), ('o_orderdate', 'context'), ('o_orderstatus', 'target'), ('o_orderpriority', 'excluded'), ('o_totalprice', 'numeric'), ('order_key', 'identifier')) t(\"column\", role)",
)
def pre_07(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("order_key", F.concat(F.lit("K"), F.col("o_orderkey").cast("string")))
    types = prepare.inferred_types(prepare.cells(o, "o_orderkey"))
    return prepare.roles(types, prepare.Policy(excluded=("o_orderpriority",), targets=("o_orderstatus",))).select("column", "role")


@query("pre_10_eligibility", "select 'value' as \"column\", count(distinct value) as distinct_values, round(count(value) / count(*), 4) as observed, count(distinct value) > 1 as usable, count(distinct value) > 1 and count(value) / count(*) >= 0.8 as neighbours from events union all select 'few', count(distinct case when event_id % 5 = 0 then value end), round(count(case when event_id % 5 = 0 then value end) / count(*), 4), count(distinct case when event_id % 5 = 0 then value end) > 1, count(distinct case when event_id % 5 = 0 then value end) > 1 and count(case when event_id % 5 = 0 then value end) / count(*) >= 0.8 from events")
def pre_10(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("few", F.when(F.col("event_id") % 5 == 0, F.col("value")))
    return prepare.eligible(e, ["value", "few"])


@query("pre_14_preview", "select o_orderkey, o_orderstatus, o_orderpriority from orders order by o_orderkey limit 10")
def pre_14(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").orderBy("o_orderkey").limit(10)


# --- duplicates and rarity ------------------------------------------------------------------------

_DUP = "select o_custkey, o_orderstatus, o_orderpriority from orders"


@query("frq_01_duplicate_rows", f"with d as ({_DUP}), g as (select *, count(*) as n from d group by all having count(*) > 1) select count(*) as groups, coalesce(sum(n - 1), 0)::bigint as extra_rows, max(n) as largest from g")
def frq_01(spark, sf_dir):
    return frequency.duplicate_groups(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")).agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"), F.max("n").alias("largest"))


@query("frq_02_rare_category", "with c as (select case when p_partkey % 500 = 1 then 'only ' || p_partkey else p_brand end as v from part), s as (select count(v) as present, count(distinct v) as u from c), g as (select v, count(*) as n from c group by 1) select v as value, greatest(42, least(58, 34 + 100.0 / n))::double as score from g, s where n = 1 and present >= 10 and u / present < 0.8")
def frq_02(spark, sf_dir):
    v = F.when(F.col("p_partkey") % 500 == 1, F.concat(F.lit("only "), F.col("p_partkey").cast("string"))).otherwise(F.col("p_brand"))
    return frequency.rare_categories(table(spark, sf_dir, "part").select(v.alias("v")), "v")


@query(
    "frq_03_rare_pairs",
    "with p as (select p_brand as a, p_type as b, p_partkey as k from part where p_partkey % 3 = 0 or p_brand <> 'Brand#11' ), c as (select a, b, count(*) as n, min(k) as k from p group by a, b), a as (select a, count(*) as na from p group by 1), b as (select b, count(*) as nb from p group by 1), g as (select count(*) as pairs, count(*) filter (where n = 1) as single, sum(n) as paired from c) select c.a, c.b, 54::double as score from c join a using (a) join b using (b), g where n = 1 and na > 1 and nb > 1 and pairs >= 3 and not (single / pairs > 0.45 and pairs > greatest(10, 0.6 * paired))",
)
def frq_03(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey % 3 = 0 or p_brand <> 'Brand#11'").select(F.col("p_brand").alias("a"), F.col("p_type").alias("b"))
    return frequency.rare_pairs(p, "a", "b")


@query("frq_04_duplicate_ids", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def frq_04(spark, sf_dir):
    return frequency.duplicate_groups(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))


@query("frq_06_duplicate_amount", "with d as (select o_orderkey, count(*) over (partition by o_totalprice) > 1 as duplicate from orders where o_totalprice is not null) select o_orderkey from d where duplicate")
def frq_06(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return frequency.with_duplicate_flag(o, "o_totalprice", "duplicate").where("duplicate").select("o_orderkey")


@query("frq_07_rare_entity", "with c as (select user_id, count(*) as n from events group by 1), t as (select greatest(1, floor(quantile_cont(n, 0.05))) as most from c) select user_id, n from c, t where n <= most")
def frq_07(spark, sf_dir):
    return frequency.rare_entities(table(spark, sf_dir, "events"), "user_id")


@query("frq_08_distinct_rows", "select count(*) as n from (select distinct l_returnflag, l_linestatus, l_linenumber from lineitem)")
def frq_08(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates().agg(F.count("*").alias("n"))


@query("frq_09_row_fingerprint", "select o_orderkey, sha256(o_orderkey || chr(31) || coalesce(o_orderstatus, '') || chr(31) || coalesce(o_orderpriority, '')) as fingerprint from orders")
def frq_09(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", normalize.row_fingerprint(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("fingerprint"))


@query("frq_10_import_key", """select n_nationkey, sha256('["' || n_nationkey || '","csv","' || n_name || '","2024-01"]') as import_key from nation""")
def frq_10(spark, sf_dir):
    key = F.sha2(F.to_json(F.array(F.col("n_nationkey").cast("string"), F.lit("csv"), F.col("n_name"), F.lit("2024-01"))), 256)
    return table(spark, sf_dir, "nation").select("n_nationkey", key.alias("import_key"))


@query("frq_11_missing_rate", "with r as (select 'few' as \"column\", count(*) filter (where event_id % 5 <> 0) / count(*) as rate from events union all select 'value', count(*) filter (where value is null) / count(*) from events) select \"column\", round(rate, 4) as missing_rate, round(least(100, rate * 120), 4) as score from r where rate >= 0.2")
def frq_11(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("few", F.when(F.col("event_id") % 5 == 0, F.col("value")))
    return frequency.missing_columns(e, ["few", "value"])
