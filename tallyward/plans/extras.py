"""Queries: readers on written files, scalar rules, decisions and metadata."""

from __future__ import annotations

import json
from datetime import date

import pandas as pd
from pyspark.sql import functions as F

from tallyward.functions import normalize
from tallyward.functions.canonical import canonical_json, content_hash
from tallyward.operators import credit, frequency, lifecycle, prepare, risk, rules, sampling
from tallyward.plans.registry import query
from tallyward.session import shared_dir, table
from tallyward.sources import tabular


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/files-{spark.sparkContext.applicationId}-{name}"


_ORD = "select o_orderkey::varchar as o_orderkey, o_orderstatus, o_orderpriority from orders"


@query("src_01_delimited", _ORD)
def src_01(spark, sf_dir):
    path = _folder(spark, "delimited")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").write.mode("overwrite").csv(path, sep=";", header=True)
    return tabular.read_delimited(spark, path, multiline=False)  # no value holds a line break, so files split


@query("src_02_wrapped_json", "select o_orderkey, o_custkey as \"who.id\" from orders")
def src_02(spark, sf_dir):
    path = _folder(spark, "json")
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", F.struct(F.col("o_custkey").alias("id")).alias("who"))).alias("records"))
    rows.select("records").write.mode("overwrite").json(path)
    return tabular.flatten(spark.read.json(path).select(F.explode("records").alias("r")).select("r.*"))


@query("src_04_guarded_scan", "select count(*) as n from events")
def src_04(spark, sf_dir):
    path = _folder(spark, "lines")
    table(spark, sf_dir, "events").select("event_id", "event_type").write.mode("overwrite").json(path)
    return tabular.guard(tabular.read_json(spark, path, lines=True)).agg(F.count("event_id").alias("n"))


@query("src_09_short_rows", "select p_partkey::varchar as x, p_brand as y, case when p_partkey % 3 = 0 then '' else p_size::varchar end as z from part")
def src_09(spark, sf_dir):
    path = _folder(spark, "short")
    key = F.col("p_partkey")
    line = F.concat_ws("|", key.cast("string"), "p_brand", F.when(key % 3 != 0, F.col("p_size").cast("string")))
    head = spark.range(1).select(F.lit("x|y|z").alias("value"), F.lit(0).alias("at"))
    lines = table(spark, sf_dir, "part").select(line.alias("value"), F.lit(1).alias("at"))
    head.unionByName(lines).coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)
    return tabular.read_delimited(spark, path)


@query("src_15_population_recheck", "select count(*) as n, true as unchanged from orders")
def src_15(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    seen = sampling.dataset_fingerprint(o, "o_orderkey", "o_totalprice").withColumnRenamed("fingerprint", "seen")
    now = sampling.dataset_fingerprint(o.repartition(7), "o_orderkey", "o_totalprice")
    return o.agg(F.count("*").alias("n")).crossJoin(seen).crossJoin(now).select("n", (F.col("seen") == F.col("fingerprint")).alias("unchanged"))  # one row each


_PACK_TEXT = json.dumps({"name": "p", "version": "1.3.0", "rules": [{"id": "a", "expression": "value > 100", "severity": "high"}, {"id": "b", "expression": "value > 0", "severity": "low", "effective_to": "2020-01-01"}]})


@query("src_17_rule_pack", "select 'a' as rule, count(*) filter (where value > 100) as hits from events")
def src_17(spark, sf_dir):
    return rules.dry_run(table(spark, sf_dir, "events"), rules.load_pack(_PACK_TEXT), date(2024, 1, 1))


@query("rsk_07_rules_in_force", "select event_id, case when date_part('day', ts) <= 10 then ['a', 'b'] else ['a'] end as in_force from events")
def rsk_07(spark, sf_dir):
    # days of the month as days of 2020, as the pack's second rule ends in that month
    e = table(spark, sf_dir, "events").select("event_id", F.date_add(F.lit(date(2019, 12, 22)), F.dayofmonth("ts")).alias("day"))
    return e.select("event_id", rules.rules_in_force(F.col("day"), rules.load_pack(_PACK_TEXT)).alias("in_force"))


@query("pre_01_clean_headers", "select n_nationkey as key, n_name as name from nation")
def pre_01(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("﻿key "), F.col("n_name").alias(" name"))
    return prepare.clean_headers(n)


@query("pre_04_non_finite", "select 'non_finite' as reason, count(*) as n from events where event_id % 50 = 0")
def pre_04(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, "Infinity").otherwise("1").alias("v"))
    return prepare.prepared_cells(e, "event_id", numbers=("v",)).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query("pre_09_not_applicable", "select count(*) as n, count(nullif(p_size, 50)) as applicable from part")
def pre_09(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.when(F.col("p_size") != 50, F.col("p_size")).alias("s")).agg(F.count("*").alias("n"), F.count("s").alias("applicable"))


@query("frq_05_canonical_order", "select o_orderkey from orders order by o_orderkey limit 100")
def frq_05(spark, sf_dir):
    return frequency.canonical_order(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").limit(100)


@query("rsk_17_persisted_scores", "with m as (select median(value) as med from events), d as (select median(abs(value - med)) as mad from events, m) select event_type, count(*) filter (where abs(value - med) / (1.4826 * mad) > 3.5) as flagged from events, m, d group by 1")
def rsk_17(spark, sf_dir):
    from tallyward.sources.sinks import write_scores

    path = _folder(spark, "scores")
    write_scores(risk.robust_flag(table(spark, sf_dir, "events"), "value").select("event_id", "event_type", "flag_outlier"), path, "event_type")
    return spark.read.parquet(path).groupBy("event_type").agg(F.count_if("flag_outlier").alias("flagged"))


@query(
    "smp_02_expansion_factor",
    "with p as (select p_partkey, 0.45 + p_size / 90.0 as c from part) select p_partkey, round(case when c <= 0.5 then 1.0 when c >= 0.99 then 1.9 when c <= 0.75 then 1 + (c - 0.5) when c <= 0.8 then 1.25 + (c - 0.75) when c <= 0.85 then 1.3 + 2 * (c - 0.8) "
    "when c <= 0.9 then 1.4 + 2 * (c - 0.85) when c <= 0.95 then 1.5 + 2 * (c - 0.9) else 1.6 + 7.5 * (c - 0.95) end, 6)::double as factor from p",
)
def smp_02(spark, sf_dir):
    c = F.lit(0.45) + F.col("p_size") / 90.0
    return table(spark, sf_dir, "part").select("p_partkey", F.round(sampling.expansion_factor_column(c), 6).alias("factor"))


@query("smp_04_attribute_size", "select o_custkey, least(count(*), ceil(-ln(0.05) / (0.05 * (1 + o_custkey % 4))))::int as n from orders group by 1")
def smp_04(spark, sf_dir):
    size = F.pandas_udf(lambda rate, population: pd.Series([sampling.attribute_sample_size(r, 0.0, 0.95, p) for r, p in zip(rate, population, strict=True)]), "int")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("population"))
    return o.select("o_custkey", size(F.lit(0.05) * (1 + F.col("o_custkey") % 4), "population").alias("n"))


@query("smp_05_basic_precision", "select p_partkey, round(-ln(0.05) * p_retailprice, 4) as precision from part")
def smp_05(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(sampling.basic_precision(F.col("p_retailprice"), 0.95), 4).alias("precision"))


@query("smp_11_projectable", "select case when l_partkey % 50 = 3 then 'certainty' when l_partkey % 9 = 1 then 'high_risk' else 'monetary_unit' end as basis, l_partkey % 50 = 3 or l_partkey % 9 <> 1 as projectable, count(*) as n from lineitem group by 1, 2")
def smp_11(spark, sf_dir):
    from tallyward.plans.audit import _tested

    return _tested(spark, sf_dir).groupBy(F.col("selection_basis").alias("basis"), sampling.projectable(F.col("selection_basis")).alias("projectable")).agg(F.count("*").alias("n"))


@query("smp_14_evaluate_run", "with s as (select o_orderkey, o_orderkey % 4 <> 0 as done from orders) select count(*) filter (where done) as tested, count(*) filter (where not done) as untested, count(*) filter (where not done) = 0 as complete from s")
def smp_14(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select("o_orderkey")
    values = s.where("o_orderkey % 4 <> 0").withColumn("audit", F.lit(1))
    j = s.join(values, "o_orderkey", "left")
    return j.agg(F.count("audit").alias("tested"), F.count_if(F.col("audit").isNull()).alias("untested"), (F.count_if(F.col("audit").isNull()) == 0).alias("complete"))


@query("smp_17_seed", "select count(*) as n, count(distinct c_name) as seeds, true as in_range from customer")
def smp_17(spark, sf_dir):
    seeds = F.pandas_udf(lambda names: names.map(lambda x: sampling.derive_seed(run="audit", item=x)), "long")
    s = table(spark, sf_dir, "customer").select(seeds("c_name").alias("seed"))
    return s.agg(F.count("*").alias("n"), F.countDistinct("seed").alias("seeds"), F.bool_and(F.col("seed") >= 0).alias("in_range"))


@query("join_19_item_evidence", "select o_orderkey, case when o_totalprice >= 450000 then 'high_risk' when o_orderkey % 10 = 0 then 'random' else 'not_selected' end as basis, greatest(0, 450000 - o_totalprice) as gap from orders")
def join_19(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    high = o.where("o_totalprice >= 450000").select("o_orderkey", F.lit(True).alias("high"))
    rnd = o.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit(True).alias("rnd"))
    j = o.join(high, "o_orderkey", "left").join(rnd, "o_orderkey", "left")
    return j.select("o_orderkey", F.when(F.col("high"), "high_risk").when(F.col("rnd"), "random").otherwise("not_selected").alias("basis"), F.greatest(F.lit(0.0), 450000 - F.col("o_totalprice")).alias("gap"))


@query("fn_10_column_names", "select p_partkey, trim(regexp_replace(lower(' ' || p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '_', 'g'), '_') as name from part")
def fn_10(spark, sf_dir):
    raw = F.concat(F.lit(" "), "p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", credit.normal_name_column(raw).alias("name"))


@query("fn_17_version_constraint", "select p_partkey, case when p_size % 11 <> 0 then (p_size % 3, p_size % 7, p_partkey % 10) >= (1, 2, 0) and (p_size % 3, p_size % 7, p_partkey % 10) < (2, 0, 0) end as fits from part")
def fn_17(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    version = F.concat_ws(".", (size % 3).cast("string"), (size % 7).cast("string"), (key % 10).cast("string"))
    constraint = F.when(size % 11 == 0, "any").when(key % 2 == 0, ">=1.2.0 <2.0.0").otherwise(">= 1.2.0, < 2.0.0")
    return table(spark, sf_dir, "part").select("p_partkey", normalize.satisfies_column(version, constraint).alias("fits"))


_ESCAPED = (
    "array_to_string(list_transform(string_split({t}, ''), lambda c: case when c = '\"' then '\\\"' when c = '\\' then '\\\\' when c = chr(10) then '\\n' when c = chr(13) then '\\r' when c = chr(9) then '\\t' when unicode(c) between 32 and 126 then c "
    "when unicode(c) > 65535 then printf('\\u%04x\\u%04x', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) else printf('\\u%04x', unicode(c)) end), '')"
)


@query("fn_18_canonical_json", "select event_id, '{\"Meta\":{\"at\":\"' || strftime(ts, '%Y-%m-%d') || '\",\"ok\":' || (event_id % 2 = 0)::varchar || '},\"list\":[' || user_id || ',null],\"m\":{\"a\":' || event_id || ',\"b\":0},\"value\":' || coalesce(value::varchar, 'null') || '}' as j from events")
def fn_18(spark, sf_dir):
    k = F.col("event_id")
    value = F.struct(F.create_map(F.lit("b"), F.lit(0).cast("long"), F.lit("a"), k).alias("m"), F.col("value"), F.struct((k % 2 == 0).alias("ok"), F.to_date("ts").alias("at")).alias("Meta"), F.array("user_id", F.lit(None).cast("long")).alias("list"))
    d = table(spark, sf_dir, "events").select("event_id", value.alias("v"))
    return d.select("event_id", canonical_json(F.col("v"), d.schema["v"].dataType).alias("j"))


@query("fn_18_content_hash", "select conv_id, turn, sha256('{\"role\":\"' || role || '\",\"text\":' || case when text is null then 'null' else '\"' || " + _ESCAPED.format(t="text") + " || '\"' end || ',\"turn\":' || turn || '}') as digest from conversations")
def fn_18_hash(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("turn", "text", "role").alias("v"))
    return d.select("conv_id", "turn", content_hash(F.col("v"), d.schema["v"].dataType).alias("digest"))


@query("ml_18_match_confidence")
def ml_18(spark, sf_dir):
    from tallyward.plans.credit import _scored

    d = _scored(spark, sf_dir)
    m = credit.isotonic(d, "p", "y")
    steps = spark.createDataFrame([(float(a), float(b)) for a, b in zip(m.boundaries, m.predictions, strict=True)], "edge double, value double")
    return d.join(F.broadcast(steps), F.col("edge") <= F.col("p"), "left").groupBy("doc_id").agg(F.round(F.max_by("value", "edge"), 6).alias("confidence"))


@query(
    "ml_13_gated_selection",
    "with s as (select d.source, least(1, d.n_chars / 8000) as p, coalesce(l.toxic, 0) as y from documents d join labels l using (doc_id)), m as (select source as model, count(*) as n, -avg((p - y) * (p - y)) as skill, abs(avg(p) - avg(y)) as bias from s group by 1) "
    "select model, round(skill, 6) as skill from m where n >= 10 and bias <= 0.5 order by m.skill desc, model limit 1",
)
def ml_13(spark, sf_dir):
    from tallyward.plans.credit import _scored

    d = _scored(spark, sf_dir)
    m = d.groupBy(F.col("source").alias("model")).agg(F.count("*").alias("n"), (-F.avg((F.col("p") - F.col("y")) ** 2)).alias("skill"), F.abs(F.avg("p") - F.avg("y")).alias("bias"))
    return credit.select_gated(m, "skill", (F.col("n") >= 10) & (F.col("bias") <= 0.5)).select("model", F.round("skill", 6).alias("skill"))


@query("ml_21_generated_rows")
def ml_21(spark, sf_dir):
    """As many members as customers, by the share of arrears at each number of late payments."""
    d = credit.generate_members(spark, table(spark, sf_dir, "customer").count())
    return d.groupBy("late_cnt").agg(F.count("*").alias("n"), F.round(F.avg("arrears_flag"), 4).alias("arrears"))


@query("wf_08_decisions", "with d as (select o_orderkey as case_id, case when o_orderkey % 3 = 0 then 'APPROVED' when o_orderkey % 3 = 1 then 'REJECTED' else 'PROPOSED' end as status from orders) select status, count(*) as n from d group by 1")
def wf_08(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    cases = o.select(k.alias("case_id"), F.lit("PROPOSED").alias("status"))
    first = o.where("o_orderkey % 3 < 2").select(k.alias("case_id"), F.lit("return").alias("action"), F.lit(1).alias("at"))
    second = o.where("o_orderkey % 3 < 2").select(k.alias("case_id"), F.when(k % 3 == 0, "approve").otherwise("reject").alias("action"), F.lit(2).alias("at"))
    return lifecycle.decide(cases, first.unionByName(second)).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "wf_16_plan_problems",
    "with s as (select event_id, event_id % 6 as shape, event_type from events) select event_id, case shape when 0 then 'FORBIDDEN_STEP' when 1 then 'UNKNOWN_STEP' when 2 then 'UNKNOWN_PARAMETER' else 'UNKNOWN_COLUMN' end as problem, "
    "case shape when 2 then 'how' when 3 then event_type when 4 then 'nope' else '' end as items from s where shape < 3 or shape = 3 and event_type not in ('click', 'view') or shape = 4",
)
def wf_16(spark, sf_dir):
    k, e = F.col("event_id") % 6, F.col("event_type")
    step = F.when(k == 0, "drop_duplicates").when(k == 1, "trim").when(k == 4, "engineer_feature").otherwise("scale_numeric")
    params = F.when(k == 2, F.create_map(F.lit("column"), F.lit("view"), F.lit("how"), e)).when(k == 4, F.create_map(F.lit("name"), e)).otherwise(F.create_map(F.lit("column"), F.when(k == 5, "view").otherwise(e)))
    sources = F.when(k == 4, F.array(F.lit("click"), F.lit("nope")))
    steps = table(spark, sf_dir, "events").select("event_id", step.alias("step"), params.alias("params"), sources.alias("source_columns"))
    return lifecycle.plan_step_problems(steps, ["click", "view"]).select("event_id", "problem", F.array_join("items", ",").alias("items"))


@query(
    "wf_20_promotion",
    "with v as (select distinct p_brand as model, p_size as version, case when p_size % 10 = 1 then 'production' else 'candidate' end as stage from part), c as (select model, max(version) as version from v where model like '%1' group by 1) "
    "select v.model, v.version, case when c.version is null then stage when v.version = c.version then 'production' when stage = 'production' then 'archived' else stage end as stage from v left join c using (model)",
)
def wf_20(spark, sf_dir):
    v = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), F.col("p_size").alias("version"), F.when(F.col("p_size") % 10 == 1, "production").otherwise("candidate").alias("stage")).distinct()
    chosen = v.where("model like '%1'").groupBy("model").agg(F.max("version").alias("version"))
    return lifecycle.promote(v, "model", "version", chosen)
