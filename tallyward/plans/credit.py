"""Queries: credit-risk dataflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.operators import credit
from tallyward.plans.registry import query
from tallyward.session import spread, table

_S = "with s as (select d.doc_id, d.source, least(1, d.n_chars / 8000) as p, coalesce(l.toxic, 0) as y from documents d join labels l using (doc_id)) "


def _scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return d.select("doc_id", "source", F.least(F.lit(1.0), F.col("n_chars") / 8000).alias("p"), F.coalesce("toxic", F.lit(0)).alias("y"))


@query("ml_01_mapping", "select c_custkey as member_id, c_acctbal as loan_amount, c_nationkey as days_past_due, c_mktsegment as market_segment, c_name as target_arrears from customer")
def ml_01(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return credit.apply_mapping(c.select(F.col("c_custkey").alias("Cust No"), F.col("c_acctbal").alias("loan_amt"), F.col("c_nationkey").alias("DPD"), F.col("c_mktsegment").alias(" Market-Segment"), F.col("c_name").alias("default flag")))


_NAMES = ("Gender", "Post Code", "zip", "trace no", "unzipped", "Future Balance", "written off", "write-off", "political view", "e mail", "surname 2", "AGE band", "average", "income", "final_default", "Languages")
_NAME_SQL = "select c_custkey, lower((['" + "', '".join(_NAMES) + f"'])[c_custkey % {len(_NAMES)} + 1] || ' ' || c_nationkey) as raw from customer"
_LIST = lambda words: "['" + "', '".join(words) + "']"


@query(
    "fn_11_governance_flags",
    f"with r as ({_NAME_SQL}), n as (select c_custkey, trim(regexp_replace(raw, '[^a-z0-9]+', '_', 'g'), '_') as n from r), p as (select *, list_append(string_split(n, '_'), n) as parts from n) "
    f"select c_custkey, case when list_has_any(parts, {_LIST([*credit.PROTECTED, 'political'])}) then 'protected' when list_has_any(parts, {_LIST(credit.PROXY)}) then 'review' when regexp_matches(n, '{credit.LEAKAGE}') then 'leakage' end as flag from p",
)
def fn_11(spark, sf_dir):
    names = F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (F.col("c_custkey") % len(_NAMES) + 1).cast("int"))
    c = table(spark, sf_dir, "customer").withColumn("raw", F.concat_ws(" ", names, F.col("c_nationkey").cast("string")))
    return c.select("c_custkey", credit.governance_flag(F.col("raw")).alias("flag"))


@query("ml_02_feature_problems", "select * from (values ('c_acctbal', 'NEGATIVE'), ('c_name', 'CARDINALITY')) t(feature, problem)")
def ml_02(spark, sf_dir):
    return credit.feature_problems(table(spark, sf_dir, "customer"), ["c_acctbal", "c_name", "c_mktsegment"])


@query(
    "ml_03_purged_split",
    "with d as (select distinct o_orderdate::date as d from orders), r as (select d, row_number() over (order by d) as r, count(*) over () as n from d), c as (select min(d) filter (where r >= ceil(n * 0.5)) as c0, min(d) filter (where r >= ceil(n * 0.65)) as c1, min(d) filter (where r >= ceil(n * 0.8)) as c2 from r), "
    "p as (select o_orderkey, o_custkey, case when o_orderdate::date <= c0 then 0 when o_orderdate::date > c0 + 90 and o_orderdate::date <= c1 then 1 when o_orderdate::date > c1 + 90 and o_orderdate::date <= c2 then 2 when o_orderdate::date > c2 + 90 then 3 end as p from orders, c), "
    "l as (select *, max(p) over (partition by o_custkey) as last from p where p is not null) select o_orderkey, (['fit', 'tune', 'calibrate', 'test'])[p + 1] as part from l where p = last",
)
def ml_03(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return credit.purged_split(o, "o_custkey", "day").select("o_orderkey", "part")


@query("ml_04_stratified_split", "with u as (select doc_id, ('0x' || substr(md5(toxic || '|' || doc_id), 1, 8))::bigint / 4294967296.0 as u from labels where toxic is not null) select doc_id, case when u < 0.5 then 'fit' when u < 0.65 then 'tune' when u < 0.8 then 'calibrate' else 'test' end as part from u")
def ml_04(spark, sf_dir):
    return credit.stratified_split(table(spark, sf_dir, "labels").where("toxic is not null"), "doc_id", "toxic").select("doc_id", "part")


@query("ml_05_last_history", "with r as (select o_custkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) select o_custkey, round(sum(o_totalprice), 2) as total, count(*) as steps from r where r <= 6 group by 1 having count(*) = 6")
def ml_05(spark, sf_dir):
    h = credit.last_history(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", ["o_totalprice"], tie="o_orderkey")
    return h.select("o_custkey", F.round(F.aggregate("history", F.lit(0.0), lambda a, x: a + x["o_totalprice"]), 2).alias("total"), F.size("history").cast("long").alias("steps"))


@query("ml_06_impute_scale", "with e as (select event_id, case when event_id % 10 = 0 then null else value end as v from events), f as (select * from e where event_id % 2 = 0), m as (select median(v) as m from f), s as (select avg(coalesce(v, m)) as a, stddev_pop(coalesce(v, m)) as s from f, m) select event_id, round((coalesce(v, m) - a) / s, 6) as v from e, m, s")
def ml_06(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("v"))
    return credit.impute_and_scale(e, e.where("event_id % 2 = 0"), ["v"]).select("event_id", F.round("v", 6).alias("v"))


@query("ml_07_logistic_candidate")
def ml_07(spark, sf_dir):
    d = _scored(spark, sf_dir).withColumn("len", F.col("p") * F.col("p"))
    model = credit.candidates(["p", "len"], "y")["logistic"].fit(d)
    from pyspark.ml.functions import vector_to_array

    return model.transform(d).select("doc_id", F.round(vector_to_array("probability")[1], 6).alias("p"))


@query("ml_08_isotonic_calibration")
def ml_08(spark, sf_dir):
    m = credit.isotonic(_scored(spark, sf_dir), "p", "y")
    return spark.createDataFrame([(float(b), float(v)) for b, v in zip(m.boundaries, m.predictions)], "boundary double, value double")


_CONF = "c as (select {g} count(*) filter (where p >= 0.3 and y = 1) as tp, count(*) filter (where p >= 0.3 and y = 0) as fp, count(*) filter (where p < 0.3 and y = 0) as tn, count(*) filter (where p < 0.3 and y = 1) as fn, avg((p - y) * (p - y)) as b from s {gb}), m as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as pr, case when tp + fn > 0 then tp / (tp + fn) else 0 end as re, case when tn + fp > 0 then tn / (tn + fp) else 0 end as sp from c) select {g} tp, fp, tn, fn, round(pr, 6) as precision, round(re, 6) as recall, round(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end, 6) as f1, round(sp, 6) as specificity, round((re + sp) / 2, 6) as balanced, round(case when tp + fn > 0 then fn / (tp + fn) else 0 end, 6) as fnr, round(b, 6) as brier from m"


@query("ml_10_threshold_metrics", _S + ", " + _CONF.format(g="", gb=""))
def ml_10(spark, sf_dir):
    return credit.threshold_metrics(_scored(spark, sf_dir), "p", "y", 0.3)


@query("ml_10_ranking_metrics", _S + ", g as (select p, count(*) filter (where y = 1) as pos, count(*) filter (where y = 0) as neg from s group by 1), c as (select *, sum(pos) over (order by p desc) as tp, sum(neg) over (order by p desc) as fp, sum(pos) over () as pp, sum(neg) over () as nn from g) select round(sum(neg * (tp - pos / 2)) / (max(pp) * max(nn)), 6) as roc_auc, round(sum(pos / pp * tp / (tp + fp)), 6) as average_precision from c")
def ml_10_ranking(spark, sf_dir):
    return credit.ranking_metrics(_scored(spark, sf_dir), "p", "y")


@query("ml_11_best_threshold", _S + ", g as (select p, count(*) filter (where y = 1) as pos, count(*) filter (where y = 0) as neg from s group by 1), c as (select *, sum(pos) over (order by p desc) as tp, sum(neg) over (order by p desc) as fp, sum(pos) over () as pp from g) select arg_max(p, (round(2 * tp / (tp + fp + pp), 9), p)) as threshold, round(max(2 * tp / (tp + fp + pp)), 6) as f1 from c")
def ml_11(spark, sf_dir):
    return credit.best_threshold(_scored(spark, sf_dir), "p", "y")


@query("ml_11_recall_threshold", _S + ", g as (select p, count(*) filter (where y = 1) as pos from s group by 1), c as (select *, sum(pos) over (order by p desc) as tp, sum(pos) over () as pp from g) select max(p) as threshold from c where tp / pp >= 0.8")
def ml_11_recall(spark, sf_dir):
    return credit.best_threshold(_scored(spark, sf_dir), "p", "y", 0.8)


@query("ml_12_weighted_mean", _S + "select doc_id, round((0.5 * p + 0.3 * p * p + 0.2 * sqrt(p)), 6) as p from s")
def ml_12(spark, sf_dir):
    p = F.col("p")
    return _scored(spark, sf_dir).select("doc_id", F.round(0.5 * p + 0.3 * p * p + 0.2 * F.sqrt(p), 6).alias("p"))


@query("ml_14_score_bands", _S + "select doc_id, case when p >= 0.6 then 'high' when p >= 0.25 then 'medium' else 'low' end as band from s")
def ml_14(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", credit.band(F.col("p"), [0.25, 0.6], ["low", "medium", "high"]).alias("band"))


@query("ml_15_contributions", "select event_id, case when abs((value - 40) * 0.02) >= abs((user_id - 50) * 0.01) then 'value' else 'user_id' end as leading from events where value is not null and abs((value - 40) * 0.02) <> abs((user_id - 50) * 0.01)")
def ml_15(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null and abs((value - 40) * 0.02) <> abs((user_id - 50) * 0.01)")
    return e.select("event_id", credit.contributions({"value": (40.0, 0.02), "user_id": (50.0, 0.01)})[0]["feature"].alias("leading"))


@query("ml_15_tree_attributions", "select p_partkey, 2 as n_features, 0.0::double as gap from part")
def ml_15_trees(spark, sf_dir):
    """gap is what base and attributions miss of the margin of boosted trees."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from tallyward.operators.attribution import tree_attributions

    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 40).cast("double").alias("shelf"), "p_retailprice")
    d = VectorAssembler(inputCols=["size", "shelf"], outputCol="_f").transform(spread(part, "p_partkey"))
    model = GBTRegressor(featuresCol="_f", labelCol="p_retailprice", predictionCol="margin", maxIter=5, maxDepth=3, seed=1).fit(d)
    out = tree_attributions(model.transform(d), model, ["size", "shelf"])
    total = F.aggregate("attributions.by_feature", F.col("attributions.base"), lambda a, x: a + x["attribution"])
    return out.select("p_partkey", F.size("attributions.by_feature").alias("n_features"), (F.round(total - F.col("margin"), 6) + 0.0).alias("gap"))


@query("ml_16_drift", "with r as (select avg(value) as a, stddev_pop(value) as s, avg(user_id) as ua, stddev_pop(user_id) as us from events where event_type <> 'purchase'), n as (select avg(value) as v, avg(user_id) as u from events where event_type = 'purchase') select 'value' as \"column\", round(abs(v - a) / greatest(s, 1e-6), 6) as shift, abs(v - a) / greatest(s, 1e-6) > 0.5 as drifted from r, n union all select 'user_id', round(abs(u - ua) / greatest(us, 1e-6), 6), abs(u - ua) / greatest(us, 1e-6) > 0.5 from r, n")
def ml_16(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return credit.drift(e.where("event_type = 'purchase'"), e.where("event_type <> 'purchase'"), ["value", "user_id"])


@query("ml_17_fairness", _S + ", " + _CONF.format(g="source,", gb="group by source"))
def ml_17(spark, sf_dir):
    return credit.threshold_metrics(_scored(spark, sf_dir), "p", "y", 0.3, "source")


@query("ml_19_calibration_error", _S + ", g as (select least(floor(p * 10), 9) as b, count(*) as n, avg(p) as s, avg(y) as r from s group by 1) select round(sum(n * abs(s - r)) / sum(n), 6) as ece from g")
def ml_19(spark, sf_dir):
    return credit.calibration_error(_scored(spark, sf_dir), "p", "y")


@query("ml_20_reliability", _S + "select least(floor(p * 10), 9)::int as bin, count(*) as n, round(avg(p), 6) as mean_score, round(avg(y), 6) as rate from s group by 1")
def ml_20(spark, sf_dir):
    return credit.reliability(_scored(spark, sf_dir), "p", "y")
