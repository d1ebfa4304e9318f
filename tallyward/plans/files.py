"""Queries: nested JSON, batches, sinks, over the driver tables."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from tallyward.operators import ordering, prepare
from tallyward.plans.registry import query
from tallyward.session import shared_dir, table
from tallyward.sources import packs, sinks, statements, tabular, workbook


@query("src_03_nested_flatten", "select event_id, (props->>'$.k')::bigint as \"p.k\" from events")
def src_03(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    return tabular.flatten(e)


@query("src_05_batches", "select (row_number() over (order by event_id) - 1) // 2500 as batch_id, event_id from events")
def src_05(spark, sf_dir):
    e = ordering.row_numbers(table(spark, sf_dir, "events").select("event_id"), [F.col("event_id")])
    return tabular.batch_ids(e, "row_id", rows=2500).select("batch_id", "event_id")


@query("src_06_parquet_scan", "select count(*) as n, max(o_orderkey) as last from orders")
def src_06(spark, sf_dir):
    return tabular.load(spark, f"{sf_dir}/orders.parquet").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


@query("src_16_audit_values", "select count(*) filter (where d.doc_id is not null) as known, count(*) filter (where d.doc_id is null) as unknown from (select doc_id from labels union all select -doc_id - 1 from labels where doc_id % 7 = 0) v left join documents d using (doc_id)")
def src_16(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select("doc_id")
    v = l.unionByName(l.where("doc_id % 7 = 0").select((-F.col("doc_id") - 1).alias("doc_id")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("known"))
    return v.join(d, "doc_id", "left").agg(F.count("known").alias("known"), F.count_if(F.col("known").isNull()).alias("unknown"))


# --- statements: one of each customer, several in a file ----------------------------------------------------

_STATEMENTS = (
    "with o as (select 'C' || o_custkey as account, case when o_orderkey % 2 = 0 then 'CR' else 'DR' end as direction, round(o_totalprice, 2)::decimal(28,2) as amount from orders) "
    "select account, direction, count(*) as n, sum(amount) as total, 0::decimal(38,2) as difference from o group by 1, 2"
)


def _accounts(spark, sf_dir, entry, net):
    """(account, entries, closing, side): of each customer the lines of its orders, in order, and what they net to."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    amount = F.round("o_totalprice", 2).cast("decimal(28,2)")
    signed = F.sum(F.when(k % 2 == 0, amount).otherwise(-amount))
    rows = o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(entry(k, amount))), "").alias("entries"), signed.alias("net"))
    return rows.select("o_custkey", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("account"), "entries", net(F.abs("net")).alias("closing"), (F.col("net") >= 0).alias("credit"))


def _read_back(spark, texts, kind, per_file):
    """Writes one text per row, so many to a file, reads the files as statements and sums them up."""
    path = f"{shared_dir(spark)}/statements-{spark.sparkContext.applicationId}-{kind}"
    texts.select("value").write.mode("overwrite").option("maxRecordsPerFile", per_file).text(path)
    rows = statements.read_statements(spark, path, kind)
    sums = rows.where("kind = 'ENTRY'").groupBy("account", "direction").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(28,2)")).alias("total"))
    if kind == "bai2":  # it has no balances here
        return sums.withColumn("difference", F.lit(0).cast("decimal(38,2)"))
    return sums.join(statements.balance_check(rows).select("account", "difference"), "account")


def _comma(amount):
    return F.translate(amount.cast("string"), ".", ",")


@query("src_11_mt940_grammar", _STATEMENTS)
def src_11(spark, sf_dir):
    entry = lambda k, a: F.concat(F.lit(":61:2401020102"), F.when(k % 2 == 0, "C").otherwise("D"), _comma(a), F.lit("NTRFREF"), k.cast("string"), F.lit("\n:86:first\nline\n"))
    a = _accounts(spark, sf_dir, entry, _comma)
    text = F.concat(F.lit(":20:X\n:25:"), "account", F.lit("\n:60F:C240101EUR0,00\n"), "entries", F.lit(":62F:"), F.when(F.col("credit"), "C").otherwise("D"), F.lit("240103EUR"), "closing", F.lit("\n-}"))
    return _read_back(spark, a.select(text.alias("value")), "mt940", 200)


@query("src_12_camt053_grammar", _STATEMENTS)
def src_12(spark, sf_dir):
    side = lambda credit: F.when(credit, "CRDT").otherwise("DBIT")
    entry = lambda k, a: F.concat(F.lit('<Ntry><Amt Ccy="EUR">'), a.cast("string"), F.lit("</Amt><CdtDbtInd>"), side(k % 2 == 0), F.lit("</CdtDbtInd><BookgDt><Dt>2024-01-03</Dt></BookgDt><NtryRef>R"), k.cast("string"), F.lit("</NtryRef></Ntry>"))
    balance = lambda code, amount, credit: F.concat(F.lit(f'<Bal><Tp><CdOrPrtry><Cd>{code}</Cd></CdOrPrtry></Tp><Amt Ccy="EUR">'), amount, F.lit("</Amt><CdtDbtInd>"), side(credit), F.lit("</CdtDbtInd></Bal>"))
    a = _accounts(spark, sf_dir, entry, lambda net: net.cast("string"))
    one = F.concat(F.lit("<Stmt><Acct><Id><IBAN>"), "account", F.lit("</IBAN></Id></Acct>"), balance("OPBD", F.lit("0.00"), F.lit(True)), balance("CLBD", F.col("closing"), F.col("credit")), "entries", F.lit("</Stmt>"))
    # a file is one document, of a hundred customers at most
    documents = a.groupBy(F.floor(F.col("o_custkey") / 100)).agg(F.concat(F.lit('<Document xmlns="urn:x">'), F.array_join(F.collect_list(one), ""), F.lit("</Document>")).alias("value"))
    return _read_back(spark, documents, "camt053", 1)


@query("src_13_bai2_grammar", _STATEMENTS)
def src_13(spark, sf_dir):
    entry = lambda k, a: F.concat(F.lit("16,"), F.when(k % 2 == 0, "195").otherwise("495"), F.lit(","), (a * 100).cast("long").cast("string"), F.lit(",0,REF"), k.cast("string"), F.lit(",,payment/\n88,more text/\n"))
    a = _accounts(spark, sf_dir, entry, lambda net: net.cast("string"))
    text = F.concat(F.lit("02,R,S,1,240101,,USD,2/\n03,"), "account", F.lit(",USD,010,,,/\n"), "entries", F.lit("49,0,2/"))
    return _read_back(spark, a.select(text.alias("value")), "bai2", 200)


@query("snk_05_csv_export", "select o_orderkey::varchar as o_orderkey, o_totalprice::decimal(20,2)::varchar as o_totalprice from orders")
def snk_05(spark, sf_dir):
    path = f"{shared_dir(spark)}/export-{spark.sparkContext.applicationId}-orders"
    sinks.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), path, money=("o_totalprice",))
    return spark.read.csv(path, header=True, inferSchema=False)


@query("snk_07_evidence_pack", "select o_custkey, count(*) as n from orders group by 1")
def snk_07(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    packs = sinks.evidence_pack(items.select("o_custkey").distinct(), items, "o_custkey")
    back = F.from_json("pack", "items array<struct<o_orderkey:bigint,o_totalprice:double>>")
    return packs.select("o_custkey", F.size(back["items"]).cast("long").alias("n"))


_EXPORTED = "'{\"o_custkey\":' || o_custkey || ',\"o_orderdate\":\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || '\",\"o_orderkey\":' || o_orderkey || ',\"o_orderpriority\":\"' || o_orderpriority || '\",\"o_orderstatus\":\"' || o_orderstatus || '\",\"o_totalprice\":' || o_totalprice || '}'"


@query("snk_08_export_manifest", f"with r as (select o_orderkey, sha256({_EXPORTED}) as h from orders) select count(*) as rows, count(distinct o_orderkey) as keys, sha256(count(*) || '|' || sum(('0x' || substr(h, 1, 14))::ubigint::hugeint)) as digest from r")
def snk_08(spark, sf_dir):
    return sinks.manifest(table(spark, sf_dir, "orders"), "o_orderkey")


@query("snk_06_audit_export", "select event_id, event_type from events")
def snk_06(spark, sf_dir):
    path = f"{shared_dir(spark)}/export-{spark.sparkContext.applicationId}-events"
    sinks.write_csv(table(spark, sf_dir, "events").select("event_id", "event_type").repartitionByRange("event_id").sortWithinPartitions("event_id"), path)
    return spark.read.csv(path, header=True, schema="event_id long, event_type string")


# --- splittable scans, uploads, workbooks, manifests ---------------------------------------------------------


def _path(spark, name):
    return f"{shared_dir(spark)}/{name}-{spark.sparkContext.applicationId}"


@query("src_07_split_scan", "select count(*) as n, sum(l_orderkey) as keys from lineitem")
def src_07(spark, sf_dir):
    path = _path(spark, "split")
    table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity").write.mode("overwrite").csv(path, header=True, sep="\t")
    rows = tabular.read_delimited(spark, path, multiline=False)
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("l_orderkey").cast("long")).alias("keys"))


@query("src_08_upload_limits", "select count(*) as rows, 2 as columns, case when count(*) > 200000 then 'ROWS' end as problem from lineitem")
def src_08(spark, sf_dir):
    return tabular.upload_problem(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"))


_XLSX = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _workbook(rows) -> bytes:
    """A workbook of (key, name, nation) under a blank row and a header that spans two columns, and a sheet of notes."""
    cell = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    lines = [f'<row r="2">{cell("A2", "key")}{cell("B2", "who")}</row>']
    for i, (key, name, nation) in enumerate(rows, 4):
        lines.append(f'<row r="{i}">{cell(f"A{i}", key)}{cell(f"B{i}", name)}{cell(f"C{i}", nation)}</row>')
    # the header's second cell is merged with a third one, which is there and empty
    lines[0] = lines[0].replace("</row>", '<c r="C2"/></row>')
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {_XLSX}><sheets><sheet name="data"/><sheet name="notes"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_XLSX}><sheetData>{''.join(lines)}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {_XLSX}><sheetData/></worksheet>")
    return b.getvalue()


def _workbooks(spark, sf_dir):
    """(path, content): suppliers, 500 to a workbook."""
    pack = F.pandas_udf(lambda rows: rows.map(lambda r: _workbook([(x["key"], x["name"], x["nation"]) for x in r])), "binary")
    row = F.struct(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    books = table(spark, sf_dir, "supplier").groupBy(F.floor(F.col("s_suppkey") / 500).cast("string").alias("path")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return books.select("path", pack("rows").alias("content"))


@query("src_10_workbooks", "select s_suppkey::varchar as \"key\", s_name as who, s_nationkey::varchar as \"who (2)\", row_number() over (partition by s_suppkey // 500 order by s_suppkey) + 3 as line_no from supplier")
def src_10(spark, sf_dir):
    f = F.col("fields")
    return workbook.parse_workbooks(_workbooks(spark, sf_dir)).select(*[f[c].alias(c) for c in ("key", "who", "who (2)")], "line_no")


@query("src_14_sheets", "select distinct (s_suppkey // 500)::varchar as file, sheet from supplier, (values ('data'), ('notes')) t(sheet)")
def src_14(spark, sf_dir):
    return workbook.list_sheets(_workbooks(spark, sf_dir))


@query(
    "src_18_installation",
    "with m as (select p_partkey as key, p_size, p_partkey % 40 as dim, case when p_size % 5 = 0 then 'INVALID' when p_size % 7 = 0 then 'INCOMPATIBLE' end as own from part) "
    "select key, coalesce(own, case when p_size < 25 then 'BREAK_CODE' when dim < 5 then 'DIMENSION' end) as problem, case when own is not null then '' when p_size < 25 then array_to_string(list_sort(case when p_size < 24 then ['B' || p_size, 'B' || (p_size + 1)] else ['B' || p_size] end), ',') when dim < 5 then 'D' || dim else '' end as items from m",
)
def src_18_installation(spark, sf_dir):
    size, text = F.col("p_size"), lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    codes = F.transform(F.array(F.lit(1), F.lit(0)), lambda more: F.struct(F.when(size + more < 100, text("B", size + more)).alias("code")))
    pack = F.struct(F.col("p_name").alias("id"), F.when(size % 5 != 0, "1.0.0").alias("version"), F.when(size % 7 == 0, ">=2.0.0").otherwise(">=1.0.0 <2.0.0").alias("engine_compat"))
    manifest = F.struct(pack.alias("pack"), F.when(size != 49, codes).alias("break_types"), F.array(F.struct(text("D", F.col("p_partkey") % 40).alias("key"))).alias("dimensions"))
    installed = table(spark, sf_dir, "nation").select(F.lit("BREAK_CODE").alias("kind"), text("B", F.col("n_nationkey")).alias("name")).unionByName(table(spark, sf_dir, "region").select(F.lit("DIMENSION").alias("kind"), text("D", F.col("r_regionkey")).alias("name")))
    found = packs.installation_problems(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.to_json(manifest).alias("raw")), installed)
    return found.select("key", "problem", F.array_join("items", ",").alias("items"))


@query("src_18_manifests", "select p_partkey, case when p_size % 5 = 0 then 'INVALID' when p_size % 7 = 0 or p_size % 8 > 4 or p_size % 8 = 4 and p_partkey % 3 > 0 then 'INCOMPATIBLE' end as problem from part")
def src_18(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    lower = F.concat(F.lit(">=1."), (size % 8).cast("string"), F.lit("."), (key % 3).cast("string"))
    compat = F.when(size % 7 == 0, "newest").otherwise(F.concat(lower, F.when(key % 2 == 0, " <2.0.0").otherwise(",<2.0.0")))
    pack = F.struct(F.col("p_name").alias("id"), F.when(size % 5 != 0, "1.0.0").alias("version"), compat.alias("engine_compat"))
    return table(spark, sf_dir, "part").select("p_partkey", packs.manifest_problem(F.to_json(F.struct(pack.alias("pack"))), "1.4.0").alias("problem"))


@query("src_18_installed_conflicts", "with n as (select distinct p_brand as pack, case when p_size % 2 = 0 then 'break_code' else 'dimension' end as kind, p_size as code from part where p_size > 40), i as (select 'core' as owner, 'break_code' as kind, p_size as code from part where p_size < 45 group by 3) select pack, kind, code, owner from n join i using (kind, code)")
def src_18_conflicts(spark, sf_dir):
    from tallyward.operators.lifecycle import conflicts_with_installed

    part, size = table(spark, sf_dir, "part"), F.col("p_size")
    new = part.where("p_size > 40").select(F.col("p_brand").alias("pack"), F.when(size % 2 == 0, "break_code").otherwise("dimension").alias("kind"), size.alias("code"))
    installed = part.where("p_size < 45").select(F.lit("core").alias("pack"), F.lit("break_code").alias("kind"), size.alias("code")).distinct()
    return conflicts_with_installed(new, installed)


@query("snk_01_findings", "select event_id, value from events where value > 100")
def snk_01(spark, sf_dir):
    path = _path(spark, "findings")
    sinks.write_findings(table(spark, sf_dir, "events").where("value > 100").select("event_id", "value"), path)
    return spark.read.schema("event_id long, value double").json(path)


@query("snk_02_analysis", "select event_type, count(*) as n, max(value) as largest from events group by 1")
def snk_02(spark, sf_dir):
    path = _path(spark, "analysis")
    sinks.save_analysis(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("largest")), path)
    return spark.read.schema("event_type string, n long, largest double").json(path)


@query("snk_03_scores", "select event_id, value as score, event_type from events")
def snk_03(spark, sf_dir):
    path = _path(spark, "all-scores")
    sinks.write_scores(table(spark, sf_dir, "events").select("event_id", F.col("value").alias("score"), "event_type"), path, "event_type")
    return spark.read.parquet(path).select("event_id", "score", "event_type")


@query("snk_04_sample_items", "select o_orderkey as item_id, o_totalprice as amount, case when o_totalprice >= 450000 then 'certainty' else 'random' end as stratum, 'run-2' as run_id from orders union all select o_orderkey, o_totalprice, 'all', 'run-1' from orders")
def snk_04(spark, sf_dir):
    path, o = _path(spark, "sample"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_totalprice").alias("amount"))
    sinks.write_sample(o.withColumn("stratum", F.lit("all")), path, "run-1")
    sinks.write_sample(o.withColumn("stratum", F.when(F.col("amount") >= 450000, "certainty").otherwise("random")), path, "run-2")
    return spark.read.parquet(path)


@query("pre_13_policy", "select event_id, event_type, value from events")
def pre_13(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    policy = prepare.Policy.from_environment({"TALLYWARD_EXCLUDED_COLUMNS": "props, ts", "TALLYWARD_TARGET_COLUMNS": "user_id"})
    return e.select(*policy.features(e))
