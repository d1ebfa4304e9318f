"""Readers on small files."""

import io
import json
import zipfile

import pytest

from tallyward.operators import prepare
from tallyward.sources import packs, sinks, statements, tabular, workbook
from tallyward.streaming import bulk

MT940 = ":20:X\n:25:ACC\n:60F:C240101EUR1000,00\n:61:2401020102C50,00NTRFREF1\n:86:first\nline\n:61:240103D25,50NMSCREF2\n:86:second\n:62F:C240103EUR1024,50\n-}"
BAI2 = "01,S,R,240101,1200,1,,,2/\n02,R,S,1,240101,,USD,2/\n03,ACC,USD,010,,,/\n16,195,5000,0,REF1,,payment/\n88,more text/\n16,495,2500,0,REF2,,fee/\n49,7500,4/\n98,7500,1,6/\n99,7500,1,8/"
CAMT = """<Document xmlns="urn:x"><BkToCstmrStmt><Stmt><Acct><Id><IBAN>DE1</IBAN></Id></Acct>
<Bal><Tp><CdOrPrtry><Cd>OPBD</Cd></CdOrPrtry></Tp><Amt Ccy="EUR">1000.00</Amt><CdtDbtInd>CRDT</CdtDbtInd><Dt><Dt>2024-01-01</Dt></Dt></Bal>
<Bal><Tp><CdOrPrtry><Cd>CLBD</Cd></CdOrPrtry></Tp><Amt Ccy="EUR">1024.50</Amt><CdtDbtInd>CRDT</CdtDbtInd><Dt><Dt>2024-01-03</Dt></Dt></Bal>
<Ntry><NtryRef>R1</NtryRef><Amt Ccy="EUR">50.00</Amt><CdtDbtInd>CRDT</CdtDbtInd><BookgDt><Dt>2024-01-02</Dt></BookgDt></Ntry>
<Ntry><NtryRef>R2</NtryRef><Amt Ccy="EUR">25.50</Amt><CdtDbtInd>DBIT</CdtDbtInd><ValDt><Dt>2024-01-03</Dt></ValDt></Ntry></Stmt></BkToCstmrStmt></Document>"""


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_separators(spark, tmp_path, sep):
    p = tmp_path / "x.csv"
    p.write_text(f"﻿age{sep}job{sep}note\n1{sep}a{sep}\"x{sep}y\"\n2{sep}b{sep}\n")
    got = tabular.read_delimited(spark, str(p))
    assert got.columns == ["age", "job", "note"]
    assert sorted(map(tuple, got.collect())) == [("1", "a", f"x{sep}y"), ("2", "b", "")]


def test_cp1252(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes("name;city\nJosé;Köln\n".encode("cp1252"))
    assert tabular.read_delimited(spark, str(p)).first()["city"] == "Köln"


def test_wrapped_json_is_flattened(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text(json.dumps({"records": [{"user": {"id": 1, "tier": "a"}, "amount": 5, "tags": [1, 2]}, {"user": {"id": 2, "tier": "b"}, "amount": 6, "tags": []}]}))
    got = tabular.read_json(spark, str(p))
    assert set(got.columns) == {"amount", "tags", "user.id", "user.tier"}
    assert got.where("amount = 5").first()["tags"] == "[1,2]"


@pytest.mark.parametrize(("kind", "text"), [("mt940", MT940), ("bai2", BAI2), ("camt053", CAMT)])
def test_statements(spark, tmp_path, kind, text):
    (tmp_path / "f.txt").write_text(text)
    rows = statements.read_statements(spark, str(tmp_path / "f.txt"), kind)
    got = [(r["amount"], r["direction"], r["reference"]) for r in rows.where("kind = 'ENTRY'").orderBy("line_no").collect()]
    assert [(float(a), d) for a, d, _ in got] == ([(50.0, "CR"), (25.0, "DR")] if kind == "bai2" else [(50.0, "CR"), (25.5, "DR")])
    if kind != "bai2":
        assert float(statements.balance_check(rows).first()["difference"]) == 0


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row/><row>{cell("A2", "Name")}{cell("C2", "Name")}</row><row>{cell("A3", "x")}{cell("B3", "y")}</row></sheetData></worksheet>')
    (tmp_path / "w.xlsx").write_bytes(b.getvalue())
    assert workbook.sheet_names(b.getvalue()) == ["One"]
    assert tabular.load(spark, str(tmp_path / "w.xlsx")).first()["fields"] == {"Name": "x", "Name (2)": "y", "Name (3)": ""}


def test_long_records_fail(spark):
    d = spark.createDataFrame([("x" * 100,)], "a string")
    assert tabular.guard(d).count() == 1
    with pytest.raises(Exception, match="longer"):
        tabular.guard(d, most_record=10).count()


def test_findings_are_whole(spark, tmp_path):
    sinks.write_findings(spark.range(5), str(tmp_path / "out"))
    assert (tmp_path / "out" / "_SUCCESS").exists() and spark.read.json(str(tmp_path / "out")).count() == 5


def test_bulk_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"id": k * 100 + i, "amount": 10 + i % 5 if i != 50 else 10_000}) for i in range(100)))
    q = bulk.score_files(spark, str(src), "id long, amount double", "id", "amount", str(tmp_path / "out"), str(tmp_path / "cp"), files_per_batch=1)
    q.awaitTermination(120)
    assert sorted(r["row"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [50, 150, 250]


def test_uploads(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1, "y": "a"}, {"x": 2, "y": null}]')
    assert tabular.read_upload(spark, str(tmp_path / "a.json")).count() == 2
    for name, text, why in (("b.json", '[{"x": {"y": 1}}]', "NESTED"), ("c.json", '{"rows": [{"x": 1}]}', "array"), ("d.csv", "x,y\n", "ROWS"), ("e.txt", "x\n1\n", "accepted")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match=why):
            tabular.read_upload(spark, str(tmp_path / name))
    assert tabular.upload_problem(spark.range(3), most_rows=2).first()["problem"] == "ROWS"
    assert tabular.upload_problem(spark.range(3).selectExpr("id", "id as b"), most_columns=1).first()["problem"] == "COLUMNS"


def test_manifests(spark, tmp_path):
    for i, text in enumerate(('{"pack": {"id": "p", "version": "1.0.0", "engine_compat": ">=1.2.0, <2.0.0"}}', '{"pack": {"id": "p", "version": "1.0.0", "engine_compat": "1.3.0"}}', '{"pack": {"id": "p"}}', "no json", '{"pack": {"id": "p", "version": "1.0.0", "engine_compat": ">=one"}}')):
        (tmp_path / f"{i}.json").write_text(text)
    got = sorted((r["file"][-6], r["problem"]) for r in packs.load_manifests(spark, str(tmp_path), "1.4.0").collect())
    assert got == [("0", None), ("1", "INCOMPATIBLE"), ("2", "INVALID"), ("3", "INVALID"), ("4", "INCOMPATIBLE")]


def test_policy_from_environment():
    p = prepare.Policy.from_environment({"X_EXCLUDED_COLUMNS": " a, ,b", "X_RATIO_PAIRS": '[["c", "d"]]'}, "X_")
    assert (p.excluded, p.targets, p.ratio_pairs) == (("a", "b"), prepare.TARGETS, (("c", "d"),))
    for bad in ('[["c", "c"]]', '[["c"]]', '{"c": "d"}', json.dumps([["a", "b"]] * 29)):
        with pytest.raises(ValueError):
            prepare.Policy.from_environment({"X_RATIO_PAIRS": bad}, "X_")
