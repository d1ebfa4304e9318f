"""Quantiles, neighbours, dates and state machines against plain loops and independent parsers."""

import collections
import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyward.functions import dates, explain, normalize, parsing
from tallyward.operators import detect, lifecycle, matching, neighbours, ordering, quantiles, sampling
from tallyward.sources import packs, tabular

FRACTIONS = [0, 0.05, 0.25, 0.5, 0.75, 0.95, 1]


@pytest.mark.parametrize("small", [0, 200_000])
@pytest.mark.parametrize("n", [0, 1, 2, 7, 12_000])
def test_quantiles_equal_numpy(spark, n, small, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", small)
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=n) * 10.0 ** rng.integers(-5, 200, n), "b": rng.integers(0, 5, n).astype(float), "c": np.where(rng.random(n) < 0.4, 7.0, rng.exponential(size=n))}
    rows = [tuple(float(v[i]) for v in data.values()) for i in range(n)] + [(None, float("nan"), None)] * 3
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    got = quantiles.quantiles(df, {x: F.col(x) for x in data}, FRACTIONS, nearest=(0.95,)).first()
    for x, v in data.items():
        assert got[f"n_{x}"] == n
        for j, f in enumerate(FRACTIONS):
            want = None if not n else float(np.sort(v)[round((n - 1) * f)]) if f == 0.95 else float(np.quantile(v, f))
            assert got[f"{x}_{j}"] == want or got[f"{x}_{j}"] == pytest.approx(want, rel=1e-12), (x, f)


@pytest.mark.parametrize("small", [0, 200_000])
def test_quantiles_by_key(spark, small, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", small)
    rng = np.random.default_rng(2)
    key, v = rng.integers(0, 4, 3000), rng.normal(size=3000)
    df = spark.createDataFrame([(int(k), float(x)) for k, x in zip(key, v, strict=True)] + [(9, None), (None, 1.0)], "k int, v double")
    got = {r["k"]: r for r in quantiles.quantiles(df, {"v": F.col("v")}, [0.5, 0.95], ["k"]).collect()}
    assert set(got) == {0, 1, 2, 3, 9} and got[9]["v_0"] is None and got[9]["n_v"] == 0
    for k in range(4):
        assert got[k]["v_0"] == pytest.approx(np.median(v[key == k]), rel=1e-12) and got[k]["v_1"] == pytest.approx(np.quantile(v[key == k], 0.95), rel=1e-12)


def test_distinct_counts(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (1, 2.0, "a"), (2**60, None, None), (2**60 + 1, 2.0, "")], "i long, d double, s string")
    assert {r["column"]: r["distinct_values"] for r in quantiles.distinct_counts(df, ["i", "d", "s"]).collect()} == {"i": 3, "d": 2, "s": 2}


# --- neighbours ---------------------------------------------------------------------------------------


def near(rows, k):
    out = {}
    for i, x in rows:
        d = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), j) for j, y in rows if j != i)
        out[i] = d[:k]
    return out


@pytest.mark.parametrize(("block", "pivots"), [(256, 1024), (7, 5), (16, 1024)])
def test_neighbours_match_a_loop(spark, block, pivots):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(size=3) + 6 * rng.integers(0, 3)]) for i in range(220)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(400 + i, [float(i % 4), 0.0, 0.0]) for i in range(20)]  # copies, and a lattice of ties
    bad = [(900, [None, 1.0, 1.0]), (901, [float("nan"), 1.0, 1.0])]
    df = spark.createDataFrame([(i, *x) for i, x in rows + bad], "id int, a double, b double, c double").repartition(4)
    got = collections.defaultdict(list)
    for r in neighbours.neighbours(df, "id", ["a", "b", "c"], 5, block, pivots).collect():
        got[r["row"]].append((r["d"], r["other"]))
    want = near(rows, 5)
    assert set(got) == set(want)
    for i, w in want.items():
        assert [x[1] for x in sorted(got[i])] == [x[1] for x in w], i
        assert np.allclose([x[0] for x in sorted(got[i])], [x[0] for x in w], atol=1e-12)


def test_few_packs_meet(spark):
    """On points of two dimensions a pack of about 16 meets under 10 others, however many there are."""
    rng = np.random.default_rng(4)
    for n in (4000, 12_000):
        df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.random((n, 2)))], "point long, x array<double>")
        index = neighbours.Index(df, 2, pack=32)
        found = index.nearest(3)
        assert found.count() == 3 * n
        assert index.compared.count() < 10 * index.packs.count()


def test_neighbours_of_few_rows(spark):
    schema = "id int, a double"
    assert neighbours.neighbours(spark.createDataFrame([], schema), "id", ["a"], 3).count() == 0
    assert neighbours.neighbours(spark.createDataFrame([(1, 1.0)], schema), "id", ["a"], 3).count() == 0
    got = neighbours.neighbours(spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 4.0)], schema), "id", ["a"], 3).collect()
    assert sorted((r["row"], r["other"], r["d"]) for r in got) == [(1, 2, 0.0), (1, 3, 3.0), (2, 1, 0.0), (2, 3, 3.0), (3, 1, 3.0), (3, 2, 3.0)]


# --- detectors' score rules -----------------------------------------------------------------------------


def test_scores_have_a_floor_for_exact_baselines_only(spark):
    noisy = [(i, 10.0, 100.0 + (i % 5)) for i in range(40)] + [(99, 10.0, 108.0)]
    got = detect.ratio_breaks(spark.createDataFrame(noisy, "id int, x double, y double"), "id", "x", "y").collect()
    values = [y / x for _, x, y in noisy]
    mad = np.median(np.abs(values - np.median(values)))
    assert [(r["row"], r["score"]) for r in got] == [(99, round(18 * 0.6745 * abs(10.8 - np.median(values)) / mad, 4))] and got[0]["score"] < 74
    exact = [(i, float(i), 2.0 * i) for i in range(1, 30)] + [(99, 5.0, 20.0)]
    got = detect.ratio_breaks(spark.createDataFrame(exact, "id int, x double, y double"), "id", "x", "y").collect()
    assert [(r["row"], r["score"]) for r in got] == [(99, 74.0)]


# --- dates and normalisation ------------------------------------------------------------------------------

SHAPES = "%Y-%m-%d|%d/%m/%Y|%m/%d/%Y|%d.%m.%Y|%Y%m%d|%y%m%d|%d-%m-%y|%m-%d-%y|%d %b %Y|%b %d, %Y|%B %d %Y|%d-%b-%y|%b-%d-%y|%Y-%b-%d|%a, %d %b %Y %H:%M:%S +0500|%Y-%m-%dT%H:%M:%SZ|%Y-%m-%d %H:%M:%S.123456|%A %d %B %Y|%d %B, %Y %I:%M %p|%b %Y|%B %d|%d %b|%m/%d|%Y/%m|%m/%Y|%H:%M|%Y|%Y%m%d%H%M%S|%Y%m%dT%H%M%S|%Y-%m-%dT%H:%M:%S+05:30|%d%b%Y|%I %p %d %b %Y|%d|%Y %d %b|%y %b %d|%b %y %d".split("|")
ODD = ["", "  ", "x", "31/02/2024", "13/14/2024", "2024-13-01", "March 5th, 2024", "the 5th of March", "5th of March 2024", "1 2 3 4", "sept 3 1999", "0001-01-01", "99/01/02", "32/1/5", "12/11/10", "2024.03.05", "5 Mar '24", "at 10:30 on 5 Mar 2024", "jan feb 2020", "2024-03-05 12:00:00 UTC", "May", "45", "100", "30 feb", "29 feb 2023", "2/29/24", "Thu Sep 25 10:36:28 2003", None]


@pytest.mark.parametrize("dayfirst", [False, True])
def test_dates_agree_with_an_independent_parser(spark, dayfirst):
    parser = pytest.importorskip("dateutil.parser")
    rng, rows, default = random.Random(4), list(ODD), dt.datetime(2026, 11, 30)
    for i in range(2000):
        d = dt.datetime(rng.randint(1960, 2040), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59))
        rows.append(d.strftime(SHAPES[i % len(SHAPES)]))
    df = spark.createDataFrame([(r,) for r in rows], "raw string")
    for r in df.select("raw", dates.parse_date(F.col("raw"), dayfirst, default=F.lit(default.date())).alias("day")).collect():
        try:
            if not (r["raw"] or "").strip():
                raise ValueError
            want = parser.parse(r["raw"].strip(), dayfirst=dayfirst, default=default).date()
        except (ValueError, OverflowError):
            want = None
        assert r["day"] == want, r["raw"]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "raw string").select(column(F.col("raw")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "amount", "direction"),
    [("1,234.50", "1234.5", "CR"), ("(50.00)", "50", "DR"), ("50.00-", "50", "DR"), ("50.00+", "50", "CR"), ("-7,5", "7.5", "DR"), ("1.234,50", "1234.5", "CR"), ("1234,567", "1234567", "CR"), ("1,234,567", "1234567", "CR"), ("USD 50", "50", "CR"), ("5,00", "5", "CR"), ("1-2", None, None), ("", None, None), ("abc", None, None), (None, None, None), ("0", "0", "CR")],
)
def test_amounts(spark, raw, amount, direction):
    got = one(spark, raw, normalize.normalize_amount)
    assert got["amount"] == (None if amount is None else Decimal(amount)) and got["direction"] == direction
    assert one(spark, raw, lambda c: normalize.normalize_amount(c, F.lit("DR")))["direction"] == (None if amount is None else "DR")


def test_names_codes_and_nulls(spark):
    assert one(spark, " Acme  Co., Ltd. ", normalize.normalize_counterparty) == "Acme"
    assert one(spark, "Zed & Sons, Inc", normalize.normalize_counterparty) == "Zed & Sons"
    assert one(spark, "Limited Brands", normalize.normalize_counterparty) == "Limited Brands"
    assert [one(spark, c, normalize.normalize_currency) for c in (" xdr", "SVC", "ANG")] == ["XDR", None, "ANG"]
    assert [one(spark, c, parsing.null_kind) for c in (None, " ", "NA", "-", "none")] == ["NULL", "EMPTY", "UNKNOWN_LITERAL", "VALUE", "VALUE"]
    assert one(spark, "ﬁne\x85 \x07tab\tend", normalize.normalize_description) == "fine tab end"
    assert list(one(spark, "12.5% of 1,000 for 15, 99.5 and 21", lambda c: normalize.ungrounded_numbers(c, F.array(F.lit(100.0))))) == ["12.5%", "1,000", "21"]


def test_versions(spark):
    assert normalize.satisfies("1.2.0", ">=1.0.0 <2.0.0") and not normalize.satisfies("2.0.0", ">=1.0.0,<2.0.0") and normalize.satisfies("1.2.0-rc1", "== 1.2.0")
    with pytest.raises(ValueError):
        normalize.satisfies("1.2.0", "any")
    assert one(spark, ">=1.0.0 <2.0.0", lambda c: normalize.meets_column("1.2.0", c)) is True and one(spark, "any", lambda c: normalize.meets_column("1.2.0", c)) is None


def test_expansion_factors(spark):
    got = spark.range(1).select(*[sampling.expansion_factor_column(F.lit(c)).alias(str(i)) for i, c in enumerate((0.5, 0.6, 0.98, 0.3, 0.995))]).first()
    assert [round(x, 6) for x in got] == [1.0, 1.1, 1.825, 1.0, 1.9]
    assert [round(sampling.expansion_factor(c), 6) for c in (0.5, 0.6, 0.98)] == [1.0, 1.1, 1.825]


def test_short_rows_pass_and_surplus_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y;z\n1;2\n3;4;5\n6\n")
    assert [tuple(r) for r in tabular.read_delimited(spark, str(tmp_path / "a.csv")).orderBy("x").collect()] == [("1", "2", ""), ("3", "4", "5"), ("6", "", "")]
    (tmp_path / "b.csv").write_text("x;y\n1;2\n3;4;5\n")
    assert tabular.read_delimited(spark, str(tmp_path / "b.csv"), strict=False).count() == 2
    with pytest.raises(Exception, match="more values"):
        tabular.read_delimited(spark, str(tmp_path / "b.csv")).collect()


# --- state ------------------------------------------------------------------------------------------------


def test_previous_row_across_partitions(spark):
    rows = [(k, s, f"{k}{s}") for k in "ab" for s in range(40)] + [("c", 0, "c0")]
    df = spark.createDataFrame(rows, "k string, s int, v string").repartition(6)
    got = {(r["k"], r["s"]): r["before"] for r in ordering.with_previous(df, ["k"], "s", {"before": "v"}, 7).collect()}
    assert got == {(k, s): f"{k}{s - 1}" if s else None for k, s, _ in rows}


def test_breaker_latches_until_a_person_resets_with_a_reason(spark):
    rng = random.Random(3)
    rows, want = [], {}
    state = {"x": None, "y": None}
    for at in range(300):
        key, kind = rng.choice("xy"), rng.random()
        row = [key, at, None, None, None, None, None]
        if kind < 0.1:
            row[5], row[6] = rng.choice(["ann", ""]), rng.choice(["checked", "", None])
            if row[5] and row[6]:
                state[key] = None
        else:
            row[2:5] = [rng.choice([0.0, 0.0, 0.0002]), rng.choice([0.01, 0.01, 0.06, None]), rng.choice([0.001, 0.001, 0.006])]
            for m, x, most in zip(("auto_match_false_rate", "calibration_ece", "suggest_false_accept_rate"), (row[2], row[3], row[4]), (0.0001, 0.05, 0.005), strict=True):
                if state[key] is None and x is not None and x > most:
                    state[key] = (m, x, most, at)
        rows.append(tuple(row))
        want[at] = state[key]
    df = spark.createDataFrame(rows, "k string, at int, auto_match_false_rate double, calibration_ece double, suggest_false_accept_rate double, reset_by string, reset_reason string").repartition(5)
    got = {r["at"]: tuple(r["breach"]) if r["tripped"] else None for r in lifecycle.breaker_state(df, "k", "at").collect()}
    assert got == want


def test_moves(spark):
    rows = [("OPEN", "TRIAGED", None, False, None), ("OPEN", "PROPOSED", None, False, "ILLEGAL"), ("CLOSED", "REOPENED", "", False, "NO_REASON"), ("CLOSED", "REOPENED", "x", False, None), ("OPEN", "CARRIED_FORWARD", None, False, "ILLEGAL"), ("APPROVED", "CARRIED_FORWARD", None, True, None), ("RESOLVED", "CARRIED_FORWARD", None, True, "NOT_ELIGIBLE"), ("OPEN", "TRIAGED", None, True, "ONLY_CARRY_FORWARD"), ("NEW", "ASSIGNED", None, False, "ILLEGAL")]
    df = spark.createDataFrame(rows, "a string, b string, r string, p boolean, want string")
    assert [r["got"] for r in df.select(lifecycle.move_problem(F.col("a"), F.col("b"), F.col("r"), F.col("p")).alias("got")).collect()] == [r[4] for r in rows]


def test_plan_steps(spark):
    rows = [(1, 0, "parse_type", {"column": "a", "target_type": "int"}, None, None), (1, 1, "drop_duplicates", {}, None, "FORBIDDEN_STEP"), (1, 2, "trim", None, None, "UNKNOWN_STEP"), (1, 3, "scale_numeric", {"column": "a", "how": "z"}, None, "UNKNOWN_PARAMETER"), (1, 4, "map_schema", {"source_column": "q", "target_field": "a"}, None, "UNKNOWN_COLUMN"), (1, 5, "engineer_feature", {"name": "n", "formula": "a"}, ["a", "b"], None), (1, 6, "engineer_feature", {"name": "n"}, ["a", "zz"], "UNKNOWN_COLUMN"), (1, 7, "strip_whitespace", {"column": "a"}, ["a"], "UNKNOWN_PARAMETER")]
    df = spark.createDataFrame(rows, "plan_id int, number int, step string, params map<string,string>, source_columns array<string>, want string")
    got = {r["number"]: r["problem"] for r in lifecycle.plan_step_problems(df, ["a", "b"]).collect()}
    assert got == {r[1]: r[5] for r in rows if r[5]}
    assert {r["number"] for r in lifecycle.valid_steps(df, ["a", "b"]).collect()} == {0, 5}


def test_canonical_json_equals_the_usual_writer(spark):
    import json

    from pyspark.sql import types as T

    from tallyward.functions.canonical import canonical_json, content_hash

    rng = random.Random(1)
    numbers = [0.1, 1e16, 1e15, 123456789012345680.0, 1e-4, 1e-5, 1.5e-7, -2.5, 1e22, 1.0, 100.0, 1e7, 3.14e300, 0.0, -0.0, 0.001, 0.00012345, None, float("inf")] + [rng.uniform(-1, 1) * 10 ** rng.randint(-20, 20) for _ in range(500)]
    texts = ['a"b\\c\n\r\t\b\f\x01\x7f/', "éß", "😀x", "", None, "\n", "plain"]
    kind = T.StructType.fromDDL("z struct<b: bigint, a: array<string>>, m map<string, double>, B boolean, s string, x double")
    rows = [((i, [texts[i % 7], None]), {f"k{j}": x for j in range(i % 3)} | {"é": 1.0}, None if i % 5 == 0 else i % 2 == 0, texts[(i + 3) % 7], x) for i, x in enumerate(numbers)]
    df = spark.createDataFrame([(r,) for r in rows], T.StructType([T.StructField("v", kind)]))
    for r in df.select("v", canonical_json(F.col("v"), kind).alias("j"), content_hash(F.col("v"), kind).alias("h")).collect():
        want = json.dumps(r["v"].asDict(recursive=True), sort_keys=True, separators=(",", ":"))
        assert r["j"] == want and len(r["h"]) == 64


def test_imports_hold_whole_batches(spark):
    from tallyward.operators import imports

    good = ("12.50", "usd", "dr", "2024-03-05", "r-1")
    faults = {"AMOUNT_FORMAT": ("1,5", *good[1:]), "AMOUNT_RANGE": ("1" + "0" * 20, *good[1:]), "DIRECTION": (*good[:2], "x", *good[3:]), "VALUE_DATE": (*good[:3], "2024-02-30", good[4]), "OUTSIDE_PERIOD": (*good[:3], "20240401", good[4]), "CURRENCY": ("1", "SVC", *good[2:]), "REFERENCE": (*good[:4], " - ")}
    rows = [("ok", "2024-03", *good), ("ok", "2024-03", "99999999999999999999.12345678", "EUR", " CR", "20240331", "x"), ("short", "2024-03", *good)] + [(k, "2024-03", *v) for k, v in faults.items()] + [("null", "2024-03", None, None, None, None, None)]
    raw = spark.createDataFrame(rows, "batch string, period string, amount string, currency string, direction string, value_date string, reference string")
    out = imports.validated(raw, "period")
    assert {(r["batch"], r["problem"]) for r in out.where("problem is not null").collect()} == {(k, k) for k in faults} | {("null", "AMOUNT_FORMAT")}
    reports = imports.batch_reports(out, "batch", spark.createDataFrame([("ok", 2), ("short", 5), ("gone", 0)], "batch string, expected long"))
    assert {r["batch"] for r in reports.where("status = 'ACCEPTED'").collect()} == {"ok"}
    assert [r["typed_amount"] for r in imports.accepted(out, reports, "batch").orderBy("typed_amount").collect()] == [Decimal("12.5"), Decimal("99999999999999999999.12345678")]
    with pytest.raises(ValueError, match="value_date"):
        imports.apply_mapping(raw, {x: x for x in imports.REQUIRED if x != "value_date"})
    with pytest.raises(ValueError, match="nope"):
        imports.apply_mapping(raw, {x: x for x in imports.REQUIRED} | {"reference": "nope"})


def test_group_matches_equal_plain_enumeration():
    from itertools import combinations

    from tallyward.operators.matching import _may_net, _smallest_sets

    rng = random.Random(6)
    for _ in range(60):
        rows = [(f"r{i:02d}", rng.choice(["SOURCE_A", "SOURCE_B"]), rng.randint(-40, 40)) for i in range(rng.randint(2, 11))]
        used, want = set(), []
        for size in range(2, 7):
            for c in combinations(range(len(rows)), size):
                if not used & set(c) and sum(rows[i][2] for i in c) == 0 and len({rows[i][1] for i in c}) == 2:
                    want.append(list(c))
                    used |= set(c)
        assert _smallest_sets(rows, 6, 0, 10**9) == (want, False)
        for size in range(2, 7):
            if not _may_net(np.array([r[2] for r in rows]), [r[1] for r in rows], size, 0):
                assert not any(sum(rows[i][2] for i in c) == 0 and len({rows[i][1] for i in c}) == 2 for c in combinations(range(len(rows)), size))


def test_group_matches_of_a_large_pool_without_a_net_set_are_proven(spark):
    from tallyward.operators import matching

    rows = [("a", "USD", f"i{i:03d}", "SOURCE_A" if i % 2 else "SOURCE_B", "CR", float(3 * i + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "account string, currency string, id string, side string, direction string, amount double")
    assert matching.group_matches(df, most_size=6, steps=1000).count() == 0


def test_group_matches_take_many_accounts_per_call_of_python(spark):
    from tallyward.operators import matching

    rng = random.Random(8)
    rows = [(a, "USD" if a % 2 else "EUR", f"i{i:02d}", rng.choice([matching.A, matching.B]), rng.choice(["CR", "DR"]), float(rng.randint(1, 30))) for a in range(700) for i in range(rng.randint(1, 9))]
    rows.append((0, "EUR", "none", matching.A, "CR", None))  # a record without an amount is in no set
    df = spark.createDataFrame(rows, "account int, currency string, id string, side string, direction string, amount double").repartition(3)
    out = matching.group_matches(df, most_size=4)
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    want = set()
    for a in range(700):
        own = sorted((i, s, round(100 * x) * (1 if d == "CR" else -1)) for b, _, i, s, d, x in rows if b == a and x is not None)
        for no, c in enumerate(matching._smallest_sets(own, 4, 0, 10**9)[0], 1):
            want.add((a, "USD" if a % 2 else "EUR", no, tuple(own[i][0] for i in c), 0.0, False))
    assert {(r["account"], r["currency"], r["group_no"], tuple(r["ids"]), r["net"], r["capped"]) for r in out.collect()} == want


def test_tree_attributions_are_shapley_values(spark):
    from itertools import combinations
    from math import factorial

    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from tallyward.operators import attribution

    rng = np.random.default_rng(5)
    x = rng.integers(0, 8, (300, 3)).astype(float)
    y = x[:, 0] * x[:, 1] + 3 * x[:, 2] + rng.normal(size=300)
    df = spark.createDataFrame([(*map(float, r), float(t), float(t > 20)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double, z double")
    d = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df)
    boosted = GBTRegressor(featuresCol="f", labelCol="y", predictionCol="margin", maxIter=3, maxDepth=3).fit(d)
    forest = RandomForestClassifier(featuresCol="f", labelCol="z", numTrees=3, maxDepth=3, seed=1).fit(d)
    for model in (boosted, forest):
        found = attribution.leaves(model)
        some = x[:20]

        def worth(row, known):
            total = 0.0
            for v, path in found:
                for f, (share, conditions) in path.items():
                    v *= all(a < row[f] <= b for _, a, b in conditions) if f in known else share
                total += v
            return total

        want = np.zeros((20, 3))
        for r, row in enumerate(some):
            for f in range(3):
                for n in range(3):
                    for s in combinations([g for g in range(3) if g != f], n):
                        want[r, f] += factorial(n) * factorial(2 - n) / 6 * (worth(row, {*s, f}) - worth(row, set(s)))
        assert np.allclose(attribution.shapley(some, found), want)
    out = attribution.tree_attributions(boosted.transform(d), boosted, ["a", "b", "c"]).collect()
    assert all(abs(r["attributions"]["base"] + sum(p["attribution"] for p in r["attributions"]["by_feature"]) - r["margin"]) < 1e-9 for r in out)
    probability = forest.transform(d).select("probability").collect()
    out = attribution.tree_attributions(df, forest, ["a", "b", "c"]).collect()
    assert all(abs(r["attributions"]["base"] + sum(p["attribution"] for p in r["attributions"]["by_feature"]) - q["probability"][1]) < 1e-9 for r, q in zip(out, probability, strict=True))


def test_scheduled_cycles_replay_to_the_same_result(spark, tmp_path):
    import json

    from tallyward.operators.cycle import run_cycle
    from tallyward.streaming.schedule import scheduled_cycles

    rows = []
    for i in range(40):
        day = dt.date(2024, 1 + i % 4, 10)
        rows.append((f"A{i}", "SOURCE_A", "acc", "USD", Decimal(100 + i), "CR", day, f"R{i}"))
        if i % 5:
            rows.append((f"B{i}", "SOURCE_B", "acc", "USD", Decimal(100 + i), "CR", day + dt.timedelta(days=2 * (i % 3 == 0)), f"R{i}"))
    schema = "id string, side string, account string, currency string, amount decimal(28,8), direction string, value_date date, reference string"
    records = spark.createDataFrame(rows, schema)
    periods = spark.createDataFrame([("2024-04", "CERTIFIED"), ("2024-01", "OPEN")], "period string, status string")
    period = F.date_format("value_date", "yyyy-MM")
    found, stay, summary = (df.collect() for df in run_cycle(records, spark.createDataFrame([], "id string"), periods, period, days=2, absolute=1))
    assert {r["period"] for r in summary} == {"2024-01", "2024-02", "2024-03"} and {r["period"] for r in found + stay} <= {"2024-01", "2024-02", "2024-03"}
    assert {r["id"] for r in found} == {x[0] for x in rows if x[6].month != 4 and int(x[0][1:]) % 5}
    source, out = tmp_path / "ticks", str(tmp_path / "out")
    source.mkdir()
    for n in range(2):
        (source / f"{n}.json").write_text(json.dumps({"at": n}))
    ticks = spark.readStream.schema("at long").option("maxFilesPerTrigger", 1).json(str(source))

    def run(checkpoint):
        scheduled_cycles(ticks, lambda: records, lambda: periods, period, out, str(tmp_path / checkpoint), days=2, absolute=1).awaitTermination(120)
        return {name: sorted(map(str, spark.read.parquet(f"{out}/{name}").where("cycle >= 0").collect())) for name in ("matches", "breaks", "summary")}

    first = run("c1")
    assert first["matches"] == sorted(str(x) for x in spark.createDataFrame(found).withColumn("cycle", F.lit(0)).select("period", "id", "rule", "cycle").collect())
    assert run("c1") == first  # nothing new
    assert run("c2") == first  # the source replayed from the start
    done = spark.createDataFrame([(x[0],) for x in rows], "id string")
    assert {r["status"] for r in run_cycle(records, done, periods, period, days=2, absolute=1)[2].collect()} == {"SKIPPED"}


def test_isotonic_equals_pooled_violators(spark):
    from tallyward.operators import credit

    rng = np.random.default_rng(2)
    p = rng.permutation(200) / 200.0
    y = (rng.random(200) < p).astype(int)
    model = credit.isotonic(spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int").repartition(3), "p", "y")
    blocks = []
    for v in y[np.argsort(p)]:
        blocks.append([float(v), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, n = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + v * n) / (blocks[-1][1] + n), blocks[-1][1] + n]
    want = np.repeat([b[0] for b in blocks], [b[1] for b in blocks])
    assert np.allclose(np.interp(np.sort(p), list(model.boundaries), list(model.predictions)), want)


def test_fingerprints_see_every_row_and_no_order(spark):
    rows = [(i, i * 1.5) for i in range(100)]
    mark = lambda r: sampling.dataset_fingerprint(spark.createDataFrame(r, "k long, a double").repartition(4), "k", "a").first()[0]
    assert mark(rows) == mark(rows[::-1]) != mark([*rows[:-1], (99, 1.0)]) and mark(rows) != mark([*rows, rows[0]])


# --- explanations, packs on installation, reversals ------------------------------------------------------


def test_replies_by_intent(spark):
    kind = "row string, model string, method string, layer string, score double, severity string, confidence double, threshold string, message string, drivers array<struct<feature: string, reason: string>>, recommended_action string"
    full = ("7", "ratio_break", "MAD", "L3", 54.0, "medium", 0.77, "z >= 3", "Odd ratio.", [(x, f"far {x}") for x in "abcde"], "Check units.")
    bare = ("0", "ratio_break", "MAD", "L3", None, None, None, None, "Odd ratio.", None, None)
    asked = ["WHY is it", "Reasonable score?", "what THRESHOLD", "next?", "hello", None, "yakarna"]
    rows = [(i, m, f) for i, m in enumerate(asked) for f in (full, bare)]
    df = spark.createDataFrame(rows, f"i int, asked string, f struct<{kind}>")
    got = [tuple(r) for r in df.select("i", explain.intent(F.col("asked")).alias("intent"), explain.reply(F.col("asked"), F.col("f")).alias("reply"), explain.explanation(F.col("f")).alias("text")).collect()]
    assert [r[1] for r in got[::2]] == ["WHY", "WHY", "MEASURE", "ACTION", "OTHER", "OTHER", "ACTION"]
    assert got[0][2] == "This anomaly was flagged because a (far a), b (far b), c (far c), d (far d). The detector was ratio_break using MAD."
    assert got[1][2] == "This anomaly was flagged because Odd ratio.. The detector was ratio_break using MAD."
    assert got[4][2] == "The score is 54.0 on a capped 0-100 risk index, with confidence 0.77. The threshold was: z >= 3."
    assert (got[6][2], got[7][2]) == ("Check units.", "Review the row values and verify the source record.")
    assert got[9][2] == "For row column-level, the main finding is: Odd ratio. Main drivers: model threshold evidence."
    assert got[0][3] == "Row 7 was flagged by ratio_break in L3. The score is 54.0 (medium) because a: far a; b: far b; c: far c; d: far d. Threshold used: z >= 3. Recommended next step: Check units."
    assert got[1][3] == "Row column-level was flagged by ratio_break in L3. The score is  () because Odd ratio.. Threshold used: . Recommended next step: Review the source record."


def test_installation_problems(spark):
    head = '"pack": {"id": "p", "version": "1", "engine_compat": ">=1.0.0 <2.0.0"}'
    raw = {
        1: "{%s}" % head, 2: '{%s, "break_types": [{"code": "X9"}, {"code": "X10"}, {"code": "NEW"}, {}], "dimensions": [{"key": "FUND"}]}' % head, 3: '{%s, "break_types": [{"code": "FUND"}], "dimensions": [{"key": "FUND"}, {"key": "FUND"}]}' % head,
        4: "no manifest", 5: None, 6: '{"pack": {"id": "p", "version": "1", "engine_compat": ">=2.0.0"}, "break_types": [{"code": "X9"}]}', 7: '{%s, "break_types": null, "dimensions": []}' % head,
    }
    installed = spark.createDataFrame([("BREAK_CODE", "X9"), ("BREAK_CODE", "X9"), ("BREAK_CODE", "X10"), ("DIMENSION", "FUND"), ("DIMENSION", None)], "kind string, name string")
    manifests = spark.createDataFrame(list(raw.items()), "key int, raw string")
    got = {r["key"]: (r["problem"], r["items"]) for r in packs.installation_problems(manifests, installed).collect()}
    assert got == {1: (None, []), 2: ("BREAK_CODE", ["X10", "X9"]), 3: ("DIMENSION", ["FUND"]), 4: ("INVALID", []), 5: ("INVALID", []), 6: ("INCOMPATIBLE", []), 7: (None, [])}
    assert packs.installation_problems(manifests, installed.limit(0)).where("problem = 'BREAK_CODE'").count() == 0
    assert [r[0] for r in spark.createDataFrame([("core",), ("x",), (None,)], "p string").select(packs.removal_problem(F.col("p"))).collect()] == ["CORE_PACK", None, None]


def test_unmatch_keeps_history(spark):
    requests = spark.createDataFrame(
        [(1, 10, "MAKER", "typo"), (2, 10, "MAKER", "again"), (3, 11, "CHECKER", "x"), (4, 11, "MAKER", " "), (5, 99, "MAKER", "x"), (6, 12, "MAKER", "x"), (7, 13, "MAKER", "x"), (8, 11, None, "x"), (9, None, "MAKER", "x"), (10, 14, "MAKER", "x"), (10, 14, "MAKER", "x")],
        "request_id int, match_id int, role string, reason string",
    )
    matches = spark.createDataFrame([(10, "p1", False), (11, "p1", None), (12, "p1", True), (13, "p2", False), (14, "p1", False)], "match_id int, period string, reversed boolean")
    answers = matching.unmatch(requests, matches, spark.createDataFrame([("p1",), ("p1",)], "period string"))
    got = {r["request_id"]: r["problem"] for r in answers.collect()}
    assert answers.count() == 11
    assert got == {1: None, 2: "ALREADY_REVERSED", 3: "ROLE", 4: "REASON", 5: "NOT_FOUND", 6: "ALREADY_REVERSED", 7: "PERIOD_CLOSED", 8: "ROLE", 9: "NOT_FOUND", 10: None}
    members = spark.createDataFrame([(10, "a", "MATCHED"), (10, "b", "HELD"), (11, "c", "MATCHED"), (14, "d", "MATCHED"), (None, "e", "MATCHED")], "match_id int, record_id string, status string")
    assert {r["record_id"]: r["status"] for r in matching.after_unmatch(members, answers).collect()} == {"a": "UNMATCHED", "b": "HELD", "c": "MATCHED", "d": "UNMATCHED", "e": "MATCHED"}


def test_a_cycle_finds_open_records_once(spark):
    """Counting matches and breaks reads tables written once, not the records again."""
    from tallyward.operators.cycle import run_cycle

    rows = [(f"{s}{i}", "SOURCE_A" if s == "A" else "SOURCE_B", 1, "USD", "CR", f"{i}.00", f"2024-0{1 + i % 3}-05", f"R{i}") for i in range(9) for s in "AB" if s == "A" or i % 4]
    records = spark.createDataFrame(rows, "id string, side string, account int, currency string, direction string, amount string, value_date string, reference string")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    records = records.mapInArrow(counted, records.schema).selectExpr("* except (amount, value_date)", "cast(amount as decimal(28,8)) as amount", "cast(value_date as date) as value_date")
    periods = spark.createDataFrame([("2024-01", "CERTIFIED")], "period string, status string")
    found, stay, summary = run_cycle(records, spark.createDataFrame([], "id string"), periods, F.date_format("value_date", "yyyy-MM"), days=2, absolute=1)
    got = {(r["period"], r["n_open"], r["n_matched"], r["n_breaks"], r["status"]) for r in summary.collect()}
    assert got == {("2024-02", 5, 4, 1, "RECONCILED"), ("2024-03", 5, 4, 1, "RECONCILED")}
    assert (found.count(), stay.count()) == (8, 2)
    assert reads.value <= 2 * len(rows)
