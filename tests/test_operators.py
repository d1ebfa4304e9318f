"""Operators on small fixtures: literal cases, closed forms against loops, and invariants."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyward.operators import credit, detect, lifecycle, matching, ordering, prepare, profile, rules, sampling


def test_row_numbers_do_not_depend_on_partitions(spark):
    d = spark.createDataFrame([(i * 7 % 100, i) for i in range(100)], "k int, v int")
    a = {r["k"]: r["rn"] for r in ordering.row_numbers(d.repartition(7), [F.col("k")], "rn").collect()}
    assert a == {k: k + 1 for k in range(100)}


def test_nearest_rank_rounds_half_to_even(spark):
    d = spark.createDataFrame([(float(x),) for x in range(6)], "x double")
    got = {r["fraction"]: r["value"] for r in ordering.nearest_rank(d, "x", [0.5, 0.9]).collect()}
    assert got == {0.5: 2.0, 0.9: 4.0}  # round(2.5) is 2, round(4.5) is 4


def test_histogram_of_a_constant_has_one_bin(spark):
    d = spark.createDataFrame([(3.0,)] * 5, "x double")
    assert [(r["bin"], r["n"]) for r in profile.histogram(d, "x").collect()] == [(0, 5)]


def test_every_row_is_in_a_band(spark):
    d = spark.createDataFrame([(34.9,), (54.9,), (64.9,), (84.9,), (100.0,)] + [(0.0,)] * 5, "s double")
    got = {r["b"]: r["count"] for r in d.groupBy(profile.bands(F.col("s")).alias("b")).count().collect()}
    assert got == {"0-34": 6, "35-54": 1, "55-64": 1, "65-84": 1, "85-100": 1}


def test_headers():
    class D:
        def __init__(self, columns):
            self.columns = columns

    for bad in (["a", " a"], ["a", ""]):
        with pytest.raises(ValueError):
            prepare.clean_headers(D(bad))


def test_cell_quality(spark):
    d = spark.createDataFrame([(i, "bad" if i == 3 else str(i), "unknown" if i % 2 else "ok") for i in range(30)], "id int, amount string, status string")
    q = prepare.cell_quality(prepare.prepared_cells(d, "id", numbers=("amount",))).first()
    assert (q["cells"], q["unavailable"], q["quality"]) == (60, 16, round(100 * 44 / 60, 2))


def test_late_outlier(spark):
    d = spark.createDataFrame([(i, 10.0 + i % 7) for i in range(600)] + [(600, 100000.0)], "id int, amount double")
    assert [r["row"] for r in detect.numeric_outliers(d, "id", "amount").collect()] == [600]


def test_knn_matches_a_loop(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")
    got = {r["row"]: r["distance"] for r in detect.knn_distances(d, "id", ["a", "b"], block=16).collect()}
    med = np.median(x, 0)
    s = (x - med) / np.median(abs(x - med), 0)
    dist = np.sort(np.sqrt(((s[:, None] - s[None]) ** 2).sum(-1)), 1)[:, 1:6].mean(1)
    assert np.allclose([got[i] for i in range(60)], dist)


@pytest.mark.parametrize("expression", ["__import__('os')", "a.b > 1", "a < b < c", "[1]", "lambda: 1", "f(a)", "a[0] > 1"])
def test_rules_reject_everything_else(expression):
    with pytest.raises(rules.RuleError):
        rules.compile_rule(expression, {"a": "double", "b": "double", "c": "double"})


def test_rules_follow_python(spark):
    d = spark.createDataFrame([(-7.0, 3.0), (7.0, -3.0), (None, 3.0), (float("nan"), 1.0)], "a double, b double")
    t = {"a": "double", "b": "double"}
    got = d.select(rules.compile_rule("a % b == 2", t).alias("m"), rules.compile_rule("a != 1", t).alias("n"), rules.compile_rule("not a > 0", t).alias("p")).collect()
    assert [r["m"] for r in got] == [True, False, False, False]
    assert [r["n"] for r in got] == [True, True, True, True]
    assert [r["p"] for r in got] == [True, False, True, True]


def test_rules_in_force_and_missing_columns(spark):
    pack = rules.RulePack("p", "1", (rules.Rule("big", "amount >= 50000 and approvers < 2", "critical"), rules.Rule("gone", "amount > 0", "low", effective_to=date(2020, 1, 1)), rules.Rule("absent", "x > 1", "low")))
    d = spark.createDataFrame([(60000.0, 1), (100.0, 1)], "amount double, approvers int")
    assert [(r["rule_score"], r["fired"]) for r in rules.evaluate(d, pack, date(2024, 1, 1)).collect()] == [(100, ["big"]), (0, [])]


def test_reliability_factors():
    for k, c, f in ((0, 0.95, 3.0), (1, 0.95, 4.75), (2, 0.95, 6.3), (0, 0.9, 2.31), (3, 0.9, 6.69)):
        assert abs(sampling.reliability_factor(k, c) - f) < 0.011


def test_monetary_unit_matches_a_loop(spark):
    rng = np.random.default_rng(5)
    amounts = np.round(rng.exponential(1000, 200), 2)
    d = spark.createDataFrame([(i, float(a)) for i, a in enumerate(amounts)], "id int, amount double")
    interval, start, size = 500_000, 123_456, 30
    got = {r["id"]: r["hits"] for r in sampling.select_monetary_unit(d.repartition(5), "id", "amount", interval, start, size).collect()}
    cum = np.cumsum(np.round(amounts * 100).astype(int))
    want: dict[int, int] = {}
    for k in range(size):
        t = start + k * interval
        if t <= cum[-1]:
            i = int(np.searchsorted(cum, t))
            want[i] = want.get(i, 0) + 1
    assert got == want


def test_projection_counts_certainty_as_known(spark):
    d = spark.createDataFrame([(20000.0, 15000.0, "certainty"), (1000.0, 500.0, "monetary_unit"), (1000.0, 1000.0, "monetary_unit")], "book double, audit double, selection_basis string")
    r = sampling.project_misstatement(d, interval=10000.0, confidence=0.95, tolerable=100000.0).first()
    assert (r["known"], r["projected"], r["conclusion"]) == (5000.0, 10000.0, "ACCEPT")


def _record(i, side, amount="100.00", day="2024-01-01", direction="CR", ref="R1", account="A"):
    return (i, side, account, "USD", amount, direction, day, ref)


def _records(spark, rows):
    return spark.createDataFrame(rows, "id string, side string, account string, currency string, amount string, direction string, value_date string, reference string").withColumns({"amount": F.col("amount").cast("decimal(28,8)"), "value_date": F.col("value_date").cast("date")})


def test_exact_pairs_need_one_record_a_side(spark):
    a, b = matching.A, matching.B
    assert matching.exact_pairs(_records(spark, [_record("1", a), _record("2", b, "100.0")])).count() == 1
    assert matching.exact_pairs(_records(spark, [_record("1", a), _record("2", b), _record("3", b)])).count() == 0
    assert matching.exact_pairs(_records(spark, [_record("1", a, ref=" "), _record("2", b, ref=" ")])).count() == 0


def test_tolerance_drops_ambiguous_rows_first(spark):
    a, b = matching.A, matching.B
    rows = [_record("a1", a), _record("a2", a, "103"), _record("b1", b, "101"), _record("b2", b, "104", "2024-01-02")]
    got = matching.tolerance_pairs(_records(spark, rows), days=2, absolute=1.5).collect()
    assert {(r["a_id"], r["b_id"]) for r in got} == {("a1", "b1"), ("a2", "b2")} or {(r["a_id"], r["b_id"]) for r in got} == {("a1", "b1")}


def test_group_matches(spark):
    a, b = matching.A, matching.B
    rows = [_record("a1", a, "300")] + [_record(f"b{i}", b, "100", direction="DR") for i in range(3)]
    got = matching.group_matches(_records(spark, rows)).collect()
    assert [(r["ids"], r["capped"]) for r in got] == [(["a1", "b0", "b1", "b2"], False)]
    assert [r["capped"] for r in matching.group_matches(_records(spark, rows), pool=3).collect()] == [True]


def test_chain_finds_tampering(spark):
    e = spark.createDataFrame([("s", i, f"p{i}") for i in range(1, 6)], "stream string, seq int, payload string")
    chain = lifecycle.chained(e, "stream", "seq", F.col("payload"))
    bad = chain.withColumn("payload", F.when(F.col("seq") == 3, "x").otherwise(F.col("payload")))
    assert [(r["seq"], r["problem"]) for r in lifecycle.broken_links(bad, "stream", "seq", F.col("payload")).collect()] == [(3, "ALTERED")]
    assert [(r["seq"], r["problem"]) for r in lifecycle.broken_links(chain.where("seq <> 3"), "stream", "seq", F.col("payload")).collect()] == [(4, "GAP")]
    assert lifecycle.broken_links(chain, "stream", "seq", F.col("payload")).count() == 0


def test_projection_beyond_many_misstatements(spark):
    factor = lambda k: sampling.reliability_factor(k, 0.95)
    assert [round(factor(k), 4) for k in (0, 1, 2)] == [2.9957, 4.7439, 6.2958]
    for k in (600, 695, 750, 2000, 50_000):
        a = k + 1
        about = a * (1 - 1 / (9 * a) + 1.6448536 / (3 * a**0.5)) ** 3  # Wilson and Hilferty
        assert abs(factor(k) - about) < 0.02 and 1 < factor(k) - factor(k - 1) < 1.05
    tested = spark.range(3000).select(F.lit(100.0).alias("book"), F.lit(50.0).alias("audit"), F.lit("monetary_unit").alias("selection_basis"))
    r = sampling.project_misstatement(tested, interval=10.0, confidence=0.95, tolerable=1e9).first()
    assert r["projected"] == 15000 and abs(r["allowance"] - 10 * (factor(0) + (factor(3000) - factor(0) - 3000) / 2)) < 0.01


def test_lift_counts_all_scores(spark):
    scored = spark.range(150_000).select(F.col("id").alias("score"), (F.col("id") < 50_000).cast("int").alias("y"))
    r = sampling.bootstrap_lift(scored, "score", "y", 100, rounds=8).first()
    assert r["rounds"] == 8 and r["verdict"] == "NOT_DISTINGUISHABLE" and r["high"] == 0


def test_smallest_sets_are_those_of_plain_enumeration():
    from itertools import combinations

    rng = random.Random(3)
    for trial in range(60):
        rows = [(f"r{i:02d}", rng.choice("AB"), rng.randint(-12, 12)) for i in range(rng.randint(2, 9))]
        tolerance = trial % 3
        used, want = set(), []
        for size in range(2, 6):
            for c in combinations(range(len(rows)), size):
                if not used & set(c) and len({rows[i][1] for i in c}) == 2 and abs(sum(rows[i][2] for i in c)) <= tolerance:
                    used |= set(c)
                    want.append(list(c))
        assert matching._smallest_sets(rows, 5, tolerance, 10**6) == (want, False)
    assert matching._smallest_sets(rows, 5, 0, 1)[1]


def test_names_of_columns(spark):
    assert credit.propose_mapping(["Cust No", "loan_amt", "Other (x)"]) == {"Cust No": "member_id", "loan_amt": "loan_amount", "Other (x)": "other_x"}
    names = ["gender", "Post Code", "zip", "trace", "unzipped", "write off", "political view", "arrears_flag", "Age", "average", "e-mail", "Marital Status", "marital_status", "future_x"]
    want = {"gender": "protected", "zip": "review", "write off": "leakage", "political view": "protected", "Age": "protected", "future_x": "leakage", "marital_status": "protected", "Marital Status": "protected"}
    assert dict(credit.governance_flags(names)) == want
    d = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["f"] for r in d.select("n", credit.governance_flag(F.col("n")).alias("f")).collect() if r["f"]} == want
    assert credit.mapping_problems(["zip", "a", "b"], {"zip": "income", "a": "x", "b": "x"}) == [("zip", "SENSITIVE"), ("a", "DUPLICATE"), ("b", "DUPLICATE")]
    assert credit.mapping_problems(["a", "b"], {"a": "1x", "c": "c"}) == [("b", "NOT_MAPPED"), ("c", "UNKNOWN"), ("a", "INVALID_NAME")]


def test_generated_members(spark):
    d = credit.generate_members(spark, 4000).cache()
    r = d.selectExpr("avg(arrears_flag) a", "avg(arrears_flag) filter (where late_cnt >= 3) b", "avg(arrears_flag) filter (where late_cnt = 0) c", "count(distinct cust_id) n").first()
    assert 0.1 < r["a"] < 0.5 and r["b"] > r["c"] + 0.1 and r["n"] == 4000
    assert d.exceptAll(credit.generate_members(spark, 4000)).count() == 0
