"""Every query with SQL agrees with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tallyward import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    try:
        return f"{float(x):.6g}"
    except (TypeError, ValueError):
        return str(x)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, df.collect()) == _rows(want.columns, want.fetchall())


def test_finding_ids_beyond_four_digits_are_those_of_sql(spark, duck, tmp_path):
    """With over 9,999 findings the SQL's lpad cuts numbers to four digits."""
    path = f"{tmp_path}/events.parquet"
    duck.sql(f"copy (select e.* replace (e.event_id + i * 1000000 as event_id) from events e, range(150) r(i)) to '{path}'")
    want = duck.sql(catalog.oracle_sql()["det_16_finding_ids"].replace("from events", f"from '{path}'")).fetchall()
    assert len(want) > 10_000
    got = catalog.queries()["det_16_finding_ids"](spark, str(tmp_path)).select("row", "id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_boosted_trees_are_fitted_in_tasks_of_bounded_rows(spark, monkeypatch):
    from pyspark.ml.regression import GBTRegressor

    from tallyward import session

    sizes, fit = [], GBTRegressor.fit
    monkeypatch.setattr(session, "TASK_ROWS", 10, raising=False)
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, d: sizes.extend(d.rdd.glom().map(len).collect()) or fit(self, d))
    n = catalog.queries()["ml_15_tree_attributions"](spark, SF).count()
    assert sum(sizes) == n and max(sizes) <= 40


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
