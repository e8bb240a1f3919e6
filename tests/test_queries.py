"""Each registered query with SQL gives the oracle's rows."""

import glob
import os

import duckdb
import pytest

from pelagia import plans


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    df = plans.QUERIES[name](spark, sf_dir)
    found = oracle.execute(plans.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert _sorted([tuple(r[c] for c in columns) for r in df.collect()]) == _sorted(found.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 7
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_displaced_pole_grid_has_all_nodes(spark, sf_dir):
    from pelagia.plans.views import nodes

    rows = {r["id"]: r for r in plans.QUERIES["displaced_pole_grid"](spark, sf_dir).collect()}
    wanted = {r["id"]: r for r in nodes(spark, sf_dir).collect()}
    assert rows.keys() == wanted.keys() and any(r["lat"] <= -70 for r in wanted.values())
    for k, r in wanted.items():
        assert rows[k]["back_lat"] == pytest.approx(r["lat"], abs=1e-5)
        assert (rows[k]["back_lon"] - r["lon"] + 180) % 360 - 180 == pytest.approx(0, abs=1e-5)
