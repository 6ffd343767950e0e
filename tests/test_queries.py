import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from helpers import plan
from tidemark.plans.oracle import ORACLE
from tidemark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(map(repr, r)) for r in df.select(*columns).collect())
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    assert {c: TYPES[t] for c, t in df.dtypes} == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert mine == sorted(tuple(map(repr, r)) for r in rel.select(quoted).fetchall())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["panel_id", "severity", "amount", "total", "share_ppm"]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


def test_plans_have_no_cross_joins_or_python(spark):
    for name in ("zone_prevalence", "buildings_wide", "nearest_bfe", "zone_cells_sampled", "clean_buildings_rejected"):
        text = plan(QUERIES[name](spark, SF))
        assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


def test_known_sizes(spark):
    # Agreed row counts of the derived inputs.
    expected = {"points_in_zones": 52, "buildings_outside_zones": 1448, "zone_prevalence_rollup": 86}
    for name, rows in expected.items():
        assert QUERIES[name](spark, SF).count() == rows


def test_groups_add_up(spark):
    rows = QUERIES["zone_prevalence"](spark, SF)
    sums = rows.groupBy("panel_id", "total").sum("amount").where("total <> `sum(amount)`")
    assert sums.count() == 0
    assert rows.agg({"amount": "sum"}).first()[0] == 1500
