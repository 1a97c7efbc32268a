"""Every registered query against its checking SQL on the smallest tables."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_module  # noqa: E402
from tandem.plans.registry import ORACLES as registered  # noqa: E402
from tandem.plans.registry import full_oracle, spark_queries  # noqa: E402
from verify import number_like, rows_of  # noqa: E402

QUERIES, ORACLES = spark_queries(), {name: full_oracle(sql) for name, sql in registered.items()}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_entry(spark):
    rows = entry_module.entry(spark)
    assert rows.columns == ["work_id", "manhwa", "novela", "faltan"]
    assert 0 < rows.count() <= 50


def test_every_query_has_checking_sql():
    assert set(ORACLES) == set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLES) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert number_like(rows_of(got)) == number_like(rows_of(want))
