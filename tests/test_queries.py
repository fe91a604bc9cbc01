"""Every driver query against its SQL in DuckDB, and the entry points."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from cellquill import queries as core

from .conftest import same_rows


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, tables, name):
    same_rows(core.QUERIES[name](spark, sf_dir).toPandas(), tables.sql(core.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert core.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 548


def test_sql_only_for_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plan_deals_molecules_out_once(spark, sf_dir, capsys):
    core.QUERIES["count_genes"](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(barcode") == 2  # molecules, then the small sums by gene
    assert "SortMergeJoin" not in plan
