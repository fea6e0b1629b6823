"""Registered queries beside their SQL on the smallest given tables."""

import ast
import os
import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry
from tools.check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are absent")

SAMPLE = (
    "W7_prepare_series_pentad", "W7_prepare_series_decad", "W10_rough_outlier_filter", "W14_group_gaps",
    "R1_fit_period_regression", "R2_hindcast_regression", "R14_model_input_window", "A6_skill_metrics",
    "A9_pentad_hydrograph", "A10_daily_hydrograph", "A16_virtual_station", "A20_ensemble_stats_ranked",
    "S4_flatten_api_payload", "S26_write_linreg_forecasts", "U11_assemble_daily", "X1_stream_daily_mean",
)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    result, _ = compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name])
    assert result == "ok"


def columns_of(con, sql):
    return sorted(r[0] for r in con.execute(f"DESCRIBE {sql}").fetchall())


#: Queries that do their whole work before they return; others are only analysed here.
EAGER = ("op", "pipeline", "X", "R10", "R11", "R12", "R13", "S17", "S18", "S19", "S2", "S12", "S34", "S36")


@pytest.mark.parametrize("name", [n for n in sorted(entry.oracle_sql()) if not n.startswith(EAGER)])
def test_every_query_has_the_columns_of_its_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == columns_of(con, entry.oracle_sql()[name])


def test_no_helper_is_defined_twice():
    """A later function of the same name would take the place of the first one."""
    for path in Path(entry.__file__).resolve().parent.glob("freshet/**/*.py"):
        body = ast.parse(path.read_text()).body
        names = [n.name for n in body if isinstance(n, ast.FunctionDef | ast.ClassDef)]
        assert len(names) == len(set(names)), (path.name, {n for n in names if names.count(n) > 1})


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
