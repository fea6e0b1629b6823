"""Large tables: the work is dealt to as many tasks as the rows need, whatever the session's shuffle partitions."""

import datetime as dt
import re

import pytest

from freshet import session
from freshet.plans import load
from freshet.plans.registry import QUERIES

load()

TASKS = 60


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """600 lines of six suppliers (three gauges), one without a supplier and one without a date."""
    folder = str(tmp_path_factory.mktemp("given"))
    day = dt.datetime(1999, 1, 1)
    rows = [(i, 10 * (i % 6 // 2) + i % 2, i // 6 % 3 + 1, float(i * 7 % 50), i * 11.25, i % 10 / 100, "ANR"[i % 3], "FO"[i % 2], day + dt.timedelta(days=i // 6 % 40)) for i in range(600)]
    rows += [(600, None, 1, 5.0, 1.0, 0.0, "A", "F", day), (601, 1, 1, 5.0, 1.0, 0.0, "A", "F", None)]
    columns = "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, columns).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(i * 50,) for i in range(8)], "c_custkey long").write.parquet(f"{folder}/customer.parquet")
    return folder


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    """Kind and number of partitions of each exchange, as planned before the run."""
    return re.findall(r"Exchange (\w+)\(.*?, (\d+)\)", plan_of(df).rpartition("== Initial Plan ==")[2])


@pytest.fixture
def dealt(spark, given, monkeypatch):
    """A query on the rows as they are, and as if one task could hold few of them."""

    def both(name):
        few = QUERIES[name](spark, given)
        plain = sorted(map(repr, few.collect()))
        monkeypatch.setattr(session, "ROWS_PER_TASK", 602 // TASKS)
        many = QUERIES[name](spark, given)
        assert sorted(map(repr, many.collect())) == plain and plain
        return many

    return both


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
    assert session.tasks_for(spark, 10 * cores) is None
    assert [session.tasks_for(spark, 10 * cores * k) for k in (2, 20)] == [2 * cores, 20 * cores]


def test_neural_ensemble_takes_one_exchange_of_many_tasks(dealt):
    found = exchanges(dealt("A14_dashboard_neural_ensemble"))
    assert [int(n) > 60 for _, n in found] == [True], found


def test_missing_sites_do_not_sort_records_by_station(dealt):
    plan = dealt("U6_add_missing_hydroposts")._jdf.queryExecution().optimizedPlan().toString()
    # the sites, and the stations of the records
    assert len(re.findall(r"Aggregate \[code#\d+\], \[code#\d+\]", plan)) == 2, plan


def test_station_filter_keeps_its_windows_in_many_tasks(dealt):
    found = exchanges(dealt("W11_station_iqr_filter"))
    # by day, by station and variable; the others deal the quartiles alone
    assert [int(n) > 60 for _, n in found[:2]] == [True, True], found


def test_best_features_are_chosen_from_rows_built_once(spark, dealt):
    many = dealt("R9_select_k_best")
    assert "lineitem" not in plan_of(many) and "Join" not in plan_of(many)


def test_ranked_statistics_end_in_many_tasks(dealt):
    found = exchanges(dealt("A20_ensemble_stats_ranked"))
    assert sum(int(n) > 60 for _, n in found) >= 3, found
