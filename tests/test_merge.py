import datetime as dt

import pytest

from pyspark.sql import functions as F

from freshet.operators import aggregates, merge
from freshet.operators.quantiles import exact_quantiles
from freshet.sources import readers, writers

SCHEMA = "code string, date date, discharge double"
D = dt.date


def rows(df):
    return sorted((r.code, r.date, r.discharge) for r in df.collect())


def test_update_takes_new_values_and_keeps_old_ones(frame):
    old = frame([("A", D(2024, 1, 1), 100.0), ("B", D(2024, 1, 1), 50.0), ("C", D(2024, 1, 1), 7.0)], SCHEMA)
    new = frame([("A", D(2024, 1, 1), 105.5), ("A", D(2024, 1, 2), 110.0), ("C", D(2024, 1, 1), None)], SCHEMA)
    assert rows(merge.update_append(old, new, ["code", "date"])) == [
        ("A", D(2024, 1, 1), 105.5), ("A", D(2024, 1, 2), 110.0), ("B", D(2024, 1, 1), 50.0), ("C", D(2024, 1, 1), 7.0),
    ]


def test_keep_last_is_idempotent(frame):
    df = frame([("A", D(2024, 1, 1), float(i), i) for i in range(50)], SCHEMA + ", arrival int")
    once = merge.dedupe(df, ["code", "date"], F.col("arrival"))
    assert rows(once) == [("A", D(2024, 1, 1), 49.0)] == rows(merge.dedupe(once, ["code", "date"], F.col("arrival")))
    assert rows(merge.dedupe(df, ["code", "date"], F.col("arrival"), keep="first")) == [("A", D(2024, 1, 1), 0.0)]


def test_dedupe_keeps_the_whole_row_even_with_nulls(frame):
    df = frame([("A", D(2024, 1, 1), 5.0, 0), ("A", D(2024, 1, 1), None, 1)], SCHEMA + ", arrival int")
    assert rows(merge.dedupe(df, ["code", "date"], F.col("arrival"))) == [("A", D(2024, 1, 1), None)]


def test_stale_rows_lose_values_with_grace(frame):
    df = frame([("A", D(2024, 3, 1), 1.0), ("B", D(2023, 12, 28), 2.0), ("C", D(2023, 12, 20), 3.0)], SCHEMA)
    assert [r[2] for r in rows(merge.null_stale_rows(df, ["discharge"]))] == [1.0, 2.0, None]


def test_missing_site_gets_one_null_row(frame):
    df = frame([("A", D(2024, 1, 2), 1.0), ("A", D(2024, 1, 1), 2.0)], SCHEMA)
    out = merge.add_missing_sites(df, frame([("A",), ("N",)], "code string"))
    assert ("N", D(2024, 1, 1), None) in [(r.code, r.date, r.discharge) for r in out.collect()]
    assert out.count() == 3


def test_virtual_station_needs_every_contributor(frame):
    df = frame([("1", D(2024, 1, 1), 10.0), ("2", D(2024, 1, 1), 4.0), ("1", D(2024, 1, 2), 8.0), ("2", D(2024, 1, 3), 9.0)], SCHEMA)
    rules = frame([("v", "1", 1.0, 0), ("v", "2", 0.5, 1)], "virtual_code string, code string, weight double, position int")
    out = sorted((r.date, r.discharge) for r in aggregates.virtual_station(df, rules).collect())
    assert out == [(D(2024, 1, 1), 12.0), (D(2024, 1, 2), None)]


def test_rules_come_from_nested_configuration(frame):
    text = '{"virtualStations": {"v": {"combinationFunction": "sum", "weightByStation": {"1": 1.0, "2": 0.5}}}}'
    out = readers.read_virtual_rules(frame([(text,)], "json string")).collect()
    assert sorted((r.virtual_code, r.code, r.weight, r.position) for r in out) == [("v", "1", 1.0, 0), ("v", "2", 0.5, 1)]


def test_publication_switches_and_never_overwrites_its_source(spark, frame, folder):
    base = folder
    assert writers.published(spark, base) is None
    first = writers.publish(frame([("A", D(2024, 1, 1), 1.0)], SCHEMA), base)
    current = writers.published(spark, base)
    writers.publish(current.withColumn("discharge", F.col("discharge") + 1), base)
    assert rows(writers.published(spark, base)) == [("A", D(2024, 1, 1), 2.0)]
    assert rows(spark.read.parquet(first)) == [("A", D(2024, 1, 1), 1.0)]
    writers.publish(frame([("A", D(2024, 1, 1), 3.0)], SCHEMA), base)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(first)


def test_quantiles_of_a_hot_group_are_exact(spark, folder):
    """One key holds most rows and many equal values."""
    import numpy as np

    n = 60000
    df = spark.range(n).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise((F.col("id") % 7).cast("string")).alias("code"),
        F.round(F.pow(F.rand(3) * 10, 2), 1).alias("value"),
    )
    df.write.parquet(folder)
    df = spark.read.parquet(folder)
    probs = {"q05": 0.05, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    got = {r.code: r for r in exact_quantiles(df, ["code"], "value", probs).collect()}
    for code, group in df.toPandas().groupby("code"):
        for name, p in probs.items():
            np.testing.assert_allclose(got[code][name], np.quantile(group["value"], p), rtol=1e-12)


def test_reliability_counts_up(frame):
    stats = frame([("A", 9, 9, None), ("B", 4, 2, D(2024, 1, 1))], "code string, checks bigint, recent_data_present bigint, last_gap_date date")
    check = frame([("A", True), ("B", False), ("N", False)], "code string, recent boolean")
    out = {r.code: r for r in aggregates.reliability_stats(stats, check, "2024-05-01").collect()}
    assert (out["A"].checks, out["A"].reliability_pct, out["A"].last_gap_date) == (10, 100.0, None)
    assert (out["B"].checks, out["B"].recent_data_present, out["B"].reliability_pct) == (5, 2, 40.0)
    assert (out["N"].checks, out["N"].last_gap_date) == (1, D(2024, 5, 1))
