"""The daily runs, composed from the operators.

Each takes and returns DataFrames; publish the results with ``sources.writers``.  The forcing run publishes
its tables itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import aggregates, forcing, hydrograph, merge, regression, skill
from ..operators import windows as win
from ..sources import readers, writers


@dataclass
class Ingested:
    daily: DataFrame
    hydrograph: DataFrame
    gaps: DataFrame


def ingest(base: DataFrame, readings: DataFrame, as_of: str, rules: DataFrame | None = None, gap_values: DataFrame | None = None, thresholds: DataFrame | None = None) -> Ingested:
    """Raw readings -> clean daily series, daily hydrograph and open gaps."""
    recent = aggregates.daily_mean_readings(readings)
    virtual = aggregates.virtual_station(base, rules) if rules is not None else None
    whole = merge.assemble_daily(base, recent, gap_values=gap_values, virtual=virtual)
    clean = win.rough_outlier_filter(whole)
    graph = hydrograph.daily_hydrograph(clean, int(as_of[:4]))
    if thresholds is not None:
        graph = hydrograph.danger_thresholds(graph, thresholds)
    return Ingested(clean, graph, win.detect_gaps(whole, as_of))


@dataclass
class Forecast:
    series: DataFrame
    hydrograph: DataFrame
    fits: DataFrame
    hindcast: DataFrame


def forecast(daily: DataFrame, horizon: str, as_of_year: int, norms: DataFrame | None = None, parity: bool = False) -> Forecast:
    """Daily series -> period series, hydrograph, regressions and issue-date forecasts.

    All windows and fits share the partitioning by station that the first one sets up.
    """
    series = win.prepare_series(daily, horizon)
    return Forecast(
        series,
        hydrograph.period_hydrograph(series, horizon, as_of_year, norms),
        regression.fit_period_regression(series),
        regression.hindcast_regression(series, parity=parity),
    )


@dataclass
class Scored:
    skill: DataFrame
    forecasts: DataFrame
    latest: DataFrame


def postprocess(series: DataFrame, hindcast: DataFrame, models: list[DataFrame], horizon: str, since: int = 2010, thresholds: dict | None = None, parity: bool = False) -> Scored:
    """Observations and all models' forecasts -> skill, ensembles and the latest view."""
    h = cal.horizon_of(horizon)
    stored = hindcast.drop("issue_date", "discharge").withColumn("_arrival", F.lit(0))
    linreg, stats = readers.read_linreg_forecasts(stored, h, "_arrival")
    observed = readers.read_observed(series, h).join(stats, ["code", "date"], "left")
    columns = ["code", "date", h.in_month, h.in_year, "forecasted_discharge", "model_long", "model_short"]
    table = merge.stack(*[m.select(*columns) for m in (linreg, *models)])
    table = skill.neural_ensemble(skill.complete_blocks(table), h)
    scores, joint = skill.skill_metrics(observed, table, h, since, thresholds, parity)
    return Scored(scores, joint, merge.latest_forecasts(joint, h))


MEMBER = ["code", "name", "ensemble_member"]


def control_forcing(wide: DataFrame, parameters: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """The gateway's control member -> corrected, gap-filled P and T per station, published below ``base``.

    Returns the two tables as they are read back.
    """
    whole = forcing.prepare_forcing(forcing.transform_control_member(wide), parameters)
    tables = dict(zip(("P", "T"), forcing.split_forcing(whole), strict=True))
    return tuple(_published(table, f"{base}/control_{name}", ["code", "date"]) for name, table in tables.items())


def ensemble_forcing(p: list[tuple[DataFrame, int]], t: list[tuple[DataFrame, int]], code: str, parameters: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """The files of all members (wide tables and their numbers) of one basin -> as above, per sub-basin and member."""
    parts = [
        reduce(DataFrame.unionByName, [forcing.transform_ensemble_member(wide, name, code, n) for wide, n in members])
        for name, members in (("P", p), ("T", t))
    ]
    whole = forcing.prepare_forcing(forcing.merge_ensemble(*parts), parameters, MEMBER)
    return tuple(
        _published(whole.select("date", *MEMBER, name), f"{base}/ensemble_{name}", [*MEMBER, "date"]) for name in ("P", "T")
    )


def _published(table: DataFrame, base: str, order: list[str]) -> DataFrame:
    writers.write_csv(table, base, order)
    return writers.read_csv(table.sparkSession, base, table.schema)
