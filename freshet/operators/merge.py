"""Keep-first / keep-last, unions and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.rounding import stable_round


def dedupe(df: DataFrame, keys: list[str], order: Column, keep: str = "last") -> DataFrame:
    """One row per key, the last (or first) by an explicit order.

    A ``max_by`` aggregate rather than ``row_number``: duplicates collapse before the
    shuffle, so a key that holds a large share of all rows costs one row per map task.
    """
    pick = F.max_by if keep == "last" else F.min_by
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row"))
    return chosen.select(*keys, "_row.*").select(*df.columns)


def one_row_per_day(df: DataFrame, order: Column, keep: str = "last") -> DataFrame:
    return dedupe(df, ["code", "date"], order, keep)


def stack(*tables: DataFrame) -> DataFrame:
    """All models' rows under the union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], keep: str = "last") -> DataFrame:
    """Union where one side wins on equal keys."""
    tagged = existing.withColumn("_side", F.lit(0)).unionByName(
        new.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    return dedupe(tagged, keys, F.col("_side"), keep).drop("_side")


def update_append(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New non-null values replace old ones, new keys are appended."""
    values = [c for c in old.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])
    joined = old.join(renamed, keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) for c in values])


def extend_reanalysis(reanalysis: DataFrame, operational: DataFrame, settle_days: int = 195) -> DataFrame:
    """U4: operational rows become part of the reanalysis once they are settled."""
    newest = operational.agg(F.max("date").alias("d"))
    settled = operational.where(F.col("date") < F.date_sub(newest.scalar(), settle_days))
    return upsert(reanalysis, settled, ["date", "code"])


def add_missing_sites(df: DataFrame, sites: DataFrame, value: str = "discharge") -> DataFrame:
    """A station without any record gets one null row on the earliest date."""
    earliest = df.agg(F.min("date").alias("d"))
    # one row per station on both sides, so the records are not sorted by station
    new = sites.select("code").distinct().join(df.select("code").distinct(), "code", "left_anti")
    rows = new.select(
        "code",
        earliest.scalar().alias("date"),
        F.lit(None).cast("double").alias(value),
    )
    return df.unionByName(rows, allowMissingColumns=True)


def unique_codes(*tables: DataFrame) -> DataFrame:
    """U7."""
    return reduce(lambda a, b: a.union(b), [t.select("code") for t in tables]).distinct()


def replace_same_day(existing: DataFrame, new: DataFrame) -> DataFrame:
    """A rerun on the same forecast date replaces that date's rows."""
    dates = new.select("code", "forecast_date").distinct()
    kept = existing.join(dates, ["code", "forecast_date"], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def with_code_twins(df: DataFrame, twins: DataFrame) -> DataFrame:
    """Rows of a station repeated under its virtual twin's code."""
    twin = twins.select("code", F.col("twin").alias("_twin"))
    joined = df.join(twin, "code", "left").withColumn("_own", F.col("code"))
    codes = F.when(F.col("_twin").isNull(), F.array("_own")).otherwise(F.array("_own", "_twin"))
    columns = [c for c in df.columns if c != "code"]
    return joined.select(F.explode(codes).alias("code"), *columns).select(*df.columns)


def assemble_daily(base, recent, morning=None, gap_values=None, virtual=None, new_wins: bool = True) -> DataFrame:
    """Base table, recent daily means, this morning's readings, gap values and
    virtual stations; the later source wins per (code, date); rounded to 3 decimals."""
    if not new_wins:
        cutoff = base.groupBy("code").agg(F.max("date").alias("_last"))
        recent = recent.join(cutoff, "code", "left").where(
            F.col("_last").isNull() | (F.col("date") > F.col("_last"))
        ).drop("_last")
    sources = [s for s in (base, recent, gap_values, morning, virtual) if s is not None]
    tagged = [s.withColumn("_side", F.lit(i)) for i, s in enumerate(sources)]
    df = dedupe(stack(*tagged), ["code", "date"], F.col("_side")).drop("_side")
    return df.withColumn("discharge", stable_round("discharge", 3))


def latest_per_period(df: DataFrame, horizon, period: str | None = None, extra=()) -> DataFrame:
    """Newest row per (code, period, ...) of the last two calendar years."""
    period = period or cal.horizon_of(horizon).in_year
    newest = dedupe(df, ["code", period, *extra], F.col("date"))
    top = newest.agg(F.max(F.year("date")).alias("y"))
    return newest.where(F.year("date") >= top.scalar() - 1)


def latest_forecasts(df: DataFrame, horizon) -> DataFrame:
    """Newest forecast per (code, period, model), numbers rounded to 3 decimals."""
    out = latest_per_period(df, horizon, extra=("model_short",))
    return round_doubles(out, 3)


def round_doubles(df: DataFrame, decimals: int) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[stable_round(c, decimals).alias(c) if c in doubles else F.col(c) for c in df.columns])


def null_stale_rows(df: DataFrame, values: list[str], grace_days: int = 5) -> DataFrame:
    """Rows outside the newest year (with a few days' grace) keep only their keys."""
    year = df.agg(F.max(F.year("date")).alias("y")).scalar()
    first = F.date_sub(F.make_date(year, F.lit(1), F.lit(1)), grace_days)
    fresh = F.col("date") >= first
    return df.withColumns({c: F.when(fresh, F.col(c)) for c in values})


def last_n_per_group(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Newest ``n`` rows per key (``n = 1`` without a window)."""
    if n == 1:
        return dedupe(df, keys, F.col(order))
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def merge_registry(database: DataFrame, configured: DataFrame, selection: DataFrame, restriction: DataFrame | None = None) -> DataFrame:
    """Database sites plus configured ones it lacks; configured coordinates win;
    then only the selected (and allowed) stations."""
    new = configured.join(database, "code", "left_anti")
    sites = database.unionByName(new, allowMissingColumns=True)
    own = configured.select("code", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    sites = sites.join(own, "code", "left")
    sites = sites.withColumns(
        {"lat": F.coalesce("_lat", "lat"), "lon": F.coalesce("_lon", "lon")}
    ).drop("_lat", "_lon")
    for wanted in (selection, restriction):
        if wanted is not None:
            sites = sites.join(wanted.select("code").distinct(), "code", "left_semi")
    return sites
