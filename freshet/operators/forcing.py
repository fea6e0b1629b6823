"""Weather and snow forcing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import physics
from ..functions.text import parse_date_mixed
from .windows import ffill

# Name suffix of a station's second and third column in gateway files.
CONTROL_SUFFIX = {"1": "P", "2": "SD"}


def transform_control_member(df: DataFrame, date: str = "Station") -> DataFrame:
    """One column pair per station -> (date, code, T, P).

    Column ``<code>`` holds temperature, ``<code>.1`` precipitation; the text rows on top
    fail the date parse and drop out.
    """
    values = [c for c in df.columns if c not in (date, "Source")]
    quoted = df.select(
        parse_date_mixed(date).alias("date"), *[F.col(f"`{c}`").cast("string") for c in values]
    ).where(F.col("date").isNotNull())
    long = quoted.unpivot(["date"], [F.col(f"`{c}`") for c in values], "column", "value")
    parts = F.split("column", r"\.")
    long = long.select(
        "date",
        parts[0].alias("code"),
        F.coalesce(
            F.element_at(F.create_map(*[F.lit(x) for kv in CONTROL_SUFFIX.items() for x in kv]), F.get(parts, 1)),
            F.lit("T"),
        ).alias("var"),
        F.expr("try_cast(value AS DOUBLE)").alias("value"),
    )
    return long.groupBy("date", "code").pivot("var", ["T", "P"]).agg(F.first("value"))


def transform_ensemble_member(df: DataFrame, variable: str, code: str, member: int, date: str = "date") -> DataFrame:
    """One column per sub-basin -> (date, code, name, ensemble_member, value)."""
    names = [c for c in df.columns if c != date]
    typed = df.select(
        parse_date_mixed(F.col(date).cast("string")).alias("date"), *[F.col(n).cast("string") for n in names]
    ).where(F.col("date").isNotNull())
    long = typed.unpivot(["date"], names, "name", "_v")
    return long.select(
        "date",
        F.lit(code).alias("code"),
        "name",
        F.lit(member).alias("ensemble_member"),
        F.expr("try_cast(_v AS DOUBLE)").alias(variable),
    )


def merge_ensemble(p: DataFrame, t: DataFrame) -> DataFrame:
    """S15."""
    return p.join(t, ["code", "name", "ensemble_member", "date"], "full_outer")


def transform_snow(df: DataFrame, var: str, date: str = "date") -> DataFrame:
    """Columns ``<code>_<band>`` or ``<code>`` -> (date, code, var, band, value)."""
    names = [c for c in df.columns if c not in (date, "Source")]
    typed = df.select(
        parse_date_mixed(F.col(date).cast("string")).alias("date"), *[F.col(n).cast("string") for n in names]
    ).where(F.col("date").isNotNull())
    long = typed.unpivot(["date"], names, "_name", "_v")
    parts = F.split("_name", "_")
    return long.select(
        "date",
        parts[0].alias("code"),
        F.lit(var).alias("var"),
        F.get(parts, 1).cast("int").alias("band"),
        F.expr("try_cast(_v AS DOUBLE)").alias("value"),
    )


def pivot_snow(long: DataFrame, var: str, bands: list[int]) -> DataFrame:
    """Long snow -> ``VAR_<band>`` columns; the caller names the bands."""
    rows = long.where(F.col("var") == var)
    wide = rows.groupBy("date", "code").pivot("band", bands).agg(F.first("value"))
    return wide.select("date", "code", *[F.col(f"`{b}`").alias(f"{var}_{b}") for b in bands])


def quantile_map(df: DataFrame, parameters: DataFrame) -> DataFrame:
    """M4: bias correction of P and T; stations without parameters keep their values.

    ``parameters`` rows: ``code, a_p, b_p, wet_day, a_t, b_t``.
    """
    joined = df.join(parameters, "code", "left")
    p = physics.map_precipitation("P", "a_p", "b_p", "wet_day")
    t = physics.map_temperature("T", "a_t", "b_t")
    out = joined.withColumns(
        {
            "P": F.when(F.col("a_p").isNotNull(), p).otherwise(F.col("P")),
            "T": F.when(F.col("a_t").isNotNull(), t).otherwise(F.col("T")),
        }
    )
    return out.select(*df.columns)


def prepare_forcing(df: DataFrame, parameters: DataFrame | None = None, keys=("code",)) -> DataFrame:
    """Bias correction where parameters exist, then gaps carried forward per station."""
    if parameters is not None:
        df = quantile_map(df, parameters)
    return ffill(ffill(df, "P", keys), "T", keys)


def split_forcing(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two published tables."""
    return df.select("date", "P", "code"), df.select("date", "T", "code")
