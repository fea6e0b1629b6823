"""Text, date-parsing and naming expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import calendar as cal
from .calendar import _col

# Month names by number, January first.
MONTHS = {
    "roman": "I II III IV V VI VII VIII IX X XI XII".split(),
    "ru_nominative": (
        "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь"
    ).split(),
    "ru_genitive": (
        "января февраля марта апреля мая июня июля августа сентября октября ноября декабря"
    ).split(),
    "en": (
        "January February March April May June July August September October November December"
    ).split(),
    "en_short": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
}

# Model key -> (short label, long label).
MODEL_LABELS = {
    "LR": ("LR", "Linear regression (LR)"),
    "TFT": ("TFT", "Temporal-Fusion Transformer (TFT)"),
    "TIDE": ("TiDE", "Time-Series Dense Encoder (TiDE)"),
    "TSMIXER": ("TSMixer", "Time-Series Mixer (TSMixer)"),
    "ARIMA": ("ARIMA", "AutoRegressive Integrated Moving Average (ARIMA)"),
    "RRAM": ("RRAM", "Rainfall runoff assimilation model (RRAM)"),
}

# Date layouts tried when free parsing leaves too many gaps.
DATE_FORMATS = (
    "yyyy-M-d",
    "yyyy/M/d",
    "d-M-yyyy",
    "d/M/yyyy",
    "M-d-yyyy",
    "M/d/yyyy",
    "yyyy-M-d HH:mm:ss",
    "yyyy/M/d HH:mm:ss",
)


def literal_map(mapping: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def month_name(date, style: str = "en") -> Column:
    """D16."""
    names = F.array(*[F.lit(n) for n in MONTHS[style]])
    return F.element_at(names, F.month(_col(date)))


def predictor_month(date, style: str = "roman") -> Column:
    """Name of the month before."""
    return month_name(F.add_months(_col(date), -1), style)


def normalize_code(code) -> Column:
    """D14: '15013.0' -> '15013'."""
    return F.regexp_replace(_col(code).cast("string"), r"\.0$", "")


def standardize_date(ts) -> Column:
    """S3: drop zone and time of day."""
    return F.to_date(_col(ts))


def parse_date_mixed(text) -> Column:
    """Dd.MM.yyyy first, then ISO, then any ISO-like timestamp."""
    t = F.trim(_col(text))
    return F.coalesce(
        F.try_to_date(t, "dd.MM.yyyy"),
        F.try_to_date(t, "yyyy-MM-dd"),
        F.to_date(F.try_to_timestamp(t)),
    )


def parse_dates_robust(df: DataFrame, column: str, threshold: float = 0.8) -> DataFrame:
    """One layout for the whole column, chosen by the share of rows it parses.

    The free ISO parse wins when it covers more than ``threshold`` of the rows;
    otherwise the best of ``DATE_FORMATS`` above it does; otherwise the query fails.
    The vote is a one-row aggregate used as a scalar subquery, so no data passes the
    driver.
    """
    text = F.trim(F.col(column))
    free = F.to_date(F.try_to_timestamp(text))
    tries = [F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in DATE_FORMATS]
    shares = [
        F.avg(t.isNotNull().cast("double")).alias(f"s{i}") for i, t in enumerate([free, *tries])
    ]
    named = F.array(*[
        F.struct(F.col(f"s{i}").alias("share"), F.lit(-i).alias("rank"))
        for i in range(1, len(DATE_FORMATS) + 1)
    ])
    best = F.array_max(named)
    choice = (
        df.where(F.col(column).isNotNull())
        .agg(*shares)
        .select(
            F.when(F.col("s0") > threshold, 0)
            .when(best["share"] > threshold, -best["rank"])
            .otherwise(-1)
            .alias("choice")
        )
    )
    chosen = choice.scalar()
    parsed = F.when(chosen == 0, free)
    for i, t in enumerate(tries, start=1):
        parsed = parsed.when(chosen == i, t)
    failed = F.raise_error(F.lit(f"no date layout fits column {column}")).cast("date")
    return df.withColumn(column, parsed.otherwise(failed))


def is_gregorian(text, layout: str = "yyyy-MM-dd") -> Column:
    """D15."""
    return F.try_to_date(_col(text), layout).isNotNull()


def split_name(name) -> Column:
    """D21: 'river - place' -> struct(river, place) by the first separator that fits."""
    n = _col(name)
    dashes = F.size(F.split(n, "-")) - 1
    parts = F.split(n, "-")
    out = F.when(n.contains(" - "), F.split(n, " - "))
    out = out.when(n.contains(" -"), F.split(n, " -"))
    out = out.when(n.contains("- "), F.split(n, "- "))
    out = out.when(dashes == 1, parts)
    out = out.when(dashes == 2, F.array(F.concat_ws("-", parts[0], parts[1]), parts[2]))
    out = out.when(
        dashes == 3,
        F.array(F.concat_ws("-", parts[0], parts[1]), F.concat_ws("-", F.get(parts, 2), F.get(parts, 3))),
    )
    out = out.otherwise(F.array(n, F.lit("")))
    return F.struct(F.get(out, 0).alias("river"), F.get(out, 1).alias("place"))


def bracketed(name) -> Column:
    """Text of the first (...) or ''."""
    return F.regexp_extract(_col(name), r"\((.*?)\)", 1)


def bulletin_header(date, horizon, style: str = "ru_genitive") -> dict[str, Column]:
    """Period number, month names and day range printed above a bulletin."""
    d = _col(date)
    return {
        "period": cal.period_in_month(d, horizon),
        "month_roman": month_name(d, "roman"),
        "month_name": month_name(d, style),
        "year": cal.year_text(d),
        "first_day": cal.period_first_day(d, horizon),
        "last_day": cal.period_last_day(d, horizon),
    }


def translate(label, catalogue: dict[str, str]) -> Column:
    """Label by catalogue, unchanged when it has no entry."""
    return F.coalesce(F.element_at(literal_map(catalogue), _col(label)), _col(label))


def model_short(key) -> Column:
    return F.element_at(literal_map({k: v[0] for k, v in MODEL_LABELS.items()}), F.upper(_col(key)))


def model_long(key) -> Column:
    return F.element_at(literal_map({k: v[1] for k, v in MODEL_LABELS.items()}), F.upper(_col(key)))


def site_label(code, name) -> Column:
    """J13: 'code - name'."""
    return F.concat_ws(" - ", _col(code), _col(name))
