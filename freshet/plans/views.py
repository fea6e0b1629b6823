"""Domain tables derived by Spark from the given tables.

Ten suppliers share one gauge, so the number of gauges grows with the data while each
keeps a dense daily record.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text
from ..operators import regression
from ..operators.windows import detect_gaps, prepare_series
from ..session import deal, shared_folder, tasks_for
from ..sources.readers import table, with_target_period


def gauge(key: str, share: int) -> Column:
    return (F.expr(f"{key} div {share}") + 10000).cast("string")


def cents(c: str) -> Column:
    """Money and rates as exact integers, so sums do not depend on the order of rows."""
    return F.round(F.col(c) * 100).cast("bigint")


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in (
            "region nation customer supplier part orders lineitem events documents "
            "embeddings pages benchmark labels conversations"
        ).split():
            return table(self.spark, self.folder, name)
        raise AttributeError(name)

    def scratch(self, name: str) -> str:
        """A new folder below the shared one for tables a query writes and reads back."""
        return f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"

    def _shipped(self) -> DataFrame:
        return self.lineitem.withColumns(
            {"code": gauge("l_suppkey", 10), "date": F.to_date("l_shipdate")}
        )

    @cached_property
    def tasks(self) -> int | None:
        """Tasks that keep a task's share of the lines small, however large the table; counted from the file footers."""
        return tasks_for(self.spark, self.lineitem.count())

    def _dealt(self) -> DataFrame:
        """Lines by gauge and day: every table below groups by these two at least, so it needs no other exchange."""
        return deal(self._shipped(), self.tasks, "code", "date")

    @cached_property
    def daily(self) -> DataFrame:
        return self._dealt().groupBy("code", "date").agg(F.sum("l_quantity").alias("discharge"))

    @cached_property
    def raw(self) -> DataFrame:
        """As ``daily`` with some negative values."""
        return self.daily.withColumn("discharge", F.col("discharge") - 12)

    @cached_property
    def holes(self) -> DataFrame:
        """As ``daily`` with low values missing."""
        return self.daily.withColumn("discharge", F.when(F.col("discharge") >= 25, F.col("discharge")))

    @cached_property
    def readings(self) -> DataFrame:
        return self.events.select(gauge("user_id", 15).alias("code"), "ts", "value")

    @cached_property
    def registry(self) -> DataFrame:
        s = (
            self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .groupBy(gauge("s_suppkey", 10).alias("code"))
            .agg(
                F.min_by("n_name", "s_suppkey").alias("river"),
                F.min_by("s_name", "s_suppkey").alias("place"),
                F.min_by("r_name", "s_suppkey").alias("basin"),
                (F.min("s_nationkey") * 0.25 + 36).alias("lat"),
                (F.max("s_nationkey") * 0.5 + 66).alias("lon"),
                F.max("s_suppkey").cast("int").alias("bulletin_order"),
                (F.min("s_acctbal") + 20000).alias("area"),
                F.bool_or(F.col("s_acctbal") > 8000).alias("flag"),
            )
        )
        return s.withColumn("name", F.concat_ws(" - ", "river", "place"))

    @staticmethod
    def _forcing() -> list[Column]:
        return [
            (F.sum(cents("l_extendedprice")).cast("double") / 1000000).alias("P"),
            (F.sum(cents("l_discount")).cast("double") / F.count(F.lit(1)) - 5).alias("T"),
        ]

    @cached_property
    def forcing(self) -> DataFrame:
        return self._dealt().groupBy("code", "date").agg(*self._forcing())

    @cached_property
    def daily_forcing(self) -> DataFrame:
        """``daily`` joined with ``forcing``: both hold the same keys, so one aggregate of the lines gives both."""
        known = self._dealt().where(F.col("code").isNotNull() & F.col("date").isNotNull())
        return known.groupBy("code", "date").agg(F.sum("l_quantity").alias("discharge"), *self._forcing())

    @cached_property
    def snow(self) -> DataFrame:
        var = F.when(F.col("l_returnflag") == "A", "SWE").when(F.col("l_returnflag") == "N", "HS").otherwise("ROF")
        return self._shipped().groupBy(
            "code", "date", var.alias("var"), F.col("l_linenumber").alias("band")
        ).agg(F.sum("l_quantity").alias("value"))

    @cached_property
    def bands(self) -> DataFrame:
        return self._shipped().groupBy("code", F.col("l_linenumber").alias("band")).agg(
            F.count(F.lit(1)).cast("double").alias("area")
        )

    @cached_property
    def daily_ml(self) -> DataFrame:
        model = F.when(F.col("l_returnflag") == "A", "TFT").when(F.col("l_returnflag") == "N", "TIDE").otherwise("TSMIXER")
        q = F.sum("l_quantity")
        return self._dealt().groupBy(
            "code",
            model.alias("model"),
            F.col("date").alias("forecast_date"),
            F.date_add("date", F.col("l_linenumber")).alias("lead_date"),
        ).agg(
            (q * 0.5).alias("Q5"), (q * 0.75).alias("Q25"), q.alias("Q50"),
            (q * 1.25).alias("Q75"), (q * 1.5).alias("Q95"),
            F.when(F.min("l_linestatus") == "F", 1).otherwise(0).alias("flag"),
        ).withColumnRenamed("lead_date", "date")

    @cached_property
    def forecasts(self) -> DataFrame:
        number = F.substring("o_orderpriority", 1, 1)
        key = (
            F.when(number == "1", "LR").when(number == "2", "TFT").when(number == "3", "TIDE")
            .when(number == "4", "TSMIXER").otherwise("ARIMA")
        )
        rows = self.orders.groupBy(
            gauge("o_custkey", 150).alias("code"),
            cal.next_issue_date(F.to_date("o_orderdate"), "pentad").alias("date"),
            key.alias("model"),
        ).agg(
            (F.sum(cents("o_totalprice")).cast("double") / F.count(F.lit(1)) / 598937).alias("forecasted_discharge")
        )
        return with_target_period(rows, "pentad").withColumns(
            {"model_short": text.model_short("model"), "model_long": text.model_long("model")}
        ).drop("model")

    @cached_property
    def meteo(self) -> DataFrame:
        flag = F.col("l_returnflag")
        variable = F.when(flag == "A", "Precipitation").when(flag == "N", "Temperature").otherwise("Snow depth")
        unit = F.when(flag == "A", "mm").when(flag == "N", "C").otherwise("cm")
        return self._dealt().groupBy("code", variable.alias("variable"), "date", unit.alias("unit")).agg(
            F.sum("l_quantity").alias("value")
        )

    def series(self, horizon: str) -> DataFrame:
        return prepare_series(self.raw, horizon)

    @cached_property
    def observed(self) -> DataFrame:
        s = self.series("pentad").where(F.col("issue_date") & F.col("discharge_avg").isNotNull())
        return s.select("code", "date", "discharge_avg", F.lit(12.5).alias("delta"))

    @cached_property
    def fits(self) -> DataFrame:
        return regression.fit_period_regression(
            self.series("pentad"), complete=["discharge", "predictor", "discharge_avg"]
        )

    @cached_property
    def gaps(self) -> DataFrame:
        return detect_gaps(self.daily, "2001-12-31", 36500)

    @cached_property
    def linreg(self) -> DataFrame:
        """Stored regression output: every issue date with its period's fit."""
        rows = self.series("pentad").where("issue_date").join(self.fits, ["code", "issue_period"])
        return rows.withColumn(
            "forecasted_discharge", F.col("slope") * F.col("predictor") + F.col("intercept")
        )

    @cached_property
    def gateway(self) -> DataFrame:
        """A wide gateway file: a date column and one column pair per sub-basin 1..7."""
        wide = self.lineitem.groupBy(F.date_format("l_shipdate", "dd.MM.yyyy").alias("Station")).pivot(
            "l_linenumber", list(range(1, 8))
        ).agg(
            F.sum("l_quantity").cast("string").alias("T"), F.max("l_quantity").cast("string").alias("P")
        )
        for i in range(1, 8):
            wide = wide.withColumnsRenamed({f"{i}_T": str(i), f"{i}_P": f"{i}.1"})
        return wide.withColumn("Source", F.lit("gateway"))
