import datetime as dt
import math
import random

from pyspark.sql import functions as F

from freshet.plans import runs
from freshet.sources import readers


def test_the_three_runs_from_readings_to_ensemble(spark, frame):
    rng = random.Random(1)
    rows = []
    for code, size in (("10001", 30.0), ("10002", 90.0)):
        for i in range(6 * 365):
            day = dt.date(2015, 1, 1) + dt.timedelta(days=i)
            if rng.random() < 0.03:
                continue
            q = size * (1.2 + math.sin(day.timetuple().tm_yday / 58)) + rng.uniform(0, 1) + day.year % 4
            rows.append((code, day, round(q, 3)))
    base = frame(rows, "code string, date date, discharge double")
    readings = frame(
        [("10001", dt.datetime(2020, 12, 30, h), 40.0 + h) for h in (8, 20)], "code string, ts timestamp, value double"
    )
    done = runs.ingest(base, readings, "2020-12-30")
    daily = done.daily.cache()
    assert daily.groupBy("code").agg(F.count_distinct("date").alias("n"), F.count(F.lit(1)).alias("m")).where("n <> m").count() == 0
    assert daily.where("code = '10001' and date = '2020-12-30'").first().discharge == 54.0
    assert done.hydrograph.where("code = '10002'").count() == 366
    assert done.gaps.count() > 0

    made = runs.forecast(daily, "pentad", 2020)
    series, hindcast = made.series.cache(), made.hindcast.cache()
    assert made.hydrograph.count() == 144 and made.fits.count() == 144
    columns = ["code", "date", "pentad_in_month", "pentad_in_year", "forecasted_discharge", "model_long", "model_short"]
    truth = readers.read_observed(series, "pentad")
    models = [
        truth.withColumn("forecasted_discharge", F.col("discharge_avg") * f)
        .withColumns({"model_long": F.lit(f"x ({name})"), "model_short": F.lit(name)})
        .select(*columns)
        for name, f in (("TFT", 1.001), ("TiDE", 0.999))
    ]
    scored = runs.postprocess(series, hindcast, models, "pentad", since=2015)
    short = {r[0] for r in scored.forecasts.select("model_short").distinct().collect()}
    assert {"LR", "TFT", "TiDE", "NE", "EM"} <= short
    assert scored.skill.where("model_short = 'TFT' and nse < 0.9").count() == 0
    newest = scored.latest.groupBy("code", "pentad_in_year", "model_short").count()
    assert newest.where("count > 1").count() == 0
