"""Input views derived from the driver tables (``/root/testdata/sf*/``).

The reference reads two hourly city feeds; the driver ships an ``events``
stream instead.  ``hourly`` (R1) pivots events per hour into feed-like
measures with natural nulls; ``event_rows`` (R2) is the raw stream keyed by
user as many series; ``orders_by_day`` (R3) carries a long date range for
calendar operators.  All three are lazy DataFrames over the parquet files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.functions.calendar import floor_hour

AIR_COLUMNS = ["us_aqi", "pm2_5"]
WEATHER_COLUMNS = ["precipitation", "wind_speed_10m", "boundary_layer_height",
                   "relative_humidity_2m", "wind_direction_10m"]
HOURLY_COLUMNS = ["time"] + AIR_COLUMNS + WEATHER_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _prop_k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def hourly(spark: SparkSession, sf_dir: str, start: str | None = None,
           end: str | None = None) -> DataFrame:
    """One row per hour present in ``events`` (single series).

    ``start``/``end`` bound ``ts`` half-open and are pushed into the parquet
    scan before the aggregation.
    """
    ev = table(spark, sf_dir, "events")
    if start:
        ev = ev.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        ev = ev.where(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    et, v, k = F.col("event_type"), F.col("value"), _prop_k()
    return (ev.groupBy(floor_hour("ts").alias("time"))
            .agg(F.avg(F.when(et == "view", v)).alias("us_aqi"),
                 F.avg(F.when(et == "click", v)).alias("pm2_5"),
                 F.sum(F.when(et == "signup", v)).alias("precipitation"),
                 F.avg(F.when(et == "purchase", v)).alias("wind_speed_10m"),
                 (F.avg(F.when(et == "error", v)) * 20).alias("boundary_layer_height"),
                 F.avg(k).alias("relative_humidity_2m"),
                 (F.sum(k) % 361).cast("double").alias("wind_direction_10m")))


def air_feed(h: DataFrame) -> DataFrame:
    return h.select("time", *AIR_COLUMNS)


def weather_feed(h: DataFrame) -> DataFrame:
    return h.select("time", *WEATHER_COLUMNS)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: raw events as many series (``series_id = user_id``), order ``(ts, event_id)``."""
    return table(spark, sf_dir, "events").withColumnRenamed("user_id", "series_id")


def orders_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their order date (1995-2001) for calendar operators."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
