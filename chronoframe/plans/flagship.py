"""Minimum end-to-end slice (build step 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.functions.categories import category_continuous
from chronoframe.operators import windows as W
from chronoframe.sources import views as V


def daily_outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings -> lag 24 + rolling mean 24 -> category -> daily max."""
    h = V.hourly(spark, sf_dir)
    feats = W.window_features(h, [W.lag("us_aqi", 24, "aqi_lag_24"),
                                  W.rolling("us_aqi", 24, "mean", "aqi_roll_mean_24")],
                              keys=[], order=["time"])
    daily = (feats.groupBy(F.to_date("time").alias("date"))
             .agg(F.max("us_aqi").alias("max_aqi"),
                  F.avg("aqi_roll_mean_24").alias("avg_roll_mean_24"),
                  F.max("aqi_lag_24").alias("max_lag_24")))
    return daily.withColumn("category", category_continuous("max_aqi")).orderBy("date")
