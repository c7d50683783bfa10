"""Joins: feed merge, festival membership, dimension lookups.

Dimension tables here are fixed literal vocabularies (a handful of rows), so
broadcasting them is a proven size bound; data-sized sides are never
broadcast explicitly.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe.operators.keyed import join_keyed
from chronoframe.functions.calendar import to_local

# ---- fixed values that must match the reference ------------------------------
# festival days (batch builder list, 2020-2024)
DIWALI_DATES = ["2020-11-14", "2021-11-04", "2022-10-24", "2023-11-12", "2024-11-01"]
HOLI_DATES = ["2020-03-10", "2021-03-29", "2022-03-18", "2023-03-08", "2024-03-25"]
GANESH_DATES = ["2020-09-01", "2021-09-19", "2022-09-09", "2023-09-28", "2024-09-17"]
# later years, only in the live feature path
LIVE_EXTRA_DATES = ["2025-10-20", "2026-11-08", "2025-03-14", "2026-03-03", "2025-08-27", "2026-09-15"]

# pollutant -> safe limit and unit
POLLUTANT_LIMITS = [
    ("pm2_5", 25.0, "µg/m³", "PM₂.₅"),
    ("pm10", 50.0, "µg/m³", "PM₁₀"),
    ("nitrogen_dioxide", 40.0, "µg/m³", "NO₂"),
    ("ozone", 100.0, "µg/m³", "O₃"),
    ("sulphur_dioxide", 20.0, "µg/m³", "SO₂"),
    ("carbon_monoxide", 4000.0, "µg/m³", "CO"),
]

# category -> fallback health advice (unknown categories get "Moderate")
FALLBACK_ADVICE = {
    "Good": (
        "**General Public:**\n"
        "- Air quality is satisfactory. Enjoy outdoor activities.\n"
        "- No special precautions needed.\n\n"
        "**Sensitive Groups:**\n"
        "- No restrictions. Normal outdoor activities are safe."
    ),
    "Moderate": (
        "**General Public:**\n"
        "- Air quality is acceptable. Consider reducing prolonged outdoor exertion.\n\n"
        "**Sensitive Groups:**\n"
        "- People with respiratory conditions should monitor symptoms.\n"
        "- Limit extended outdoor exercise if you feel discomfort."
    ),
    "Unhealthy for Sensitive Groups": (
        "**General Public:**\n"
        "- Reduce prolonged outdoor exertion.\n"
        "- Keep windows closed during peak pollution hours.\n\n"
        "**Sensitive Groups:**\n"
        "- Children and elderly should limit outdoor exposure.\n"
        "- People with asthma or heart disease should avoid outdoor exercise."
    ),
    "Unhealthy": (
        "**General Public:**\n"
        "- Avoid prolonged outdoor activities.\n"
        "- Consider wearing a mask outdoors.\n\n"
        "**Sensitive Groups:**\n"
        "- Stay indoors as much as possible.\n"
        "- Use air purifiers if available."
    ),
    "Very Unhealthy": (
        "**General Public:**\n"
        "- Stay indoors whenever possible.\n"
        "- Avoid all outdoor physical activity.\n\n"
        "**Sensitive Groups:**\n"
        "- Remain indoors with windows and doors closed.\n"
        "- Seek medical attention if you experience symptoms."
    ),
    "Hazardous": (
        "**General Public:**\n"
        "- Avoid ALL outdoor activities.\n"
        "- Follow emergency health precautions.\n\n"
        "**Sensitive Groups:**\n"
        "- Remain indoors. Use air purifiers.\n"
        "- Seek immediate medical attention if symptomatic."
    ),
}
ADVICE_DEFAULT_CATEGORY = "Moderate"
# category -> colour and badge of its label
CATEGORY_BADGES = [
    ("Good", "#38a169", "badge-good"),
    ("Moderate", "#d69e2e", "badge-moderate"),
    ("Unhealthy for Sensitive Groups", "#ed8936", "badge-sensitive"),
    ("Unhealthy", "#e53e3e", "badge-unhealthy"),
    ("Very Unhealthy", "#805ad5", "badge-very"),
    ("Hazardous", "#c53030", "badge-hazardous"),
]
DEFAULT_BADGE = "badge-moderate"
# request text for advice: value and category
ADVICE_PROMPT = (
    "You are an air quality health advisor.\n\n"
    "Mumbai AQI forecast:\nAQI: %s\nCategory: %s\n\n"
    "Provide advice in this format:\n\n"
    "General Public:\n- bullet point\n- bullet point\n\n"
    "Sensitive Groups:\n- bullet point\n- bullet point\n\n"
    "Keep it concise and practical."
)
ADVICE_HEADER = "*⚠️ AI advisor unavailable — showing standard guidance for **%s** (AQI %s).*\n\n"
# -----------------------------------------------------------------------------


def merge_feeds(air: DataFrame, weather: DataFrame, keys: Sequence[str] = ("series_id", "time")) -> DataFrame:
    """Inner equi-join of the two feeds (J1); feeds of several series join on the series as well.  Both sides are data-sized, so the
    planner picks sort-merge (or AQE a broadcast when one side turns out small)."""
    times = [k for k in keys if k == "time"]
    out = join_keyed(air, weather, keys)  # a null series is a series; a reading without a time has no partner
    return out.where(F.col("time").isNotNull()) if times else out


def festival_dates(spark: SparkSession, dates: Sequence[str] | None = None,
                   include_next_day: bool = True) -> DataFrame:
    """Distinct festival days, optionally unioned with day+1 (U1, C10).  Tiny literal table."""
    dates = list(dates if dates is not None else DIWALI_DATES + HOLI_DATES + GANESH_DATES)
    base = spark.createDataFrame([(d,) for d in dates], "d string").select(F.to_date("d").alias("date"))
    if include_next_day:
        base = base.union(base.select(F.date_add("date", 1).alias("date")))
    return base.distinct()


def live_festival_dates(spark: SparkSession) -> DataFrame:
    """The festival days of the live feature path, which knows later years too."""
    return festival_dates(spark, DIWALI_DATES + HOLI_DATES + GANESH_DATES + LIVE_EXTRA_DATES)


def flag_festival(df: DataFrame, festivals: DataFrame, time_col: str = "time",
                  name: str = "is_festival", tz: str | None = None) -> DataFrame:
    """``is_festival`` = the row's calendar day, in zone ``tz`` if given, is in the festival set.

    Left join to the broadcast literal set (<= 2 x len(dates) rows)."""
    fest = F.broadcast(festivals.select(F.col("date").alias("_fd"), F.lit(1).alias("_hit")))
    day = F.to_date(to_local(time_col, tz) if tz else F.col(time_col))
    out = df.join(fest, day == F.col("_fd"), "left")
    return out.withColumn(name, F.coalesce(F.col("_hit"), F.lit(0))).drop("_fd", "_hit")


def advice_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FALLBACK_ADVICE.items()), "category string, advice_body string")


def with_advice(df: DataFrame, category_col: str, aqi_col: str, name: str = "advice") -> DataFrame:
    """Fallback advice text for a category, default for unknown keys."""
    spark = df.sparkSession
    adv = F.broadcast(advice_table(spark).withColumnRenamed("category", "_acat"))
    default = FALLBACK_ADVICE[ADVICE_DEFAULT_CATEGORY]
    out = df.join(adv, F.col(category_col) == F.col("_acat"), "left")
    body = F.coalesce(F.col("advice_body"), F.lit(default))
    header = F.format_string(ADVICE_HEADER, F.col(category_col), F.col(aqi_col).cast("string"))
    return out.withColumn(name, F.concat(header, body)).drop("_acat", "advice_body")


def with_badge(df: DataFrame, category_col: str, color: str = "badge_color", badge: str = "badge") -> DataFrame:
    """Colour and badge of a category (J7): an unknown one has the default badge and no colour, null has neither."""
    known = df.sparkSession.createDataFrame(CATEGORY_BADGES, f"_bcat string, `{color}` string, `{badge}` string")
    return df.join(F.broadcast(known), F.col(category_col) == F.col("_bcat"), "left").drop("_bcat").withColumn(
        badge, F.when(F.col(category_col).isNotNull(), F.coalesce(F.col(badge), F.lit(DEFAULT_BADGE))))


def with_prompt(df: DataFrame, category_col: str, aqi_col: str, name: str = "prompt") -> DataFrame:
    """Request text for a row's value and category; null if either is."""
    text = F.format_string(ADVICE_PROMPT, F.col(aqi_col).cast("string"), F.col(category_col))
    return df.withColumn(name, F.when(F.col(aqi_col).isNotNull() & F.col(category_col).isNotNull(), text))


def pollutant_limits(spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField("pollutant", T.StringType()), T.StructField("safe_limit", T.DoubleType()),
                           T.StructField("unit", T.StringType()), T.StructField("label", T.StringType())])
    return spark.createDataFrame(POLLUTANT_LIMITS, schema)


def pollutant_long(df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Unpivot the pollutant columns present in ``df`` and attach their limits.

    Absent readings are dropped (the reference cannot render them either)."""
    present = [p for p, *_ in POLLUTANT_LIMITS if p in df.columns]
    long = df.select(*id_cols, *[F.col(p).cast("double") for p in present]).unpivot(
        list(id_cols), present, "pollutant", "value").where(F.col("value").isNotNull())
    return long.join(F.broadcast(pollutant_limits(df.sparkSession)), on="pollutant", how="inner")
