"""Queries over nullable keys and inputs, several series, and the live calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.functions import categories as C
from chronoframe.operators import joins as J
from chronoframe.operators.aggregates import box_stats
from chronoframe.operators.quantiles import medians_wide
from chronoframe.operators.ranking import tail_n
from chronoframe.operators.splits import positional_split
from chronoframe.plans.registry import r6, register
from chronoframe.sources import views as V

# a key that is null for some users, and a value that is null for some events
_KEY_SQL = "CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(user_id % 5 AS VARCHAR) END"
_EVENTS_SQL = f"SELECT event_id, ts, {_KEY_SQL} AS series_id, value FROM events"


def _events(spark, sf):
    ev = V.table(spark, sf, "events")
    return ev.select("event_id", "ts", F.when(F.col("user_id") % 7 != 0, (F.col("user_id") % 5).cast("string")).alias("series_id"), "value")


@register("category_nulls", """
SELECT event_id, v,
  CASE WHEN v IS NULL THEN NULL WHEN r BETWEEN 0 AND 50 THEN 'Good' WHEN r BETWEEN 51 AND 100 THEN 'Moderate'
       WHEN r BETWEEN 101 AND 150 THEN 'Unhealthy for Sensitive Groups' WHEN r BETWEEN 151 AND 200 THEN 'Unhealthy'
       WHEN r BETWEEN 201 AND 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END AS rounded,
  CASE WHEN v IS NULL THEN NULL WHEN r <= 50 THEN '#38a169' WHEN r <= 100 THEN '#d69e2e' WHEN r <= 150 THEN '#dd6b20'
       WHEN r <= 200 THEN '#e53e3e' WHEN r <= 300 THEN '#805ad5' ELSE '#63171b' END AS colour,
  CASE WHEN v IS NULL THEN NULL WHEN r <= 50 THEN 'success' WHEN r <= 150 THEN 'warning' ELSE 'danger' END AS severity,
  CASE WHEN v IS NULL THEN NULL WHEN v / 25 < 0.5 THEN '#38a169' WHEN v / 25 < 1 THEN '#d69e2e' ELSE '#e53e3e' END AS bar,
  CASE WHEN v IS NULL THEN NULL ELSE CAST(least(trunc(v / 25.0::DOUBLE * 100), 100) AS DOUBLE) END AS pct,
  CASE WHEN v IS NULL THEN NULL WHEN v < 25 THEN 'good' WHEN v < 55 THEN 'moderate' ELSE 'unhealthy' END AS pm_class,
  CASE WHEN v IS NULL THEN NULL WHEN v <= 50 THEN 'good' WHEN v <= 100 THEN 'moderate' ELSE 'unhealthy' END AS aqi_class
FROM (SELECT event_id, v, CAST(round_even(v, 0) AS BIGINT) AS r
      FROM (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS v FROM events))
""")
def q_category_nulls(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("v"))
    r = C.round_half_even_int("v")
    severity, _ = C.alert_level(r, C.category_continuous(r))
    return e.select("event_id", "v", C.category_rounded("v").alias("rounded"), C.category_color("v").alias("colour"),
                    severity.alias("severity"), C.ratio_status("v", F.lit(25.0)).alias("bar"),
                    C.pct_of_limit("v", F.lit(25.0)).cast("double").alias("pct"), C.kpi_class_pm25("v").alias("pm_class"),
                    C.kpi_class_aqi("v").alias("aqi_class"))


@register("split_80_20_rows", f"""
WITH e AS ({_EVENTS_SQL}),
p AS (SELECT event_id, series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts, event_id) - 1 AS pos,
             count(*) OVER (PARTITION BY series_id) AS n FROM e)
SELECT event_id, series_id, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM p
""")
def q_split_80_20_rows(spark, sf):
    """Per-series 80/20 split in which null is a series of its own."""
    return positional_split(_events(spark, sf), 0.8, ["series_id"], ["ts", "event_id"]).select("event_id", "series_id", "split")


@register("medians_null_key", f"""
SELECT series_id, round(median(value), 6) AS value__median FROM ({_EVENTS_SQL}) GROUP BY series_id
""")
def q_medians_null_key(spark, sf):
    m = medians_wide(_events(spark, sf), ["value"], ["series_id"])
    return m.select("series_id", r6("value__median"))


@register("box_null_group", f"""
WITH e AS ({_EVENTS_SQL}),
q AS (SELECT series_id, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3
      FROM e GROUP BY series_id)
SELECT q.series_id, round(min(q1), 6) AS q1, round(min(q.median), 6) AS median, round(min(q3), 6) AS q3, count(*) AS n,
       count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM e JOIN q ON e.series_id IS NOT DISTINCT FROM q.series_id WHERE value IS NOT NULL GROUP BY q.series_id
""")
def q_box_null_group(spark, sf):
    b = box_stats(_events(spark, sf), "value", "series_id")
    return b.select("series_id", r6("q1"), r6("median"), r6("q3"), "n", "n_outliers")


@register("merge_feeds_series", """
WITH h AS (SELECT user_id AS series_id, date_trunc('hour', ts) AS time, event_type, value FROM events),
a AS (SELECT series_id, time, count(*) AS n_view FROM h WHERE event_type = 'view' GROUP BY ALL),
b AS (SELECT series_id, time, count(*) AS n_click FROM h WHERE event_type = 'click' GROUP BY ALL)
SELECT series_id, time, n_view, n_click FROM a JOIN b USING (series_id, time)
""")
def q_merge_feeds_series(spark, sf):
    """Feeds of many series meet on series and hour, never every series with every other."""
    h = V.event_rows(spark, sf).select("series_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"), "event_type")
    feed = lambda kind: h.where(F.col("event_type") == kind).groupBy("series_id", "time").agg(
        F.count(F.lit(1)).alias(f"n_{kind}"))
    return J.merge_feeds(feed("view"), feed("click"))


@register("tail48_series", """
SELECT series_id, event_id, ts FROM (
  SELECT user_id AS series_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events)
WHERE i <= 48
""")
def q_tail48_series(spark, sf):
    return tail_n(V.event_rows(spark, sf), 48, ["series_id"], ["ts", "event_id"]).select("series_id", "event_id", "ts")


@register("is_festival_tz", """
SELECT event_id, CAST(CAST(ts + INTERVAL '330 minutes' AS DATE) IN (DATE '2024-01-14', DATE '2024-01-15') AS INTEGER) AS is_festival
FROM events
""")
def q_is_festival_tz(spark, sf):
    """The festival day is the local one: 18:30 UTC begins the next day in this zone."""
    days = J.festival_dates(spark, ["2024-01-14"])
    return J.flag_festival(V.table(spark, sf, "events"), days, "ts", tz="Asia/Kolkata").select("event_id", "is_festival")


@register("festival_hours", """
SELECT count(*) AS n, CAST(sum(CASE WHEN CAST(ts AS DATE) IN (DATE '2024-01-14', DATE '2024-01-15') THEN 1 ELSE 0 END) AS BIGINT) AS festival_rows
FROM events
""")
def q_festival_hours(spark, sf):
    days = J.festival_dates(spark, ["2024-01-14"])
    flagged = J.flag_festival(V.table(spark, sf, "events"), days, "ts")
    return flagged.agg(F.count(F.lit(1)).alias("n"), F.sum("is_festival").alias("festival_rows"))


@register("complete_rows", """
SELECT count(*) AS n, count(*) FILTER (WHERE v IS NOT NULL AND w IS NOT NULL) AS n_complete
FROM (SELECT CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS v, CASE WHEN user_id % 9 = 0 THEN NULL ELSE 1 END AS w FROM events)
""")
def q_complete_rows(spark, sf):
    e = V.table(spark, sf, "events").select(F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("v"),
                                            F.when(F.col("user_id") % 9 != 0, F.lit(1)).alias("w"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNotNull() & F.col("w").isNotNull()).alias("n_complete"))
