"""Several series with null keys and gaps, as-of at many instants, stored counts, and files written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe.functions import categories as C
from chronoframe.functions.numeric import interactions
from chronoframe.operators import aggregates as A
from chronoframe.operators import joins as J
from chronoframe.operators import nulls as N
from chronoframe.operators import ranking as R
from chronoframe.operators import windows as W
from chronoframe.plans.features import built_columns
from chronoframe.plans.registry import HOURLY_CTE, TEST_START, _round_all, _win, hourly, r9, register
from chronoframe.session import scratch_path
from chronoframe.sources import feeds, spine
from chronoframe.sources import views as V

# a series key that is null for some users, and hourly readings of each series
_SERIES = "CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(user_id % 4 AS VARCHAR) END"
_READ_CTE = f"""r AS (SELECT {_SERIES} AS series_id, date_trunc('hour', ts) AS time, avg(value) AS value
      FROM events WHERE event_type = 'signup' GROUP BY ALL)"""


def _series():
    return F.when(F.col("user_id") % 4 != 0, (F.col("user_id") % 4).cast("string"))


def _readings(spark, sf):
    e = V.table(spark, sf, "events").where(F.col("event_type") == "signup")
    return e.groupBy(_series().alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")).agg(F.avg("value").alias("value"))


@register("gap_fill_series", f"""
WITH {_READ_CTE},
b AS (SELECT series_id, min(time) AS lo, max(time) AS hi FROM r GROUP BY 1),
s AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS time FROM b)
SELECT s.series_id, s.time, round(r.value, 9) AS value, CAST(r.time IS NULL AS INTEGER) AS is_filled
FROM s LEFT JOIN r ON s.series_id IS NOT DISTINCT FROM r.series_id AND s.time = r.time
""")
def q_gap_fill_series(spark, sf):
    """Missing hours of each series, between neighbours; null is a series."""
    return spine.gap_fill(_readings(spark, sf), keys=["series_id"]).select("series_id", "time", r9("value"), "is_filled")


@register("daily_mean_series", f"""
WITH {_READ_CTE},
k AS (SELECT * FROM r WHERE day(time) % 5 <> 0),
d AS (SELECT series_id, CAST(time AS DATE) AS date, avg(value) AS m FROM k GROUP BY ALL),
s AS (SELECT series_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d GROUP BY 1)
SELECT s.series_id, s.date, round(d.m, 9) AS value_daily_mean
FROM s LEFT JOIN d ON s.series_id IS NOT DISTINCT FROM d.series_id AND s.date = d.date
""")
def q_daily_mean_series(spark, sf):
    """Daily means with the empty days of each series between its first and last one (A2)."""
    some = _readings(spark, sf).where(F.dayofmonth("time") % 5 != 0)
    return _round_all(spine.daily_mean(some, "value", keys=["series_id"]))


@register("describe_null_key", f"""
SELECT {_SERIES} AS series_id, count(*) AS n, round(avg(value), 9) AS mean, round(min(value), 9) AS lo, round(max(value), 9) AS hi,
       round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.99), 6) AS p99
FROM events GROUP BY 1
""")
def q_describe_null_key(spark, sf):
    """Summary statistics by a key that may be null (A10)."""
    e = V.table(spark, sf, "events").select(_series().alias("series_id"), "value")
    d = A.describe(e, ["value"], [0.25, 0.5, 0.99], ["series_id"])
    out = d.select("series_id", F.col("count").alias("n"), "mean", F.col("min").alias("lo"), F.col("max").alias("hi"), "std", "p25", "p50", "p99")
    return _round_all(out, six=("std", "p25", "p50", "p99"))


@register("merge_feeds_null_key", f"""
WITH a AS (SELECT {_SERIES} AS series_id, date_trunc('hour', ts) AS time, avg(value) AS views FROM events WHERE event_type = 'view' GROUP BY ALL),
c AS (SELECT {_SERIES} AS series_id, date_trunc('hour', ts) AS time, avg(value) AS clicks FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT a.series_id, a.time, round(views, 9) AS views, round(clicks, 9) AS clicks
FROM a JOIN c ON a.series_id IS NOT DISTINCT FROM c.series_id AND a.time = c.time
""")
def q_merge_feeds_null_key(spark, sf):
    """Two feeds of several series, one of which has no name."""
    e = V.table(spark, sf, "events").select(_series().alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"), "event_type", "value")
    feed = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("series_id", "time").agg(F.avg("value").alias(name))
    return _round_all(J.merge_feeds(feed("view", "views"), feed("click", "clicks")).select("series_id", "time", "views", "clicks"))


@register("asof_many", f"""
WITH e AS (SELECT *, {_SERIES} AS series_id FROM events WHERE event_type IN ('view', 'purchase'))
SELECT series_id, event_id, ts, round(v, 9) AS last_view, coalesce(view_id, -1) AS view_id, view_ts
FROM (SELECT series_id, event_id, ts, event_type,
             last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS v,
             last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS view_id,
             last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER w AS view_ts
      FROM e WINDOW w AS (PARTITION BY series_id ORDER BY ts, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, event_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE event_type = 'purchase'
""")
def q_asof_many(spark, sf):
    """The newest view of the series at the instant of every purchase."""
    e = V.table(spark, sf, "events").withColumn("series_id", _series()).select("series_id", "event_id", "ts", "event_type", "value")
    views, asked = e.where("event_type = 'view'"), e.where("event_type = 'purchase'").select("series_id", "event_id", "ts")
    found = R.asof_many(views, asked, ["series_id"], "ts", ["event_id"])
    return found.select("series_id", "event_id", "ts", F.round("row.value", 9).alias("last_view"), F.coalesce("row.event_id", F.lit(-1)).alias("view_id"),
                        F.col("row.ts").alias("view_ts"))


@register("describe_range", """
SELECT event_type, count(*) AS n, round(avg(value), 9) AS mean, round(min(value), 9) AS lo, round(max(value), 9) AS hi,
       round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.9), 6) AS p90
FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22' GROUP BY 1
""")
def q_describe_range(spark, sf):
    """Two weeks described from a stored table of value counts by day."""
    path = scratch_path(spark, "value-counts")
    e = V.table(spark, sf, "events").select("event_type", "ts", "value")
    A.daily_value_counts(e, ["value"], "ts", ["event_type"]).write.partitionBy("day").parquet(path)
    stored = spark.read.schema("event_type string, column string, _v double, _c long, day date").parquet(path)
    d = A.describe_range(stored, "2024-01-08", "2024-01-22", [0.25, 0.5, 0.9], ["event_type"])
    out = d.select("event_type", F.col("count").alias("n"), "mean", F.col("min").alias("lo"), F.col("max").alias("hi"), "std", "p25", "p50", "p90")
    return _round_all(out, six=("std", "p25", "p50", "p90"))


# --------------------------------------------------------------------------- columns and checks

_WIDE_CTE = """w AS (SELECT event_id, value, CAST(NULL AS DOUBLE) AS empty, CASE WHEN event_id % 50 = 0 THEN value END AS rare,
             CASE WHEN event_id % 2 = 0 THEN value END AS half FROM events)"""


def _wide(spark, sf):
    e, v = F.col("event_id"), F.col("value")
    return V.table(spark, sf, "events").select(e, v, F.lit(None).cast("double").alias("empty"), F.when(e % 50 == 0, v).alias("rare"),
                                               F.when(e % 2 == 0, v).alias("half"))


@register("prune_null_columns", f"WITH {_WIDE_CTE} SELECT event_id, value, rare, half FROM w")
def q_prune_null_columns(spark, sf):
    """The column without any value goes."""
    return N.prune_null_columns(N.require_rows(_wide(spark, sf), "events"))


@register("mostly_null_columns", f"""
WITH {_WIDE_CTE},
c AS (SELECT count(*) AS n, count(*) - count(empty) AS empty, count(*) - count(rare) AS rare, count(*) - count(half) AS half FROM w),
l AS (SELECT 'empty' AS "column", empty AS missing, n FROM c UNION ALL SELECT 'rare', rare, n FROM c UNION ALL SELECT 'half', half, n FROM c)
SELECT "column" AS column_name, missing, round_even(missing / n * 100, 2) AS pct FROM l WHERE missing / n * 100 > 90
""")
def q_mostly_null_columns(spark, sf):
    """Columns with more than 90 % nulls."""
    return N.null_profile(_wide(spark, sf), min_pct=90.0).withColumnRenamed("column", "column_name")


@register("conditional_features", f"""
WITH {HOURLY_CTE}
SELECT time, CAST(0.0 AS DOUBLE) AS ventilation_idx, CAST(0 AS INTEGER) AS inversion_proxy,
       round(relative_humidity_2m * pm2_5 / 100, 9) AS humidity_pm25
FROM hourly
""")
def q_conditional_features(spark, sf):
    """Interactions where the layer height was not measured: constants take their place."""
    h = hourly(spark, sf).drop("boundary_layer_height")
    return _round_all(interactions(h).select("time", "ventilation_idx", "inversion_proxy", "humidity_pm25"))


@register("column_groups", """
SELECT * FROM (VALUES ('pollutants', 'pm2_5'), ('weather', 'relative_humidity_2m'), ('weather', 'precipitation'), ('weather', 'wind_speed_10m'),
  ('weather', 'wind_direction_10m'), ('weather', 'boundary_layer_height'), ('aqi_lags', 'aqi_lag_24'), ('rolling', 'aqi_roll_mean_3')) t(kind, column_name)
WHERE (SELECT count(*) FROM events) > 0
""")
def q_column_groups(spark, sf):
    """Columns of a feature table by kind."""
    df = _win(N.require_rows(hourly(spark, sf)), [W.lag("us_aqi", 24, "aqi_lag_24"), W.rolling("us_aqi", 3, "mean", "aqi_roll_mean_3")])
    return spark.createDataFrame([(g, c) for g, cs in N.column_groups(df, built_columns(df)).items() for c in cs], "kind string, column_name string")


@register("feature_diff", """
SELECT * FROM (VALUES ('available', 'us_aqi'), ('available', 'pm2_5'), ('missing', 'pm10'), ('missing', 'aqi_lag_1')) t(status, column_name)
WHERE (SELECT count(*) FROM events) > 0
""")
def q_feature_diff(spark, sf):
    """Features of a list that a frame has and lacks."""
    have, lack = N.column_diff(N.require_rows(hourly(spark, sf)), ["us_aqi", "pm10", "aqi_lag_1", "pm2_5"])
    return spark.createDataFrame([("available", c) for c in have] + [("missing", c) for c in lack], "status string, column_name string")


# --------------------------------------------------------------------------- files

@register("csv_round_trip", f"WITH {HOURLY_CTE} SELECT time, round(us_aqi, 9) AS us_aqi, round(pm2_5, 9) AS pm2_5 FROM hourly")
def q_csv_round_trip(spark, sf):
    """Readings written as CSV and scanned with an explicit schema."""
    path = scratch_path(spark, "csv")
    rows = hourly(spark, sf).select(F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), "us_aqi", "pm2_5")
    feeds.write_table(rows, path, "csv", partition_by=())
    schema = T.StructType([T.StructField("time", T.TimestampNTZType()), T.StructField("us_aqi", T.DoubleType()), T.StructField("pm2_5", T.DoubleType())])
    return _round_all(feeds.read_csv_table(spark, path, schema))


@register("partitioned_round_trip", f"""
WITH {HOURLY_CTE}
SELECT time, round(us_aqi, 9) AS us_aqi FROM hourly WHERE time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-12'
""")
def q_partitioned_round_trip(spark, sf):
    """A table partitioned by month, read back for two days."""
    path = scratch_path(spark, "table")
    feeds.write_table(hourly(spark, sf).select("time", "us_aqi"), path)
    return _round_all(feeds.read_table(spark, path, "2024-01-10", "2024-01-12").select("time", "us_aqi"))


@register("history_json", f"WITH {HOURLY_CTE} SELECT 'city' AS series_id, time, round(us_aqi, 9) AS us_aqi FROM hourly")
def q_history_json(spark, sf):
    """History kept as JSON lines, scanned with an explicit schema."""
    path = scratch_path(spark, "json")
    h = hourly(spark, sf).select(F.lit("city").alias("series_id"), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), "us_aqi")
    h.write.json(path)
    return _round_all(feeds.read_history_json(spark, path).select("series_id", "time", "us_aqi"))


_CATEGORY_SQL = ("CASE WHEN us_aqi <= 50 THEN 'Good' WHEN us_aqi <= 100 THEN 'Moderate' WHEN us_aqi <= 150 THEN 'Unhealthy for Sensitive Groups' "
                 "WHEN us_aqi <= 200 THEN 'Unhealthy' WHEN us_aqi <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END")


@register("evaluation_report", f"""
WITH {HOURLY_CTE},
e AS (SELECT *, {_CATEGORY_SQL} AS category
      FROM (SELECT time, us_aqi, lag(us_aqi, 1) OVER (ORDER BY time) AS p FROM hourly)
      WHERE time < TIMESTAMP '{TEST_START}' AND us_aqi IS NOT NULL AND p IS NOT NULL),
o AS (SELECT round_even(avg(abs(us_aqi - p)), 3) AS mae, round_even(sqrt(avg(power(us_aqi - p, 2))), 3) AS rmse,
             round_even(1 - sum(power(us_aqi - p, 2)) / (count(*) * var_pop(us_aqi)), 4) AS r2, count(*) AS n FROM e),
c AS (SELECT category, count(*) AS c_n, round_even(avg(abs(us_aqi - p)), 2) AS c_mae, round_even(sqrt(avg(power(us_aqi - p, 2))), 2) AS c_rmse
      FROM e GROUP BY 1 HAVING count(*) >= 5)
SELECT '2024-01-01' AS period_start, '{TEST_START}' AS period_end, mae, rmse, r2, n, category, c_n, c_mae, c_rmse FROM o, c
""")
def q_evaluation_report(spark, sf):
    """The nested report of an evaluation, written as JSON and read again."""
    rows = _win(hourly(spark, sf), [W.lag("us_aqi", 1, "p")]).where(F.col("time") < F.lit(TEST_START).cast("timestamp_ntz"))
    rows = rows.withColumn("category", F.when(F.col("us_aqi").isNotNull(), C.category_continuous("us_aqi")))
    path = scratch_path(spark, "report")
    feeds.write_report(A.evaluation_report(rows, "us_aqi", "p", "category", "2024-01-01", TEST_START), path)
    rep = feeds.read_evaluation_report(spark, path)
    return rep.select(F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"), "overall.*",
                      F.explode("by_category").alias("c")).select(
        "period_start", "period_end", "mae", "rmse", "r2", "n", "c.category", F.col("c.n").alias("c_n"), F.col("c.mae").alias("c_mae"),
        F.col("c.rmse").alias("c_rmse"))
