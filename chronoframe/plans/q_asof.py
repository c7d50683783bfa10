"""R1 as-of, recent-window, snapshot, profile and spine queries
(P19, L2, L3, S3-S5, S7, C29, C34, J4, J8, C22, C23, A2-A4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.functions import calendar as cal
from chronoframe.functions import categories as C
from chronoframe.operators import aggregates as A
from chronoframe.operators import joins as J
from chronoframe.operators import ranking as R
from chronoframe.plans.registry import HOURLY_CTE, NOW, _round_all, hourly, hourly_asof, r9, register
from chronoframe.sources import payload, spine
from chronoframe.sources import views as V

R1_MEASURES = V.AIR_COLUMNS + V.WEATHER_COLUMNS
R1_SELECT = "time, " + ", ".join(f"round({c}, 9) AS {c}" for c in R1_MEASURES)


@register("latest_asof", f"""
WITH {HOURLY_CTE}
SELECT time, round(us_aqi, 9) AS us_aqi, round(pm2_5, 9) AS pm2_5,
       CAST(trunc(us_aqi) AS INTEGER) AS current_aqi, time + INTERVAL 24 HOUR AS forecast_timestamp
FROM hourly WHERE time <= TIMESTAMP '{NOW}' ORDER BY time DESC LIMIT 1
""")
def q_latest_asof(spark, sf):
    row = R.latest(R.as_of(hourly_asof(spark, sf), NOW))
    return row.select("time", r9("us_aqi"), r9("pm2_5"), F.col("us_aqi").cast("int").alias("current_aqi"),
                      cal.plus_hours("time", 24).alias("forecast_timestamp"))


@register("tail48", f"""
WITH {HOURLY_CTE}
SELECT {R1_SELECT} FROM hourly WHERE time <= TIMESTAMP '{NOW}' ORDER BY time DESC LIMIT 48
""")
def q_tail48(spark, sf):
    return _round_all(R.tail_n(R.as_of(hourly_asof(spark, sf), NOW), 48))


@register("recent_window", f"""
WITH {HOURLY_CTE}
SELECT {R1_SELECT} FROM hourly
WHERE time >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND time <= TIMESTAMP '{NOW}'
""")
def q_recent_window(spark, sf):
    """Live scan: the last 7 days up to ``now`` (S7); both bounds reach the parquet scan."""
    lo = F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")
    h = hourly_asof(spark, sf, start="2024-01-18 13:00:00")  # the first full hour of the seven days
    return _round_all(R.as_of(h, NOW).where(F.col("time") >= lo))


# (column, display unit); absent columns show the dash
_CONDITIONS = [("temperature_2m", "°C", "temperature"), ("relative_humidity_2m", "%", "humidity"),
               ("wind_speed_10m", "km/h", "wind_speed"), ("surface_pressure", "hPa", "pressure")]
_DASH = "—"


@register("current_conditions", f"""
WITH {HOURLY_CTE},
l AS (SELECT * FROM hourly WHERE time <= TIMESTAMP '{NOW}' ORDER BY time DESC LIMIT 1)
SELECT time,
       coalesce(printf('%.1f', round_even(pm2_5, 1)), '{_DASH}') AS pm25_now,
       '{_DASH}' AS temperature,
       coalesce(printf('%.1f %s', round_even(relative_humidity_2m, 1), '%'), '{_DASH}') AS humidity,
       coalesce(printf('%.1f %s', round_even(wind_speed_10m, 1), 'km/h'), '{_DASH}') AS wind_speed,
       '{_DASH}' AS pressure
FROM l
""")
def q_current_conditions(spark, sf):
    """Snapshot of the newest row, one decimal, dash when a reading is absent."""
    row = R.latest(R.as_of(hourly_asof(spark, sf), NOW))
    # format_string renders a null argument as text, so absent readings are guarded
    pm = F.when(F.col("pm2_5").isNotNull(), F.format_string("%.1f", F.bround("pm2_5", 1)))
    out = [F.col("time"), F.coalesce(pm, F.lit(_DASH)).alias("pm25_now")]
    for col, unit, name in _CONDITIONS:
        if col in row.columns:
            txt = F.when(F.col(col).isNotNull(), F.format_string("%.1f %s", F.bround(col, 1), F.lit(unit)))
            out.append(F.coalesce(txt, F.lit(_DASH)).alias(name))
        else:
            out.append(F.lit(_DASH).alias(name))
    return row.select(*out)


@register("pollutant_status", f"""
WITH {HOURLY_CTE}
SELECT time, 'pm2_5' AS pollutant, round(pm2_5, 9) AS value, CAST(25.0 AS DOUBLE) AS safe_limit,
       CASE WHEN pm2_5 / 25.0 < 0.5 THEN '#38a169' WHEN pm2_5 / 25.0 < 1.0 THEN '#d69e2e' ELSE '#e53e3e' END AS status_color,
       least(CAST(trunc(pm2_5 / 25.0 * 100) AS INTEGER), 100) AS pct_of_limit
FROM hourly WHERE pm2_5 IS NOT NULL
""")
def q_pollutant_status(spark, sf):
    """Pollutant columns unpivoted, joined to the fixed limit table."""
    long = J.pollutant_long(hourly(spark, sf), ["time"])
    return long.select("time", "pollutant", r9("value"), "safe_limit",
                       C.ratio_status("value", "safe_limit").alias("status_color"),
                       C.pct_of_limit("value", "safe_limit").alias("pct_of_limit"))


@register("daily_mean", f"""
WITH {HOURLY_CTE},
d AS (SELECT CAST(time AS DATE) AS date, avg(us_aqi) AS m FROM hourly GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d)
SELECT s.date, round(d.m, 9) AS us_aqi_daily_mean FROM s LEFT JOIN d USING (date)
""")
def q_daily_mean(spark, sf):
    return _round_all(spine.daily_mean(hourly(spark, sf), "us_aqi"))


@register("hourly_profile", f"""
WITH {HOURLY_CTE}
SELECT CAST(hour(time) AS INTEGER) AS hour, round(avg(us_aqi), 9) AS us_aqi_mean FROM hourly GROUP BY 1
""")
def q_hourly_profile(spark, sf):
    return _round_all(A.hour_profile(hourly(spark, sf), "us_aqi"))


@register("heatmap_pivot", f"""
WITH {HOURLY_CTE}
SELECT CAST(isodow(time) - 1 AS INTEGER) AS dow_index, strftime(time, '%a') AS dow,
       {", ".join(f"round(avg(CASE WHEN hour(time) = {h} THEN us_aqi END), 9) AS h{h:02d}" for h in range(24))}
FROM hourly GROUP BY 1, 2
""")
def q_heatmap_pivot(spark, sf):
    return _round_all(A.weekday_hour_pivot(hourly(spark, sf), "us_aqi"))


@register("gap_fill", f"""
WITH {HOURLY_CTE},
s AS (SELECT unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) AS time FROM hourly)
SELECT s.time, round(h.us_aqi, 9) AS us_aqi, CAST(h.time IS NULL AS INTEGER) AS is_filled
FROM s LEFT JOIN hourly h USING (time)
""")
def q_gap_fill(spark, sf):
    """Regular hourly spine left-joined with the readings (S4 + J4)."""
    h = hourly(spark, sf).select("time", "us_aqi")
    return spine.gap_fill(h).select("time", r9("us_aqi"), "is_filled")


@register("time_spine", """
WITH b AS (SELECT CAST(floor(min(epoch(ts)) / 3600) * 3600 AS BIGINT) AS s,
                  CAST(floor(max(epoch(ts)) / 3600) * 3600 AS BIGINT) AS e FROM events)
SELECT make_timestamp(CAST(x AS BIGINT) * 1000000) AS time
FROM b, range(b.s, b.e + 1, 3600) AS r(x)
""")
def q_time_spine(spark, sf):
    """Hourly index over the events' epoch range, built from epoch seconds."""
    ev = V.table(spark, sf, "events")
    epoch = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    b = ev.agg((F.floor(F.min(epoch) / 3600) * 3600).cast("bigint").alias("s"),
               (F.floor(F.max(epoch) / 3600) * 3600).cast("bigint").alias("e"))
    secs = b.select(F.explode(F.sequence("s", "e", F.lit(3600).cast("bigint"))).alias("x"))
    return secs.select(cal.epoch_to_timestamp("x").alias("time"))


@register("payload_explode", f"""
WITH {HOURLY_CTE}
SELECT time, round(us_aqi, 9) AS us_aqi, round(pm2_5, 9) AS pm2_5 FROM hourly
""")
def q_payload_explode(spark, sf):
    """Struct-of-arrays payloads (one per day, 24 entries max) -> rows."""
    h = hourly(spark, sf)
    wire = payload.to_daily_payload(h, ["us_aqi", "pm2_5"])
    rows = payload.explode_payload(wire, "hourly", ["us_aqi", "pm2_5"])
    return rows.select("time", r9("us_aqi"), r9("pm2_5"))
