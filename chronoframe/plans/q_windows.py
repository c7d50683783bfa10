"""R1 scans, feed merge and window queries."""

from __future__ import annotations

from pyspark.sql import functions as F  # noqa: F401

from chronoframe.operators import windows as W
from chronoframe.plans import features as FE
from chronoframe.plans.registry import (HOURLY_CTE, _lag_sql, _rnd, _roll_sql, _round_all, _win,
                                        hourly, r6, r9, register)
from chronoframe.sources import views as V

# --------------------------------------------------------------------------- S1 / S2 / J1

@register("scan_readings", f"""
WITH {HOURLY_CTE}
SELECT time, round(us_aqi, 9) AS us_aqi, round(pm2_5, 9) AS pm2_5
FROM hourly WHERE time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-25'
""")
def q_scan_readings(spark, sf):
    """Air-feed scan bounded by date; the bound is pushed into the events scan."""
    h = V.hourly(spark, sf, start="2024-01-05", end="2024-01-25")
    return V.air_feed(h).select("time", r9("us_aqi"), r9("pm2_5"))


@register("scan_weather", f"""
WITH {HOURLY_CTE}
SELECT time, round(precipitation, 9) AS precipitation, round(wind_speed_10m, 9) AS wind_speed_10m,
       round(boundary_layer_height, 9) AS boundary_layer_height,
       round(relative_humidity_2m, 9) AS relative_humidity_2m, wind_direction_10m
FROM hourly WHERE time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-25'
""")
def q_scan_weather(spark, sf):
    h = V.hourly(spark, sf, start="2024-01-05", end="2024-01-25")
    return _round_all(V.weather_feed(h))


@register("merge_feeds", f"""
WITH {HOURLY_CTE}
SELECT a.time, round(a.us_aqi, 9) AS us_aqi, round(a.pm2_5, 9) AS pm2_5,
       round(w.precipitation, 9) AS precipitation, round(w.wind_speed_10m, 9) AS wind_speed_10m,
       round(w.boundary_layer_height, 9) AS boundary_layer_height,
       round(w.relative_humidity_2m, 9) AS relative_humidity_2m, w.wind_direction_10m
FROM (SELECT time, us_aqi, pm2_5 FROM hourly) a
JOIN (SELECT time, precipitation, wind_speed_10m, boundary_layer_height, relative_humidity_2m,
             wind_direction_10m FROM hourly) w USING (time)
""")
def q_merge_feeds(spark, sf):
    from chronoframe.operators.joins import merge_feeds
    h = hourly(spark, sf)  # both feeds project the once-materialised hourly view: one raw scan
    return _round_all(merge_feeds(V.air_feed(h), V.weather_feed(h), ["time"]))


# --------------------------------------------------------------------------- W1-W10

_AQI_LAG_COLS = [f"aqi_lag_{n}" for n in FE.AQI_LAGS]


@register("lag_aqi", f"""
WITH {HOURLY_CTE}
SELECT time, round(us_aqi, 9) AS us_aqi, {", ".join(f"round(aqi_lag_{n}, 9) AS aqi_lag_{n}" for n in FE.AQI_LAGS)}
FROM (SELECT time, us_aqi, {", ".join(_lag_sql("us_aqi", n, f"aqi_lag_{n}") for n in FE.AQI_LAGS)} FROM hourly)
""")
def q_lag_aqi(spark, sf):
    out = _win(hourly(spark, sf), FE.lag_exprs(which=("aqi",)))
    return out.select("time", r9("us_aqi"), *[r9(c) for c in _AQI_LAG_COLS])


_MULTI = ([("pm2_5", n, f"pm25_lag_{n}") for n in FE.PM25_LAGS]
          + [("precipitation", n, f"precip_lag_{n}") for n in FE.PRECIP_LAGS]
          + [("wind_speed_10m", n, f"wind_lag_{n}") for n in FE.WIND_LAGS])


@register("lag_multi", f"""
WITH {HOURLY_CTE}
SELECT time, {", ".join(_rnd(nm) for _, _, nm in _MULTI)}
FROM (SELECT time, {", ".join(_lag_sql(c, n, nm) for c, n, nm in _MULTI)} FROM hourly)
""")
def q_lag_multi(spark, sf):
    out = _win(hourly(spark, sf), FE.lag_exprs(which=("pm25", "precip", "wind")))
    return out.select("time", *[r9(nm) for _, _, nm in _MULTI])


_MEANS = ([("us_aqi", n, f"aqi_roll_mean_{n}") for n in FE.AQI_ROLL_MEANS]
          + [("pm2_5", 24, "pm25_roll_mean_24")])


@register("rolling_mean", f"""
WITH {HOURLY_CTE}
SELECT time, {", ".join(_rnd(nm) for _, _, nm in _MEANS)}
FROM (SELECT time, {", ".join(_roll_sql(c, n, "mean", nm) for c, n, nm in _MEANS)} FROM hourly)
""")
def q_rolling_mean(spark, sf):
    exprs = [e for e in FE.rolling_exprs() if e.name in {nm for _, _, nm in _MEANS}]
    return _win(hourly(spark, sf), exprs).select("time", *[r9(nm) for _, _, nm in _MEANS])


@register("rolling_std", f"""
WITH {HOURLY_CTE}
SELECT time, round(aqi_roll_std_24, 6) AS aqi_roll_std_24
FROM (SELECT time, {_roll_sql("us_aqi", 24, "std", "aqi_roll_std_24")} FROM hourly)
""")
def q_rolling_std(spark, sf):
    out = _win(hourly(spark, sf), [W.rolling("us_aqi", 24, "std", "aqi_roll_std_24")])
    return out.select("time", r6("aqi_roll_std_24"))


_MINMAX = [("us_aqi", 24, "max", "aqi_roll_max_24"), ("us_aqi", 24, "min", "aqi_roll_min_24"),
           ("pm2_5", 24, "max", "pm25_roll_max_24")]


@register("rolling_minmax", f"""
WITH {HOURLY_CTE}
SELECT time, {", ".join(_rnd(nm) for *_, nm in _MINMAX)}
FROM (SELECT time, {", ".join(_roll_sql(c, n, a, nm) for c, n, a, nm in _MINMAX)} FROM hourly)
""")
def q_rolling_minmax(spark, sf):
    out = _win(hourly(spark, sf), [W.rolling(c, n, a, nm) for c, n, a, nm in _MINMAX])
    return out.select("time", *[r9(nm) for *_, nm in _MINMAX])


_SUMS = [("precipitation", 6, "sum", "precip_sum_6h"), ("precipitation", 24, "sum", "precip_sum_24h")]


@register("rolling_sum", f"""
WITH {HOURLY_CTE}
SELECT time, {", ".join(_rnd(nm) for *_, nm in _SUMS)}
FROM (SELECT time, {", ".join(_roll_sql(c, n, a, nm) for c, n, a, nm in _SUMS)} FROM hourly)
""")
def q_rolling_sum(spark, sf):
    out = _win(hourly(spark, sf), [W.rolling(c, n, a, nm) for c, n, a, nm in _SUMS])
    return out.select("time", *[r9(nm) for *_, nm in _SUMS])


@register("rolling_strict", f"""
WITH {HOURLY_CTE}
SELECT time, round(aqi_roll_mean_24, 9) AS aqi_roll_mean_24, round(aqi_roll_std_24, 6) AS aqi_roll_std_24,
       round(pm25_roll_mean_24, 9) AS pm25_roll_mean_24
FROM (SELECT time, {_roll_sql("us_aqi", 24, "mean", "aqi_roll_mean_24", True)},
             {_roll_sql("us_aqi", 24, "std", "aqi_roll_std_24", True)},
             {_roll_sql("pm2_5", 24, "mean", "pm25_roll_mean_24", True)} FROM hourly)
""")
def q_rolling_strict(spark, sf):
    out = _win(hourly(spark, sf), FE.strict_rolling_exprs())
    return out.select("time", r9("aqi_roll_mean_24"), r6("aqi_roll_std_24"), r9("pm25_roll_mean_24"))


_LEADS = [6, 12, 24, 48]


@register("lead_target", f"""
WITH {HOURLY_CTE}
SELECT time, {", ".join(_rnd(f"target_{h}h") for h in _LEADS)}
FROM (SELECT time, {", ".join(f"lead(us_aqi, {h}) OVER (ORDER BY time) AS target_{h}h" for h in _LEADS)} FROM hourly)
""")
def q_lead_target(spark, sf):
    out = _win(hourly(spark, sf), [W.lead("us_aqi", h, f"target_{h}h") for h in _LEADS])
    return out.select("time", *[r9(f"target_{h}h") for h in _LEADS])


_FILL_COLS = ["pm2_5", "precipitation", "wind_speed_10m", "boundary_layer_height"]


@register("ffill_limit", f"""
WITH {HOURLY_CTE}
SELECT time, {", ".join(f"round(last_value({c} IGNORE NULLS) OVER (ORDER BY time ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 9) AS {c}" for c in _FILL_COLS)}
FROM hourly
""")
def q_ffill_limit(spark, sf):
    out = _win(hourly(spark, sf), [W.ffill(c, 3) for c in _FILL_COLS])
    return out.select("time", *[r9(c) for c in _FILL_COLS])


@register("fill_const", f"""
WITH {HOURLY_CTE}
SELECT time, {", ".join(f"round(coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY time ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0.0), 9) AS {c}" for c in _FILL_COLS)}
FROM hourly
""")
def q_fill_const(spark, sf):
    from chronoframe.operators.nulls import fill_const
    out = fill_const(_win(hourly(spark, sf), [W.ffill(c, 3) for c in _FILL_COLS]), _FILL_COLS, 0.0)
    return out.select("time", *[r9(c) for c in _FILL_COLS])


@register("lag_time_aqi", f"""
WITH {HOURLY_CTE}
SELECT h.time, round(p.us_aqi, 9) AS aqi_tlag_24h,
       round(avg(h.us_aqi) OVER (ORDER BY h.time RANGE BETWEEN INTERVAL 86399 SECOND PRECEDING AND CURRENT ROW), 9)
         AS aqi_troll_mean_24h
FROM hourly h LEFT JOIN hourly p ON p.time = h.time - INTERVAL 24 HOUR
""")
def q_lag_time_aqi(spark, sf):
    """Time-true twins of lag 24 / rolling mean 24 (F3): value exactly 24 h earlier
    (null when that hour is missing) and the mean over the trailing 24 h."""
    out = _win(hourly(spark, sf), [W.lag_time("us_aqi", 24 * 3600, "aqi_tlag_24h"),
                                   W.rolling_time("us_aqi", 24 * 3600, "mean", "aqi_troll_mean_24h")])
    return out.select("time", r9("aqi_tlag_24h"), r9("aqi_troll_mean_24h"))
