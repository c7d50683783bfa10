"""R1 null handling, imputation policies, projections and row-local features
(P1, P4-P16, A13, A14, C8, C9, C11-C13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.functions import calendar as cal
from chronoframe.functions import encode
from chronoframe.functions.numeric import interactions
from chronoframe.operators import nulls
from chronoframe.operators import windows as W
from chronoframe.plans import features as FE
from chronoframe.plans.registry import HOURLY_CTE, _round_all, _win, hourly, r9, register
from chronoframe.sources import views as V

R1_MEASURES = V.AIR_COLUMNS + V.WEATHER_COLUMNS
R1_SELECT = "time, " + ", ".join(f"round({c}, 9) AS {c}" for c in R1_MEASURES)
IMPUTE_COLS = ["pm2_5", "precipitation", "wind_speed_10m", "boundary_layer_height",
               "relative_humidity_2m", "wind_direction_10m"]
R1_KEYS_PRESENT = [k for k in FE.KEY_COLUMNS if k in R1_MEASURES]


def _ffill_sql(c: str, src_alias: str = "") -> str:
    return (f"last_value({src_alias}{c} IGNORE NULLS) OVER (ORDER BY time ROWS BETWEEN 3 PRECEDING "
            f"AND CURRENT ROW) AS {c}")


@register("drop_null_target", f"""
WITH {HOURLY_CTE}
SELECT {R1_SELECT} FROM hourly WHERE us_aqi IS NOT NULL
""")
def q_drop_null_target(spark, sf):
    return _round_all(nulls.drop_null_target(hourly(spark, sf)))


@register("drop_null_keys", f"""
WITH {HOURLY_CTE}
SELECT {R1_SELECT} FROM hourly WHERE {" AND ".join(f"{k} IS NOT NULL" for k in R1_KEYS_PRESENT)}
""")
def q_drop_null_keys(spark, sf):
    return _round_all(nulls.drop_null_keys(hourly(spark, sf), FE.KEY_COLUMNS))


_CC_COLS = R1_MEASURES + ["aqi_lag_1", "aqi_lag_24"]


@register("complete_cases", f"""
WITH {HOURLY_CTE},
f AS (SELECT *, lag(us_aqi, 1) OVER (ORDER BY time) AS aqi_lag_1,
             lag(us_aqi, 24) OVER (ORDER BY time) AS aqi_lag_24 FROM hourly)
SELECT time, {", ".join(f"round({c}, 9) AS {c}" for c in _CC_COLS)}
FROM f WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _CC_COLS)}
""")
def q_complete_cases(spark, sf):
    f = _win(hourly(spark, sf), [W.lag("us_aqi", 1, "aqi_lag_1"), W.lag("us_aqi", 24, "aqi_lag_24")])
    return _round_all(nulls.complete_cases(f, _CC_COLS))


_NP_COLS = R1_MEASURES + ["aqi_lag_24", "aqi_lag_72"]


@register("null_profile", f"""
WITH {HOURLY_CTE},
f AS (SELECT *, lag(us_aqi, 24) OVER (ORDER BY time) AS aqi_lag_24,
             lag(us_aqi, 72) OVER (ORDER BY time) AS aqi_lag_72 FROM hourly),
p AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) AS total FROM f" for c in _NP_COLS)})
SELECT column_name, missing, round_even(CAST(missing AS DOUBLE) / total * 100, 2) AS pct
FROM p WHERE missing > 0
""")
def q_null_profile(spark, sf):
    f = _win(hourly(spark, sf), [W.lag("us_aqi", 24, "aqi_lag_24"), W.lag("us_aqi", 72, "aqi_lag_72")])
    return nulls.null_profile(f, _NP_COLS).withColumnRenamed("column", "column_name")


@register("impute_median_pre", f"""
WITH {HOURLY_CTE},
kept AS (SELECT * FROM hourly WHERE us_aqi IS NOT NULL),
med AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in IMPUTE_COLS)} FROM kept),
filled AS (SELECT time, us_aqi, {", ".join(_ffill_sql(c) for c in IMPUTE_COLS)} FROM kept)
SELECT time, round(us_aqi, 9) AS us_aqi,
       {", ".join(f"round(coalesce(f.{c}, m.m_{c}), 9) AS {c}" for c in IMPUTE_COLS)}
FROM filled f CROSS JOIN med m
""")
def q_impute_median_pre(spark, sf):
    """Batch policy: drop null target, ffill(3), medians of the pre-fill frame."""
    kept = nulls.drop_null_target(hourly(spark, sf))
    filled = _win(kept, [W.ffill(c, 3) for c in IMPUTE_COLS])
    return _round_all(nulls.fill_with_medians(filled, IMPUTE_COLS, medians_from=kept))


@register("impute_median_post", f"""
WITH {HOURLY_CTE},
kept AS (SELECT * FROM hourly WHERE us_aqi IS NOT NULL AND {" AND ".join(f"{k} IS NOT NULL" for k in R1_KEYS_PRESENT)}),
filled AS (SELECT time, us_aqi, {", ".join(_ffill_sql(c) for c in IMPUTE_COLS)} FROM kept),
med AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in IMPUTE_COLS)} FROM filled)
SELECT time, round(us_aqi, 9) AS us_aqi,
       {", ".join(f"round(coalesce(f.{c}, m.m_{c}), 9) AS {c}" for c in IMPUTE_COLS)}
FROM filled f CROSS JOIN med m
""")
def q_impute_median_post(spark, sf):
    """Notebook policy: drop null target and key nulls first, ffill(3), medians after."""
    kept = nulls.drop_null_keys(nulls.drop_null_target(hourly(spark, sf)), FE.KEY_COLUMNS)
    filled = _win(kept, [W.ffill(c, 3) for c in IMPUTE_COLS])
    return _round_all(nulls.fill_with_medians(filled, IMPUTE_COLS))


_EX_KEEP = ["pm2_5", "precipitation", "wind_speed_10m", "boundary_layer_height",
            "relative_humidity_2m", "wind_direction_10m", "hour", "day_of_week", "aqi_lag_1"]


@register("exclude_leakage", f"""
WITH {HOURLY_CTE}
SELECT {", ".join(f"round({c}, 9) AS {c}" for c in _EX_KEEP[:6])},
       CAST(hour(time) AS INTEGER) AS hour, CAST(isodow(time) - 1 AS INTEGER) AS day_of_week,
       round(lag(us_aqi, 1) OVER (ORDER BY time), 9) AS aqi_lag_1
FROM hourly
""")
def q_exclude_leakage(spark, sf):
    f = _win(hourly(spark, sf), [W.lag("us_aqi", 1, "aqi_lag_1")])
    f = cal.with_calendar(f).select(*R1_MEASURES, "time", "hour", "day_of_week", "aqi_lag_1")
    out = nulls.exclude_columns(f, FE.EXCLUDE_COLUMNS)
    return _round_all(out)


_ALIGN_LIST = ["aqi_lag_1", "pm2_5", "pm10", "relative_humidity_2m", "ozone", "hour"]


@register("align_features", f"""
WITH {HOURLY_CTE}
SELECT round(lag(us_aqi, 1) OVER (ORDER BY time), 9) AS aqi_lag_1, round(pm2_5, 9) AS pm2_5,
       CAST(0.0 AS DOUBLE) AS pm10, round(relative_humidity_2m, 9) AS relative_humidity_2m, CAST(0.0 AS DOUBLE) AS ozone,
       CAST(hour(time) AS INTEGER) AS hour
FROM hourly
""")
def q_align_features(spark, sf):
    f = _win(hourly(spark, sf), [W.lag("us_aqi", 1, "aqi_lag_1")]).withColumn("hour", F.hour("time"))
    return _round_all(nulls.align_features(f, _ALIGN_LIST))


@register("interactions", f"""
WITH {HOURLY_CTE}
SELECT time, round(boundary_layer_height * wind_speed_10m / 1000, 9) AS ventilation_idx,
       coalesce(CAST(boundary_layer_height < 500 AS INTEGER), 0) AS inversion_proxy,
       round(relative_humidity_2m * pm2_5 / 100, 9) AS humidity_pm25
FROM hourly
""")
def q_interactions(spark, sf):
    out = interactions(hourly(spark, sf))
    return out.select("time", r9("ventilation_idx"), "inversion_proxy", r9("humidity_pm25"))


_SECTOR_SQL = ("CASE WHEN wind_direction_10m >= 0 AND wind_direction_10m < 360 THEN "
               "['N','NE','E','SE','S','SW','W','NW'][CAST(floor(wind_direction_10m / 45) AS INTEGER) + 1] "
               "ELSE 'nan' END")


@register("wind_sector", f"""
WITH {HOURLY_CTE}
SELECT time, wind_direction_10m, {_SECTOR_SQL} AS wind_dir_cat FROM hourly
""")
def q_wind_sector(spark, sf):
    h = hourly(spark, sf)
    return h.select("time", "wind_direction_10m", encode.wind_sector("wind_direction_10m").alias("wind_dir_cat"))


_WLEVELS = encode.WIND_SECTORS + ["nan"]


@register("wind_onehot", f"""
WITH {HOURLY_CTE}, s AS (SELECT time, {_SECTOR_SQL} AS c FROM hourly)
SELECT time, {", ".join(f"CAST(c = '{l}' AS INTEGER) AS wdir_{l}" for l in _WLEVELS)} FROM s
""")
def q_wind_onehot(spark, sf):
    h = hourly(spark, sf).withColumn("wind_dir_cat", encode.wind_sector("wind_direction_10m"))
    return encode.wind_onehot(h).select("time", *[f"wdir_{l}" for l in _WLEVELS])
