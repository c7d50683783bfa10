"""The full feature table (batch profile) on R1 and the MLlib model queries.

``features_batch`` is the reference's whole feature build -- 19 lags, 12
rolling statistics, calendar, cyclical, season one-hot, festival flag,
interactions and wind one-hot, then drop null target, ffill(3) and
pre-fill medians -- checked column by column against generated SQL.

The model queries (M2-M10) fit MLlib trees; they have no SQL oracle
(iterative learner), so the driver records a rows-only check for them.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from chronoframe.functions import encode
from chronoframe.operators import joins as J
from chronoframe.operators import nulls
from chronoframe.plans import features as FE
from chronoframe.plans import model as M
from chronoframe.plans.registry import HOURLY_CTE, NOW, TEST_START, VAL_START, _round_all, hourly, register
from chronoframe.sources import views as V

MEASURES = V.AIR_COLUMNS + V.WEATHER_COLUMNS
W = "OVER (ORDER BY time)"


def _frame(n: int) -> str:
    return f"OVER (ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _lag_cols():
    out = [("us_aqi", n, f"aqi_lag_{n}") for n in FE.AQI_LAGS]
    out += [("pm2_5", n, f"pm25_lag_{n}") for n in FE.PM25_LAGS]
    out += [("precipitation", n, f"precip_lag_{n}") for n in FE.PRECIP_LAGS]
    out += [("wind_speed_10m", n, f"wind_lag_{n}") for n in FE.WIND_LAGS]
    return out


_ROLLS = ([("avg", "us_aqi", n, f"aqi_roll_mean_{n}") for n in FE.AQI_ROLL_MEANS]
          + [("stddev_samp", "us_aqi", 24, "aqi_roll_std_24"), ("max", "us_aqi", 24, "aqi_roll_max_24"),
             ("min", "us_aqi", 24, "aqi_roll_min_24"), ("avg", "pm2_5", 24, "pm25_roll_mean_24"),
             ("max", "pm2_5", 24, "pm25_roll_max_24"), ("sum", "precipitation", 6, "precip_sum_6h"),
             ("sum", "precipitation", 24, "precip_sum_24h")])

_INT_COLS = (["hour", "day_of_week", "month", "week_of_year", "year", "day_of_year", "is_weekend",
              "season_post_monsoon", "season_summer", "season_winter", "is_festival", "inversion_proxy"]
             + [f"wdir_{s}" for s in encode.WIND_SECTORS + ["nan"]])
_CYC = [("hour", "hour(time)", 24), ("month", "month(time)", 12), ("dow", "(isodow(time) - 1)", 7)]
_SEASON = ("CASE WHEN month(time) IN (6, 7, 8, 9) THEN 'monsoon' WHEN month(time) IN (10, 11) THEN 'post_monsoon' "
           "WHEN month(time) IN (12, 1, 2) THEN 'winter' ELSE 'summer' END")
_SECTOR = ("CASE WHEN wind_direction_10m >= 0 AND wind_direction_10m < 360 THEN "
           "['N','NE','E','SE','S','SW','W','NW'][CAST(floor(wind_direction_10m / 45) AS INTEGER) + 1] ELSE 'nan' END")


def _feature_sql() -> str:
    fest = ", ".join(f"DATE '{d}'" for d in J.DIWALI_DATES + J.HOLI_DATES + J.GANESH_DATES)
    sel = ["time", *MEASURES]
    sel += [f"lag({c}, {n}) {W} AS {nm}" for c, n, nm in _lag_cols()]
    sel += [f"{fn}({c}) {_frame(n)} AS {nm}" for fn, c, n, nm in _ROLLS]
    sel += ["CAST(hour(time) AS INTEGER) AS hour", "CAST(isodow(time) - 1 AS INTEGER) AS day_of_week",
            "CAST(month(time) AS INTEGER) AS month", "CAST(weekofyear(time) AS INTEGER) AS week_of_year",
            "CAST(year(time) AS INTEGER) AS year", "CAST(dayofyear(time) AS INTEGER) AS day_of_year",
            "CAST(isodow(time) - 1 >= 5 AS INTEGER) AS is_weekend"]
    for n, e, p in _CYC:
        sel.append(f"sin({2 * math.pi!r} * {e} / {p}) AS {n}_sin")
        sel.append(f"cos({2 * math.pi!r} * {e} / {p}) AS {n}_cos")
    sel += [f"CAST(({_SEASON}) = '{s}' AS INTEGER) AS season_{s}" for s in ("post_monsoon", "summer", "winter")]
    sel.append(f"CAST(CAST(time AS DATE) IN ({fest}) OR CAST(time AS DATE) - INTERVAL 1 DAY IN ({fest}) AS INTEGER)"
               " AS is_festival")
    sel += ["boundary_layer_height * wind_speed_10m / 1000 AS ventilation_idx",
            "coalesce(CAST(boundary_layer_height < 500 AS INTEGER), 0) AS inversion_proxy",
            "relative_humidity_2m * pm2_5 / 100 AS humidity_pm25"]
    sel += [f"CAST(({_SECTOR}) = '{s}' AS INTEGER) AS wdir_{s}" for s in encode.WIND_SECTORS + ["nan"]]
    return ",\n       ".join(sel)


def _columns() -> list[str]:
    names = ["time", *MEASURES] + [nm for *_, nm in _lag_cols()] + [nm for *_, nm in _ROLLS]
    names += ["hour", "day_of_week", "month", "week_of_year", "year", "day_of_year", "is_weekend"]
    names += [f"{n}_{f}" for n, _, _ in _CYC for f in ("sin", "cos")]
    names += ["season_post_monsoon", "season_summer", "season_winter", "is_festival", "ventilation_idx",
              "inversion_proxy", "humidity_pm25"] + [f"wdir_{s}" for s in encode.WIND_SECTORS + ["nan"]]
    return names


_COLS = _columns()
_DOUBLES = [c for c in _COLS if c not in _INT_COLS and c not in ("time", "us_aqi")]


def _final(c: str) -> str:
    d = 6 if c == "aqi_roll_std_24" else 9
    if c in _INT_COLS:
        return f"f.{c}"
    return f"round(coalesce(f.{c}, m.m_{c}), {d}) + 0.0 AS {c}"


@register("features_batch", f"""
WITH {HOURLY_CTE},
feat AS (SELECT {_feature_sql()} FROM hourly),
kept AS (SELECT * FROM feat WHERE us_aqi IS NOT NULL),
med AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in _DOUBLES)} FROM kept),
filled AS (SELECT time, us_aqi, {", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY time ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS {c}" for c in _COLS if c not in ("time", "us_aqi"))}
           FROM kept)
SELECT f.time, round(f.us_aqi, 9) AS us_aqi, {", ".join(_final(c) for c in _COLS if c not in ("time", "us_aqi"))}
FROM filled f CROSS JOIN med m
""")
def q_features_batch(spark, sf):
    """Reference batch feature build on the hourly view (F2a medians, F7 fixed vocabularies)."""
    out = FE.engineer_features(hourly(spark, sf), "batch")
    return _round_all(out.select(*_COLS), six=("aqi_roll_std_24",))


# --------------------------------------------------------------------------- model queries (rows-only)

MODEL_PARAMS = {"maxIter": 40, "maxDepth": 4, "stepSize": 0.1}


def _feature_table(spark, sf):
    """Rolling frames that end before the current row: the ``batch`` frames contain the target."""
    return FE.engineer_features(hourly(spark, sf), "leak_free")


def _feature_list(df):
    return [c for c in nulls.feature_columns(df, FE.EXCLUDE_COLUMNS)]


@register("gbt_test_metrics")
def q_gbt_test_metrics(spark, sf):
    """Temporal split, fit on train + val, score the held-out test split once (M1, M2, M5, M6)."""
    from chronoframe.operators import splits as S
    feats = S.temporal_split(_feature_table(spark, sf), VAL_START, TEST_START)
    fl = _feature_list(feats.drop("split"))
    model = M.fit(feats.where(F.col("split") != "test"), fl, params=MODEL_PARAMS)
    return _round_all(M.evaluate(model, feats.where(F.col("split") == "test"), fl))


@register("gbt_score_latest")
def q_gbt_score_latest(spark, sf):
    """Fit on history up to ``now`` and score the newest row: the 8-field prediction record (M8)."""
    feats = _feature_table(spark, sf)
    fl = _feature_list(feats)
    model = M.fit(feats.where(F.col("time") <= F.lit(NOW).cast("timestamp_ntz")), fl, params=MODEL_PARAMS)
    return M.score_latest(model, feats, fl, NOW)


@register("gbt_horizon_backtest")
def q_gbt_horizon_backtest(spark, sf):
    """Direct multi-horizon backtest, persistence vs model per horizon."""
    feats = _feature_table(spark, sf)
    fl = _feature_list(feats)
    return _round_all(M.direct_horizon_backtest(feats, fl, params=MODEL_PARAMS))
