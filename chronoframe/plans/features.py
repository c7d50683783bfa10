"""Feature table construction (reference feature engineering, all profiles).

Profiles (SURVEY F1, F2, F7):

``batch``     build features on the full frame, drop null target, ffill(3) the
              non-target columns, fill the rest with medians of the frame
              *before* the forward fill.
``notebook``  drop null target *before* the lags, drop rows null in key
              columns, ffill(3), medians *after* the fill (numeric columns).
``live``      ffill(3), then 0.
``leak_free`` ``batch`` with rolling frames that end at t-1.
``archived``  the older subset: 6 lags, strict rolling, 24 h lead target,
              then complete cases only.

All lags/rollings of one profile are evaluated in a single window stage
(one Exchange + Sort + WindowExec per strategy).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.functions import calendar as cal
from chronoframe.functions import encode
from chronoframe.functions.numeric import interactions
from chronoframe.operators import nulls, windows as W
from chronoframe.operators.joins import festival_dates, flag_festival, live_festival_dates
from chronoframe.session import cut_lineage

# ---- fixed values that must match the reference ------------------------------
TARGET = "us_aqi"
AQI_LAGS = [1, 2, 3, 6, 12, 24, 48, 72]
PM25_LAGS = [1, 3, 6, 24]
PRECIP_LAGS = [1, 3, 6, 12, 24]
WIND_LAGS = [1, 6]
AQI_ROLL_MEANS = [3, 6, 12, 24, 48]
ARCHIVED_AQI_LAGS = [1, 3, 6, 12, 24, 48]
KEY_COLUMNS = ["us_aqi", "pm2_5", "pm10", "nitrogen_dioxide", "temperature_2m",
               "relative_humidity_2m", "wind_speed_10m"]
EXCLUDE_COLUMNS = ["time", "us_aqi", "us_aqi_pm2_5", "us_aqi_pm10",
                   "us_aqi_nitrogen_dioxide", "us_aqi_ozone", "season"]
FFILL_LIMIT = 3
# -----------------------------------------------------------------------------


def lag_exprs(aqi: str = "us_aqi", pm25: str = "pm2_5", precip: str = "precipitation",
              wind: str = "wind_speed_10m", which: Sequence[str] = ("aqi", "pm25", "precip", "wind")):
    out = []
    if "aqi" in which:
        out += [W.lag(aqi, n, f"aqi_lag_{n}") for n in AQI_LAGS]
    if "pm25" in which:
        out += [W.lag(pm25, n, f"pm25_lag_{n}") for n in PM25_LAGS]
    if "precip" in which:
        out += [W.lag(precip, n, f"precip_lag_{n}") for n in PRECIP_LAGS]
    if "wind" in which:
        out += [W.lag(wind, n, f"wind_lag_{n}") for n in WIND_LAGS]
    return out


def rolling_exprs(include_current: bool = True, aqi: str = "us_aqi", pm25: str = "pm2_5",
                  precip: str = "precipitation"):
    ic = include_current
    out = [W.rolling(aqi, n, "mean", f"aqi_roll_mean_{n}", ic) for n in AQI_ROLL_MEANS]
    out += [
        W.rolling(aqi, 24, "std", "aqi_roll_std_24", ic),
        W.rolling(aqi, 24, "max", "aqi_roll_max_24", ic),
        W.rolling(aqi, 24, "min", "aqi_roll_min_24", ic),
        W.rolling(pm25, 24, "mean", "pm25_roll_mean_24", ic),
        W.rolling(pm25, 24, "max", "pm25_roll_max_24", ic),
        W.rolling(precip, 6, "sum", "precip_sum_6h", ic),
        W.rolling(precip, 24, "sum", "precip_sum_24h", ic),
    ]
    return out


def strict_rolling_exprs(aqi: str = "us_aqi", pm25: str = "pm2_5"):
    """Archived notebook: full 24-row window of non-nulls required."""
    return [
        W.rolling(aqi, 24, "mean", "aqi_roll_mean_24", min_periods=24),
        W.rolling(aqi, 24, "std", "aqi_roll_std_24", min_periods=24),
        W.rolling(pm25, 24, "mean", "pm25_roll_mean_24", min_periods=24),
    ]


def static_features(df: DataFrame, time_col: str = "time", tz: str | None = None,
                    festivals: DataFrame | None = None, wind_reference_level: str | None = None) -> DataFrame:
    """Row-local features: calendar, cyclical, season one-hot, festival flag,
    interactions and wind one-hot (C1-C13, J2)."""
    out = cal.with_cyclical(cal.with_calendar(df, time_col, tz))
    out = out.withColumn("season", encode.season("month"))
    out = encode.season_onehot(out)
    fest = festivals if festivals is not None else festival_dates(df.sparkSession)
    out = flag_festival(out, fest, time_col, tz=tz)
    out = interactions(out)
    if "wind_direction_10m" in out.columns:
        out = out.withColumn("wind_dir_cat", encode.wind_sector("wind_direction_10m"))
        out = encode.wind_onehot(out, reference_level=wind_reference_level)
        out = out.drop("wind_dir_cat")
    return out.drop("season")


def built_columns(df: DataFrame) -> dict[str, list[str]]:
    """Columns of ``df`` that the feature builders make, by builder."""
    calendar = [*cal.calendar_columns("time"), "is_festival"]
    cyclic = [f"{n}_{f}" for n in ("hour", "month", "dow") for f in ("sin", "cos")]
    made = {"temporal": calendar, "interactions": ["ventilation_idx", "humidity_pm25", "inversion_proxy"],
            "aqi_lags": [e.name for e in lag_exprs(which=("aqi",))], "rolling": [e.name for e in rolling_exprs()],
            "cyclical": cyclic, "season": [f"season_{s}" for s in encode.SEASONS]}
    have = set(df.columns)
    return {g: [c for c in names if c in have] for g, names in made.items()}


#: Rows that a feature can look back: the longest lag, and a forward fill on top of it.
LOOKBACK_ROWS = max(AQI_LAGS) + FFILL_LIMIT


def _recent(df: DataFrame, keys: list[str], time_col: str, bound, lookback_hours: int, needed: Sequence[str] = ()) -> DataFrame:
    """``df`` from ``lookback_hours`` before ``bound`` on, if every series has rows enough there; else ``df``.

    Only rows that the profile keeps count (``needed`` columns present): of
    ``LOOKBACK_ROWS`` of them the last ones are all that a fill can reach, and
    the others all that a lag of those can.
    """
    usable = nulls.complete_flag(list(needed)) if needed else F.lit(True)
    near = df.where(F.col(time_col) >= bound - F.expr(f"INTERVAL {lookback_hours} HOURS"))
    late, before = F.col(time_col) >= bound, F.col(time_col) < bound
    short = near.groupBy(*keys).agg(F.count_if(late).alias("_late"), F.count_if(before & usable).alias("_n")).where(
        (F.col("_late") > 0) & (F.col("_n") < LOOKBACK_ROWS))
    return near if short.isEmpty() else df


def engineer_features(df: DataFrame, profile: str = "batch", keys: Sequence[str] = (),
                      order: Sequence[str] = ("time",), strategy: str = "auto",
                      tz: str | None = None, festivals: DataFrame | None = None,
                      target: str = TARGET, median_keys: Sequence[str] | None = None,
                      since: str | None = None, lookback_hours: int = 24 * 14,
                      materialize: bool = True, medians: DataFrame | None = None) -> DataFrame:
    """Full feature table for one of the profiles listed in the module docstring.

    ``since`` returns only rows at or after that instant; the result equals the
    full build filtered to them.  Lags count rows, so the input may be cut only
    where the rows that a feature can reach are surely there: it is read from
    ``since - lookback_hours`` on (the bound reaches the file scan) if every
    series has ``LOOKBACK_ROWS`` rows between that the profile keeps, else whole.  Profiles that fill
    with medians need the whole history for them, so they are cut only when
    ``medians`` passes a stored table.

    ``materialize`` writes the frame that feeds both the forward fill and the
    medians once (reliable checkpoint in the session's checkpoint folder), so
    the window stage is not recomputed by each consumer.
    """
    keys, order = list(keys), list(order)
    if since is not None:
        bound = F.lit(since).cast("timestamp_ntz")
        if profile in ("live", "archived") or medians is not None:
            needed = {"batch": [target], "leak_free": [target], "notebook": [target, *KEY_COLUMNS]}.get(profile, [])
            df = _recent(df, keys, order[0], bound, lookback_hours, [c for c in dict.fromkeys(needed) if c in df.columns])
        full = engineer_features(df, profile, keys, order, strategy, tz, festivals, target, median_keys,
                                 materialize=materialize, medians=medians)
        return full.where(F.col(order[0]) >= bound)
    time_col = order[0]
    wkw = dict(keys=keys, order=order, strategy=strategy)
    median_keys = keys if median_keys is None else list(median_keys)

    if profile == "archived":
        base = cal.with_calendar(df, time_col, tz).drop("year", "day_of_year", "is_weekend")
        exprs = [W.lag(target, n, f"aqi_lag_{n}") for n in ARCHIVED_AQI_LAGS]
        exprs += strict_rolling_exprs()
        exprs.append(W.lead(target, 24, "target_24h"))
        return nulls.complete_cases(W.window_features(base, exprs, **wkw))

    if profile == "notebook":
        df = nulls.drop_null_target(df, target)
    include_current = profile != "leak_free"
    feats = W.window_features(df, lag_exprs() + rolling_exprs(include_current), **wkw)
    if festivals is None and profile == "live":
        festivals = live_festival_dates(df.sparkSession)
    feats = static_features(feats, time_col, tz, festivals,
                            wind_reference_level="E" if profile == "notebook" else None)
    non_target = [c for c in feats.columns if c not in (target, *keys, *order)]
    fill = [W.ffill(c, FFILL_LIMIT) for c in non_target]

    if profile == "live":
        filled = W.window_features(feats, fill, **wkw)
        return nulls.fill_const(filled, nulls.numeric_columns(filled, [target, *keys]), 0.0)
    if profile in ("batch", "leak_free"):
        kept = nulls.drop_null_target(feats, target)
        if materialize:
            kept = cut_lineage(kept)
        filled = W.window_features(kept, fill, **wkw)
        num = nulls.numeric_columns(kept, [target, *keys])
        return nulls.fill_with_medians(filled, num, medians_from=kept, keys=median_keys, medians=medians)
    if profile == "notebook":
        kept = nulls.drop_null_keys(feats, KEY_COLUMNS)
        filled = W.window_features(kept, fill, **wkw)
        if materialize:
            filled = cut_lineage(filled)
        num = nulls.numeric_columns(filled, [target, *keys])
        return nulls.fill_with_medians(filled, num, keys=median_keys, medians=medians)
    raise ValueError(f"unknown profile {profile!r}")
