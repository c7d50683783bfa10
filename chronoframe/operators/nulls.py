"""Null handling: drops, profiles, alignment, constant and median imputation."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe.operators.keyed import join_keyed
from chronoframe.operators.quantiles import medians_wide

NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Schema-driven feature list: everything not excluded."""
    ex = set(exclude)
    return [c for c in df.columns if c not in ex]


def exclude_columns(df: DataFrame, exclude: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in exclude if c in df.columns])


def drop_null_target(df: DataFrame, target: str = "us_aqi") -> DataFrame:
    """P4."""
    return df.na.drop(subset=[target])


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows null in any of ``keys`` that exist in the frame (P5)."""
    present = [k for k in keys if k in df.columns]
    return df.na.drop(subset=present) if present else df


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with no null in ``cols`` (default all columns)."""
    return df.na.drop(how="any", subset=list(cols) if cols else None)


def complete_flag(cols: Sequence[str]) -> F.Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def count_complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: total rows and rows complete in ``cols``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(complete_flag(cols)).alias("n_complete"))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None, only_missing: bool = True,
                 min_pct: float | None = None) -> DataFrame:
    """Missing count and percent (2 dp, half-even) per column in one pass.

    Returns ``(column, missing, pct)`` -- one aggregate row unpivoted, so the
    work is a single partial aggregation regardless of data size.
    """
    cols = list(cols or df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("_total"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = agg.unpivot(["_total"], cols, "column", "missing")
    out = long.select("column", "missing",
                      F.bround(F.col("missing") / F.col("_total") * 100, 2).alias("pct"))
    if min_pct is not None:  # P9: columns above a null-share threshold (e.g. 90)
        out = out.where(F.col("pct") > F.lit(float(min_pct)))
    return out.where(F.col("missing") > 0) if only_missing else out


def total_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row: total number of null cells over ``cols`` (A13's remaining-NaN count)."""
    cols = list(cols or df.columns)
    return df.agg(sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0)).alias("total_missing"))


def prune_null_columns(df: DataFrame, threshold: float = 1.0, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns whose null fraction is >= ``threshold`` (P8; 1.0 = all-null).

    One aggregate row is collected to decide the projection (a plan-time
    decision on a bounded result).
    """
    cols = [c for c in df.columns if c not in keep]
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(c).alias(c) for c in cols]).first()
    n = row["_n"] or 0
    drop = [c for c in cols if n == 0 or (1 - row[c] / n) >= threshold]
    return df.drop(*drop)


def column_diff(df: DataFrame, feature_list: Sequence[str]) -> tuple[list[str], list[str]]:
    """(available, missing) training features for this frame (U3); schema only."""
    have = set(df.columns)
    return [c for c in feature_list if c in have], [c for c in feature_list if c not in have]


def align_features(df: DataFrame, feature_list: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Project to the training feature list; absent columns become ``fill`` (P10)."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(float(fill)).alias(c) for c in feature_list])


def fill_const(df: DataFrame, cols: Sequence[str], value: float = 0.0) -> DataFrame:
    """Constant fill."""
    return df.na.fill(float(value), subset=list(cols))


def attach_group_row(df: DataFrame, stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Join one stats row per ``keys`` onto every data row.

    Without keys the stats frame is a single row and is broadcast on a
    constant key (a proven size bound); with keys it is an equi-join (null keys
    match) that AQE turns into a broadcast only when its runtime size allows.
    """
    if keys:
        return join_keyed(df, stats, list(keys), "left")
    return (df.withColumn("_g", F.lit(0))
            .join(F.broadcast(stats.withColumn("_g", F.lit(0))), on="_g", how="left").drop("_g"))


def fill_with_medians(df: DataFrame, cols: Sequence[str], medians_from: DataFrame | None = None,
                      keys: Sequence[str] = (), medians: DataFrame | None = None) -> DataFrame:
    """Fill nulls with exact medians computed on ``medians_from`` (default ``df``).

    ``medians_from`` is how the two reference policies differ: the batch
    builder takes medians of the frame *before* the forward fill, the
    notebook *after* it.  ``medians`` is a stored table as
    :func:`chronoframe.operators.quantiles.medians_wide` makes it.
    """
    cols = list(cols)
    src = medians_from if medians_from is not None else df
    med = medians if medians is not None else medians_wide(src, cols, keys)
    joined = attach_group_row(df, med, keys)
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    # the median takes the column's own type, so integral columns stay integral
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.col(c + "__median").cast(types[c])) for c in cols})
    return filled.drop(*[c + "__median" for c in cols])


def require_rows(df: DataFrame, what: str = "frame") -> DataFrame:
    """Raise when ``df`` is empty (P20); an opt-in action (``isEmpty`` reads one row)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


# ---- fixed values that must match the reference: reported pollutants and weather variables
POLLUTANT_COLUMNS = ["pm2_5", "pm10", "nitrogen_dioxide", "ozone", "sulphur_dioxide", "carbon_monoxide", "ammonia", "dust"]
WEATHER_COLUMNS = ["temperature_2m", "relative_humidity_2m", "dew_point_2m", "precipitation", "surface_pressure",
                   "wind_speed_10m", "wind_direction_10m", "wind_gusts_10m", "visibility", "uv_index",
                   "boundary_layer_height", "cloud_cover", "shortwave_radiation"]
# -----------------------------------------------------------------------------


def column_groups(df: DataFrame, built: Mapping[str, Sequence[str]] | None = None) -> dict[str, list[str]]:
    """Columns of ``df`` by kind (P18); schema only.

    Measured columns are the fixed lists above.  ``built`` names the columns
    that each feature builder makes (:func:`chronoframe.plans.features.built_columns`),
    so no group depends on how a name happens to be spelled.
    """
    groups = {"pollutants": POLLUTANT_COLUMNS, "weather": WEATHER_COLUMNS, **(built or {})}
    have = set(df.columns)
    return {g: [c for c in names if c in have] for g, names in groups.items()}
