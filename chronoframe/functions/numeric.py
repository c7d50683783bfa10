"""Numeric helpers: NaN handling, coercion, rounding and interaction terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def nan_to_null(col) -> Column:
    """NaN -> NULL so Spark aggregates match pandas' NaN-skipping ones."""
    x = _c(col)
    return F.nanvl(x, F.lit(None).cast("double"))


def nan_to_null_all(df: DataFrame) -> DataFrame:
    """Apply :func:`nan_to_null` to every float/double column (ingest rule)."""
    cols = {f.name: nan_to_null(f.name) for f in df.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(cols) if cols else df


def coerce_numeric(col, fill: float | None = 0.0) -> Column:
    """``to_numeric(errors='coerce')`` then ``fillna`` (P11).  ``try_cast`` because
    ANSI mode makes a plain cast raise on bad input."""
    x = F.expr(f"try_cast({col} as double)") if isinstance(col, str) else col.try_cast("double")
    return x if fill is None else F.coalesce(x, F.lit(float(fill)))


def interactions(df: DataFrame) -> DataFrame:
    """Ventilation index, inversion flag, humidity x PM2.5.

    Missing source columns give the reference's constants instead.
    """
    out = {}
    if "boundary_layer_height" in df.columns:
        out["ventilation_idx"] = F.col("boundary_layer_height") * F.col("wind_speed_10m") / 1000
        out["inversion_proxy"] = F.coalesce((F.col("boundary_layer_height") < 500).cast("int"), F.lit(0))
    else:
        out["ventilation_idx"] = F.lit(0.0)
        out["inversion_proxy"] = F.lit(0)
    out["humidity_pm25"] = F.col("relative_humidity_2m") * F.col("pm2_5") / 100
    return df.withColumns(out)
