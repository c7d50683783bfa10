"""Calendar, cyclical and time-zone column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_local(col, tz: str) -> Column:
    """Instant stored as UTC wall-clock -> wall-clock in ``tz``."""
    return F.from_utc_timestamp(_c(col).cast("timestamp"), tz).cast("timestamp_ntz")


def weekday0(col) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(_c(col))


def calendar_columns(time_col: str = "time", tz: str | None = None) -> dict[str, Column]:
    """Name -> expression for hour, day_of_week, month, week_of_year, year,
    day_of_year and is_weekend (C1-C4).  ``tz`` converts from UTC first."""
    t = to_local(time_col, tz) if tz else F.col(time_col)
    dow = F.weekday(t)
    return {
        "hour": F.hour(t),
        "day_of_week": dow,
        "month": F.month(t),
        "week_of_year": F.weekofyear(t),
        "year": F.year(t),
        "day_of_year": F.dayofyear(t),
        "is_weekend": (dow >= 5).cast("int"),
    }


def cyclical(col, period: float) -> tuple[Column, Column]:
    """(sin, cos) of ``2*pi*x/period``."""
    x = 2 * math.pi * _c(col).cast("double") / float(period)
    return F.sin(x), F.cos(x)


def with_calendar(df: DataFrame, time_col: str = "time", tz: str | None = None) -> DataFrame:
    return df.withColumns(calendar_columns(time_col, tz))


def with_cyclical(df: DataFrame) -> DataFrame:
    """hour/month/day-of-week sin-cos pairs; needs :func:`with_calendar` first."""
    out = {}
    for name, src, period in (("hour", "hour", 24), ("month", "month", 12), ("dow", "day_of_week", 7)):
        s, c = cyclical(src, period)
        out[f"{name}_sin"], out[f"{name}_cos"] = s, c
    return df.withColumns(out)


def day_label(col, pattern: str = "EEE dd MMM") -> Column:
    """Display label such as ``Mon 01 Jan``."""
    return F.date_format(_c(col), pattern)


def plus_hours(col, hours: int) -> Column:
    """Timestamp + fixed duration."""
    return _c(col) + F.make_dt_interval(F.lit(0), F.lit(hours))


def epoch_to_timestamp(col) -> Column:
    """Epoch seconds -> UTC wall clock as ``timestamp_ntz`` (S5), independent of the session zone."""
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=_c(col))


def floor_hour(col) -> Column:
    """Truncate to the hour as ``timestamp_ntz`` without any session-zone round trip."""
    t = _c(col)
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.lit(0), F.lit(0))
