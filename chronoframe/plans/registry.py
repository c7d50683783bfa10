"""Query registry: one Spark builder and (when SQL-expressible) one oracle SQL per key.

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame over the driver
tables.  Output doubles are rounded at the very end only for hashing (means
and products 9 dp, std/quantiles 6 dp); the library itself never rounds.
The oracle SQL is independent DuckDB SQL over the same parquet views.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.operators import windows as W
from chronoframe.sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


def r9(c: str) -> F.Column:
    return F.round(F.col(c), 9).alias(c)


def r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


def _round_all(df: DataFrame, digits: int = 9, six: tuple = ()) -> DataFrame:
    """Round every double column (std-like columns in ``six`` to 6 dp)."""
    out = []
    for name, typ in df.dtypes:
        if typ == "double":
            out.append(F.round(F.col(name), 6 if name in six else digits).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


# --------------------------------------------------------------------------- SQL building blocks

HOURLY_CTE = """
hourly AS (
  SELECT date_trunc('hour', ts) AS time,
         avg(CASE WHEN event_type = 'view' THEN value END) AS us_aqi,
         avg(CASE WHEN event_type = 'click' THEN value END) AS pm2_5,
         sum(CASE WHEN event_type = 'signup' THEN value END) AS precipitation,
         avg(CASE WHEN event_type = 'purchase' THEN value END) AS wind_speed_10m,
         avg(CASE WHEN event_type = 'error' THEN value END) * 20 AS boundary_layer_height,
         avg(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS relative_humidity_2m,
         CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) % 361 AS DOUBLE) AS wind_direction_10m
  FROM events
  GROUP BY 1
)"""

NOW = "2024-01-25 12:30:00"
VAL_START = "2024-01-21"
TEST_START = "2024-01-26"


def _lag_sql(col: str, n: int, name: str) -> str:
    return f"lag({col}, {n}) OVER (ORDER BY time) AS {name}"


def _roll_sql(col: str, n: int, agg: str, name: str, strict: bool = False) -> str:
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum"}[agg]
    frame = f"OVER (ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    if strict:
        return f"CASE WHEN count({col}) {frame} >= {n} THEN {fn}({col}) {frame} END AS {name}"
    return f"{fn}({col}) {frame} AS {name}"


def _rnd(name: str, d: int = 9) -> str:
    return f"round({name}, {d}) AS {name}"


def hourly(spark: SparkSession, sf: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """R1 as a lazy view: no action runs while a query is built.

    Catalyst drops the measures a query doesn't ask for, so most queries read
    two or three columns and never parse ``props``; ``start`` / ``end`` reach the
    scan.
    """
    return V.hourly(spark, sf, start, end)


#: First instant after the hour of NOW: readings of hours up to NOW lie before it.
NOW_END = "2024-01-25 13:00:00"


def hourly_asof(spark: SparkSession, sf: str, start: str | None = None) -> DataFrame:
    """R1 up to the hour of NOW; the bound is one of ``ts`` and reaches the scan."""
    return hourly(spark, sf, start, NOW_END)


def _win(df: DataFrame, exprs) -> DataFrame:
    """R1 is one series: ``auto`` keeps it in one task only while it is shorter
    than ``chunk_rows``; a longer series is cut into halo chunks."""
    return W.window_features(df, exprs, keys=[], order=["time"], strategy="auto")


