"""Wire payloads: struct of parallel arrays <-> rows.

The live feeds deliver ``{"hourly": {"time": [...], "v1": [...], ...}}``.
Parsing is ``from_json`` with an explicit schema and ``inline(arrays_zip)``;
null elements survive.  Payloads built here are per series and day, so an
array never holds more than 24 hourly entries.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIRE_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm"


def payload_schema(cols: Sequence[str], field: str = "hourly") -> T.StructType:
    inner = T.StructType([T.StructField("time", T.ArrayType(T.StringType()))]
                         + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in cols])
    return T.StructType([T.StructField(field, inner)])


def _field(name: str):
    return lambda r: r[name]


def to_daily_payload(df: DataFrame, cols: Sequence[str], time_col: str = "time",
                     keys: Sequence[str] = (), field: str = "hourly") -> DataFrame:
    """Rows -> one JSON body per (series, day) in the wire shape."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(time_col).alias("t"), *[F.col(c) for c in cols])))
    g = df.groupBy(*keys, F.to_date(time_col).alias("day")).agg(rows.alias("_rows"))
    body = F.struct(F.transform("_rows", lambda r: F.date_format(r["t"], WIRE_TIME_FORMAT)).alias("time"),
                    *[F.transform("_rows", _field(c)).alias(c) for c in cols])
    return g.select(*keys, "day", F.to_json(F.struct(body.alias(field))).alias("body"))


def explode_payload(wire: DataFrame, field: str, cols: Sequence[str], body_col: str = "body",
                    keys: Sequence[str] = ()) -> DataFrame:
    """JSON bodies -> one row per array position, time parsed."""
    parsed = wire.select(*keys, F.from_json(body_col, payload_schema(cols, field)).alias("_p"))
    arrays = [F.col(f"_p.{field}.time")] + [F.col(f"_p.{field}.{c}") for c in cols]
    z = parsed.select(*keys, F.inline(F.arrays_zip(*arrays)))
    z = z.toDF(*keys, "_t", *cols)
    return z.select(*keys, F.to_timestamp_ntz("_t", F.lit(WIRE_TIME_FORMAT)).alias("time"), *cols)
