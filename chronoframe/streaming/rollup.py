"""Hourly roll-up with late data (T2): event-time windows under a watermark.

The reference refreshed through cache TTLs; here a file-source stream is
aggregated into tumbling event-time windows.  The watermark bounds the state
kept per window, and ``append`` mode emits each window once it is final.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz_to_instant(col: str):
    """UTC wall clock (timestamp_ntz) -> instant, through epoch micros (no session zone)."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, {_EPOCH_NTZ}, `{col}`)"))


def instant_to_ntz(col):
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({col}), {_EPOCH_NTZ})")


def hourly_rollup(stream: DataFrame, time_col: str = "ts", value_col: str = "value",
                  keys: Sequence[str] = ("event_type",), watermark: str = "2 hours",
                  window: str = "1 hour") -> DataFrame:
    """avg / max / count per (window, keys) with a watermark on event time.

    Watermarks need a zoned timestamp; the UTC wall clock is turned into an
    instant via epoch microseconds and back, so windows do not move with the
    session time zone.  On a batch frame the watermark is a no-op and the
    same function gives the batch roll-up.
    """
    s = stream.withColumn("_et", ntz_to_instant(time_col)).withWatermark("_et", watermark)
    agg = s.groupBy(F.window("_et", window).alias("w"), *keys).agg(
        F.avg(value_col).alias("mean"), F.max(value_col).alias("max"), F.count(F.lit(1)).alias("n"))
    return agg.select(instant_to_ntz("w.start").alias("window_start"),
                      instant_to_ntz("w.end").alias("window_end"), *keys, "mean", "max", "n")


def start_rollup(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                 schema: T.StructType = EVENTS_SCHEMA, fmt: str = "parquet",
                 trigger_available_now: bool = True, max_files_per_trigger: int | None = None,
                 **kw) -> StreamingQuery:
    """File source -> roll-up -> parquet sink (exactly-once via the checkpoint).

    ``checkpoint`` must live on shared storage on a cluster; restarting with
    the same checkpoint resumes after executor or driver loss.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_dir)
    out = hourly_rollup(stream, **kw)
    writer = (out.writeStream.outputMode("append").format("parquet")
              .option("path", sink_dir).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if trigger_available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
