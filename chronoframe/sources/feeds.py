"""Feed readers and file sinks.

Feeds land as files (JSON lines or parquet) partitioned by date; readers
apply an explicit schema (no inference), turn NaN into NULL, and bound the
scan by date so the predicate reaches the file source.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe.functions.numeric import nan_to_null_all
from chronoframe.session import path_exists

# ---- fixed values that must match the reference ------------------------------
AIR_VARIABLES = ["pm10", "pm2_5", "carbon_monoxide", "nitrogen_dioxide", "sulphur_dioxide", "ozone",
                 "ammonia", "us_aqi", "us_aqi_pm2_5", "us_aqi_pm10", "us_aqi_nitrogen_dioxide",
                 "us_aqi_ozone", "dust"]
WEATHER_VARIABLES = ["temperature_2m", "relative_humidity_2m", "dew_point_2m", "precipitation",
                     "surface_pressure", "wind_speed_10m", "wind_direction_10m", "wind_gusts_10m",
                     "visibility", "uv_index", "boundary_layer_height", "cloud_cover",
                     "et0_fao_evapotranspiration", "shortwave_radiation"]
FORECAST_VARIABLES = ["us_aqi", "pm2_5", "pm10", "nitrogen_dioxide", "ozone", "carbon_monoxide"]
# -----------------------------------------------------------------------------


def feed_schema(variables) -> T.StructType:
    return T.StructType([T.StructField("series_id", T.StringType()),
                         T.StructField("time", T.TimestampNTZType())]
                        + [T.StructField(v, T.DoubleType()) for v in variables])


AIR_SCHEMA = feed_schema(AIR_VARIABLES)
WEATHER_SCHEMA = feed_schema(WEATHER_VARIABLES)
FORECAST_SCHEMA = feed_schema(FORECAST_VARIABLES)


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "json":
        return reader.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm[:ss]").json(path)
    return reader.format(fmt).load(path)


def read_feed(spark: SparkSession, path: str, schema: T.StructType, start: str | None = None,
              end: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Scan a feed with a half-open ``[start, end)`` time bound."""
    df = nan_to_null_all(_read(spark, path, schema, fmt))
    if start:
        df = df.where(F.col("time") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.where(F.col("time") < F.lit(end).cast("timestamp_ntz"))
    return df


def read_air(spark, path, start=None, end=None, fmt="parquet"):
    return read_feed(spark, path, AIR_SCHEMA, start, end, fmt)


def read_weather(spark, path, start=None, end=None, fmt="parquet"):
    return read_feed(spark, path, WEATHER_SCHEMA, start, end, fmt)


def read_recent(spark, path, schema, now: str, days: int = 7, fmt="parquet") -> DataFrame:
    """Live scan of the last ``days`` days up to ``now``."""
    df = read_feed(spark, path, schema, fmt=fmt)
    hi = F.lit(now).cast("timestamp_ntz")
    return df.where((F.col("time") <= hi) & (F.col("time") >= hi - F.expr(f"INTERVAL {days} DAYS")))


def read_forecast(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """External forecast scan; a missing source yields an empty typed frame (S8), other faults are errors."""
    if path_exists(spark, path):
        df = read_feed(spark, path, FORECAST_SCHEMA, fmt=fmt)
    else:
        df = spark.createDataFrame([], FORECAST_SCHEMA)
    return df.withColumn("date", F.to_date("time"))


#: Partition columns of a written table: year and month of the stored (UTC) time.
PARTITIONS = ("_py", "_pm")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=PARTITIONS,
                mode: str = "overwrite", time_col: str = "time") -> None:
    """Feature-table sink: parquet partitioned by year/month of storage time by default.

    The partition columns have names of their own, so ``year`` and ``month``
    features, which may be in local time, are stored as they are.
    """
    parts = [p for p in partition_by if p]
    w = df
    if time_col in df.columns:
        own = {PARTITIONS[0]: F.year(time_col), PARTITIONS[1]: F.month(time_col)}
        w = df.withColumns({c: own[c] for c in parts if c in own})
    writer = w.write.mode(mode)
    if parts:
        writer = writer.partitionBy(*parts)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def read_table(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
               time_col: str = "time", fmt: str = "parquet") -> DataFrame:
    """Scan a table written by :func:`write_table` with a half-open time bound.

    The bound is also stated on the partition columns (``year * 12 + month``
    range), so whole partitions are pruned before any file is opened; the
    exact ``time`` predicate still reaches the row-group filter.
    """
    df = spark.read.format(fmt).load(path)
    parted = set(PARTITIONS) <= set(df.columns)
    ym = F.col(PARTITIONS[0]) * 12 + F.col(PARTITIONS[1]) if parted else None
    if start:
        t0 = F.lit(start).cast("timestamp_ntz")
        df = df.where(F.col(time_col) >= t0)
        if parted:
            df = df.where(ym >= F.year(t0) * 12 + F.month(t0))
    if end:
        t1 = F.lit(end).cast("timestamp_ntz")
        df = df.where(F.col(time_col) < t1)
        if parted:
            df = df.where(ym <= F.year(t1) * 12 + F.month(t1))
    return df.drop(*PARTITIONS)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType,
                   timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """CSV scan with header and explicit schema/timestamp format."""
    return (spark.read.schema(schema).option("header", True)
            .option("timestampNTZFormat", timestamp_format).csv(path))


def read_history_json(spark: SparkSession, path: str, cols=("us_aqi",)) -> DataFrame:
    """History table stored as JSON lines (S11): explicit schema, NaN -> NULL."""
    schema = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("time", T.TimestampNTZType())]
                          + [T.StructField(c, T.DoubleType()) for c in cols])
    df = spark.read.schema(schema).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm[:ss]").json(path)
    return nan_to_null_all(df)


def write_report(df: DataFrame, path: str) -> None:
    """One-row report sink as JSON (S12); reports are tiny aggregates."""
    df.coalesce(1).write.mode("overwrite").json(path)


#: Layout of a stored evaluation report, a fixed value of its format.
REPORT_SCHEMA = ("period struct<start:string,end:string>, overall struct<mae:double,rmse:double,r2:double,n:bigint>, "
                 "by_category array<struct<category:string,n:bigint,mae:double,rmse:double>>")


def read_evaluation_report(spark: SparkSession, path: str) -> DataFrame:
    """Scan of a report that :func:`write_report` stored from an evaluation."""
    return spark.read.schema(REPORT_SCHEMA).json(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType, default: dict) -> DataFrame:
    """Report scan with a literal fallback row when the report is missing."""
    if path_exists(spark, path):
        df = spark.read.schema(schema).json(path)
        if not df.isEmpty():
            return df
    return spark.createDataFrame([tuple(default.get(f.name) for f in schema.fields)], schema)


def _line(k: int, value) -> F.Column:
    v = F.lit(value) if isinstance(value, str) else value
    return F.struct(F.lit(k).alias("k"), v.alias("value"))


def markdown_lines(split_report: DataFrame, cv_summary: DataFrame, test_metrics: DataFrame) -> DataFrame:
    """Metrics report as ordered markdown lines (S14): split table with counted
    rows (F13), CV mean / std and held-out metrics.  Three tiny inputs, so the
    result is a handful of rows; ``write_markdown`` writes it as one text file."""
    spark = split_report.sparkSession
    head = spark.createDataFrame([(0, "# Model Evaluation Results"), (1, ""), (2, "| Set | Period | Rows |"),
                                  (3, "|-----|--------|------|")], "k int, value string")
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    splits = split_report.select((F.lit(10) + order).alias("k"), F.format_string(
        "| %s | %s – %s | %d |", "split", F.date_format("min_time", "yyyy-MM-dd"),
        F.date_format("max_time", "yyyy-MM-dd"), "n_rows").alias("value"))
    cv = cv_summary.select(F.explode(F.array(
        _line(20, ""), _line(21, "| Metric | Mean | Std |"), _line(22, "|--------|------|-----|"),
        _line(23, F.format_string("| MAE | %.3f | ±%.3f |", "mae_mean", "mae_std")),
        _line(24, F.format_string("| RMSE | %.3f | ±%.3f |", "rmse_mean", "rmse_std")),
        _line(25, F.format_string("| R² | %.4f | ±%.4f |", "r2_mean", "r2_std")))).alias("x")).select("x.*")
    test = test_metrics.select(F.explode(F.array(
        _line(30, ""), _line(31, F.format_string("| Test MAE | %.3f |", "mae")),
        _line(32, F.format_string("| Test RMSE | %.3f |", "rmse")),
        _line(33, F.format_string("| Test R² | %.4f |", "r2")),
        _line(34, F.format_string("| Test rows | %d |", "n")))).alias("x")).select("x.*")
    return head.unionByName(splits).unionByName(cv).unionByName(test)


def write_markdown(lines: DataFrame, path: str) -> None:
    """One ordered text file (the report is a few dozen lines)."""
    lines.orderBy("k").coalesce(1).select("value").write.mode("overwrite").text(path)
