"""History table by day: idempotent batches, compaction, latest row wins (S10, T1 sink).

Rows lie under ``_day=<date>/_part=<batch>``.  A batch writes its own parts
only, so a replay replaces exactly what it wrote before, and a batch costs what
it brings, not what the day holds.  :func:`compact` turns the parts of finished
days into one part each, which bounds the listing by the number of days.  Every
row keeps the batch that brought it, and a read takes the latest row of each
key, so the result is the same before, during and after a compaction, and a
compaction that is stopped halfway loses nothing.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.session import cut_lineage, path_exists

#: Part of a compacted day; batches have their number.
COMPACTED = -1
NO_DAY = "none"


def write_batch(rows: DataFrame, path: str, batch_id: int, time_col: str = "time") -> None:
    """Write (or write again) the rows of one batch, into the days of their times; rows without a time have a day of their own."""
    day = F.coalesce(F.date_format(time_col, "yyyy-MM-dd"), F.lit(NO_DAY))
    (rows.withColumns({"_batch": F.lit(batch_id).cast("long"), "_day": day, "_part": F.lit(batch_id).cast("long")})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_day", "_part").parquet(path))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).withColumn("_day", F.col("_day").cast("string"))


def _latest(rows: DataFrame, keys: Sequence[str], time_col: str) -> DataFrame:
    """One row per key and time, of the latest batch; a partial aggregate, so no key gathers its rows."""
    group = [*keys, time_col]
    rest = [c for c in rows.columns if c not in group]
    best = F.max_by(F.struct(*rest), F.struct("_batch", F.xxhash64(*rest)))
    return rows.groupBy(*group).agg(best.alias("_row")).select(*group, "_row.*").select(rows.columns)


def read_history(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, keys: Sequence[str] = ("series_id",),
                 time_col: str = "time") -> DataFrame | None:
    """The rows of ``[start, end)``, one per key and time, or None where no batch was written; other days are not opened."""
    if not path_exists(spark, path):
        return None
    rows = _stored(spark, path)
    if start is not None:
        rows = rows.where((F.col("_day") >= F.date_format(F.lit(start).cast("timestamp_ntz"), "yyyy-MM-dd"))
                          & (F.col(time_col) >= F.lit(start).cast("timestamp_ntz")))
    if end is not None:
        rows = rows.where((F.col("_day") <= F.date_format(F.lit(end).cast("timestamp_ntz"), "yyyy-MM-dd"))
                          & (F.col(time_col) < F.lit(end).cast("timestamp_ntz")))
    return _latest(rows, keys, time_col).drop("_day", "_part", "_batch")


def compact(spark: SparkSession, path: str, before: str, keys: Sequence[str] = ("series_id",), time_col: str = "time") -> list[str]:
    """Turn the parts of every day before ``before`` (a date) into one; returns the days that had several.

    The new part is written first and the old ones are removed after it, so a
    reader never misses a row, and a second run finishes what a stopped one left.
    """
    if not path_exists(spark, path):
        return []
    parts = _stored(spark, path).select("_day", "_part").distinct()
    days = (parts.where((F.col("_day") < before) & (F.col("_day") != NO_DAY)).groupBy("_day").agg(F.sort_array(F.collect_list("_part")).alias("p"))
            .where((F.size("p") > 1)).orderBy("_day").collect())  # a row per day with open parts
    if not days:
        return []
    names = [r["_day"] for r in days]
    # written apart first: the parts that are read are also the ones that go
    merged = cut_lineage(_latest(_stored(spark, path).where(F.col("_day").isin(names)), keys, time_col))
    (merged.withColumn("_part", F.lit(COMPACTED).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("_day", "_part").parquet(path))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in days:
        for part in r["p"]:
            if part != COMPACTED:
                old = jvm.org.apache.hadoop.fs.Path(f"{path}/_day={r['_day']}/_part={part}")
                old.getFileSystem(conf).delete(old, True)
    return names

