"""Aggregations: metrics, profiles, pivots, histograms, box statistics.

All of these are partial (map-side) aggregations: each task keeps one small
buffer per group, so a hot group costs a few bytes per task, not its rows.
Quantile-based ones go through :mod:`chronoframe.operators.quantiles`.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.functions.calendar import weekday0
from chronoframe.operators.keyed import broadcast_few, join_keyed
from chronoframe.operators.quantiles import quantiles_from_counts, quantiles_long, to_long, value_counts
from chronoframe.session import cut_lineage


def metric_columns(actual: str, pred: str) -> list[Column]:
    """MAE, RMSE and R^2 = 1 - SSE/SST as aggregate expressions.

    SST is ``n * var_pop(actual)`` (a numerically stable aggregate), not
    the squared correlation ``regr_r2``.
    """
    err = F.col(actual) - F.col(pred)
    n = F.count(F.lit(1))
    sse = F.sum(err * err)
    sst = n * F.var_pop(actual)
    return [
        n.alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.lit(1.0) - sse / F.nullif(sst, F.lit(0.0))).alias("r2"),
    ]


def regression_metrics(df: DataFrame, actual: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics over rows where both sides are present."""
    both = df.where(F.col(actual).isNotNull() & F.col(pred).isNotNull())
    return both.groupBy(*keys).agg(*metric_columns(actual, pred))


def metrics_by_group(df: DataFrame, actual: str, pred: str, group: str, min_n: int = 5,
                     digits: int | None = 2) -> DataFrame:
    """Per-group MAE/RMSE, groups with ``n >= min_n`` only, null group excluded."""
    both = df.where(F.col(actual).isNotNull() & F.col(pred).isNotNull() & F.col(group).isNotNull())
    err = F.col(actual) - F.col(pred)
    out = both.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"),
                                  F.sqrt(F.avg(err * err)).alias("rmse")).where(F.col("n") >= min_n)
    if digits is not None:
        out = out.withColumn("mae", F.bround("mae", digits)).withColumn("rmse", F.bround("rmse", digits))
    return out


def evaluation_report(df: DataFrame, actual: str, pred: str, group: str, start: str, end: str, min_n: int = 5) -> DataFrame:
    """One nested row: the period, overall metrics and metrics by category, rounded half-even."""
    overall = regression_metrics(df, actual, pred).select(F.struct(
        F.bround("mae", 3).alias("mae"), F.bround("rmse", 3).alias("rmse"), F.bround("r2", 4).alias("r2"), "n").alias("overall"))
    # a handful of categories
    by = metrics_by_group(df, actual, pred, group, min_n).agg(F.sort_array(F.collect_list(
        F.struct(F.col(group).alias("category"), "n", "mae", "rmse"))).alias("by_category"))
    period = F.struct(F.lit(start).alias("start"), F.lit(end).alias("end")).alias("period")
    return overall.join(F.broadcast(by)).select(period, "overall", "by_category")


def fold_summary(per_fold: DataFrame, metrics: Sequence[str] = ("mae", "rmse", "r2"),
                 digits: dict | None = None) -> DataFrame:
    """Mean and *population* std over folds, rounded half-even."""
    digits = digits or {"mae": 3, "rmse": 3, "r2": 4}
    cols = [F.count(F.lit(1)).alias("n_splits")]
    for m in metrics:
        d = digits.get(m, 3)
        cols.append(F.bround(F.avg(m), d).alias(f"{m}_mean"))
        cols.append(F.bround(F.stddev_pop(m), d).alias(f"{m}_std"))
    return per_fold.agg(*cols)


def describe(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99),
             keys: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """count, mean, std (sample), min, max and linear quantiles per column (A10).

    Quantiles are exact by default; ``accuracy`` switches to the bounded
    ``percentile_approx`` sketch (relative rank error about 1/accuracy).
    """
    from chronoframe.operators.quantiles import approx_quantiles
    long = to_long(df, cols, keys)
    moments = long.groupBy(*keys, "column").agg(
        F.count(F.lit(1)).alias("count"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"),
        F.min("_v").alias("min"), F.max("_v").alias("max"))
    if accuracy is None:
        q = quantiles_long(long, [*keys, "column"], probs)
    else:
        q = approx_quantiles(df, cols, probs, keys, accuracy)
    names = {p: f"p{int(round(p * 100)):02d}" for p in probs}
    wide = q.groupBy(*keys, "column").pivot("p", [float(p) for p in probs]).agg(F.first("value"))
    wide = wide.select(*keys, "column", *[F.col(f"`{float(p)}`").alias(names[p]) for p in probs])
    return join_keyed(moments, wide, [*keys, "column"], "left")


def confusion_counts(df: DataFrame, actual: str, pred: str, labels: Sequence[str],
                     names: Sequence[str] | None = None) -> DataFrame:
    """Confusion matrix: one row per present actual label, one column per fixed
    label, zeros filled (A11)."""
    names = list(names or labels)
    piv = (df.where(F.col(actual).isNotNull() & F.col(pred).isNotNull())
           .groupBy(F.col(actual).alias("actual")).pivot(pred, list(labels)).count())
    piv = piv.na.fill(0, subset=list(labels))
    return piv.select("actual", *[F.col(f"`{l}`").cast("bigint").alias(n) for l, n in zip(labels, names)])


def accuracy(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """Share of rows whose two labels agree."""
    both = df.where(F.col(actual).isNotNull() & F.col(pred).isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"),
                    F.avg((F.col(actual) == F.col(pred)).cast("double")).alias("accuracy"))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram over ``[min, max]`` with ``bins`` bins (A5).

    The one-row min/max is joined on a constant key (broadcast, one row).
    """
    x = df.where(F.col(col).isNotNull())
    rng = x.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi")).withColumn("_g", F.lit(0))
    j = x.withColumn("_g", F.lit(0)).join(F.broadcast(rng), "_g")
    raw = F.floor((F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1))).cast("int")
    out = j.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.first("_lo").alias("_lo"),
                                         F.first("_hi").alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    return out.select("bin", (F.col("_lo") + F.col("bin") * w).alias("bin_lo"),
                      (F.col("_lo") + (F.col("bin") + 1) * w).alias("bin_hi"), "count")


def box_stats(df: DataFrame, col: str, group: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (most extreme values inside the fences) and
    outlier count per group (A6).

    The rows are read once, into a table of distinct values with their counts;
    quartiles, fences, whiskers and outliers all come from that table.
    """
    counts = cut_lineage(value_counts(df.select(group, F.col(col).cast("double").alias("_v")), [group]))
    q = quantiles_from_counts(counts, [group], [0.25, 0.5, 0.75])
    wide = q.groupBy(group).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
                                  for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    wide = wide.withColumn("iqr", F.col("q3") - F.col("q1"))
    # one row per group; null is a group of its own
    j = join_keyed(counts, broadcast_few(cut_lineage(wide)), [group])
    inside = (F.col("_v") >= F.col("q1") - 1.5 * F.col("iqr")) & (F.col("_v") <= F.col("q3") + 1.5 * F.col("iqr"))
    return j.groupBy(group, "q1", "median", "q3", "iqr").agg(
        F.sum("_c").alias("n"), F.min(F.when(inside, F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_hi"), F.sum(F.when(inside, 0).otherwise(F.col("_c"))).alias("n_outliers"))


def daily_value_counts(df: DataFrame, cols: Sequence[str], time_col: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, ``day``, ``column``, ``_v``, ``_c``: how often each column has each value on each day.

    A table to be stored: days are independent, so a new day is added without
    reading others, and any range of days is described from it
    (:func:`describe_range`) as exactly as from the rows.
    """
    long = to_long(df.withColumn("day", F.to_date(time_col)), cols, [*keys, "day"])
    return value_counts(long, [*keys, "day", "column"])


def describe_range(stored: DataFrame, start: str, end: str, probs: Sequence[float] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99),
                   keys: Sequence[str] = ()) -> DataFrame:
    """:func:`describe` over the days ``[start, end)`` from a table of :func:`daily_value_counts`.

    The counts of the days are added up, so the work follows the number of
    distinct values, not of rows; quantiles are exact.
    """
    group = [*keys, "column"]
    days = stored.where((F.col("day") >= F.lit(start).cast("date")) & (F.col("day") < F.lit(end).cast("date")))
    counts = cut_lineage(days.groupBy(*group, "_v").agg(F.sum("_c").alias("_c")))
    sums = counts.groupBy(*group).agg(F.sum("_c").alias("count"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"),
                                      F.min("_v").alias("min"), F.max("_v").alias("max"))
    square = (F.col("_v") - F.col("mean")) * (F.col("_v") - F.col("mean")) * F.col("_c")
    spread = join_keyed(counts, sums, group).groupBy(*group).agg(F.sum(square).alias("_sq"))
    q = quantiles_from_counts(counts, group, probs).groupBy(*group).agg(
        *[F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(f"p{int(round(p * 100)):02d}") for p in probs])
    out = join_keyed(join_keyed(sums, spread, group), q, group)
    return out.withColumn("std", F.when(F.col("count") > 1, F.sqrt(F.col("_sq") / (F.col("count") - 1)))).drop("_sq")


def hour_profile(df: DataFrame, value_col: str, time_col: str = "time") -> DataFrame:
    """Mean by hour of day (A3)."""
    return df.groupBy(F.hour(time_col).alias("hour")).agg(F.avg(value_col).alias(f"{value_col}_mean"))


DOW_LABELS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def weekday_hour_pivot(df: DataFrame, value_col: str, time_col: str = "time") -> DataFrame:
    """Mean of ``value_col`` with weekday rows (Mon..Sun order key) and 24 hour columns (A4)."""
    base = df.select(weekday0(time_col).alias("dow_index"), F.date_format(time_col, "EEE").alias("dow"),
                     F.hour(time_col).alias("_h"), F.col(value_col))
    piv = base.groupBy("dow_index", "dow").pivot("_h", list(range(24))).agg(F.avg(value_col))
    return piv.select("dow_index", "dow", *[F.col(f"`{h}`").alias(f"h{h:02d}") for h in range(24)])
