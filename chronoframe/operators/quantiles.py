"""Exact linear-interpolation quantiles without gathering a group in one task.

Spark's exact ``percentile``/``median`` merge every distinct value of a
group into one aggregation buffer, so one hot group (or a global median)
lands whole in one task.  Here:

* when every group has at most ``small_group_rows`` values (checked on the
  per-group count table) Spark's exact ``percentile`` aggregate is used -- its
  per-group buffer is then bounded;
* otherwise the distinct values are counted, dealt by range into pieces of
  bounded size (one range shuffle, whatever the number of groups) and counted
  per piece; each wanted rank is located in its piece, and only that piece's
  rows are ranked -- recursively if a piece is still large (an action on the
  small count table decides whether another level is needed).

Quantiles follow pandas/``percentile_cont``: ``pos = p*(n-1)``, linear
interpolation between the neighbouring order statistics.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.operators.keyed import broadcast_few, join_keyed
from chronoframe.session import cut_lineage


def to_long(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (),
            name_col: str = "column", value_col: str = "_v") -> DataFrame:
    """Unpivot numeric ``cols`` to ``(keys, column, _v)`` dropping nulls."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(keys), list(cols), name_col, value_col)
    return long.where(F.col(value_col).isNotNull() & ~F.isnan(value_col))


def _ranked(values: DataFrame, groups: list[str], ranks: DataFrame) -> DataFrame:
    """Each wanted rank falls into the run of equal values whose running count passes it."""
    w = Window.partitionBy(*groups).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = values.select(*groups, "_v", "_c", F.sum("_c").over(w).alias("_hi"))
    hit = (F.col("_r") >= F.col("_hi") - F.col("_c")) & (F.col("_r") < F.col("_hi"))
    return join_keyed(runs, ranks, groups, where=hit).select(*groups, "_r", F.col("_v").alias("_val"))


def _values_at_ranks(values: DataFrame, groups: list[str], ranks: DataFrame,
                     small: int, buckets: int, depth: int) -> DataFrame:
    """``ranks(groups, _r)`` -> ``(groups, _r, _val)`` with the ``_r``-th smallest value.

    ``values``: distinct ``_v`` of each group with their count ``_c``, so a value
    that fills most of a group is one row.  While a group has more than ``small``
    of them, all are dealt by range of ``(groups, _v)`` into pieces of about
    ``small / 2`` rows, at most ``buckets`` a group on average: as many tasks as
    the rows ask for, however few the groups.  The largest group falls by
    ``buckets`` a level, so the depth is ``log(distinct / small, buckets)``.
    """
    size = values.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.max("_n").alias("most"), F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("groups")).first()
    if (size["most"] or 0) <= small:
        return _ranked(values, groups, ranks)
    bn = f"_b{depth}"
    pieces = max(2, min(buckets * size["groups"], -(-size["rows"] // max(1, small // 2))))
    # written once: the ranges come from a sample, and rows meet them in two places of the plan
    dealt = cut_lineage(values.repartitionByRange(pieces, *groups, "_v").withColumn(bn, F.spark_partition_id()))
    bc = dealt.groupBy(*groups, bn).agg(F.sum("_c").alias("_bn"))
    wo = Window.partitionBy(*groups).orderBy(bn).rowsBetween(Window.unboundedPreceding, -1)
    bc = bc.withColumn("_lo", F.coalesce(F.sum("_bn").over(wo), F.lit(0)))
    # each wanted rank -> its piece (few ranks, and together no more rows than groups and pieces)
    located = (join_keyed(ranks, bc, groups, where=(F.col("_r") >= F.col("_lo")) & (F.col("_r") < F.col("_lo") + F.col("_bn")))
               .select(*groups, bn, "_r", (F.col("_r") - F.col("_lo")).alias("_rr")))
    located = cut_lineage(located)
    # only the values of the located pieces go one level down; lineage is cut so
    # plans stay flat however deep the refinement goes
    sub = cut_lineage(join_keyed(dealt, broadcast_few(located.select(*groups, bn).distinct()), [*groups, bn], "left_semi"))
    sub_ranks = located.select(*groups, bn, F.col("_rr").alias("_r")).distinct()
    inner = _values_at_ranks(sub, [*groups, bn], sub_ranks, small, buckets, depth + 1)
    return (join_keyed(located, inner.withColumnRenamed("_r", "_rr"), [*groups, bn, "_rr"])
            .select(*groups, "_r", "_val"))


def quantiles_long(long: DataFrame, groups: Sequence[str], probs: Sequence[float],
                   small_group_rows: int = 2_000_000, buckets: int = 1024) -> DataFrame:
    """Exact quantiles of ``_v`` per ``groups`` -> ``(groups, p, value)``."""
    groups = list(groups)
    cnt = long.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    # size check: when every group is bounded, the exact ``percentile`` aggregate
    # (one bounded buffer per group, object-hash aggregation with sort fallback)
    # is the cheapest exact plan
    if cnt.where(F.col("_n") > small_group_rows).limit(1).count() == 0:
        pl = [float(p) for p in probs]
        agg = long.groupBy(*groups).agg(F.percentile("_v", F.array(*[F.lit(p) for p in pl])).alias("_q"))
        return agg.select(*groups, F.posexplode("_q").alias("_i", "value")).select(
            *groups, F.element_at(F.array(*[F.lit(p) for p in pl]), F.col("_i") + 1).alias("p"), "value")
    return quantiles_from_counts(cut_lineage(value_counts(long, groups)), groups, probs, small_group_rows, buckets)


def value_counts(long: DataFrame, groups: Sequence[str], value_col: str = "_v") -> DataFrame:
    """Distinct values of each group with their counts (``_v``, ``_c``); nulls and NaN are left out."""
    rows = long.where(F.col(value_col).isNotNull() & ~F.isnan(value_col))
    return rows.groupBy(*groups, F.col(value_col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))


def quantiles_from_counts(values: DataFrame, groups: Sequence[str], probs: Sequence[float],
                          small_group_rows: int = 2_000_000, buckets: int = 1024) -> DataFrame:
    """Exact quantiles per ``groups`` from their distinct values ``_v`` and counts ``_c`` -> ``(groups, p, value)``."""
    groups = list(groups)
    cnt = values.groupBy(*groups).agg(F.sum("_c").alias("_n"))
    pa = F.array(*[F.lit(float(p)) for p in probs])
    tg = (cnt.select(*groups, "_n", F.explode(pa).alias("p"))
          .withColumn("_pos", F.col("p") * (F.col("_n") - 1))
          .withColumn("_rlo", F.floor("_pos").cast("bigint"))
          .withColumn("_rhi", F.ceil("_pos").cast("bigint"))
          .withColumn("_frac", F.col("_pos") - F.col("_rlo")))
    ranks = (tg.select(*groups, F.explode(F.array("_rlo", "_rhi")).alias("_r")).distinct())
    vals = _values_at_ranks(values, groups, ranks, small_group_rows, buckets, 0)
    lo = vals.withColumnRenamed("_r", "_rlo").withColumnRenamed("_val", "_vlo")
    hi = vals.withColumnRenamed("_r", "_rhi").withColumnRenamed("_val", "_vhi")
    out = join_keyed(join_keyed(tg, lo, [*groups, "_rlo"]), hi, [*groups, "_rhi"])
    value = F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")
    return out.select(*groups, "p", value.alias("value"))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    keys: Sequence[str] = (), small_group_rows: int = 2_000_000,
                    buckets: int = 1024) -> DataFrame:
    """Exact quantiles of several columns -> ``(keys, column, p, value)``."""
    long = to_long(df, cols, keys)
    return quantiles_long(long, [*keys, "column"], probs, small_group_rows, buckets)


def medians_wide(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (),
                 suffix: str = "__median", **kw) -> DataFrame:
    """One row per ``keys`` with the exact median of every column."""
    q = exact_quantiles(df, cols, [0.5], keys, **kw)
    wide = q.groupBy(*keys).pivot("column", list(cols)).agg(F.first("value"))
    return wide.select(*keys, *[F.col(c).alias(c + suffix) for c in cols])


def approx_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     keys: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """``percentile_approx`` twin with bounded sketches -> ``(keys, column, p, value)``."""
    long = to_long(df, cols, keys)
    arr = long.groupBy(*keys, "column").agg(
        F.percentile_approx("_v", [float(p) for p in probs], accuracy).alias("_q"))
    return arr.select(*keys, "column", F.posexplode("_q").alias("_i", "value")).withColumn(
        "p", F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1)).drop("_i")
