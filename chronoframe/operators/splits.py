"""Temporal splits, slices, positional splits and expanding folds.

Positions come from :func:`chronoframe.operators.windows.with_ordinal`
(exact per-series ordinals from bucketed counts), so no split ever needs a
whole series in one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.operators.keyed import broadcast_few, join_keyed
from chronoframe.operators.windows import DEFAULT_CHUNK_ROWS, RangeBuckets, heavy_keys, with_ordinal
from chronoframe.session import cut_lineage


def _ts(v: str) -> Column:
    return F.lit(v).cast("timestamp_ntz")


def split_label(val_start: str, test_start: str, time_col: str = "time") -> Column:
    """Half-open train / val / test label."""
    t = F.col(time_col)
    return (F.when(t < _ts(val_start), "train").when(t < _ts(test_start), "val").otherwise("test"))


def temporal_split(df: DataFrame, val_start: str, test_start: str, time_col: str = "time",
                   name: str = "split") -> DataFrame:
    return df.withColumn(name, split_label(val_start, test_start, time_col))


def time_slice(df: DataFrame, start: str, end: str, end_inclusive: str = "instant",
               time_col: str = "time") -> DataFrame:
    """Closed slice (P3, F9).  ``instant``: ``time <= end`` at midnight (drops the
    rest of the last day, the reference's behaviour); ``day``: the whole last day."""
    t = F.col(time_col)
    lower = t >= _ts(start)
    if end_inclusive == "instant":
        return df.where(lower & (t <= _ts(end)))
    if end_inclusive == "day":
        return df.where(lower & (t < F.date_add(F.to_date(F.lit(end)), 1).cast("timestamp_ntz")))
    raise ValueError(end_inclusive)


def with_positions(df: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("time",),
                   bucket="auto", chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """0-based ``pos`` and series length ``n`` per row.

    ``row_number`` per series while every series has at most ``chunk_rows``
    rows (checked on a key-only count); otherwise exact ordinals from
    bucketed counts, the buckets cut where the rows of the series are, so a
    hot or bursty series never lands in one task; few series are joined with
    their lengths by broadcast.
    """
    keys, heavy = list(keys), False
    if heavy_keys(df, keys, chunk_rows).limit(1).count() == 0:
        o = df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    else:
        b = RangeBuckets(max(1, chunk_rows // 4)) if bucket == "auto" else bucket
        o, heavy = with_ordinal(df, keys, order, bucket=b, name="pos"), True
    n = o.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if keys:
        return join_keyed(o, broadcast_few(cut_lineage(n)) if heavy else n, keys)
    return o.withColumn("_g", F.lit(0)).join(F.broadcast(n.withColumn("_g", F.lit(0))), "_g").drop("_g")


def positional_split(df: DataFrame, frac: float = 0.8, keys: Sequence[str] = (),
                     order: Sequence[str] = ("time",), name: str = "split",
                     chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """First ``int(frac*n)`` rows of each series are train, the rest test."""
    p = with_positions(df, keys, order, chunk_rows=chunk_rows)
    cut = F.floor(F.col("n") * F.lit(frac))
    return p.withColumn(name, F.when(F.col("pos") < cut, "train").otherwise("test")).drop("pos", "n")


def fold_columns(n_splits: int = 5, gap: int = 24, pos: str = "pos", n: str = "n") -> tuple[Column, Column]:
    """First fold that trains on a row, and the fold that tests it (null if none), in closed form.

    A row that enters the training set stays in it for all later folds, so
    these two numbers say all that :func:`expanding_folds` says in up to
    ``n_splits`` rows.
    """
    k, p, m = n_splits, F.col(pos), F.col(n)
    ts = F.floor(m / (k + 1))
    since = F.when(ts > 0, F.greatest(F.lit(0), k + 1 - F.ceil((m - gap - p) / ts)))
    test = F.when((ts > 0) & (p >= m - k * ts), F.floor((p - (m - k * ts)) / ts))
    return since.cast("int"), test.cast("int")


def expanding_folds(df: DataFrame, n_splits: int = 5, gap: int = 24, keys: Sequence[str] = (),
                    order: Sequence[str] = ("time",), chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Expanding-window folds with a gap (W12), one output row per (row, fold, role).

    ``ts = n // (n_splits + 1)``; fold ``i`` tests ``[n-(k-i)ts, n-(k-i-1)ts)``
    and trains on ``[0, test_start - gap)``.  Each row is expanded to its
    ``n_splits`` candidate folds with ``explode(sequence(...))`` (a generator,
    not a join), then the role is decided per fold.
    """
    p = with_positions(df, keys, order, chunk_rows=chunk_rows)
    k = n_splits
    ts = F.floor(F.col("n") / (k + 1))
    f = F.col("fold")
    test_start = F.col("n") - (k - f) * ts
    test_end = test_start + ts
    role = (F.when((F.col("pos") >= test_start) & (F.col("pos") < test_end), "test")
            .when(F.col("pos") < test_start - gap, "train"))
    out = p.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("role", role)
    return out.where(F.col("role").isNotNull()).drop("pos", "n")


def union_splits(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag concatenation by column name."""
    return a.unionByName(b)
