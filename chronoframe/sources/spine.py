"""Regular time spines and gap filling."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.operators import windows as W
from chronoframe.operators.keyed import join_keyed

_ORIGIN = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def time_spine_between(bounds: DataFrame, start_col: str, end_col: str, step: str = "1 hour",
                       name: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """Explode ``[start, end]`` by ``step`` for every row of ``bounds``.

    One row of ``bounds`` per series keeps the spine generation distributed
    across series (a spine per series, not one global array).
    """
    seq = F.sequence(F.col(start_col), F.col(end_col), F.expr(f"INTERVAL {step}"))
    return bounds.select(*keys, F.explode(seq).alias(name))


def data_spine(df: DataFrame, time_col: str = "time", step: str = "1 hour",
               keys: Sequence[str] = ()) -> DataFrame:
    """Spine from each series' first to last timestamp."""
    b = df.groupBy(*keys).agg(F.min(time_col).alias("_s"), F.max(time_col).alias("_e"))
    return time_spine_between(b, "_s", "_e", step, time_col, keys)


#: Longest array that one row explodes into while gaps are filled.
GAP_ROWS = 4096


def _missing(rows: DataFrame, keys: list[str], at: str, chunk_rows: int) -> DataFrame:
    """``keys`` and the whole numbers between neighbours of column ``at`` that no row of the series has.

    Every row explodes the gap behind itself only, long gaps in two steps, so
    no array grows with the length of a series.
    """
    ahead = W.window_features(rows.select(*keys, at).distinct(), [W.lead(at, 1, "_next")], keys=keys, order=[at], chunk_rows=chunk_rows)
    gaps = ahead.where(F.col("_next") > F.col(at) + 1).select(
        *keys, (F.col(at) + 1).alias("_from"), "_next",
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_next - `{at}` - 2) div {GAP_ROWS}"))).alias("_piece"))
    first = F.col("_from") + F.col("_piece") * GAP_ROWS
    return gaps.select(*keys, F.explode(F.sequence(first, F.least(first + GAP_ROWS - 1, F.col("_next") - 1))).alias(at))


def gap_fill(df: DataFrame, time_col: str = "time", step: str = "1 hour", keys: Sequence[str] = (),
             chunk_rows: int = W.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """The rows of each series on its regular grid, and a row for every missing instant; ``is_filled`` marks those (S4 + J4).

    The grid starts at the first instant of the series and has the fixed length
    ``step``; rows off the grid or without a time are left out, repeated rows
    stay.  Null keys are keys like others.
    """
    keys = list(keys)
    width = F.expr(f"timestampdiff(MICROSECOND, {_ORIGIN}, {_ORIGIN} + INTERVAL {step})")
    micros = F.expr(f"timestampdiff(MICROSECOND, {_ORIGIN}, `{time_col}`)")
    start = df.groupBy(*keys).agg(F.min(micros).alias("_s"))
    timed = df.where(F.col(time_col).isNotNull())
    if keys:
        placed = join_keyed(timed, start, keys)
    else:
        placed = timed.join(F.broadcast(start))  # one row
    offset = micros - F.col("_s")
    grid = placed.withColumn("_at", F.floor(offset / width).cast("long")).where(offset % width == 0)
    filled = _missing(grid, keys, "_at", chunk_rows)
    back = join_keyed(filled, start, keys) if keys else filled.join(F.broadcast(start))
    time = F.expr(f"timestampadd(MICROSECOND, _add, {_ORIGIN})")
    new = back.withColumn("_add", F.col("_s") + F.col("_at") * width).select(*keys, time.alias(time_col), F.lit(1).alias("is_filled"))
    out = grid.drop("_s", "_at").withColumn("is_filled", F.lit(0))
    return out.unionByName(new, allowMissingColumns=True).select(*keys, time_col, *[c for c in df.columns if c not in (time_col, *keys)], "is_filled")


def daily_mean(df: DataFrame, value_col: str, time_col: str = "time", keys: Sequence[str] = (), name: str | None = None,
               chunk_rows: int = W.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Daily mean with every day between a series' first and last one: empty days are null (A2)."""
    name, keys = name or f"{value_col}_daily_mean", list(keys)
    day = F.datediff(F.to_date(time_col), F.lit("1970-01-01").cast("date")).cast("long")
    means = df.where(F.col(time_col).isNotNull()).groupBy(*keys, day.alias("_day")).agg(F.avg(value_col).alias(name))
    every = means.unionByName(_missing(means, keys, "_day", chunk_rows), allowMissingColumns=True)
    return every.select(*keys, F.date_add(F.lit("1970-01-01").cast("date"), F.col("_day").cast("int")).alias("date"), name)
