"""As-of rows, per-series tails, top-k and sampling.

Per-series limits use ``row_number`` filters, which the planner turns into a
``WindowGroupLimit`` (each task keeps at most ``n`` rows per series before
the final window); global top-k uses ``orderBy().limit()``, planned as
``TakeOrderedAndProject`` (a bounded heap per task).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(df: DataFrame, now: str, time_col: str = "time") -> DataFrame:
    """Rows at or before ``now`` (P19); ``now`` is a parameter, never the clock."""
    return df.where(F.col(time_col) <= F.lit(now).cast("timestamp_ntz"))


def latest(df: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("time",)) -> DataFrame:
    """Newest row per series (L2).

    Keyed: ``max_by(struct, order)`` -- a partial aggregation that carries one
    row per series and task, so a hot series never gathers in one task.
    """
    keys, order = list(keys), list(order)
    other = [c for c in df.columns if c not in keys]
    ordkey = F.struct(*[F.col(o) for o in order])
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in other]), ordkey).alias("_row"))
    return agg.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in other])


def tail_n(df: DataFrame, n: int, keys: Sequence[str] = (), order: Sequence[str] = ("time",),
           rank_col: str | None = None) -> DataFrame:
    """Last ``n`` rows per series (L3).

    With keys: ``row_number`` desc <= n (WindowGroupLimit prunes per task).
    Without keys: a global top-n (``TakeOrderedAndProject``), bounded by n.
    """
    keys, order = list(keys), list(order)
    if not keys:
        out = df.orderBy(*[F.col(o).desc() for o in order]).limit(n)
    else:
        w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
        out = df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n).drop("_rk")
    return out


def head_n(df: DataFrame, n: int, order: Sequence[str] = ("time",), keys: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows (globally or per series)."""
    keys, order = list(keys), list(order)
    if not keys:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n).drop("_rk")


def top_k(df: DataFrame, k: int, by: Column | str, tie: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """Global top-k by ``by`` with explicit tie-breaks."""
    b = F.col(by) if isinstance(by, str) else by
    return df.orderBy(b.desc() if descending else b.asc(), *tie).limit(k)


def sample_key(seed: int, key_col: str) -> Column:
    """Deterministic pseudo-random sort key: md5 of ``seed:key`` (portable to any SQL engine)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key_col).cast("string")))


def seeded_sample(df: DataFrame, n: int, key_col: str, seed: int = 42) -> DataFrame:
    """Exact-size sample without replacement (L8): the ``n`` rows with the
    smallest hash of ``(seed, key)``.  Deterministic and engine independent;
    not the same rows numpy would draw."""
    return df.orderBy(sample_key(seed, key_col), key_col).limit(n)


def asof_many(rows: DataFrame, instants: DataFrame, keys: Sequence[str] = ("series_id",), time_col: str = "time",
              tie: Sequence[str] = (), strategy: str = "auto", chunk_rows: int | None = None) -> DataFrame:
    """For every row of ``instants`` the newest row of its series at or before it (P19, L2 at many instants).

    Rows and instants are merged in the order of time and the last row is
    carried forward, one sort per series for all instants; a hot series is cut
    into chunks and only the last row of each chunk is handed on.  Columns of
    ``rows`` come as the struct ``row`` (null where there is none yet); of rows
    at the same time the last by ``tie`` counts.  Null keys are keys, and an
    instant without a time has no row.
    """
    from chronoframe.operators.windows import DEFAULT_CHUNK_ROWS, ffill_unbounded
    keys = list(keys)
    tied = [f"_tie_{i}" for i in range(len(tie))]
    own = rows.where(F.col(time_col).isNotNull()).select(
        *keys, F.col(time_col).alias("_t"), F.lit(0).alias("_kind"), *[F.col(c).alias(n) for c, n in zip(tie, tied)],
        F.struct(*rows.columns).alias("row"))
    asked = instants.select(*keys, F.col(time_col).alias("_t"), F.lit(1).alias("_kind"), F.struct(*instants.columns).alias("_asked"))
    both = own.unionByName(asked.where(F.col("_t").isNotNull()), allowMissingColumns=True)
    carried = ffill_unbounded(both, ["row"], keys, ["_t", "_kind", *tied], strategy, chunk_rows or DEFAULT_CHUNK_ROWS)
    found = carried.where(F.col("_kind") == 1).select("_asked.*", "row")
    untimed = instants.where(F.col(time_col).isNull()).withColumn("row", F.lit(None).cast(found.schema["row"].dataType))
    return found.unionByName(untimed)
