"""Equi-joins on keys that may be null: null matches null, as in ``groupBy`` and windows."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_keyed(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
               where: Column | None = None) -> DataFrame:
    """Join on ``keys`` with ``<=>``; the key columns come from ``left``.  ``where`` may name columns of both."""
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    renamed = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    cond = where if where is not None else F.lit(True)
    for k, r in names.items():
        cond = cond & left[k].eqNullSafe(renamed[r])
    out = left.join(renamed, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())


def broadcast_few(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (an action counts them).

    A table with a row for each of a few keys then never deals the many rows of
    the other side to one task per key.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
