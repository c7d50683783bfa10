"""Ordered per-series window operators.

Every operator is declared as a :class:`WinExpr` carrying how many rows it
looks back (``back``) and ahead (``fwd``).  :func:`window_features` evaluates
a list of *stages* (each stage a list of expressions that only read columns
produced by earlier stages) under one of two physical strategies:

``series``
    ``Window.partitionBy(keys).orderBy(order)``: one Exchange + Sort + one
    WindowExec for all expressions of a stage.  A task holds a whole series,
    so this is only safe when no series is large.

``auto`` (default)
    One key-only count finds the series longer than ``chunk_rows``.  There
    are at most ``N / chunk_rows`` of them; the planner broadcasts that key
    set only if it is small.  Light series run the ``series`` plan, heavy
    ones the ``halo`` plan, and the two results are unioned.  When no series
    is heavy the plan is exactly ``series``.

``halo``
    Skew-safe.  Exact per-series row ordinals are computed from per
    ``(keys, time bucket)`` counts (:func:`with_ordinal`); each series is cut
    into chunks of ``chunk_rows`` ordinals and the last ``H`` rows of a chunk
    (``H`` = sum of the stages' look-backs) are copied into the next chunk (and
    the first ``F`` rows into the previous one for leads).  Windows run per
    ``(keys, chunk)`` and only home rows are kept, so results equal the global
    window while no task holds more than ``chunk_rows + H + F`` rows, however
    large one series is.

Row lags count rows, not time (the reference's ``shift``); use
:func:`lag_time` or grid-fill first (:func:`chronoframe.sources.spine.gap_fill`)
for time-true lags.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.operators.keyed import broadcast_few, join_keyed
from chronoframe.session import cut_lineage

DEFAULT_CHUNK_ROWS = 1_000_000
#: Ranges smaller than a task is worth are made only while there are few of them.
FEW_RANGES, LEAST_RANGE_ROWS = 64, 100_000
#: Keys of heavy series, no rows of theirs, that are broadcast at most.
HEAVY_KEYS_SENT = 100_000
_EPOCH = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})"


@dataclass
class Ctx:
    """What an expression builder needs: the ordered window and the partition columns."""

    w: object                 # WindowSpec ordered by the series order
    parts: list[str]          # partition columns of that window
    order: list[Column]       # order expressions
    time_col: str             # first order column (timestamp-like)


@dataclass
class WinExpr:
    name: str
    build: Callable[[Ctx], Column]
    back: int = 0
    fwd: int = 0
    seconds: int = 0          # look-back in time instead of rows


# --------------------------------------------------------------------------- builders

def lag(col: str, n: int, name: str | None = None) -> WinExpr:
    """Value ``n`` rows earlier in the series."""
    return WinExpr(name or f"{col}_lag_{n}", lambda c: F.lag(col, n).over(c.w), back=n)


def lead(col: str, n: int, name: str | None = None) -> WinExpr:
    """Value ``n`` rows later in the series (W10, direct-horizon targets)."""
    return WinExpr(name or f"{col}_lead_{n}", lambda c: F.lead(col, n).over(c.w), fwd=n)


_AGGS = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
}


def rolling(col: str, n: int, agg: str = "mean", name: str | None = None,
            include_current: bool = True, min_periods: int = 1) -> WinExpr:
    """Trailing ``n``-row aggregate.

    ``include_current=True`` is the reference's frame (rows t-n+1..t, which
    leaks the target when ``col`` is the target, see the leakage audit);
    ``False`` uses rows t-n..t-1.  ``min_periods`` non-null observations are
    required, else null (``min_periods=n`` is the strict variant).
    """
    lo, hi = (-(n - 1), 0) if include_current else (-n, -1)
    fn = _AGGS[agg]

    def build(c: Ctx) -> Column:
        frame = c.w.rowsBetween(lo, hi)
        value = fn(col).over(frame)
        if min_periods <= 1:
            return value
        return F.when(F.count(col).over(frame) >= min_periods, value)

    return WinExpr(name or f"{col}_roll_{agg}_{n}", build, back=-lo)


def ffill(col: str, limit: int, name: str | None = None) -> WinExpr:
    """Forward fill at most ``limit`` consecutive nulls."""
    return WinExpr(name or col,
                   lambda c: F.last(col, ignorenulls=True).over(c.w.rowsBetween(-limit, 0)),
                   back=limit)


def lag_time(col: str, seconds: int, name: str | None = None) -> WinExpr:
    """Value exactly ``seconds`` earlier in *time* (null when that instant is absent)."""

    def build(c: Ctx) -> Column:
        epoch = F.expr(_EPOCH.format(c=f"`{c.time_col}`"))
        w = Window.partitionBy(*c.parts).orderBy(epoch).rangeBetween(-seconds, -seconds)
        return F.max(col).over(w)

    return WinExpr(name or f"{col}_tlag_{seconds}", build, seconds=seconds)


def rolling_time(col: str, seconds: int, agg: str = "mean", name: str | None = None) -> WinExpr:
    """Aggregate over the trailing time interval ``(t - seconds, t]`` (time-true twin of W5)."""
    fn = _AGGS[agg]

    def build(c: Ctx) -> Column:
        epoch = F.expr(_EPOCH.format(c=f"`{c.time_col}`"))
        w = Window.partitionBy(*c.parts).orderBy(epoch).rangeBetween(-(seconds - 1), 0)
        return fn(col).over(w)

    return WinExpr(name or f"{col}_troll_{agg}_{seconds}", build, seconds=seconds)


# --------------------------------------------------------------------------- ordinals

def _epoch_us(col: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")


def _bucket(col: str, bucket) -> Column:
    """Time bucket of ``col``: a ``date_trunc`` unit, or an integer width in
    microseconds (timestamps) / in the column's own units (numbers)."""
    if isinstance(bucket, str):
        return F.date_trunc(bucket, F.col(col))
    return F.floor(_epoch_us(col) / F.lit(int(bucket))).cast("bigint")


def bucket_width(df: DataFrame, keys: Sequence[str], order_col: str, target_rows: int) -> int:
    """Bucket width (microseconds) giving about ``target_rows`` rows per
    ``(series, bucket)`` for the densest series: one small aggregate collected
    as a single number.  Used for heavy series, whose hour buckets can
    themselves be too large for one task."""
    e = _epoch_us(order_col)
    per = df.groupBy(*keys).agg(((F.max(e) - F.min(e) + 1) * F.lit(float(target_rows))
                                 / F.count(F.lit(1))).alias("_w"))
    w = per.agg(F.min("_w")).first()[0]
    return max(1, int(w)) if w is not None else 3_600_000_000


@dataclass(frozen=True)
class RangeBuckets:
    """Buckets of about ``rows`` rows each, cut where the rows of a series are, however unevenly they lie in time.

    A bucket is a task: more than ``FEW_RANGES`` are made only while each has
    ``LEAST_RANGE_ROWS`` rows, so small ``rows`` never mean a task for every few rows.
    ``fan`` is kept for callers that name it; one range shuffle needs no levels.
    ``of`` is the number of rows in all if it is known; otherwise they are counted.
    """

    rows: int
    fan: int = 64
    of: int | None = None


def _range_buckets(df: DataFrame, keys: list[str], order: str | Sequence[str], cut: RangeBuckets, name: str) -> DataFrame:
    """Add bucket ``name``, rising with ``order`` inside a series.

    All rows are dealt by range of ``keys`` and ``order`` and written once with
    the number of their range, so bursts, gaps and few long series make no
    difference; only rows equal in all these columns stay together.
    """
    order = [order] if isinstance(order, str) else list(order)
    rows = df.count() if cut.of is None else cut.of
    pieces = max(1, min(-(-rows // cut.rows), max(FEW_RANGES, -(-rows // LEAST_RANGE_ROWS))))
    return cut_lineage(df.repartitionByRange(pieces, *keys, *order).withColumn(name, F.spark_partition_id().cast("bigint")))


def with_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 bucket="hour", name: str = "_rn") -> DataFrame:
    """Add the exact 0-based row position of each row inside its series.

    Rows are counted per ``(keys, date_trunc(bucket, order[0]))``; a running
    sum over that small count table gives each bucket's offset, and a
    ``row_number`` inside the bucket finishes the ordinal.  No task ever sees
    more than one bucket of one series, so a hot series is split by time.
    :class:`RangeBuckets` are ranges of the rows themselves instead; there only
    the series that go on over the edge of a range have offsets to be joined.
    ``order`` must be a total order (end it with a unique key).
    """
    keys, order = list(keys), list(order)
    tb = "_tb"
    ranged = isinstance(bucket, RangeBuckets)
    if ranged:
        based = _range_buckets(df, keys, order, bucket, tb)
    else:
        based = df.withColumn(tb, _bucket(order[0], bucket))
    counts = based.groupBy(*keys, tb).agg(F.count(F.lit(1)).alias("_cnt"))
    wk = Window.partitionBy(*keys).orderBy(tb).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_ok_{i}") for i, k in enumerate(keys)],
                            F.col(tb).alias("_otb"),
                            F.coalesce(F.sum("_cnt").over(wk), F.lit(0)).alias("_off"))
    if ranged:
        # only the first series of a range can have begun before it: no more rows than ranges
        offsets = broadcast_few(cut_lineage(offsets.where(F.col("_off") > 0)))
    cond = [based[k].eqNullSafe(offsets[f"_ok_{i}"]) for i, k in enumerate(keys)]
    cond.append(based[tb].eqNullSafe(offsets["_otb"]))
    joined = based.join(offsets, on=cond, how="left" if ranged else "inner")
    w = Window.partitionBy(*keys, tb).orderBy(*order)
    out = joined.withColumn(name, F.coalesce("_off", F.lit(0)) + F.row_number().over(w) - 1)
    return out.drop(*[f"_ok_{i}" for i in range(len(keys))], "_otb", "_off", tb)


# --------------------------------------------------------------------------- executor

def _as_stages(stages) -> list[list[WinExpr]]:
    if stages and isinstance(stages[0], WinExpr):
        return [list(stages)]
    return [list(s) for s in stages]


def heavy_keys(df: DataFrame, keys: Sequence[str], chunk_rows: int) -> DataFrame:
    """Series with more than ``chunk_rows`` rows (at most ``N / chunk_rows`` of them)."""
    return _heavy_counts(df, keys, chunk_rows).select(*keys)


def _heavy_counts(df: DataFrame, keys: Sequence[str], chunk_rows: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk_rows)


def window_features(df: DataFrame, stages, keys: Sequence[str] = ("series_id",),
                    order: Sequence[str] = ("time",), strategy: str = "auto",
                    chunk_rows: int = DEFAULT_CHUNK_ROWS, bucket="auto") -> DataFrame:
    """Evaluate window expressions stage by stage; see the module docstring.

    ``bucket`` is the ordinal bucket (see :func:`with_ordinal`); ``"auto"``
    cuts heavy series where their rows are, so a bucket holds about
    ``chunk_rows / 4`` rows, or more if that made too many buckets, see
    :class:`RangeBuckets` (``"hour"`` when the halo plan is forced).
    """
    stages = _as_stages(stages)
    keys, order = list(keys), list(order)
    order_cols = [F.col(o) for o in order]
    if strategy == "auto":
        heavy = heavy_keys(df, keys, chunk_rows)
        # size check (an action on the key-only count): decides the physical plan
        if heavy.limit(1).count() == 0:
            return window_features(df, stages, keys, order, "series", chunk_rows, bucket)
        if not keys:
            hb = RangeBuckets(max(1, chunk_rows // 4)) if bucket == "auto" else bucket
            return window_features(df, stages, keys, order, "halo", chunk_rows, hb)
        # counted once more and written: the rows meet the heavy keys in several passes
        counted = cut_lineage(_heavy_counts(df, keys, chunk_rows))
        hk = broadcast_few(counted.select(*[F.col(k).alias(f"_hk_{i}") for i, k in enumerate(keys)]), HEAVY_KEYS_SENT)
        cond = [df[k].eqNullSafe(hk[f"_hk_{i}"]) for i, k in enumerate(keys)]
        light_rows = df.join(hk, on=cond, how="left_anti")
        heavy_rows = df.join(hk, on=cond, how="left_semi")
        light = window_features(light_rows, stages, keys, order, "series", chunk_rows, bucket)
        hb = RangeBuckets(max(1, chunk_rows // 4), of=counted.agg(F.sum("_n")).first()[0]) if bucket == "auto" else bucket
        heavy_out = window_features(heavy_rows, stages, keys, order, "halo", chunk_rows, hb)
        return light.unionByName(heavy_out)
    if strategy == "series":
        w = Window.partitionBy(*keys).orderBy(*order_cols)
        ctx = Ctx(w, keys, order_cols, order[0])
        out = df
        for st in stages:
            out = out.withColumns({e.name: e.build(ctx) for e in st})
        return out
    if strategy != "halo":
        raise ValueError(f"unknown strategy {strategy!r}")
    if bucket == "auto":
        bucket = "hour"

    if any(e.seconds for st in stages for e in st):
        # row and time look-backs need different chunks: stage by stage, each kind by itself;
        # all expressions of a stage read the columns as they were before it
        out = df
        for st in stages:
            timed = [e for e in st if e.seconds]
            named = [WinExpr(f"_timed_{i}", e.build, seconds=e.seconds) for i, e in enumerate(timed)]
            if named:
                out = _time_features(out, named, keys, order, chunk_rows)
            if len(timed) < len(st):
                out = window_features(out, [[e for e in st if not e.seconds]], keys, order, "halo", chunk_rows, bucket)
            out = out.withColumns({e.name: F.col(n.name) for e, n in zip(timed, named)}).drop(*[n.name for n in named])
        return out
    back = sum(max([e.back for e in st] or [0]) for st in stages)
    fwd = sum(max([e.fwd for e in st] or [0]) for st in stages)
    if chunk_rows <= back + fwd:
        raise ValueError("chunk_rows must exceed the total look-back plus look-ahead")
    based = with_ordinal(df, keys, order, bucket=bucket)
    rn = F.col("_rn")
    home = F.floor(rn / chunk_rows)
    pos = rn - home * chunk_rows
    # a row serves its own chunk and at most one beside it; no chunk lies before the first
    first = F.when((pos < fwd) & (home > 0), home - 1).otherwise(home)
    last = F.when(pos >= chunk_rows - back, home + 1).otherwise(home)
    parts = based.withColumn("_home", home).withColumn("_part", F.explode(F.sequence(first, last)))
    pkeys = keys + ["_part"]
    w = Window.partitionBy(*pkeys).orderBy("_rn")
    ctx = Ctx(w, pkeys, [rn], order[0])
    out = parts
    for st in stages:
        out = out.withColumns({e.name: e.build(ctx) for e in st})
    return out.where(F.col("_part") == F.col("_home")).drop("_rn", "_home", "_part")


def time_chunks(df: DataFrame, span: int, keys: Sequence[str], time_col: str, chunk_rows: int) -> DataFrame:
    """Rows with a time, dealt to chunks: ``_home`` is a row's own chunk, ``_part`` the chunk that this copy serves.

    Time is laid out in cells of ``span`` seconds.  A running sum over the
    counted cells joins neighbours into chunks of about half of ``chunk_rows``
    rows, so bursts and gaps make no difference; a chunk is one cell at least.
    A row reaches into the next cell at most, so the last cell before a chunk
    is all the halo there is.
    """
    keys = list(keys)
    epoch = F.expr(_EPOCH.format(c=f"`{time_col}`"))
    dated = df.where(F.col(time_col).isNotNull()).withColumn("_cell", F.floor(epoch / F.lit(span)).cast("bigint"))
    in_order = Window.partitionBy(*keys).orderBy("_cell")
    before = F.coalesce(F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = dated.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    chunked = counted.withColumn("_home", F.floor(before / F.lit(max(1, chunk_rows // 2))).cast("bigint"))
    following = F.lead("_home").over(in_order)
    beside = F.lead("_cell").over(in_order) == F.col("_cell") + 1
    cells = chunked.withColumn("_next", F.when(beside & (following != F.col("_home")), following)).drop("_n")
    return join_keyed(dated, cells, [*keys, "_cell"]).withColumn(
        "_part", F.explode(F.array_compact(F.array("_home", "_next")))).drop("_cell", "_next")


def _time_features(df: DataFrame, exprs: list[WinExpr], keys: list[str], order: list[str], chunk_rows: int) -> DataFrame:
    """Time look-backs of long series: windows per ``(keys, time chunk)``."""
    parts = time_chunks(df, max(e.seconds for e in exprs) + 1, keys, order[0], chunk_rows)
    pkeys = keys + ["_part"]
    ctx = Ctx(Window.partitionBy(*pkeys).orderBy(*order), pkeys, [F.col(o) for o in order], order[0])
    out = parts.withColumns({e.name: e.build(ctx) for e in exprs})
    # rows without a time belong to no chunk
    return out.where(F.col("_part") == F.col("_home")).drop("_home", "_part").unionByName(
        df.where(F.col(order[0]).isNull()).withColumns({e.name: F.lit(None).cast(out.schema[e.name].dataType) for e in exprs}))


# --------------------------------------------------------------------------- unbounded fill

def ffill_unbounded(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("series_id",),
                    order: Sequence[str] = ("time",), strategy: str = "auto",
                    chunk_rows: int = DEFAULT_CHUNK_ROWS, bucket="auto") -> DataFrame:
    """Forward fill without limit.

    ``auto`` picks ``series`` unless a series is longer than ``chunk_rows``.
    ``series``: ``last(ignorenulls)`` over ``unboundedPreceding``.  ``halo``:
    fill inside fixed row chunks, then carry each chunk's last non-null value
    forward through a small per-chunk table, so no task holds a whole series.
    """
    keys, order = list(keys), list(order)
    if strategy == "auto":
        # same key-only size check as window_features: plain window unless a series is heavy
        light = heavy_keys(df, keys, chunk_rows).limit(1).count() == 0
        strategy = "series" if light else "halo"
    if strategy == "series":
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    based = with_ordinal(df, keys, order, bucket=RangeBuckets(max(1, chunk_rows // 4)) if bucket == "auto" else bucket)
    based = based.withColumn("_chunk", F.floor(F.col("_rn") / chunk_rows))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    filled = based.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    # per chunk: last non-null value of each column (small table: one row per chunk)
    tails = based.groupBy(*keys, "_chunk").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_rn"))).alias(f"_t_{c}") for c in cols])
    wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*[F.col(k).alias(f"_ck_{i}") for i, k in enumerate(keys)],
                         F.col("_chunk").alias("_cchunk"),
                         *[F.last(f"_t_{c}", ignorenulls=True).over(wc).alias(f"_carry_{c}") for c in cols])
    cond = [filled[k].eqNullSafe(carry[f"_ck_{i}"]) for i, k in enumerate(keys)]
    cond.append(filled["_chunk"] == carry["_cchunk"])
    out = filled.join(carry, on=cond, how="left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_carry_{c}")) for c in cols})
    return out.drop(*[f"_ck_{i}" for i in range(len(keys))], "_cchunk", "_chunk", "_rn",
                    *[f"_carry_{c}" for c in cols])
