"""Live nowcast job (T1): a stream of new readings scored per micro-batch.

``lag().over()`` is not allowed on a stream, so every series keeps its last
``history_rows`` + 1 rows in keyed state (:func:`series_frames`): new rows are
merged into that buffer by time, a late row takes its place between older ones,
a row that comes again replaces the stored one, and the buffer is all that a
batch's features can depend on.  Each micro-batch's buffers go through the batch
feature function, the newest row per series is scored, and predictions go to
the history table of :mod:`chronoframe.sources.history`.

Nothing is read back from storage.  The state is versioned with the stream's
checkpoint, so a replayed batch starts from the state it had, and its
predictions replace those it wrote before.  A timer drops the buffer of a
series that the stream's clock has left behind by ``idle``.

:func:`nowcast_batch` gives the same rows for one batch from a stored history.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoframe.functions.categories import category_continuous, confidence_band
from chronoframe.operators import ranking as R
from chronoframe.operators.keyed import join_keyed
from chronoframe.sources.history import write_batch
from chronoframe.streaming.rollup import ntz_to_instant

# rows of look-back: the longest lag (72) and 3 rows of forward fill on top of it
HISTORY_ROWS = 75


def _with_history(batch: DataFrame, history: DataFrame, keys: list[str], time_col: str, rows: int) -> DataFrame:
    """Stored rows that the batch's features can depend on.

    Lags count rows, so for each series these are the last ``rows`` before the
    batch's earliest reading, however old, and all later ones: a late reading
    stands between stored rows.  A stored row that the batch brings again
    gives way to the batch's.
    """
    bounds = batch.groupBy(*keys).agg(F.min(time_col).alias("_lo"))
    past = join_keyed(history, bounds, keys)
    older = past.where(F.col(time_col) < F.col("_lo")).withColumn(
        "_i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time_col))))
    kept = older.where(F.col("_i") <= rows).drop("_i").unionByName(past.where(F.col(time_col) >= F.col("_lo"))).drop("_lo")
    return join_keyed(kept, batch.select(*keys, time_col).distinct(), [*keys, time_col], "left_anti")


def nowcast_batch(batch: DataFrame, history: DataFrame, features: Callable[[DataFrame], DataFrame],
                  predict: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ("series_id",),
                  time_col: str = "time", history_rows: int = HISTORY_ROWS, guess_hours: int = 24 * 14) -> DataFrame:
    """Score the newest row of every series present in ``batch``.

    History is first read from ``guess_hours`` before the earliest reading on,
    a bound that reaches the file scan.  Only if a series has fewer than
    ``history_rows`` rows there is its history read without a bound; the
    result is the same either way.
    """
    keys = list(keys)
    earliest = batch.agg(F.min(time_col)).first()[0]
    if earliest is None:
        near = history.limit(0)
    else:
        lo = F.lit(earliest.isoformat(sep=" ")).cast("timestamp_ntz")  # zone-free literal
        near = history.where(F.col(time_col) >= lo - F.expr(f"INTERVAL {guess_hours} HOURS"))
        have = join_keyed(batch.groupBy(*keys).agg(F.min(time_col).alias("_lo")), near.select(*keys, time_col), keys, "left",
                          where=F.col(time_col) < F.col("_lo")).groupBy(*keys).agg(F.count(time_col).alias("_n"))
        if not have.where(F.col("_n") < history_rows).isEmpty():
            near = history
    frame = _with_history(batch, near, keys, time_col, history_rows).unionByName(batch, allowMissingColumns=True)
    newest = R.latest(features(frame), keys, [time_col])
    return predict(newest)


def persistence_predictor(target: str = "us_aqi") -> Callable[[DataFrame], DataFrame]:
    """Fallback predictor: the newest reading itself, as an integer with its band."""
    def predict(df: DataFrame) -> DataFrame:
        p = F.bround(F.col(target), 0).cast("bigint")
        lo, hi = confidence_band(p)
        return df.select(*[c for c in df.columns if c in ("series_id",)], F.col("time").alias("timestamp"),
                         p.alias("forecast_aqi"), category_continuous(p).alias("category"),
                         lo.alias("confidence_lower"), hi.alias("confidence_upper"))
    return predict


def _merged(rows: pa.Table, time_col: str, keep: int) -> pa.Table:
    """The last ``keep`` rows by time, one per instant; of equal instants the last one in the table stays."""
    rows = rows.filter(rows.column(time_col).is_valid())
    order = rows.append_column("_at", pa.array(range(rows.num_rows), pa.int64()))
    last = order.select([time_col, "_at"]).group_by(time_col).aggregate([("_at", "max")]).sort_by(time_col)
    return rows.take(last.slice(max(0, last.num_rows - keep)).column("_at_max"))


def series_frames(stream: DataFrame, keys: Sequence[str] = ("series_id",), time_col: str = "time", history_rows: int = HISTORY_ROWS,
                  idle: str | None = None) -> DataFrame:
    """For every series of a micro-batch, its last ``history_rows`` + 1 rows with the new ones merged in.

    ``stream`` holds one row per series and instant; rows of several sources
    (a backfill and a live feed, say) may be united before.  A group's rows
    come in chunks, and only the buffer is held between them.  With ``idle``
    (an interval of event time, also the stream's watermark) a buffer whose
    newest row falls behind by more is dropped, and so are rows that come later
    than that; without it buffers stay and no row is too late.
    """
    keys, schema, keep = list(keys), stream.schema, history_rows + 1
    arrow = to_arrow_schema(schema)

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else arrow.empty_table()
        for chunk in chunks:
            # rows of equal instants in a chunk: the greatest in all columns stays
            new = pa.Table.from_pandas(chunk[arrow.names], schema=arrow, preserve_index=False)
            new = new.sort_by([(c, "ascending") for c in [time_col, *[n for n in arrow.names if n != time_col]]])
            rows = _merged(pa.concat_tables([rows, new]), time_col, keep)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, arrow) as writer:
            writer.write_table(rows)
        state.update((sink.getvalue().to_pybytes(),))
        if idle is not None and rows.num_rows:
            newest = pd.Timestamp(rows.column(time_col)[-1].as_py())
            state.setTimeoutTimestamp(max(int(newest.value // 1_000_000), state.getCurrentWatermarkMs()) + 1)
        yield rows.to_pandas()

    wait = GroupStateTimeout.NoTimeout
    if idle is not None:
        wait = GroupStateTimeout.EventTimeTimeout
        stream = stream.withColumn("_et", ntz_to_instant(time_col)).withWatermark("_et", idle)
    return stream.groupBy(*keys).applyInPandasWithState(update, schema, "buffer binary", "append", wait)


def start_nowcast(spark: SparkSession, stream: DataFrame, sink_path: str, checkpoint: str, features: Callable[[DataFrame], DataFrame],
                  predict: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ("series_id",), time_col: str = "time",
                  history_rows: int = HISTORY_ROWS, idle: str | None = None, predicted_time: str = "timestamp",
                  available_now: bool = True) -> StreamingQuery:
    """Wire the stream: buffers in keyed state, features and prediction per micro-batch, predictions into the history at ``sink_path``."""

    def handle(frames: DataFrame, batch_id: int) -> None:
        frames = frames.persist()  # the state is read once, whatever the features do
        try:
            if not frames.isEmpty():
                newest = R.latest(features(frames), keys, [time_col])
                write_batch(predict(newest), sink_path, batch_id, predicted_time)
        finally:
            frames.unpersist()

    frames = series_frames(stream, keys, time_col, history_rows, idle)
    w = frames.writeStream.foreachBatch(handle).outputMode("append").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
