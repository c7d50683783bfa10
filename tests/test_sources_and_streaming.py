"""Sources, sinks, payloads and the streaming jobs."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe.sources import feeds, payload
from chronoframe.streaming import nowcast, rollup
from tests.conftest import SF001, tmpdir_new


def test_payload_round_trip_with_nulls(spark):
    rows = [("2024-01-01 00:00:00", 1.0), ("2024-01-01 01:00:00", None), ("2024-01-02 00:00:00", 3.0)]
    df = spark.createDataFrame(rows, "t string, v double").select(F.to_timestamp_ntz("t").alias("time"), "v")
    wire = payload.to_daily_payload(df, ["v"])
    back = payload.explode_payload(wire, "hourly", ["v"]).orderBy("time").collect()
    assert [r.v for r in back] == [1.0, None, 3.0]


def test_csv_round_trip_and_forecast_fallback(spark):
    d = tmpdir_new()
    df = spark.createDataFrame([("2024-01-01 05:00:00", 1.5)], "t string, v double").select(
        F.to_timestamp_ntz("t").alias("time"), "v")
    feeds.write_table(df, f"{d}/feat", fmt="csv", partition_by=())
    back = feeds.read_csv_table(spark, f"{d}/feat", T.StructType([T.StructField("time", T.TimestampNTZType()),
                                                                  T.StructField("v", T.DoubleType())]))
    assert back.collect()[0].v == 1.5
    empty = feeds.read_forecast(spark, f"{d}/does-not-exist")
    assert empty.count() == 0 and "us_aqi" in empty.columns and "date" in empty.columns


def test_report_fallback(spark):
    schema = T.StructType([T.StructField("mae_mean", T.DoubleType())])
    df = feeds.read_report(spark, "/tmp/chronoframe-no-such-report", schema, {"mae_mean": 2.24})
    assert df.first().mae_mean == 2.24


def test_hourly_rollup_stream(spark):
    import shutil
    out_dir, ck, src = tmpdir_new(), tmpdir_new(), tmpdir_new()
    shutil.copy(f"{SF001}/events.parquet", f"{src}/part-0.parquet")
    q = rollup.start_rollup(spark, src, f"{out_dir}/out", ck)
    q.awaitTermination(120)
    got = spark.read.parquet(f"{out_dir}/out")
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    # every emitted window is final; counts match a batch aggregation of the same windows
    batch = ev.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window_start"), "event_type").count()
    joined = got.join(batch, ["window_start", "event_type"])
    assert got.count() > 0 and joined.where(F.col("n") != F.col("count")).count() == 0


def test_nowcast_batch(spark):
    from chronoframe.plans.features import engineer_features
    from chronoframe.sources import views as V
    h = V.hourly(spark, SF001).withColumn("series_id", F.lit("city"))
    hist = h.where(F.col("time") < "2024-01-20")
    batch = h.where((F.col("time") >= "2024-01-20") & (F.col("time") < "2024-01-21"))
    scored = nowcast.nowcast_batch(batch, hist, lambda d: engineer_features(d, "live", keys=["series_id"]),
                                   nowcast.persistence_predictor())
    rows = scored.collect()
    assert len(rows) == 1
    r = rows[0]
    if r.forecast_aqi is None:
        assert r.confidence_lower is None and r.confidence_upper is None
    else:
        assert 0 <= r.confidence_lower <= r.forecast_aqi <= r.confidence_upper


def _hourly_feed(n=170):
    """Two interleaved series with gaps; the null key is one of them."""
    import datetime as dt
    import random
    rng = random.Random(4)
    base = dt.datetime(2024, 1, 1)
    return [(s, base + dt.timedelta(hours=h), float(rng.randint(0, 300))) for s in ("a", None) for h in sorted(rng.sample(range(3 * n), n))]


def _write_file(path, name, rows):
    import pyarrow as pa
    import pyarrow.parquet as pq
    import time as _time
    t = pa.table({"series_id": pa.array([r[0] for r in rows], pa.string()), "time": pa.array([r[1] for r in rows], pa.timestamp("us")),
                  "us_aqi": pa.array([r[2] for r in rows], pa.float64())})
    pq.write_table(t, f"{path}/{name}.parquet")
    _time.sleep(1.1)  # files are taken in the order of their times


def _lag_features(d):
    from chronoframe.operators import windows as W
    return W.window_features(d, [W.lag("us_aqi", n, f"l{n}") for n in (1, 9, 72)], keys=["series_id"])


def _plain(d):
    return d.select("series_id", F.col("time").alias("timestamp"), "us_aqi", "l1", "l9", "l72")


def test_nowcast_stream_equals_batch_through_late_rows_replay_and_restart(spark):
    from chronoframe.operators import ranking as R
    from chronoframe.sources import history
    rows = _hourly_feed()
    a, b = [r for r in rows if r[0] == "a"], [r for r in rows if r[0] is None]
    late, again = [a[150], b[160]], (a[-1][0], a[-1][1], 7.0)
    files = [("f1", a[:120] + b[:100]), ("f2", b[100:160] + a[120:150] + a[151:160]), ("f3", late + b[161:]), ("f4", a[160:]), ("f5", [again])]
    src, sink, ck = tmpdir_new(), tmpdir_new() + "/out", tmpdir_new()

    def run():
        stream = spark.readStream.schema("series_id string, time timestamp_ntz, us_aqi double").option("maxFilesPerTrigger", 1).parquet(src)
        q = nowcast.start_nowcast(spark, stream, sink, ck, _lag_features, _plain, idle="400 days")
        assert q.awaitTermination(60)

    seen = {}
    for name, part in files:  # a restart for every file: the buffers come from the checkpoint alone
        _write_file(src, name, part)
        run()
        seen.update({(r[0], r[1]): r for r in part})
        whole = spark.createDataFrame(list(seen.values()), "series_id string, time timestamp_ntz, us_aqi double")
        want = {tuple(r) for r in _plain(R.latest(_lag_features(whole), ["series_id"])).collect() if r.series_id in {p[0] for p in part}}
        got = {tuple(r) for r in history.read_history(spark, sink, time_col="timestamp").collect()}
        assert want <= got, name
    before = sorted(map(str, history.read_history(spark, sink, time_col="timestamp").collect()))
    # the last batch is replayed when its commit is lost
    import glob
    import os
    commits = sorted(glob.glob(f"{ck}/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    for f in (commits[-1], os.path.join(os.path.dirname(commits[-1]), f".{os.path.basename(commits[-1])}.crc")):
        if os.path.exists(f):
            os.remove(f)
    run()
    assert sorted(map(str, history.read_history(spark, sink, time_col="timestamp").collect())) == before


def test_silent_series_lose_their_buffer(spark):
    import datetime as dt
    from chronoframe.sources import history
    src, sink, ck, t0 = tmpdir_new(), tmpdir_new() + "/out", tmpdir_new(), dt.datetime(2024, 1, 1)
    day = lambda s, d, v: (s, t0 + dt.timedelta(days=d), v)
    for i, part in enumerate([[day("a", 0, 1.0), day("b", 0, 2.0)], [day("b", 10, 3.0)], [day("b", 11, 4.0)], [day("a", 12, 5.0)]]):
        _write_file(src, f"f{i}", part)
    stream = spark.readStream.schema("series_id string, time timestamp_ntz, us_aqi double").option("maxFilesPerTrigger", 1).parquet(src)
    q = nowcast.start_nowcast(spark, stream, sink, ck, _lag_features, _plain, idle="3 days")
    assert q.awaitTermination(60)
    got = {(r.series_id, r.us_aqi): r.l1 for r in history.read_history(spark, sink, time_col="timestamp").collect()}
    assert got["b", 4.0] == 3.0 and got["a", 5.0] is None  # a was silent for 12 days


def test_buffers_keep_the_last_rows_of_each_instant():
    import pyarrow as pa
    t = pa.table({"time": pa.array([3, 1, None, 2, 1], pa.int64()), "v": [1, 2, 3, 4, 5]})
    assert nowcast._merged(t, "time", 2).to_pydict() == {"time": [2, 3], "v": [4, 1]}
    assert nowcast._merged(t, "time", 9).to_pydict() == {"time": [1, 2, 3], "v": [5, 4, 1]}


def test_history_replay_and_compaction(spark):
    import glob
    from chronoframe.sources import history
    path = tmpdir_new() + "/h"
    assert history.read_history(spark, path) is None and history.compact(spark, path, "2030-01-01") == []

    def batch(i, rows):
        df = spark.createDataFrame([(s, t, v) for s, t, v in rows], "series_id string, t string, v double")
        history.write_batch(df.select("series_id", F.to_timestamp_ntz("t").alias("time"), "v"), path, i)

    def read(*bounds):
        return sorted(((r.series_id or "", str(r.time), r.v) for r in history.read_history(spark, path, *bounds).collect()))

    batch(0, [("a", "2024-01-01 01:00:00", 1.0), (None, "2024-01-01 01:00:00", 2.0), ("a", "2024-01-02 05:00:00", 3.0)])
    batch(1, [("a", "2024-01-01 01:00:00", 10.0), ("a", None, 5.0)])  # a late row replaces a stored one
    batch(2, [("a", "2024-01-02 06:00:00", 4.0), ("b", "2024-01-03 00:00:00", 6.0)])
    want = [("", "2024-01-01 01:00:00", 2.0), ("a", "2024-01-01 01:00:00", 10.0), ("a", "2024-01-02 05:00:00", 3.0),
            ("a", "2024-01-02 06:00:00", 4.0), ("a", "None", 5.0), ("b", "2024-01-03 00:00:00", 6.0)]
    assert read() == want
    batch(2, [("a", "2024-01-02 06:00:00", 4.0), ("b", "2024-01-03 00:00:00", 6.0)])  # replay
    assert read() == want and read("2024-01-02", "2024-01-03") == [w for w in want if w[1].startswith("2024-01-02")]
    assert history.compact(spark, path, "2024-01-03") == ["2024-01-01", "2024-01-02"]
    assert len(glob.glob(f"{path}/_day=2024-01-0[12]/_part=*")) == 2 and read() == want
    assert history.compact(spark, path, "2024-01-03") == []
    batch(0, [("a", "2024-01-01 01:00:00", 1.0)])  # an old batch comes again: the later one still wins
    assert read() == want and history.compact(spark, path, "2024-01-03") == ["2024-01-01"] and read() == want


def test_rollup_drops_rows_behind_the_watermark(spark):
    """One file per micro-batch: the last carries a row far behind the newest
    event; its window is already final (watermark 2 h, applied from the next
    batch on), so the late row is not counted."""
    import time as _time
    import datetime as dt
    import pyarrow as pa
    import pyarrow.parquet as pq
    src, out, ck = tmpdir_new(), tmpdir_new(), tmpdir_new()

    def write(name, rows):
        t = pa.table({"event_id": pa.array([r[0] for r in rows], pa.int64()),
                      "ts": pa.array([r[1] for r in rows], pa.timestamp("us")),
                      "user_id": pa.array([1] * len(rows), pa.int64()),
                      "event_type": pa.array(["view"] * len(rows)),
                      "value": pa.array([10.0] * len(rows)), "props": pa.array(['{"k": 1}'] * len(rows))})
        pq.write_table(t, f"{src}/{name}.parquet")

    base = dt.datetime(2024, 1, 1)
    write("f1", [(1, base + dt.timedelta(minutes=90)), (2, base + dt.timedelta(minutes=95)),
                 (3, base + dt.timedelta(hours=10))])
    _time.sleep(1.1)
    write("f2", [(4, base + dt.timedelta(hours=11))])   # on time; the watermark reaches 08:00 before it
    _time.sleep(1.1)
    write("f3", [(5, base + dt.timedelta(minutes=91))])  # behind the watermark by then
    q = rollup.start_rollup(spark, src, f"{out}/o", ck, max_files_per_trigger=1)
    q.awaitTermination(180)
    got = {r.window_start: r.n for r in spark.read.parquet(f"{out}/o").collect()}
    assert got[base + dt.timedelta(hours=1)] == 2


def test_partitioned_table_prunes_by_time_bound(spark):
    from chronoframe.sources import views as V
    d = tmpdir_new()
    h = V.hourly(spark, SF001)
    feeds.write_table(h, f"{d}/t")
    got = feeds.read_table(spark, f"{d}/t", "2024-01-10", "2024-01-12")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_py" in plan.split("PartitionFilters: [")[1].split("]")[0]
    exp = h.where((F.col("time") >= "2024-01-10") & (F.col("time") < "2024-01-12")).count()
    assert got.count() == exp > 0


def test_feed_reader_bounds_and_nan(spark):
    d = tmpdir_new()
    rows = [("city", "2024-01-01T00:00", 10.0), ("city", "2024-01-01T01:00", float("nan")),
            ("city", "2024-01-02T00:00", 30.0)]
    df = spark.createDataFrame(rows, "series_id string, t string, us_aqi double").select(
        "series_id", F.to_timestamp_ntz("t").alias("time"), "us_aqi")
    df.write.mode("overwrite").parquet(f"{d}/air")
    got = feeds.read_air(spark, f"{d}/air", "2024-01-01", "2024-01-02").orderBy("time").collect()
    assert [r.us_aqi for r in got] == [10.0, None]  # bounded to the first day, NaN read as NULL
    assert "pm10" in feeds.read_air(spark, f"{d}/air").columns  # the full air schema, absent columns null


def test_report_round_trip_and_history_json(spark):
    d = tmpdir_new()
    schema = T.StructType([T.StructField("mae_mean", T.DoubleType()), T.StructField("n_splits", T.LongType())])
    feeds.write_report(spark.createDataFrame([(2.279, 5)], schema), f"{d}/report")
    back = feeds.read_report(spark, f"{d}/report", schema, {"mae_mean": 0.0, "n_splits": 0}).first()
    assert back.mae_mean == 2.279 and back.n_splits == 5
    with open(f"{d}/hist.json", "w") as fh:
        fh.write('{"series_id": "city", "time": "2024-01-01T05:00", "us_aqi": 42.5}\n')
        fh.write('{"series_id": "city", "time": "2024-01-01T06:00", "us_aqi": null}\n')
    h = feeds.read_history_json(spark, f"{d}/hist.json").orderBy("time").collect()
    assert [r.us_aqi for r in h] == [42.5, None] and h[0].time.hour == 5


def test_markdown_report(spark):
    import glob
    import __spark_entry__ as entry
    qs = entry.queries()
    lines = feeds.markdown_lines(qs["split_report"](spark, SF001), qs["cv_summary"](spark, SF001),
                                 qs["regression_metrics"](spark, SF001))
    d = tmpdir_new()
    feeds.write_markdown(lines, f"{d}/md")
    text = open(glob.glob(f"{d}/md/part-*")[0]).read().splitlines()
    assert text[0] == "# Model Evaluation Results" and text[4].startswith("| train |")
    assert any(t.startswith("| RMSE |") for t in text) and text[-1].startswith("| Test rows |")


def test_partition_columns_leave_local_features_alone(spark):
    d = tmpdir_new()
    df = spark.sql("SELECT TIMESTAMP_NTZ'2023-12-31 20:00:00' AS time, 2024 AS year, 1 AS month, 1.0D AS us_aqi")
    feeds.write_table(df, f"{d}/t")
    assert tuple(feeds.read_table(spark, f"{d}/t").first()[c] for c in ("year", "month")) == (2024, 1)


def test_report_fallback_only_when_missing(spark):
    from pyspark.sql import types as T
    d = tmpdir_new()
    schema = T.StructType([T.StructField("mae", T.DoubleType())])
    assert feeds.read_report(spark, f"{d}/none", schema, {"mae": 9.0}).first().mae == 9.0
    feeds.write_report(spark.createDataFrame([(1.5,)], schema), f"{d}/r")
    assert feeds.read_report(spark, f"file://{d}/r", schema, {"mae": 9.0}).first().mae == 1.5


def test_nowcast_late_row_and_gaps(spark):
    """Features of a micro-batch equal those over the whole series, with late rows and half the hours missing."""
    import random

    from chronoframe.operators import windows as W
    rng = random.Random(1)
    hours = sorted(rng.sample(range(600), 300))
    full = spark.createDataFrame([("a", h, float(h)) for h in hours], "series_id string, h int, us_aqi double").select(
        "series_id", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("h"))).alias("time"), "us_aqi")
    late = [hours[-9], hours[-1]]  # a late row and the newest one
    is_new = F.col("us_aqi").isin([float(h) for h in late])
    lags = lambda d: W.window_features(d, [W.lag("us_aqi", n, f"l{n}") for n in (1, 9, 72)], keys=["series_id"])
    got = nowcast.nowcast_batch(full.where(is_new), full.where(~is_new), lags, lambda d: d).first()
    assert (got.us_aqi, got.l1, got.l9, got.l72) == tuple(float(hours[-1 - n]) for n in (0, 1, 9, 72))
