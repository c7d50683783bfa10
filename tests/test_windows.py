"""Window operators: reference assertions ported, pandas parity, halo == global."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import windows as W
from chronoframe.plans import features as FE


def _collect(df, order="time"):
    return df.orderBy(order).toPandas()


def test_lag_equals_earlier_rows(synthetic):
    out = _collect(W.window_features(synthetic, FE.lag_exprs(which=("aqi",)), keys=[], order=["time"]))
    y = out["us_aqi"].to_numpy()
    for n in FE.AQI_LAGS:
        col = out[f"aqi_lag_{n}"].to_numpy()
        assert np.isnan(col[:n].astype(float)).all() or pd.isna(out[f"aqi_lag_{n}"][:n]).all()
        np.testing.assert_allclose(col[n:].astype(float), y[:-n])


def test_lag_never_uses_future(synthetic):
    out = _collect(W.window_features(synthetic, [W.lag("us_aqi", 1, "l1")], keys=[], order=["time"]))
    assert (out["time"].diff().dropna() > pd.Timedelta(0)).all()
    np.testing.assert_allclose(out["l1"][1:].to_numpy(float), out["us_aqi"][:-1].to_numpy(float))


def test_rolling_first_row_is_itself_and_window_24(synthetic):
    out = _collect(W.window_features(synthetic, FE.rolling_exprs(), keys=[], order=["time"]))
    assert out["aqi_roll_mean_24"][0] == pytest.approx(out["us_aqi"][0])
    assert out["aqi_roll_mean_24"][30] == pytest.approx(out["us_aqi"][7:31].mean())
    assert pd.isna(out["aqi_roll_std_24"][0])  # one observation -> null sample std
    assert out["aqi_roll_std_24"].isna().sum() <= 1


def test_shuffled_input_gives_same_result(synthetic):
    exprs = FE.lag_exprs(which=("aqi",)) + FE.rolling_exprs()
    a = _collect(W.window_features(synthetic, exprs, keys=[], order=["time"]))
    shuffled = synthetic.orderBy(F.rand(7)).repartition(5)
    b = _collect(W.window_features(shuffled, exprs, keys=[], order=["time"]))
    pd.testing.assert_frame_equal(a, b)


def _random_null_frame(spark, n=600, series=3, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(series):
        vals = rng.uniform(0, 100, n)
        vals[rng.random(n) < 0.25] = np.nan
        t = pd.date_range("2024-01-01", periods=n, freq="h")
        rows.append(pd.DataFrame({"series_id": f"s{s}", "time": t, "v": vals}))
    pdf = pd.concat(rows, ignore_index=True)
    df = spark.createDataFrame(pdf.astype({"v": "float64"}))
    df = df.withColumn("time", F.col("time").cast("timestamp_ntz")).withColumn("v", F.nanvl("v", F.lit(None)))
    return pdf, df


def test_pandas_parity_rolling_and_ffill(spark):
    pdf, df = _random_null_frame(spark)
    exprs = [W.rolling("v", 24, "mean", "m24"), W.rolling("v", 24, "std", "s24"), W.rolling("v", 6, "sum", "p6"),
             W.rolling("v", 24, "mean", "strict24", min_periods=24), W.lag("v", 3, "l3")]
    out = W.window_features(df, exprs, keys=["series_id"], order=["time"], strategy="series")
    out = W.window_features(out, [W.ffill("v", 3, "vf")], keys=["series_id"], order=["time"], strategy="series")
    got = out.orderBy("series_id", "time").toPandas()
    exp = pdf.sort_values(["series_id", "time"]).reset_index(drop=True)
    g = exp.groupby("series_id")["v"]
    exp["m24"] = g.transform(lambda x: x.rolling(24, min_periods=1).mean())
    exp["s24"] = g.transform(lambda x: x.rolling(24, min_periods=1).std())
    exp["p6"] = g.transform(lambda x: x.rolling(6, min_periods=1).sum())
    exp["strict24"] = g.transform(lambda x: x.rolling(24).mean())
    exp["l3"] = g.shift(3)
    exp["vf"] = g.transform(lambda x: x.ffill(limit=3))
    for c in ["m24", "s24", "p6", "strict24", "l3", "vf"]:
        np.testing.assert_allclose(got[c].to_numpy(float), exp[c].to_numpy(float), rtol=1e-9, equal_nan=True)


def test_halo_equals_global_with_chained_ffill(spark):
    """Random nulls, lag 72 with ffill(3) on top: H must be 75 and is derived automatically."""
    _, df = _random_null_frame(spark, n=700, series=2, seed=11)
    stage1 = [W.lag("v", 72, "l72"), W.rolling("v", 48, "mean", "m48"), W.lead("v", 24, "f24")]
    stage2 = [W.ffill("l72", 3, "l72f")]
    kw = dict(keys=["series_id"], order=["time"])
    a = W.window_features(df, [stage1, stage2], strategy="series", **kw).orderBy("series_id", "time").toPandas()
    b = W.window_features(df, [stage1, stage2], strategy="halo", chunk_rows=100, **kw)
    b = b.orderBy("series_id", "time").toPandas()
    pd.testing.assert_frame_equal(a, b)
    c = W.window_features(df, [stage1, stage2], strategy="auto", chunk_rows=650, **kw)
    pd.testing.assert_frame_equal(a, c.orderBy("series_id", "time").toPandas())


def test_halo_single_series_no_keys(synthetic):
    exprs = FE.lag_exprs(which=("aqi",)) + FE.rolling_exprs()
    a = _collect(W.window_features(synthetic, exprs, keys=[], order=["time"], strategy="series"))
    b = _collect(W.window_features(synthetic, exprs, keys=[], order=["time"], strategy="halo", chunk_rows=80))
    pd.testing.assert_frame_equal(a, b)


def test_unbounded_ffill_halo_equals_series(spark):
    _, df = _random_null_frame(spark, n=300, series=2, seed=5)
    kw = dict(keys=["series_id"], order=["time"])
    a = W.ffill_unbounded(df, ["v"], strategy="series", **kw).orderBy("series_id", "time").toPandas()
    b = W.ffill_unbounded(df, ["v"], strategy="halo", chunk_rows=17, **kw).orderBy("series_id", "time").toPandas()
    pd.testing.assert_frame_equal(a[["series_id", "time", "v"]], b[["series_id", "time", "v"]])


def test_time_lag_skips_missing_hours(spark):
    pdf = pd.DataFrame({"series_id": "a", "time": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 01:00",
                                                                  "2024-01-01 03:00"]), "v": [1.0, 2.0, 3.0]})
    df = spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz"))
    out = W.window_features(df, [W.lag("v", 1, "row_lag"), W.lag_time("v", 3600, "time_lag")],
                            keys=["series_id"], order=["time"], strategy="series").orderBy("time").toPandas()
    assert out["row_lag"].tolist()[1:] == [1.0, 2.0]
    assert pd.isna(out["time_lag"][2]) and out["time_lag"][1] == 1.0


def test_one_window_exec_for_all_lags_and_rolls(synthetic):
    out = W.window_features(synthetic, FE.lag_exprs(which=("aqi",)) + FE.rolling_exprs(), keys=["pm10"],
                            order=["time"], strategy="series")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum(line.lstrip(" :+-*()0123456789").startswith("Window ") for line in plan.splitlines()) == 1
    assert plan.count("Exchange") == 1


def test_dense_heavy_series_uses_fine_buckets(spark):
    """700 rows inside one hour: hour buckets would hold the whole series, the
    density-sized buckets split it, and results still equal the global window."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"series_id": "hot", "time": pd.date_range("2024-01-01", periods=700, freq="5s"),
                        "v": rng.uniform(0, 100, 700)})
    light = pd.DataFrame({"series_id": "cold", "time": pd.date_range("2024-01-01", periods=30, freq="h"),
                          "v": rng.uniform(0, 100, 30)})
    df = spark.createDataFrame(pd.concat([pdf, light])).withColumn("time", F.col("time").cast("timestamp_ntz"))
    exprs = [W.lag("v", 5, "l5"), W.rolling("v", 10, "mean", "m10"), W.lead("v", 3, "f3")]
    kw = dict(keys=["series_id"], order=["time"])
    a = W.window_features(df, exprs, strategy="series", **kw).orderBy("series_id", "time").toPandas()
    b = W.window_features(df, exprs, strategy="auto", chunk_rows=100, **kw).orderBy("series_id", "time").toPandas()
    pd.testing.assert_frame_equal(a, b)
    width = W.bucket_width(df.where("series_id = 'hot'"), ["series_id"], "time", 25)
    assert width < 3_600_000_000 // 10


def test_positions_heavy_path_equals_row_number(spark):
    from chronoframe.operators import splits as S
    _, df = _random_null_frame(spark, n=300, series=2, seed=2)
    a = S.expanding_folds(df, 5, 24, keys=["series_id"]).orderBy("series_id", "time", "fold").toPandas()
    b = S.expanding_folds(df, 5, 24, keys=["series_id"], chunk_rows=50).orderBy("series_id", "time", "fold").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_time_windows_heavy_path_equals_series(spark):
    """Time look-backs promise nothing about density: bursts, gaps and equal instants."""
    rng = np.random.default_rng(4)
    start = np.datetime64("2024-01-01")
    secs = np.concatenate([rng.integers(0, 900, 200), rng.integers(0, 5_000_000, 100), [77, 77, 77]])
    pdf = pd.DataFrame({"series_id": np.where(rng.random(len(secs)) < 0.9, "hot", "cold"), "i": np.arange(len(secs)),
                        "time": start + secs.astype("timedelta64[s]"), "v": rng.uniform(0, 100, len(secs))})
    df = spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz"))
    exprs = [W.lag_time("v", 60, "t60"), W.rolling_time("v", 300, "max", "m300"), W.lag("v", 2, "l2")]
    kw = dict(keys=["series_id"], order=["time", "i"])
    a = W.window_features(df, exprs, strategy="series", **kw).orderBy("i").toPandas()
    b = W.window_features(df, exprs, strategy="auto", chunk_rows=30, **kw).orderBy("i").toPandas()
    pd.testing.assert_frame_equal(a, b[a.columns])


def test_bursty_series_is_split(spark):
    """1000 rows in 17 minutes and one row a year earlier: buckets follow the rows, not the clock."""
    rows = [("hot", np.datetime64("2023-01-01T00:00:00"), -1.0)]
    rows += [("hot", np.datetime64("2024-01-01") + np.timedelta64(i, "s"), float(i)) for i in range(1000)]
    rows += [(None, np.datetime64("2024-01-01") + np.timedelta64(i, "h"), float(i)) for i in range(40)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["series_id", "time", "v"])).withColumn("time", F.col("time").cast("timestamp_ntz"))
    cut = W._range_buckets(df, ["series_id"], "time", W.RangeBuckets(25, fan=8), "b")
    assert cut.groupBy("series_id", "b").count().agg(F.max("count")).first()[0] <= 40
    got = W.with_ordinal(df, ["series_id"], ["time"], bucket=W.RangeBuckets(25, fan=8)).toPandas()
    for _, g in got.groupby("series_id", dropna=False):
        assert g.sort_values("time")["_rn"].tolist() == list(range(len(g)))


def test_time_chunks_follow_the_rows(spark):
    """One row years before a burst: chunks stay small, and look-backs equal the plain plan's, across chunk edges and gaps."""
    base = dt.datetime(2023, 1, 1)
    times = [base - dt.timedelta(days=1461)] + [base + dt.timedelta(minutes=60 * i + (i * i) % 7) for i in range(1999)]
    rows = [("hot", t, i, float((i * 37) % 101)) for i, t in enumerate(times)]
    rows += [(None, t, i, float(i % 13)) for i, t in enumerate(times[:700])] + [("hot", times[900], 9000, 5.0), ("hot", None, 9001, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, time timestamp_ntz, u long, v double")
    exprs = [W.lag_time("v", 6 * 3600, "t6h"), W.rolling_time("v", 24 * 3600, "sum", "s24"), W.rolling_time("v", 3600, "max", "m1")]
    want = W.window_features(df, exprs, order=("time", "u"), strategy="series").collect()
    got = W.window_features(df, exprs, order=("time", "u"), strategy="halo", chunk_rows=100).collect()
    key = lambda r: (r.u, r.series_id or "")
    dated = lambda found: [tuple(r) for r in sorted(found, key=key) if r.time is not None]
    assert len(got) == len(rows) and dated(got) == dated(want)
    sizes = [r["count"] for r in W.time_chunks(df, 24 * 3600 + 1, ["series_id"], "time", 100).groupBy("series_id", "_part").count().collect()]
    assert max(sizes) <= 50 + 2 * 26 and len(sizes) > 30


def test_small_chunks_of_many_rows_make_few_ranges(spark, monkeypatch):
    """Chunks of 60 rows over 20,000 rows: few ranges, not one for every 15 rows, and the rows of the plain plan."""
    i = F.col("id")
    key = F.when(i < 14_850, i % 150).when(i < 14_890, F.lit(-1)).when(i < 14_960, F.lit(None)).otherwise(F.lit(777))
    df = spark.range(20_000).select(
        i.alias("i"), key.cast("long").alias("series_id"),
        F.when(i % 41 > 0, F.timestamp_seconds(1_700_000_000 + (i * 7) % 13).cast("timestamp_ntz")).alias("time"),
        F.when(i % 5 > 0, ((i * 37) % 101).cast("double")).alias("v"))
    seen, cut = [], W.cut_lineage
    monkeypatch.setattr(W, "cut_lineage", lambda d: (seen.append(cut(d)), seen[-1])[1])
    kw = dict(keys=["series_id"], order=["time", "i"])
    exprs = [W.lag("v", 1, "l1"), W.lag("v", 24, "l24"), W.lead("v", 24, "f24"), W.rolling("v", 24, "mean", "m24")]
    got = W.window_features(df, exprs, chunk_rows=60, **kw)
    pd.testing.assert_frame_equal(W.window_features(df, exprs, strategy="series", **kw).orderBy("i").toPandas(), got.orderBy("i").toPandas())
    dealt, carried = [d for d in seen if "v" in d.columns], [d for d in seen if "_off" in d.columns]
    assert [d.count() for d in dealt] == [19_960] and dealt[0].rdd.getNumPartitions() <= 64
    assert [0 < d.count() <= 64 for d in carried] == [True]
    ahead = [W.lead("v", 7, "f7")]
    pd.testing.assert_frame_equal(*(W.window_features(df.where("series_id = 777"), ahead, strategy=s, chunk_rows=30, bucket=W.RangeBuckets(7), **kw)
                                    .orderBy("i").toPandas() for s in ("series", "halo")))
