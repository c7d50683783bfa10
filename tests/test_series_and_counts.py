"""Gap filling, as-of at many instants, stored counts, null keys, time bounds: against pandas and plain plans."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import aggregates as A
from chronoframe.operators import joins as J
from chronoframe.operators import ranking as R
from chronoframe.plans import features as FE
from chronoframe.sources import spine

SF001 = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("chunk_rows", [1_000_000, 8])
def test_gap_fill_fills_only_gaps(spark, chunk_rows):
    hours = {"a": [0, 1, 4, 4, 9], None: [2, 30], "b": [5], "c": [0, 1, 2]}
    rows = [(s, T0 + dt.timedelta(hours=h), float(i)) for s, hs in hours.items() for i, h in enumerate(hs)]
    rows += [("a", T0 + dt.timedelta(minutes=90), 99.0), ("a", None, 98.0)]  # off the grid, and without a time
    df = _frame(spark, rows, "s string, time timestamp_ntz, v double")
    got = sorted(((r.s or "", r.time, r.v, r.is_filled) for r in spine.gap_fill(df, keys=["s"], chunk_rows=chunk_rows).collect()), key=str)
    want = []
    for s, hs in hours.items():
        have = dict(enumerate(hs))
        want += [(s or "", T0 + dt.timedelta(hours=h), float(i), 0) for i, h in have.items()]
        want += [(s or "", T0 + dt.timedelta(hours=h), None, 1) for h in range(min(hs), max(hs)) if h not in hs]
    assert got == sorted(want, key=str)


def test_long_gaps_come_in_bounded_arrays(spark):
    rows = [(T0, 1.0), (T0 + dt.timedelta(hours=3 * spine.GAP_ROWS + 7), 2.0)]
    out = spine.gap_fill(_frame(spark, rows, "time timestamp_ntz, v double"))
    assert out.count() == 3 * spine.GAP_ROWS + 8 == out.select("time").distinct().count()
    assert spine.gap_fill(_frame(spark, [], "time timestamp_ntz, v double")).count() == 0


def test_daily_mean_of_a_nameless_series(spark):
    rows = [(None, T0, 2.0), (None, T0 + dt.timedelta(hours=5), 4.0), (None, T0 + dt.timedelta(days=3), 1.0), ("x", T0, 7.0)]
    got = {(r.s, str(r.date)): r.m for r in spine.daily_mean(_frame(spark, rows, "s string, time timestamp_ntz, v double"), "v", keys=["s"], name="m").collect()}
    assert got == {(None, "2024-01-01"): 3.0, (None, "2024-01-02"): None, (None, "2024-01-03"): None, (None, "2024-01-04"): 1.0, ("x", "2024-01-01"): 7.0}


def test_feeds_of_nameless_series_meet(spark):
    left = _frame(spark, [(None, T0, 1.0), ("a", T0, 2.0), ("a", None, 3.0)], "series_id string, time timestamp_ntz, x double")
    right = _frame(spark, [(None, T0, 5.0), ("a", T0, 6.0), ("a", None, 7.0)], "series_id string, time timestamp_ntz, y double")
    assert {(r.series_id, r.x, r.y) for r in J.merge_feeds(left, right).collect()} == {(None, 1.0, 5.0), ("a", 2.0, 6.0)}


@pytest.mark.parametrize("strategy,chunk_rows", [("series", None), ("auto", 12), ("halo", 12)])
def test_asof_many_matches_a_search(spark, strategy, chunk_rows):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, T0 + dt.timedelta(minutes=rng.randint(0, 300)), rng.random()) for i in range(120)]
    asked = [(rng.choice(["a", "a", "b", None, "z"]), 1000 + i, T0 + dt.timedelta(minutes=rng.randint(-20, 320))) for i in range(80)]
    asked += [("a", 2000, None)]
    got = {r.q: (r.row.i if r.row else None) for r in R.asof_many(
        _frame(spark, rows + [("a", 900, None, 0.0)], "s string, i int, time timestamp_ntz, v double"),
        _frame(spark, asked, "s string, q int, time timestamp_ntz"), ["s"], tie=["i"], strategy=strategy, chunk_rows=chunk_rows).collect()}
    want = {q: max(((x[2], x[1]) for x in rows if x[0] == s and t is not None and x[2] <= t), default=(None, None))[1] for s, q, t in asked}
    assert got == want


def test_stored_counts_describe_any_range(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", None]), T0 + dt.timedelta(hours=rng.randint(0, 239)), float(rng.randint(0, 40)) if rng.random() < 0.9 else None) for _ in range(600)]
    df = _frame(spark, rows, "s string, time timestamp_ntz, v double")
    stored = A.daily_value_counts(df, ["v"], keys=["s"])
    for lo, hi in (("2024-01-01", "2024-01-11"), ("2024-01-04", "2024-01-06"), ("2030-01-01", "2030-01-02")):
        part = df.where((F.col("time") >= lo) & (F.col("time") < hi))
        want = {r.s: r.asDict() for r in A.describe(part, ["v"], keys=["s"]).collect()}
        got = {r.s: r.asDict() for r in A.describe_range(stored, lo, hi, keys=["s"]).collect()}
        assert got.keys() == want.keys()
        for s, w in want.items():
            assert {k: v for k, v in got[s].items() if k not in ("s", "column")} == pytest.approx({k: v for k, v in w.items() if k not in ("s", "column")})


def test_box_statistics_read_the_rows_once(spark):
    df = _frame(spark, [("g", float(v)) for v in [1, 2, 3, 4, 100]] + [(None, 5.0), ("g", None), ("e", None)], "g string, v double")
    got = {r.g: (r.q1, r.median, r.q3, r.n, r.whisker_lo, r.whisker_hi, r.n_outliers) for r in A.box_stats(df, "v", "g").collect()}
    assert got == {"g": (2.0, 3.0, 4.0, 5, 1.0, 4.0, 1), None: (5.0, 5.0, 5.0, 1, 5.0, 5.0, 0)}


@pytest.mark.parametrize("profile", ["notebook", "batch", "leak_free"])
def test_since_with_stored_medians_and_null_targets(spark, profile):
    """Rows without a target do not count as look-back where the profile drops them."""
    from chronoframe.operators.quantiles import medians_wide
    rng = random.Random(2)
    cols = ["us_aqi", "pm2_5", "precipitation", "wind_speed_10m", "boundary_layer_height", "relative_humidity_2m", "wind_direction_10m"]
    rows = [(T0 + dt.timedelta(hours=h), None if 500 <= h < 820 and rng.random() < 0.9 else rng.uniform(10, 200), *[rng.uniform(1, 90) for _ in cols[1:]])
            for h in range(1000)]
    df = _frame(spark, rows, "time timestamp_ntz, " + ", ".join(f"{c} double" for c in cols))
    full = FE.engineer_features(df, profile)
    num = [c for c, t in full.dtypes if t in ("double", "int") and c != "us_aqi"]
    medians = medians_wide(full, num)
    since = "2024-02-04 00:00:00"
    want = FE.engineer_features(df, profile, medians=medians).where(F.col("time") >= F.lit(since).cast("timestamp_ntz"))
    part = FE.engineer_features(df, profile, since=since, lookback_hours=320, medians=medians)
    pd.testing.assert_frame_equal(part.orderBy("time").toPandas(), want.orderBy("time").toPandas()[part.columns])


def test_asof_bounds_reach_the_scan(spark):
    from chronoframe.plans.catalog import QUERIES
    for name in ("latest_asof", "tail48", "recent_window", "current_conditions", "time_slice", "forecast_daily_max", "scenario_walk",
                 "scenario_compare", "compare_summary"):
        plan = QUERIES[name](spark, SF001)._jdf.queryExecution().toString()
        scans = [line for line in plan.split("== Physical Plan ==")[1].splitlines() if "PushedFilters" in line]
        assert scans and all("LessThan(ts," in line for line in scans if "events" in line), name


def test_forecast_faults_are_not_hidden(spark, tmp_path):
    from chronoframe.sources import feeds
    assert feeds.read_forecast(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad.parquet").write_text("not a table")
    with pytest.raises(Exception):
        feeds.read_forecast(spark, str(tmp_path / "bad.parquet")).count()
