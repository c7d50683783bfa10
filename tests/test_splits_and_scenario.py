"""Splits, folds, slices and the scenario walk."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronoframe.operators import splits as S
from chronoframe.plans import scenario as SC


def test_fold_sizes_match_time_series_split(spark):
    n = 16699
    df = spark.range(n).select(F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("time"))
    folds = S.expanding_folds(df, 5, 24).groupBy("fold", "role").count().collect()
    got = {(r["fold"], r["role"]): r["count"] for r in folds}
    assert [got[(i, "train")] for i in range(5)] == [2760, 5543, 8326, 11109, 13892]
    assert all(got[(i, "test")] == 2783 for i in range(5))


def test_positional_split(spark):
    df = spark.range(10).select(F.timestamp_seconds("id").cast("timestamp_ntz").alias("time"))
    out = S.positional_split(df, 0.8).groupBy("split").count().collect()
    assert {r[0]: r[1] for r in out} == {"train": 8, "test": 2}


def test_time_slice_modes(spark):
    df = spark.range(0, 48).select(
        (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id"))).alias("time"))
    assert S.time_slice(df, "2024-01-01", "2024-01-02", "instant").count() == 25
    assert S.time_slice(df, "2024-01-01", "2024-01-02", "day").count() == 48


def _python_walk(current, mu):
    out, v = [], float(current)
    for e in SC.NOISE:
        v = SC.ALPHA * v + (1 - SC.ALPHA) * mu + e
        v = max(0.0, round(v, 1))
        out.append(v)
    return out


@pytest.mark.parametrize("current,mu", [(80, 75.3), (0, 0.0), (150, 42.123), (12, 300.0)])
def test_walk_matches_python_loop(spark, current, mu):
    st = spark.createDataFrame([(current, mu)], "current int, mu double")
    got = [r["model_aqi"] for r in SC.walk(st).orderBy("day_offset").collect()]
    assert got == pytest.approx(_python_walk(current, mu), abs=1e-9)


def test_scenario_of_several_series(spark):
    """Keyed walk, daily maxima, comparison and summary equal those of each series by itself, null key included."""
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(base + 7 * (i % 11)))
            for k, base in (("a", 40), ("b", 120), (None, 10)) for i in range(24 * 9) if not (k == "b" and 120 < i < 170)]
    df = spark.createDataFrame(rows, "series_id string, time timestamp_ntz, us_aqi double")
    now, spine = "2024-01-04 05:30:00", SC.date_spine(spark, "2024-01-04", 7)

    def both(d, keys):
        state = SC.current_and_history(d, now, keys=keys)
        cmp = SC.compare(SC.daily_max_on_spine(d, spine, state, keys=keys), SC.walk(state, keys=keys), keys)
        return cmp, SC.summary(cmp, keys)
    keyed, total = both(df, ["series_id"])
    assert keyed.count() == 21 and total.count() == 3
    for k in ("a", "b", None):
        cmp, one = both(df.where(F.col("series_id").eqNullSafe(F.lit(k))).drop("series_id"), [])
        mine = F.col("series_id").eqNullSafe(F.lit(k))
        assert sorted(map(tuple, keyed.where(mine).drop("series_id").collect())) == sorted(map(tuple, cmp.collect()))
        assert tuple(total.where(mine).drop("series_id").first()) == tuple(one.first())


def test_long_series_are_dealt_by_range(spark, monkeypatch):
    """Three long series whose rows share few instants: many small pieces, and the same split as by sorting each series."""
    from chronoframe.operators import windows as W
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=(i * 7) % 3), (i * 31) % 997) for k, m in (("a", 997), (None, 600), ("b", 3)) for i in range(m)]
    df = spark.createDataFrame(rows, "k string, time timestamp_ntz, i int")
    seen, cut = [], W.cut_lineage
    monkeypatch.setattr(W, "cut_lineage", lambda d: (seen.append(cut(d)), seen[-1])[1])
    got = {(r.k, r.time, r.i): r.split for r in S.positional_split(df, 0.8, ["k"], ["time", "i"], chunk_rows=100).collect()}
    for k in ("a", None, "b"):
        mine = sorted(r for r in rows if r[0] == k) if k else sorted((r for r in rows if r[0] is None), key=lambda r: r[1:])
        assert [got[r] for r in mine] == ["train"] * int(len(mine) * 0.8) + ["test"] * (len(mine) - int(len(mine) * 0.8))
    assert len(got) == len(rows)
    sizes = [[r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()] for d in seen]
    assert any(sum(s) == len(rows) and max(s) <= 60 for s in sizes)
