"""Exact distributed quantiles, null handling and imputation policies."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import nulls
from chronoframe.operators.quantiles import approx_quantiles, exact_quantiles, medians_wide


@pytest.mark.parametrize("small", [2_000_000, 7])
def test_exact_quantiles_match_numpy_both_paths(spark, small):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "a": rng.normal(0, 1, 500), "b": rng.integers(0, 9, 500) * 1.0})
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("a", F.nanvl("a", F.lit(None)))
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs, ["g"], small_group_rows=small, buckets=8).toPandas()
    for (g, c), grp in got.groupby(["g", "column"]):
        vals = pdf.loc[pdf.g == g, c].dropna().to_numpy()
        for _, r in grp.iterrows():
            assert r["value"] == pytest.approx(np.percentile(vals, r["p"] * 100), rel=1e-12, abs=1e-12)


def test_medians_wide_global(spark, synthetic, synthetic_pdf):
    m = medians_wide(synthetic, ["us_aqi", "pm2_5"]).first()
    assert m["us_aqi__median"] == pytest.approx(synthetic_pdf.us_aqi.median())


def test_approx_quantiles_close(spark, synthetic, synthetic_pdf):
    q = approx_quantiles(synthetic, ["us_aqi"], [0.5]).first()
    assert abs(q["value"] - synthetic_pdf.us_aqi.median()) < 5


def test_null_profile_and_prune(spark):
    df = spark.createDataFrame([(1, None, None), (2, 3.0, None), (3, None, None)], "k int, a double, z double")
    prof = {r["column"]: (r["missing"], r["pct"]) for r in nulls.null_profile(df).collect()}
    assert prof == {"a": (2, 66.67), "z": (3, 100.0)}
    assert nulls.prune_null_columns(df).columns == ["k", "a"]


def test_align_and_coerce(spark):
    df = spark.createDataFrame([("1.5", 2.0), ("x", None)], "s string, b double")
    out = nulls.align_features(df, ["b", "missing"]).collect()
    assert out[0]["missing"] == 0.0
    from chronoframe.functions.numeric import coerce_numeric
    vals = [r[0] for r in df.select(coerce_numeric("s")).collect()]
    assert vals == [1.5, 0.0]


def test_pre_and_post_ffill_medians_differ(spark):
    """Batch policy takes medians before the fill, notebook after (F2)."""
    from chronoframe.operators import windows as W
    pdf = pd.DataFrame({"time": pd.date_range("2024-01-01", periods=8, freq="h"),
                        "v": [100.0, None, None, None, 1.0, 2.0, None, 3.0]})
    df = spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz")) \
        .withColumn("v", F.nanvl("v", F.lit(None)))
    filled = W.window_features(df, [W.ffill("v", 3)], keys=[], order=["time"])
    pre = nulls.fill_with_medians(filled, ["v"], medians_from=df)
    post = nulls.fill_with_medians(filled, ["v"])
    assert medians_wide(df, ["v"]).first()[0] == 2.5
    assert medians_wide(filled, ["v"]).first()[0] == 51.5
    assert pre.count() == post.count() == 8


def test_null_threshold_and_total(spark):
    df = spark.createDataFrame([(1, None, None), (2, 3.0, None), (3, None, None)], "k int, a double, z double")
    assert [r["column"] for r in nulls.null_profile(df, min_pct=90).collect()] == ["z"]
    assert nulls.total_missing(df).first()["total_missing"] == 5


def test_describe_exact_and_approx(spark, synthetic, synthetic_pdf):
    from chronoframe.operators.aggregates import describe
    ex = describe(synthetic, ["us_aqi"]).first()
    ap = describe(synthetic, ["us_aqi"], accuracy=10_000).first()
    s = synthetic_pdf.us_aqi
    assert ex["p50"] == pytest.approx(s.median()) and ex["std"] == pytest.approx(s.std())
    assert abs(ap["p50"] - s.median()) <= (s.max() - s.min()) * 0.02


def test_small_helpers(spark, synthetic):
    from chronoframe.plans.features import built_columns, engineer_features
    feats = engineer_features(synthetic, "live")
    groups = nulls.column_groups(feats, built_columns(feats))
    assert groups["pollutants"] == ["pm2_5", "pm10"] and "aqi_roll_std_24" in groups["rolling"]
    assert "aqi_lag_1" in groups["aqi_lags"] and "hour_sin" in groups["cyclical"]
    assert "season_winter" in groups["season"] and "ventilation_idx" in groups["interactions"]
    avail, missing = nulls.column_diff(feats, ["aqi_lag_1", "ozone"])
    assert avail == ["aqi_lag_1"] and missing == ["ozone"]
    with pytest.raises(ValueError):
        nulls.require_rows(feats.where("1 = 0"), "slice")
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 2.0), (3, 3.0, None)], "k int, a double, b double")
    assert nulls.prune_null_columns(df, threshold=0.6).columns == ["k", "b"]  # a is 2/3 null, b 1/3


def test_hot_value_is_one_row(spark):
    """95 % zeros: no level of the refinement ranks the repeated value row by row."""
    from pyspark.sql import functions as F

    from chronoframe.operators import quantiles as Q
    df = spark.range(2000).select((F.col("id") % 2).cast("int").alias("g"), F.when(F.col("id") % 20 == 0, F.col("id")).otherwise(0).cast("double").alias("a"))
    got = {(r.g, r.p): r.value for r in Q.exact_quantiles(df, ["a"], [0.5, 0.99], ["g"], small_group_rows=10, buckets=4).collect()}
    pdf = df.toPandas()
    for (g, p), v in got.items():
        assert v == pytest.approx(pdf[pdf.g == g].a.quantile(p))
    seen = []
    ranked = Q._ranked
    Q._ranked = lambda values, groups, ranks: (seen.append(values.groupBy(*groups).count().agg(F.max("count")).first()[0]), ranked(values, groups, ranks))[1]
    try:
        Q.exact_quantiles(df, ["a"], [0.5], ["g"], small_group_rows=10, buckets=4).collect()
    finally:
        Q._ranked = ranked
    assert max(x or 0 for x in seen) <= 10


def test_null_keys_are_a_group(spark):
    from chronoframe.operators.aggregates import box_stats
    from chronoframe.operators.splits import positional_split
    rows = [(k, i, float(i)) for k in ("a", None) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    assert positional_split(df, keys=["k"], order=["i"]).count() == 20
    assert {r.k for r in box_stats(df, "v", "k").collect()} == {"a", None}
    holes = df.withColumn("v", df.v * (df.i > 2).cast("int")).replace(0.0, None, subset=["v"])
    filled = nulls.fill_with_medians(holes, ["v"], keys=["k"])
    assert filled.count() == 20 and filled.where("v is null").count() == 0


def test_large_groups_are_dealt_by_range(spark, monkeypatch):
    """Two large groups, one null: their values lie in many small pieces, not in one task a group."""
    from chronoframe.operators import quantiles as Q
    from chronoframe.operators.aggregates import box_stats
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "a").alias("g"), ((F.col("id") * 7919) % 20_011).cast("double").alias("v"))
    df = df.unionByName(df.limit(5_000)).unionByName(spark.createDataFrame([("b", 1.0), ("b", 4.0), ("e", None)], "g string, v double"))
    seen, cut = [], Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda d: (seen.append(cut(d)), seen[-1])[1])
    got = {(r.g, r.p): r.value for r in Q.quantiles_from_counts(Q.value_counts(df.select("g", F.col("v").alias("_v")), ["g"]), ["g"], [0.0, 0.25, 0.5, 1.0], 1000).collect()}
    pdf = df.where("v is not null").toPandas().fillna({"g": ""})
    assert {g for g, _ in got} == {"a", "b", None}
    for (g, p), v in got.items():
        assert v == pytest.approx(np.percentile(pdf[pdf.g == (g or "")].v, 100 * p), rel=1e-12)
    sizes = [[r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()] for d in seen]
    assert any(sum(s) == 20_002 and max(s) <= 1000 for s in sizes)
    whole = {r.g: (r.q1, r.median, r.q3, r.n) for r in box_stats(df, "v", "g").collect()}
    assert whole["b"] == (1.75, 2.5, 3.25, 2) and whole["a"][1] == got["a", 0.5] and whole[None][0] == got[None, 0.25]
