"""Feature profiles, leakage audit and the MLlib dataflows."""

import pytest
from pyspark.sql import functions as F

from chronoframe.plans import features as FE
from chronoframe.plans import model as M


@pytest.fixture(scope="module")
def feats(synthetic):
    return FE.engineer_features(synthetic, "batch").cache()


def test_batch_profile_schema(feats):
    cols = set(feats.columns)
    for c in ["aqi_lag_72", "precip_lag_24", "wind_lag_6", "aqi_roll_mean_48", "aqi_roll_std_24", "precip_sum_24h",
              "hour_sin", "dow_cos", "season_winter", "is_festival", "ventilation_idx", "inversion_proxy",
              "humidity_pm25", "wdir_N", "wdir_E", "wdir_nan"]:
        assert c in cols, c
    assert "season" not in cols and "season_monsoon" not in cols and "wind_dir_cat" not in cols
    assert feats.where(F.col("aqi_lag_72").isNull()).count() == 0  # medians filled the warm-up rows


def test_feature_list_excludes_leakage(feats):
    from chronoframe.operators.nulls import feature_columns
    fl = feature_columns(feats, FE.EXCLUDE_COLUMNS)
    assert not set(fl) & set(FE.EXCLUDE_COLUMNS)
    audit = M.leakage_audit(feats, feature_list=fl).first()
    assert audit["leaked_columns"] == 0


def test_leakage_identity_holds_only_with_current_row(synthetic):
    a = M.leakage_audit(synthetic).first()
    assert a["max_identity_error"] < 1e-9
    assert a["leak_free_max_identity_error"] > 1.0


def test_notebook_and_live_profiles(synthetic):
    nb = FE.engineer_features(synthetic, "notebook")
    assert "wdir_E" not in nb.columns  # drop_first on the wind vocabulary
    live = FE.engineer_features(synthetic, "live")
    assert live.where(F.col("aqi_lag_72").isNull()).count() == 0  # zeros after the fill
    arch = FE.engineer_features(synthetic, "archived")
    assert "target_24h" in arch.columns and arch.count() == 200 - 48 - 24  # rows with all 48 lags and a reading 24 rows on


def test_gbt_fit_score_and_latest_record(spark, feats):
    from chronoframe.operators.nulls import feature_columns
    fl = [c for c in feature_columns(feats, FE.EXCLUDE_COLUMNS) if c != "series_id"]
    model = M.fit(feats, fl, params={"maxIter": 5, "maxDepth": 3})
    met = M.evaluate(model, feats, fl).first()
    assert met["n"] > 0 and met["rmse"] >= 0
    rec = M.score_latest(model, feats, fl, "2023-01-05 00:00:00").first().asDict()
    assert len(rec["history"]) == 48 and rec["history"][-1].time == rec["timestamp"]
    assert [h.time for h in rec["history"]] == sorted(h.time for h in rec["history"])
    assert set(rec) == {"current_aqi", "forecast_aqi", "category", "timestamp", "forecast_timestamp",
                        "confidence_lower", "confidence_upper", "history"}
    assert 0 <= rec["confidence_lower"] <= rec["forecast_aqi"] <= rec["confidence_upper"]
    imp = M.importance_table(model, fl).collect()
    assert len(imp) == len(fl) and imp[0]["importance"] >= imp[-1]["importance"]


def test_cross_validate_shapes(spark, feats):
    fl = ["aqi_lag_1", "aqi_lag_24", "hour_sin", "hour_cos"]
    per_fold, summary = M.cross_validate(feats, fl, params={"maxIter": 3, "maxDepth": 2})
    assert per_fold.count() == 5
    n = feats.count()
    assert {r["n"] for r in per_fold.collect()} == {n // 6}  # every fold tests n // (k + 1) rows
    row = summary.first()
    assert row["n_splits"] == 5 and row["rmse_std"] >= 0


def test_since_pushdown_matches_full_build_for_live_profile(spark, synthetic):
    since = "2023-01-06 00:00:00"
    full = FE.engineer_features(synthetic, "live").where(F.col("time") >= F.lit(since).cast("timestamp_ntz"))
    part = FE.engineer_features(synthetic, "live", since=since)
    cols = sorted(full.columns)
    a = full.select(cols).orderBy("time").toPandas()
    b = part.select(cols).orderBy("time").toPandas()
    import pandas as pd
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("profile", ["live", "batch", "archived"])
def test_since_on_a_gappy_series(spark, synthetic, profile):
    """Half the hours are missing: the look-back is one of rows, and medians are those of the whole history."""
    gappy = synthetic.where(F.pmod(F.xxhash64("time"), F.lit(2)) == 0)
    since = "2023-01-06 00:00:00"
    full = FE.engineer_features(gappy, profile).where(F.col("time") >= F.lit(since).cast("timestamp_ntz"))
    part = FE.engineer_features(gappy, profile, since=since, lookback_hours=75)
    import pandas as pd
    pd.testing.assert_frame_equal(full.orderBy("time").toPandas(), part.orderBy("time").toPandas()[full.columns])


def test_festival_days_follow_the_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2022-10-23 20:00:00' AS time, 1.0D AS us_aqi, 1.0D AS pm2_5, 1.0D AS relative_humidity_2m")
    assert FE.static_features(df).first().is_festival == 0
    assert FE.static_features(df, tz="Asia/Kolkata").first().is_festival == 1
    from chronoframe.operators.joins import flag_festival, live_festival_dates
    late = df.withColumn("time", F.lit("2025-10-20 05:00:00").cast("timestamp_ntz"))
    assert flag_festival(late, live_festival_dates(spark)).first().is_festival == 1


def test_model_save_load_and_permutation(spark, feats):
    from tests.conftest import tmpdir_new
    fl = ["aqi_lag_1", "aqi_lag_2", "aqi_roll_mean_3", "hour_sin"]
    model = M.fit(feats, fl, params={"maxIter": 3, "maxDepth": 2})
    d = tmpdir_new()
    M.save_model(model, d, fl)
    loaded, names = M.load_model(d)
    assert names == fl
    a = model.transform(feats).select("prediction").collect()
    b = loaded.transform(feats).select("prediction").collect()
    assert a == b
    imp = M.importance_table(model, fl)
    M.write_importance_csv(imp, d + "/importance")
    assert M.read_importance_csv(spark, d + "/importance").count() == len(fl)
    perm = M.permutation_importance(model, feats, fl, sample_rows=100).collect()
    assert {r.feature for r in perm} == set(fl)
    with pytest.raises(Exception):
        M.load_model(d + "/missing")


def test_random_search_returns_params(spark, feats):
    from chronoframe.operators import splits as S
    fl = ["aqi_lag_1", "aqi_roll_mean_3"]
    lab = S.positional_split(feats, 0.8)
    small = {"maxIter": (2, 4, 1), "maxDepth": (2, 3)}
    best, rmse = M.random_search(lab.where("split = 'train'"), lab.where("split = 'test'"), fl, n_trials=2,
                                 space=small)
    assert "maxDepth" in best and rmse >= 0


def test_multi_series_features_with_zone(spark, synthetic_pdf):
    import pandas as pd
    a = synthetic_pdf.head(100).assign(series_id="a")
    b = synthetic_pdf.tail(100).assign(series_id="b")
    b = b.assign(time=a["time"].values)  # same timestamps, different series
    df = spark.createDataFrame(pd.concat([a, b], ignore_index=True)) \
        .withColumn("time", F.col("time").cast("timestamp_ntz"))
    out = FE.engineer_features(df, "live", keys=["series_id"], tz="Asia/Kolkata") \
        .orderBy("series_id", "time").toPandas()
    for sid, grp in out.groupby("series_id"):
        src = (a if sid == "a" else b).reset_index(drop=True)
        assert grp["aqi_lag_1"].iloc[0] == 0.0  # warm-up null filled by the live policy, never the other series
        assert list(grp["aqi_lag_1"].iloc[1:6]) == pytest.approx(list(src["us_aqi"].iloc[0:5]))
    first = out.iloc[0]
    assert first["hour"] == 5  # 00:00 UTC is 05:30 in Asia/Kolkata
