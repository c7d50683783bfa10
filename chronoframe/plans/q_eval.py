"""R1 splits, folds, metrics, baselines, categories and audits
(P2, P3, W11, W12, U2, A6-A12, A16, A21, M10 baseline, M12).

"Prediction" is persistence (the previous reading) so every metric query has
an independent SQL oracle; model-based twins live in :mod:`chronoframe.plans.model`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.functions import categories as C
from chronoframe.operators import aggregates as A
from chronoframe.operators import splits as S
from chronoframe.operators import windows as W
from chronoframe.plans.registry import (HOURLY_CTE, TEST_START, VAL_START, _round_all, _win, hourly, r9,
                                        register)

SPLIT_SQL = (f"CASE WHEN time < TIMESTAMP '{VAL_START}' THEN 'train' "
             f"WHEN time < TIMESTAMP '{TEST_START}' THEN 'val' ELSE 'test' END")
PERSIST_CTE = f"""{HOURLY_CTE},
ev AS (SELECT time, us_aqi, lag(us_aqi, 1) OVER (ORDER BY time) AS pred FROM hourly)"""


def _persisted(spark, sf):
    return _win(hourly(spark, sf), [W.lag("us_aqi", 1, "pred")])


@register("temporal_split", f"""
WITH {HOURLY_CTE}
SELECT time, {SPLIT_SQL} AS split FROM hourly
""")
def q_temporal_split(spark, sf):
    return S.temporal_split(hourly(spark, sf), VAL_START, TEST_START).select("time", "split")


@register("split_report", f"""
WITH {HOURLY_CTE}
SELECT {SPLIT_SQL} AS split, count(*) AS n_rows, min(time) AS min_time, max(time) AS max_time,
       CAST(9 AS INTEGER) AS n_columns
FROM hourly GROUP BY 1
""")
def q_split_report(spark, sf):
    """Counted rows per split (not the reference's estimates, F13)."""
    df = S.temporal_split(hourly(spark, sf), VAL_START, TEST_START)
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("time").alias("min_time"),
                                   F.max("time").alias("max_time"),
                                   F.lit(len(df.columns)).alias("n_columns"))


@register("time_slice", f"""
WITH {HOURLY_CTE}
SELECT 'instant' AS mode, time FROM hourly
WHERE time >= TIMESTAMP '2024-01-26' AND time <= TIMESTAMP '2024-01-30'
UNION ALL
SELECT 'day' AS mode, time FROM hourly
WHERE time >= TIMESTAMP '2024-01-26' AND time < TIMESTAMP '2024-01-31'
""")
def q_time_slice(spark, sf):
    """Both end conventions of the closed slice."""
    h = hourly(spark, sf, "2024-01-26", "2024-01-31").select("time")
    a = S.time_slice(h, "2024-01-26", "2024-01-30", "instant").select(F.lit("instant").alias("mode"), "time")
    b = S.time_slice(h, "2024-01-26", "2024-01-30", "day").select(F.lit("day").alias("mode"), "time")
    return a.unionByName(b)


@register("split_80_20", f"""
WITH {HOURLY_CTE},
p AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS pos, count(*) OVER () AS n FROM hourly)
SELECT time, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM p
""")
def q_split_80_20(spark, sf):
    return S.positional_split(hourly(spark, sf), 0.8).select("time", "split")


FOLD_CTE = f"""{HOURLY_CTE},
p AS (SELECT time, us_aqi, row_number() OVER (ORDER BY time) - 1 AS pos, count(*) OVER () AS n
      FROM hourly WHERE us_aqi IS NOT NULL),
f AS (SELECT p.*, fold, n - (5 - fold) * (n // 6) AS ts0, n // 6 AS tsz FROM p, range(5) AS r(fold)),
folds AS (SELECT time, us_aqi, CAST(fold AS INTEGER) AS fold,
                 CASE WHEN pos >= ts0 AND pos < ts0 + tsz THEN 'test' WHEN pos < ts0 - 24 THEN 'train' END AS role
          FROM f)"""


@register("ts_folds", f"""
WITH {FOLD_CTE}
SELECT time, fold, role FROM folds WHERE role IS NOT NULL
""")
def q_ts_folds(spark, sf):
    from chronoframe.operators.nulls import drop_null_target
    return S.expanding_folds(drop_null_target(hourly(spark, sf)), 5, 24).select("time", "fold", "role")


@register("trainval_union", f"""
WITH {HOURLY_CTE}
SELECT time, round(us_aqi, 9) AS us_aqi, 'train' AS split FROM hourly WHERE time < TIMESTAMP '{VAL_START}'
UNION ALL
SELECT time, round(us_aqi, 9) AS us_aqi, 'val' AS split FROM hourly
WHERE time >= TIMESTAMP '{VAL_START}' AND time < TIMESTAMP '{TEST_START}'
""")
def q_trainval_union(spark, sf):
    df = S.temporal_split(hourly(spark, sf), VAL_START, TEST_START).select("time", r9("us_aqi"), "split")
    return S.union_splits(df.where(F.col("split") == "train"), df.where(F.col("split") == "val"))


def _metric_sql(actual: str, pred: str) -> str:
    return (f"count(*) AS n, round(avg(abs({actual} - {pred})), 9) AS mae, "
            f"round(sqrt(avg(({actual} - {pred}) * ({actual} - {pred}))), 9) AS rmse, "
            f"round(1 - sum(({actual} - {pred}) * ({actual} - {pred})) / nullif(count(*) * var_pop({actual}), 0), 9) AS r2")


@register("regression_metrics", f"""
WITH {PERSIST_CTE}
SELECT {_metric_sql("us_aqi", "pred")} FROM ev WHERE us_aqi IS NOT NULL AND pred IS NOT NULL
""")
def q_regression_metrics(spark, sf):
    return _round_all(A.regression_metrics(_persisted(spark, sf), "us_aqi", "pred"))


def _baseline_rows(df, horizons):
    """Lead targets for every horizon in one window stage, then long format."""
    leads = _win(df, [W.lead("us_aqi", h, f"t{h}") for h in horizons])
    long = leads.select("time", "us_aqi", F.explode(F.array(*[
        F.struct(F.lit(h).alias("h"), F.col(f"t{h}").alias("target")) for h in horizons])).alias("_x"))
    long = long.select("time", F.col("us_aqi").alias("pred"), "_x.h", "_x.target")
    return long.where(F.col("target").isNotNull() & F.col("pred").isNotNull())


@register("persistence_baseline", f"""
WITH {HOURLY_CTE},
t AS (SELECT time, us_aqi AS pred, lead(us_aqi, 24) OVER (ORDER BY time) AS target FROM hourly),
c AS (SELECT *, row_number() OVER (ORDER BY time) - 1 AS pos, count(*) OVER () AS n
      FROM t WHERE target IS NOT NULL AND pred IS NOT NULL)
SELECT {_metric_sql("target", "pred")} FROM c WHERE pos >= floor(n * 0.8)
""")
def q_persistence_baseline(spark, sf):
    """y(t+24) predicted by y(t), scored on the positional last 20 %."""
    rows = _baseline_rows(hourly(spark, sf), [24]).drop("h")
    test = S.positional_split(rows, 0.8).where(F.col("split") == "test")
    return _round_all(A.regression_metrics(test, "target", "pred"))


_HORIZONS = [6, 12, 24, 48]


@register("horizon_baseline", f"""
WITH {HOURLY_CTE},
t AS (SELECT time, us_aqi AS pred, {", ".join(f"lead(us_aqi, {h}) OVER (ORDER BY time) AS t{h}" for h in _HORIZONS)} FROM hourly),
l AS ({" UNION ALL ".join(f"SELECT {h} AS h, time, pred, t{h} AS target FROM t" for h in _HORIZONS)}),
c AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY time) - 1 AS pos, count(*) OVER (PARTITION BY h) AS n
      FROM l WHERE target IS NOT NULL AND pred IS NOT NULL)
SELECT CAST(h AS INTEGER) AS h, {_metric_sql("target", "pred")} FROM c WHERE pos >= floor(n * 0.8) GROUP BY h
""")
def q_horizon_baseline(spark, sf):
    """Direct multi-horizon persistence baseline (M10, baseline half)."""
    rows = _baseline_rows(hourly(spark, sf), _HORIZONS)
    test = S.positional_split(rows, 0.8, keys=["h"]).where(F.col("split") == "test")
    return _round_all(A.regression_metrics(test, "target", "pred", keys=["h"]))


_BIN_SQL = ("CASE WHEN us_aqi > 0 AND us_aqi <= 50 THEN 'Good' WHEN us_aqi > 50 AND us_aqi <= 100 THEN 'Moderate' "
            "WHEN us_aqi > 100 AND us_aqi <= 150 THEN 'Sensitive' WHEN us_aqi > 150 AND us_aqi <= 200 THEN 'Unhealthy' "
            "WHEN us_aqi > 200 AND us_aqi <= 300 THEN 'Very Unhealthy' WHEN us_aqi > 300 AND us_aqi <= 500 THEN 'Hazardous' END")


@register("metrics_by_category", f"""
WITH {PERSIST_CTE},
b AS (SELECT *, {_BIN_SQL} AS category FROM ev WHERE us_aqi IS NOT NULL AND pred IS NOT NULL)
SELECT category, count(*) AS n, round_even(avg(abs(us_aqi - pred)), 2) AS mae,
       round_even(sqrt(avg((us_aqi - pred) * (us_aqi - pred))), 2) AS rmse
FROM b WHERE category IS NOT NULL GROUP BY category HAVING count(*) >= 5
""")
def q_metrics_by_category(spark, sf):
    df = _persisted(spark, sf).withColumn("category", C.category_binned("us_aqi"))
    return A.metrics_by_group(df, "us_aqi", "pred", "category", 5, 2)


def _cont_sql(x: str) -> str:
    return (f"CASE WHEN {x} <= 50 THEN 'Good' WHEN {x} <= 100 THEN 'Moderate' "
            f"WHEN {x} <= 150 THEN 'Unhealthy for Sensitive Groups' WHEN {x} <= 200 THEN 'Unhealthy' "
            f"WHEN {x} <= 300 THEN 'Very Unhealthy' WHEN {x} IS NOT NULL THEN 'Hazardous' END")


_CM_NAMES = ["good", "moderate", "usg", "unhealthy", "very_unhealthy", "hazardous"]


@register("confusion_matrix", f"""
WITH {PERSIST_CTE},
c AS (SELECT {_cont_sql("us_aqi")} AS actual, {_cont_sql("pred")} AS predicted FROM ev
      WHERE us_aqi IS NOT NULL AND pred IS NOT NULL)
SELECT actual, {", ".join(f"count(*) FILTER (WHERE predicted = '{l}') AS {n}" for l, n in zip(C.CATEGORY_LABELS, _CM_NAMES))}
FROM c GROUP BY actual
""")
def q_confusion_matrix(spark, sf):
    df = _persisted(spark, sf).select(C.category_continuous("us_aqi").alias("a"),
                                      C.category_continuous("pred").alias("p"))
    return A.confusion_counts(df, "a", "p", C.CATEGORY_LABELS, _CM_NAMES)


@register("category_accuracy", f"""
WITH {PERSIST_CTE}
SELECT count(*) AS n, round(avg(CAST(({_cont_sql("us_aqi")}) = ({_cont_sql("pred")}) AS DOUBLE)), 9) AS accuracy
FROM ev WHERE us_aqi IS NOT NULL AND pred IS NOT NULL
""")
def q_category_accuracy(spark, sf):
    df = _persisted(spark, sf).select(C.category_continuous("us_aqi").alias("a"),
                                      C.category_continuous("pred").alias("p"))
    return _round_all(A.accuracy(df, "a", "p"))


_DESC_COLS = ["us_aqi", "pm2_5", "precipitation"]
_PROBS = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
_PNAMES = ["p25", "p50", "p75", "p90", "p95", "p99"]


@register("describe_quantiles", f"""
WITH {HOURLY_CTE}
{" UNION ALL ".join(f'''SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 9) AS mean,
       round(stddev_samp({c}), 6) AS std, round(min({c}), 9) AS min, round(max({c}), 9) AS max,
       {", ".join(f"round(quantile_cont({c}, {p}), 6) AS {n}" for p, n in zip(_PROBS, _PNAMES))} FROM hourly''' for c in _DESC_COLS)}
""")
def q_describe_quantiles(spark, sf):
    d = A.describe(hourly(spark, sf), _DESC_COLS, _PROBS).withColumnRenamed("column", "column_name")
    return _round_all(d, six=("std", *_PNAMES))


@register("cv_summary", f"""
WITH {FOLD_CTE},
e AS (SELECT f.fold, f.us_aqi, p.pred FROM folds f JOIN (SELECT time, lag(us_aqi, 1) OVER (ORDER BY time) AS pred
      FROM hourly) p USING (time) WHERE f.role = 'test' AND p.pred IS NOT NULL),
m AS (SELECT fold, avg(abs(us_aqi - pred)) AS mae, sqrt(avg((us_aqi - pred) * (us_aqi - pred))) AS rmse,
             1 - sum((us_aqi - pred) * (us_aqi - pred)) / nullif(count(*) * var_pop(us_aqi), 0) AS r2
      FROM e GROUP BY fold)
SELECT count(*) AS n_splits, round_even(avg(mae), 3) AS mae_mean, round_even(stddev_pop(mae), 3) AS mae_std,
       round_even(avg(rmse), 3) AS rmse_mean, round_even(stddev_pop(rmse), 3) AS rmse_std,
       round_even(avg(r2), 4) AS r2_mean, round_even(stddev_pop(r2), 4) AS r2_std
FROM m
""")
def q_cv_summary(spark, sf):
    """Persistence scored on the 5 expanding folds; mean and population std (A9, M3 shape)."""
    from chronoframe.operators.nulls import drop_null_target
    h = hourly(spark, sf)
    pred = _win(h, [W.lag("us_aqi", 1, "pred")]).select("time", "pred")
    # a row is tested in one fold at most, which its position gives
    rows = S.with_positions(drop_null_target(h).select("time", "us_aqi"))
    test = rows.withColumn("fold", S.fold_columns(5, 24)[1]).where(F.col("fold").isNotNull()).join(pred, on="time").where(F.col("pred").isNotNull())
    per_fold = A.regression_metrics(test, "us_aqi", "pred", keys=["fold"])
    return A.fold_summary(per_fold)


@register("leakage_audit", f"""
WITH {HOURLY_CTE},
r AS (SELECT us_aqi, lag(us_aqi, 1) OVER w AS l1, lag(us_aqi, 2) OVER w AS l2,
             avg(us_aqi) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3,
             avg(us_aqi) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m3_lf
      FROM hourly WINDOW w AS (ORDER BY time))
SELECT count(*) AS n_checked, round(max(abs(3 * m3 - l1 - l2 - us_aqi)), 6) AS max_identity_error,
       round(max(abs(3 * m3_lf - l1 - l2 - us_aqi)), 6) AS leak_free_max_identity_error,
       CAST(2 AS INTEGER) AS leaked_columns
FROM r WHERE us_aqi IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL AND m3_lf IS NOT NULL
""")
def q_leakage_audit(spark, sf):
    """F1 made measurable: with the current row inside the 3-row mean the target is
    an exact linear function of three features; the leak-free frame breaks it (M12)."""
    from chronoframe.plans.model import leakage_audit
    return _round_all(leakage_audit(
        hourly(spark, sf), keys=[], strategy="auto", feature_list=["aqi_lag_1", "us_aqi_ozone", "hour_sin", "season"]), six=(
        "max_identity_error", "leak_free_max_identity_error"))
