"""The model path with a closed-form learner, checked against exact SQL.

The linear model stands beside the boosted trees of :mod:`chronoframe.plans.model`:
the same folds, splits, horizons and records, but every number has an oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.operators import linear as L
from chronoframe.operators import splits as S
from chronoframe.operators import windows as W
from chronoframe.operators import aggregates as A
from chronoframe.plans import model as M
from chronoframe.plans.registry import HOURLY_CTE, NOW, TEST_START, VAL_START, _round_all, _win, hourly, register

_NOW = f"TIMESTAMP '{NOW}'"
_LAGS_CTE = f"""{HOURLY_CTE},
lagged AS (SELECT time, us_aqi, pm2_5, lag(us_aqi, 1) OVER w AS aqi_lag_1, lag(us_aqi, 2) OVER w AS aqi_lag_2,
                  lag(us_aqi, 24) OVER w AS aqi_lag_24, lag(pm2_5, 1) OVER w AS pm25_lag_1,
                  avg(us_aqi) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean_now,
                  avg(us_aqi) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean_past
           FROM hourly WINDOW w AS (ORDER BY time))"""


def _lagged(spark, sf):
    return _win(hourly(spark, sf), [
        W.lag("us_aqi", 1, "aqi_lag_1"), W.lag("us_aqi", 2, "aqi_lag_2"), W.lag("us_aqi", 24, "aqi_lag_24"), W.lag("pm2_5", 1, "pm25_lag_1"),
        W.rolling("us_aqi", 3, "mean", "mean_now"), W.rolling("us_aqi", 3, "mean", "mean_past", include_current=False)])


#: Metrics of a prediction column, as the operators define them.
def _metric_sql(y: str, p: str) -> str:
    return (f"count(*) AS n, avg(abs({y} - {p})) AS mae, sqrt(avg(({y} - {p}) * ({y} - {p}))) AS rmse, "
            f"1 - sum(({y} - {p}) * ({y} - {p})) / nullif(count(*) * var_pop({y}), 0) AS r2")


def _two_slopes(y: str, a: str, b: str) -> str:
    """Slopes and intercept of ``y`` on two columns from their covariances."""
    det = f"(var_pop({a}) * var_pop({b}) - covar_pop({a}, {b}) * covar_pop({a}, {b}))"
    ba = f"((covar_pop({y}, {a}) * var_pop({b}) - covar_pop({y}, {b}) * covar_pop({a}, {b})) / {det})"
    bb = f"((covar_pop({y}, {b}) * var_pop({a}) - covar_pop({y}, {a}) * covar_pop({a}, {b})) / {det})"
    return f"count(*) AS n_train, {ba} AS ba, {bb} AS bb, avg({y}) - {ba} * avg({a}) - {bb} * avg({b}) AS b0"


@register("linear_cv", f"""
WITH {_LAGS_CTE},
p AS (SELECT us_aqi AS y, aqi_lag_1 AS x, row_number() OVER (ORDER BY time) - 1 AS pos, count(*) OVER () AS n
      FROM lagged WHERE us_aqi IS NOT NULL AND aqi_lag_1 IS NOT NULL),
folds AS (SELECT p.*, f.fold, n - (5 - f.fold) * (n // 6) AS start, n // 6 AS ts FROM p, (SELECT unnest(range(5)) AS fold) f),
fit AS (SELECT fold, count(*) AS n_train, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM folds WHERE pos < start - 24 GROUP BY fold),
m AS (SELECT fold, {_metric_sql("y", "(a + b * x)")} FROM folds JOIN fit USING (fold) WHERE pos >= start AND pos < start + ts GROUP BY fold)
SELECT CAST(fold AS INTEGER) AS fold, n_train, round(a, 6) AS intercept, round(b, 6) AS slope_aqi_lag_1, n, round(mae, 6) AS mae,
       round(rmse, 6) AS rmse, round(r2, 6) AS r2
FROM fit JOIN m USING (fold)
""")
def q_linear_cv(spark, sf):
    """Five expanding folds with a gap of 24: fit and test of every fold from one pass each (M3)."""
    return _round_all(L.linear_cv(_lagged(spark, sf), ["aqi_lag_1"], "us_aqi"), 6)


@register("linear_cv_two", f"""
WITH {_LAGS_CTE},
p AS (SELECT us_aqi AS y, aqi_lag_1 AS x, aqi_lag_24 AS z, row_number() OVER (ORDER BY time) - 1 AS pos, count(*) OVER () AS n
      FROM lagged WHERE us_aqi IS NOT NULL AND aqi_lag_1 IS NOT NULL AND aqi_lag_24 IS NOT NULL),
folds AS (SELECT p.*, f.fold, n - (5 - f.fold) * (n // 6) AS start, n // 6 AS ts FROM p, (SELECT unnest(range(5)) AS fold) f),
fit AS (SELECT fold, {_two_slopes("y", "x", "z")} FROM folds WHERE pos < start - 24 GROUP BY fold),
m AS (SELECT fold, {_metric_sql("y", "(b0 + ba * x + bb * z)")} FROM folds JOIN fit USING (fold)
      WHERE pos >= start AND pos < start + ts GROUP BY fold)
SELECT count(*) AS n_splits, round_even(avg(mae), 3) AS mae_mean, round_even(stddev_pop(mae), 3) AS mae_std,
       round_even(avg(rmse), 3) AS rmse_mean, round_even(stddev_pop(rmse), 3) AS rmse_std,
       round_even(avg(r2), 4) AS r2_mean, round_even(stddev_pop(r2), 4) AS r2_std
FROM m
""")
def q_linear_cv_two(spark, sf):
    """Summary over the folds of a model of two lags."""
    return A.fold_summary(L.linear_cv(_lagged(spark, sf), ["aqi_lag_1", "aqi_lag_24"], "us_aqi"))


_FIT = """fit AS (SELECT regr_slope(us_aqi, aqi_lag_1) AS b, regr_intercept(us_aqi, aqi_lag_1) AS a FROM lagged
                 WHERE us_aqi IS NOT NULL AND aqi_lag_1 IS NOT NULL AND {where})"""


@register("linear_test_metrics", f"""
WITH {_LAGS_CTE}, {_FIT.format(where=f"time < TIMESTAMP '{TEST_START}'")},
m AS (SELECT {_metric_sql("us_aqi", "(a + b * aqi_lag_1)")} FROM lagged, fit
      WHERE time >= TIMESTAMP '{TEST_START}' AND us_aqi IS NOT NULL AND aqi_lag_1 IS NOT NULL)
SELECT n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM m
""")
def q_linear_test_metrics(spark, sf):
    """Fit on train and validation rows, score the test rows once (M1, M2, M5, M6)."""
    rows = S.temporal_split(_lagged(spark, sf), VAL_START, TEST_START)
    model = L.fit_linear(rows.where("split != 'test'"), ["aqi_lag_1"], "us_aqi")
    return _round_all(A.regression_metrics(model.transform(rows.where("split = 'test'")), "us_aqi", "prediction"), 6)


@register("linear_score_latest", f"""
WITH {_LAGS_CTE}, {_FIT.format(where=f"time <= {_NOW}")},
r AS (SELECT time, us_aqi, CAST(round_even(a + b * coalesce(aqi_lag_1, 0), 0) AS BIGINT) AS p FROM lagged, fit
      WHERE time <= {_NOW} ORDER BY time DESC LIMIT 1),
h AS (SELECT time, us_aqi FROM lagged WHERE time <= {_NOW} ORDER BY time DESC LIMIT 48)
SELECT CAST(trunc(us_aqi) AS INTEGER) AS current_aqi, p AS forecast_aqi,
       CASE WHEN p <= 50 THEN 'Good' WHEN p <= 100 THEN 'Moderate' WHEN p <= 150 THEN 'Unhealthy for Sensitive Groups'
            WHEN p <= 200 THEN 'Unhealthy' WHEN p <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END AS category,
       time AS timestamp, time + INTERVAL 24 HOUR AS forecast_timestamp,
       (SELECT count(*) FROM h) AS n_history, (SELECT min(time) FROM h) AS history_first, (SELECT max(time) FROM h) AS history_last,
       (SELECT round(sum(us_aqi), 6) FROM h) AS history_sum
FROM r
""")
def q_linear_score_latest(spark, sf):
    """The prediction record of the newest row, its history summed up (M8)."""
    rows = _lagged(spark, sf)
    model = L.fit_linear(rows.where(F.col("time") <= F.lit(NOW).cast("timestamp_ntz")), ["aqi_lag_1"], "us_aqi")
    rec = M.score_latest(model, rows, ["aqi_lag_1"], NOW)
    times = F.transform("history", lambda x: x["time"])
    return rec.select("current_aqi", "forecast_aqi", "category", "timestamp", "forecast_timestamp",
                      F.size("history").cast("long").alias("n_history"), F.array_min(times).alias("history_first"),
                      F.array_max(times).alias("history_last"),
                      F.round(F.aggregate("history", F.lit(0.0), lambda a, x: a + F.coalesce(x["us_aqi"], F.lit(0.0))), 6).alias("history_sum"))


_HORIZON = """
SELECT {h} AS h, us_aqi AS x, y, row_number() OVER (ORDER BY time) - 1 AS pos, count(*) OVER () AS n
FROM (SELECT time, us_aqi, lead(us_aqi, {h}) OVER (ORDER BY time) AS y FROM hourly) WHERE us_aqi IS NOT NULL AND y IS NOT NULL"""


@register("linear_horizon_backtest", f"""
WITH {HOURLY_CTE},
p AS ({" UNION ALL ".join(_HORIZON.format(h=h) for h in (6, 12, 24, 48))}),
fit AS (SELECT h, count(*) AS n_train, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p WHERE pos < floor(n * 0.8::DOUBLE) GROUP BY h),
t AS (SELECT p.h, y, x, a + b * x AS z FROM p JOIN fit USING (h) WHERE pos >= floor(n * 0.8::DOUBLE)),
m AS (SELECT h, 'persistence' AS method, {_metric_sql("y", "x")} FROM t GROUP BY h
      UNION ALL SELECT h, 'model' AS method, {_metric_sql("y", "z")} FROM t GROUP BY h)
SELECT CAST(h AS INTEGER) AS h, method, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, n_train,
       round(a, 6) AS intercept, round(b, 6) AS slope_us_aqi
FROM m JOIN fit USING (h)
""")
def q_linear_horizon_backtest(spark, sf):
    """Horizons of 6, 12, 24 and 48 rows: persistence against a model of the current reading."""
    return _round_all(L.linear_horizon_backtest(hourly(spark, sf), ["us_aqi"], "us_aqi"), 6)


PENALTIES = [0.0, 300.0, 1000.0, 3000.0, 10000.0, 30000.0, 100000.0, 1000000.0]
_TRIALS = ", ".join(f"({i}, {p!r}::DOUBLE)" for i, p in enumerate(PENALTIES))


@register("ridge_search", f"""
WITH {_LAGS_CTE},
s AS (SELECT covar_pop(us_aqi, aqi_lag_1) * count(*) AS sxy, var_pop(aqi_lag_1) * count(*) AS sxx, avg(us_aqi) AS my, avg(aqi_lag_1) AS mx
      FROM lagged WHERE time < TIMESTAMP '{VAL_START}' AND us_aqi IS NOT NULL AND aqi_lag_1 IS NOT NULL),
t AS (SELECT trial, l2, sxy / (sxx + l2) AS b, my - sxy / (sxx + l2) * mx AS a FROM s, (VALUES {_TRIALS}) v(trial, l2)),
e AS (SELECT trial, l2, power(a + b * aqi_lag_1 - us_aqi, 2) AS e2,
             strpos('0123456789abcdef', substr(md5('42:' || strftime(time, '%Y-%m-%d %H:%M:%S')), 1, 1)) - 1 AS slice
      FROM lagged, t WHERE time >= TIMESTAMP '{VAL_START}' AND time < TIMESTAMP '{TEST_START}' AND us_aqi IS NOT NULL AND aqi_lag_1 IS NOT NULL),
r1 AS (SELECT trial, l2, count(*) AS n, sum(e2) AS sse FROM e WHERE slice < 4 GROUP BY ALL),
k1 AS (SELECT trial FROM r1 ORDER BY sse, trial LIMIT 4),
r2 AS (SELECT trial, l2, count(*) AS n, sum(e2) AS sse FROM e JOIN k1 USING (trial) WHERE slice < 8 GROUP BY ALL),
k2 AS (SELECT trial FROM r2 ORDER BY sse, trial LIMIT 2),
r3 AS (SELECT trial, l2, count(*) AS n, sum(e2) AS sse FROM e JOIN k2 USING (trial) GROUP BY ALL),
k3 AS (SELECT trial FROM r3 ORDER BY sse, trial LIMIT 1),
u AS (SELECT *, 3 AS rung FROM r3 UNION ALL SELECT *, 2 FROM r2 WHERE trial NOT IN (FROM k2) UNION ALL SELECT *, 1 FROM r1 WHERE trial NOT IN (FROM k1))
SELECT CAST(trial AS INTEGER) AS trial, l2, CAST(rung AS INTEGER) AS rung, n, round(sqrt(sse / n), 6) AS rmse, trial IN (FROM k3) AS best FROM u
""")
def q_ridge_search(spark, sf):
    """Eight penalties, halved twice over growing slices of the validation rows (M4)."""
    rows = S.temporal_split(_lagged(spark, sf), VAL_START, TEST_START)
    return _round_all(L.ridge_search(rows.where("split = 'train'"), rows.where("split = 'val'"), ["aqi_lag_1"], "us_aqi", PENALTIES), 6)


@register("permutation_importance", f"""
WITH {_LAGS_CTE},
c AS (SELECT time, strftime(time, '%Y-%m-%d %H:%M:%S') AS k, us_aqi AS y, aqi_lag_1 AS x, aqi_lag_24 AS z FROM lagged
      WHERE us_aqi IS NOT NULL AND aqi_lag_1 IS NOT NULL AND aqi_lag_24 IS NOT NULL),
fit AS (SELECT {_two_slopes("y", "x", "z")} FROM c),
s AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || k), time) AS i FROM c QUALIFY i <= 300),
dx AS (SELECT x AS v, row_number() OVER (ORDER BY md5('42:aqi_lag_1:' || k), time) AS i FROM s),
dz AS (SELECT z AS v, row_number() OVER (ORDER BY md5('42:aqi_lag_24:' || k), time) AS i FROM s),
r AS (SELECT sqrt(avg(power(b0 + ba * x + bb * z - y, 2))) AS base, sqrt(avg(power(b0 + ba * dx.v + bb * z - y, 2))) AS px,
             sqrt(avg(power(b0 + ba * x + bb * dz.v - y, 2))) AS pz FROM s JOIN dx USING (i) JOIN dz USING (i), fit)
SELECT 'aqi_lag_1' AS feature, round(px - base, 6) AS rmse_increase FROM r UNION ALL SELECT 'aqi_lag_24', round(pz - base, 6) FROM r
""")
def q_permutation_importance(spark, sf):
    """Error added by permuting a feature of a linear model, over a seeded sample."""
    rows, features = _lagged(spark, sf), ["aqi_lag_1", "aqi_lag_24"]
    model = L.fit_linear(rows, features, "us_aqi")
    return _round_all(L.permutation_importance(model.transform, rows, features, "us_aqi", sample_rows=300), 6)


_RANK_ROWS = ["aqi_lag_1", "aqi_lag_2", "pm25_lag_1"]


def _rank_sql(mean: str, label: str) -> str:
    ok = f"""(SELECT max(abs(3 * {mean} - aqi_lag_1 - aqi_lag_2 - us_aqi)) FROM lagged
              WHERE {mean} IS NOT NULL AND us_aqi IS NOT NULL AND aqi_lag_1 IS NOT NULL AND aqi_lag_2 IS NOT NULL AND pm25_lag_1 IS NOT NULL) < 1e-6"""
    return " UNION ALL ".join(
        f"SELECT '{label}' AS frame, '{c}' AS feature, {ok if v is not None else 'false'} AS determines, "
        f"CASE WHEN {ok if v is not None else 'false'} THEN {v if v is not None else 0.0}::DOUBLE END AS coefficient"
        for c, v in ((mean, 3.0), ("aqi_lag_1", -1.0), ("aqi_lag_2", -1.0), ("pm25_lag_1", None)))


@register("leakage_rank", f"WITH {_LAGS_CTE} {_rank_sql('mean_now', 'with_current')} UNION ALL {_rank_sql('mean_past', 'past_only')}")
def q_leakage_rank(spark, sf):
    """Features that determine the target, found by rank: the three of the rolling frame with the current row, none without."""
    rows = _lagged(spark, sf)
    out = [L.leakage_by_rank(rows, [mean, *_RANK_ROWS], "us_aqi").withColumn("frame", F.lit(label))
           for mean, label in (("mean_now", "with_current"), ("mean_past", "past_only"))]
    return _round_all(out[0].unionByName(out[1]), 6)
