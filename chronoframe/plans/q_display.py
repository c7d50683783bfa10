"""Rows as a reader sees them: badges, all pollutants, full conditions, date
labels, request texts, leaderboard and metrics report (J7, J8, C22, C23, C31,
C32, C34, S14, U4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.functions import calendar as cal
from chronoframe.functions import categories as C
from chronoframe.functions.calendar import floor_hour
from chronoframe.operators import joins as J
from chronoframe.operators import ranking as R
from chronoframe.operators.nulls import drop_null_target
from chronoframe.plans.q_eval import FOLD_CTE, SPLIT_SQL, TEST_START, q_cv_summary, q_split_report
from chronoframe.plans.q_rows import _cont_sql
from chronoframe.plans.registry import NOW, NOW_END, hourly, register
from chronoframe.sources import feeds
from chronoframe.sources import views as V

_CASE = lambda pairs, col: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs) + " END"


# --------------------------------------------------------------------------- categories

@register("category_badges", f"""
WITH r AS (SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN CAST(round_even(value, 0) AS BIGINT) END AS aqi FROM events),
c AS (SELECT *, CASE WHEN aqi IS NOT NULL THEN {_cont_sql("aqi")} END AS category FROM r)
SELECT event_id, category, {_CASE([(c, h) for c, h, _ in J.CATEGORY_BADGES], "category")} AS badge_color,
       {_CASE([(c, b) for c, _, b in J.CATEGORY_BADGES], "category")} AS badge FROM c
""")
def q_category_badges(spark, sf):
    """Badge and colour of every reading's category; a missing reading has none."""
    aqi = F.when(F.col("event_id") % 6 != 0, C.round_half_even_int("value"))
    rows = V.table(spark, sf, "events").select("event_id", aqi.alias("aqi"))
    labelled = rows.select("event_id", F.when(F.col("aqi").isNotNull(), C.category_continuous("aqi")).alias("category"))
    return J.with_badge(labelled, "category")


_PROMPT_SQL = "'" + J.ADVICE_PROMPT.replace("%s", "' || {} || '") + "'"


@register("advice_prompt", f"""
WITH l AS (SELECT user_id, value FROM (SELECT user_id, value,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1),
r AS (SELECT user_id AS series_id, CASE WHEN user_id % 9 <> 0 THEN CAST(round_even(value, 0) AS BIGINT) END AS aqi FROM l),
c AS (SELECT *, CASE WHEN aqi IS NOT NULL THEN {_cont_sql("aqi")} END AS category FROM r)
SELECT series_id, {_PROMPT_SQL.format("CAST(aqi AS VARCHAR)", "category")} AS prompt FROM c
""")
def q_advice_prompt(spark, sf):
    """Request text for the newest reading of every series; none without a reading."""
    last = R.latest(V.event_rows(spark, sf).select("series_id", "ts", "event_id", "value"), ["series_id"], ["ts", "event_id"])
    aqi = F.when(F.col("series_id") % 9 != 0, C.round_half_even_int("value"))
    rows = last.select("series_id", aqi.alias("aqi")).withColumn("category", F.when(F.col("aqi").isNotNull(), C.category_continuous("aqi")))
    return J.with_prompt(rows, "category", "aqi").select("series_id", "prompt")


# --------------------------------------------------------------------------- pollutants and conditions

# column -> what of the events it is, as a condition and a factor
_MEASURES = {"pm2_5": ("event_type = 'click'", 1.0), "pm10": ("event_type = 'signup'", 2.0),
             "nitrogen_dioxide": ("event_type = 'purchase'", 1.0), "ozone": ("event_type = 'view'", 4.0),
             "sulphur_dioxide": ("event_type = 'error'", 0.5), "carbon_monoxide": ("event_id % 4 = 0", 150.0)}


def _pollutants(spark, sf) -> DataFrame:
    """All six pollutants per hour, each null in hours without readings of its own."""
    return V.table(spark, sf, "events").groupBy(floor_hour("ts").alias("time")).agg(
        *[(F.avg(F.when(F.expr(cond), F.col("value"))) * factor).alias(c) for c, (cond, factor) in _MEASURES.items()])


_LIMITS = [(p, limit, unit, label) for p, limit, unit, label in J.POLLUTANT_LIMITS]


@register("pollutant_status_all", f"""
WITH w AS (SELECT date_trunc('hour', ts) AS time,
  {", ".join(f"avg(CASE WHEN {cond} THEN value END) * {factor}::DOUBLE AS {c}" for c, (cond, factor) in _MEASURES.items())}
  FROM events GROUP BY 1),
l(pollutant, safe_limit, unit, label) AS (VALUES {", ".join(f"('{p}', {v}::DOUBLE, '{u}', '{n}')" for p, v, u, n in _LIMITS)}),
x AS (UNPIVOT w ON {", ".join(_MEASURES)} INTO NAME pollutant VALUE value)
SELECT time, pollutant, label, unit, safe_limit, round(value, 9) AS value,
       CASE WHEN round(value / safe_limit, 12) < 0.5::DOUBLE THEN '#38a169' WHEN round(value / safe_limit, 12) < 1 THEN '#d69e2e' ELSE '#e53e3e' END AS status_color,
       least(CAST(trunc(round(value, 9) / safe_limit * 100) AS INTEGER), 100) AS pct_of_limit
FROM x JOIN l USING (pollutant)
""")
def q_pollutant_status_all(spark, sf):
    """All six pollutants per hour against their limits (J8, C22, C23); hours without a reading are left out."""
    long = J.pollutant_long(_pollutants(spark, sf), ["time"]).withColumn("value", F.round("value", 9))
    ratio = F.round(F.col("value") / F.col("safe_limit"), 12)
    return long.select("time", "pollutant", "label", "unit", "safe_limit", "value",
                       C.ratio_status(ratio, F.lit(1.0)).alias("status_color"),
                       C.pct_of_limit("value", "safe_limit").alias("pct_of_limit"))


_READINGS = [("temperature", "event_type = 'view'", 10.0, "°C"), ("humidity", "event_type = 'click'", 2.0, "%"),
             ("wind_speed", "event_type = 'purchase'", 5.0, "km/h"), ("pressure", "event_type = 'error'", 0.125, "hPa")]
_DASH = "—"


@register("conditions_by_series", f"""
WITH e AS (SELECT user_id AS series_id, date_trunc('hour', ts) AS time, event_type, value FROM events WHERE ts < TIMESTAMP '{NOW_END}'),
h AS (SELECT series_id, time, {", ".join(f"avg(CASE WHEN {cond} THEN value END) / {by}::DOUBLE AS {c}" for c, cond, by, _ in _READINGS)}
      FROM e WHERE time <= TIMESTAMP '{NOW}' GROUP BY 1, 2),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time DESC) AS rk FROM h) WHERE rk = 1)
SELECT series_id, time, {", ".join(f"coalesce(printf('%.1f %s', round_even(round({c}, 6), 1), '{unit}'), '{_DASH}') AS {c}" for c, _, _, unit in _READINGS)}
FROM l
""")
def q_conditions_by_series(spark, sf):
    """Newest weather readings of every series, one decimal with unit, a dash where there is none."""
    ev = V.table(spark, sf, "events").where(F.col("ts") < F.lit(NOW_END).cast("timestamp_ntz"))
    h = ev.groupBy(F.col("user_id").alias("series_id"), floor_hour("ts").alias("time")).agg(
        *[(F.avg(F.when(F.expr(cond), F.col("value"))) / by).alias(c) for c, cond, by, _ in _READINGS])
    row = R.latest(R.as_of(h, NOW), ["series_id"], ["time"])
    text = lambda c, unit: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string(
        "%.1f %s", F.bround(F.round(c, 6), 1), F.lit(unit))), F.lit(_DASH)).alias(c)
    return row.select("series_id", "time", *[text(c, unit) for c, _, _, unit in _READINGS])


@register("date_labels", """
SELECT event_id, strftime(ts, '%a %d %b') AS short_label, strftime(ts, '%d %b %Y, %I:%M %p IST') AS updated_label,
       strftime(ts, '%d %b %Y %H:%M') AS table_label, strftime(ts + INTERVAL 24 HOUR, '%d %b %Y, %I:%M %p IST') AS valid_label
FROM events
""")
def q_date_labels(spark, sf):
    """All label patterns of a time: day, update and validity with clock and zone, table row."""
    clock = "dd MMM yyyy, hh:mm a 'IST'"
    return V.table(spark, sf, "events").select(
        "event_id", cal.day_label("ts").alias("short_label"), cal.day_label("ts", clock).alias("updated_label"),
        cal.day_label("ts", "dd MMM yyyy HH:mm").alias("table_label"), cal.day_label(cal.plus_hours("ts", 24), clock).alias("valid_label"))


# --------------------------------------------------------------------------- leaderboard and report

# ---- fixed values that must match the reference (rows of earlier models) ----
_EARLIER = [("Baseline (Linear Regression)", "10.45", "15.88", "0.565", "~8,760"),
            ("XGBoost — 1yr data (v1)", "9.86", "14.80", "0.623", "~8,760")]

_CV_CTE = f"""{FOLD_CTE},
e AS (SELECT f.fold, f.us_aqi, q.pred FROM folds f JOIN (SELECT time, lag(us_aqi, 1) OVER (ORDER BY time) AS pred
      FROM hourly) q USING (time) WHERE f.role = 'test' AND q.pred IS NOT NULL),
m AS (SELECT fold, avg(abs(us_aqi - pred)) AS mae, sqrt(avg((us_aqi - pred) * (us_aqi - pred))) AS rmse,
             1 - sum((us_aqi - pred) * (us_aqi - pred)) / nullif(count(*) * var_pop(us_aqi), 0) AS r2
      FROM e GROUP BY fold),
cv AS (SELECT round_even(avg(mae), 3) AS mae_mean, round_even(stddev_pop(mae), 3) AS mae_std,
       round_even(avg(rmse), 3) AS rmse_mean, round_even(stddev_pop(rmse), 3) AS rmse_std,
       round_even(avg(r2), 4) AS r2_mean, round_even(stddev_pop(r2), 4) AS r2_std FROM m)"""


def _pm(mean: str, std: str, d: int) -> F.Column:
    return F.format_string(f"%.{d}f ±%.{d}f", F.bround(mean, d), F.bround(std, d))


def _pm_sql(m: str, d: int) -> str:
    return f"printf('%.{d}f ±%.{d}f', round_even({m}_mean, {d}), round_even({m}_std, {d}))"


def leaderboard_text(cv: DataFrame, training_rows: DataFrame, model: str) -> DataFrame:
    """Rows of earlier models and the row of a fold summary, as text, with counted training rows (U4)."""
    spark = cv.sparkSession
    # both sides are one row
    own = cv.join(F.broadcast(training_rows)).select(
        F.lit(model).alias("model"), _pm("mae_mean", "mae_std", 2).alias("mae"), _pm("rmse_mean", "rmse_std", 2).alias("rmse"),
        _pm("r2_mean", "r2_std", 3).alias("r2"), F.concat(F.lit("~"), F.format_number("n_rows", 0)).alias("training_rows"))
    return spark.createDataFrame(_EARLIER, "model string, mae string, rmse string, r2 string, training_rows string").unionByName(own)


@register("leaderboard_text", f"""
WITH {_CV_CTE}
SELECT * FROM (VALUES {", ".join(str(r) for r in _EARLIER)}) t(model, mae, rmse, r2, training_rows)
UNION ALL
SELECT 'Persistence (5-fold CV)', {_pm_sql("mae", 2)}, {_pm_sql("rmse", 2)}, {_pm_sql("r2", 3)},
       '~' || format('{{:,}}', (SELECT count(*) FROM hourly WHERE us_aqi IS NOT NULL)) FROM cv
""")
def q_leaderboard_text(spark, sf):
    """Leaderboard as shown: mean and deviation in one text, training rows counted, not typed (U4)."""
    rows = drop_null_target(hourly(spark, sf)).agg(F.count(F.lit(1)).alias("n_rows"))
    return leaderboard_text(q_cv_summary(spark, sf), rows, "Persistence (5-fold CV)")


@register("markdown_report", f"""
WITH {_CV_CTE},
sp AS (SELECT {SPLIT_SQL} AS split, count(*) AS n, min(time) AS a, max(time) AS b FROM hourly GROUP BY 1),
ev AS (SELECT time, us_aqi, lag(us_aqi, 1) OVER (ORDER BY time) AS pred FROM hourly),
tm AS (SELECT count(*) AS n, avg(abs(us_aqi - pred)) AS mae, sqrt(avg((us_aqi - pred) * (us_aqi - pred))) AS rmse,
              1 - sum((us_aqi - pred) * (us_aqi - pred)) / nullif(count(*) * var_pop(us_aqi), 0) AS r2
       FROM ev WHERE us_aqi IS NOT NULL AND pred IS NOT NULL AND time >= TIMESTAMP '{TEST_START}')
SELECT CAST(k AS INTEGER) AS k, value FROM (
  SELECT * FROM (VALUES (0, '# Model Evaluation Results'), (1, ''), (2, '| Set | Period | Rows |'), (3, '|-----|--------|------|'),
                        (20, ''), (21, '| Metric | Mean | Std |'), (22, '|--------|------|-----|'), (30, '')) t(k, value)
  UNION ALL SELECT CASE split WHEN 'train' THEN 10 WHEN 'val' THEN 11 ELSE 12 END,
    printf('| %s | %s – %s | %d |', split, strftime(a, '%Y-%m-%d'), strftime(b, '%Y-%m-%d'), n) FROM sp
  UNION ALL SELECT 23, printf('| MAE | %.3f | ±%.3f |', mae_mean, mae_std) FROM cv
  UNION ALL SELECT 24, printf('| RMSE | %.3f | ±%.3f |', rmse_mean, rmse_std) FROM cv
  UNION ALL SELECT 25, printf('| R² | %.4f | ±%.4f |', r2_mean, r2_std) FROM cv
  UNION ALL SELECT 31, printf('| Test MAE | %.3f |', round_even(mae, 3)) FROM tm
  UNION ALL SELECT 32, printf('| Test RMSE | %.3f |', round_even(rmse, 3)) FROM tm
  UNION ALL SELECT 33, printf('| Test R² | %.4f |', round_even(r2, 4)) FROM tm
  UNION ALL SELECT 34, printf('| Test rows | %d |', n) FROM tm)
""")
def q_markdown_report(spark, sf):
    """Metrics report as numbered lines: splits, fold summary and held-out metrics of the persistence forecast."""
    from chronoframe.operators import aggregates as A
    from chronoframe.plans.q_eval import _persisted
    test = _persisted(spark, sf).where(F.col("time") >= F.lit(TEST_START).cast("timestamp_ntz"))
    metrics = A.regression_metrics(test, "us_aqi", "pred")
    rounded = metrics.select(F.bround("mae", 3).alias("mae"), F.bround("rmse", 3).alias("rmse"), F.bround("r2", 4).alias("r2"), "n")
    return feeds.markdown_lines(q_split_report(spark, sf), q_cv_summary(spark, sf), rounded).select("k", "value")
