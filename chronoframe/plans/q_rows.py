"""R2 (events as many series, ``series_id = user_id``) queries: window twins for
scale, scalar classifiers, error rankings, sampling, histogram, advice lookup
(W1-W8 at scale, C14-C24, C27, C28, C32, P11, L4, L6-L8, A5, J6, J7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.functions import categories as C
from chronoframe.functions.numeric import coerce_numeric
from chronoframe.operators import aggregates as A
from chronoframe.operators import joins as J
from chronoframe.operators import ranking as R
from chronoframe.operators import windows as W
from chronoframe.plans.registry import _round_all, r9, register
from chronoframe.sources import views as V

KEYS = ["series_id"]
ORDER = ["ts", "event_id"]
WSQL = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def rows(spark, sf):
    return V.event_rows(spark, sf)


def rwin(df, exprs, strategy="auto", chunk_rows=W.DEFAULT_CHUNK_ROWS):
    return W.window_features(df, exprs, keys=KEYS, order=ORDER, strategy=strategy, chunk_rows=chunk_rows)


def _rframe(n: int) -> str:
    return f"OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@register("lag_rows", f"""
SELECT event_id, user_id AS series_id, round(lag(value, 1) {WSQL}, 9) AS value_lag_1,
       round(lag(value, 24) {WSQL}, 9) AS value_lag_24, round(lead(value, 24) {WSQL}, 9) AS value_lead_24
FROM events
""")
def q_lag_rows(spark, sf):
    """Per-series row lags/leads over every event (skew-safe halo windows)."""
    out = rwin(rows(spark, sf), [W.lag("value", 1, "value_lag_1"), W.lag("value", 24, "value_lag_24"),
                                 W.lead("value", 24, "value_lead_24")])
    return out.select("event_id", "series_id", r9("value_lag_1"), r9("value_lag_24"), r9("value_lead_24"))


_ROLL = [("mean", 24, "value_roll_mean_24", "avg"), ("std", 24, "value_roll_std_24", "stddev_samp"),
         ("min", 24, "value_roll_min_24", "min"), ("max", 24, "value_roll_max_24", "max"),
         ("sum", 6, "value_sum_6", "sum")]


@register("rolling_rows", f"""
SELECT event_id, user_id AS series_id,
       {", ".join(f"round({fn}(value) {_rframe(n)}, {6 if a == 'std' else 9}) AS {nm}" for a, n, nm, fn in _ROLL)}
FROM events
""")
def q_rolling_rows(spark, sf):
    out = rwin(rows(spark, sf), [W.rolling("value", n, a, nm) for a, n, nm, _ in _ROLL])
    return _round_all(out.select("event_id", "series_id", *[nm for _, _, nm, _ in _ROLL]),
                      six=("value_roll_std_24",))


def _cont_sql(x: str) -> str:
    return (f"CASE WHEN {x} <= 50 THEN 'Good' WHEN {x} <= 100 THEN 'Moderate' "
            f"WHEN {x} <= 150 THEN 'Unhealthy for Sensitive Groups' WHEN {x} <= 200 THEN 'Unhealthy' "
            f"WHEN {x} <= 300 THEN 'Very Unhealthy' WHEN {x} IS NOT NULL THEN 'Hazardous' END")


@register("category_cont", f"""
SELECT event_id, value, {_cont_sql("value")} AS category FROM events
""")
def q_category_cont(spark, sf):
    return rows(spark, sf).select("event_id", "value", C.category_continuous("value").alias("category"))


def _rounded_sql(x: str) -> str:
    r = f"CAST(round_even({x}, 0) AS BIGINT)"
    return (f"CASE WHEN {r} BETWEEN 0 AND 50 THEN 'Good' WHEN {r} BETWEEN 51 AND 100 THEN 'Moderate' "
            f"WHEN {r} BETWEEN 101 AND 150 THEN 'Unhealthy for Sensitive Groups' "
            f"WHEN {r} BETWEEN 151 AND 200 THEN 'Unhealthy' WHEN {r} BETWEEN 201 AND 300 THEN 'Very Unhealthy' "
            f"WHEN {r} BETWEEN 301 AND 500 THEN 'Hazardous' ELSE 'Hazardous' END")


@register("category_rounded", f"""
SELECT event_id, CAST(round_even(value, 0) AS BIGINT) AS aqi_int, {_rounded_sql("value")} AS category FROM events
""")
def q_category_rounded(spark, sf):
    return rows(spark, sf).select("event_id", C.round_half_even_int("value").alias("aqi_int"),
                                  C.category_rounded("value").alias("category"))


_BINSQL = ("CASE WHEN value > 0 AND value <= 50 THEN 'Good' WHEN value > 50 AND value <= 100 THEN 'Moderate' "
           "WHEN value > 100 AND value <= 150 THEN 'Sensitive' WHEN value > 150 AND value <= 200 THEN 'Unhealthy' "
           "WHEN value > 200 AND value <= 300 THEN 'Very Unhealthy' WHEN value > 300 AND value <= 500 THEN 'Hazardous' END")


@register("category_binned", f"""
SELECT event_id, {_BINSQL} AS category FROM events
""")
def q_category_binned(spark, sf):
    return rows(spark, sf).select("event_id", C.category_binned("value").alias("category"))


@register("confidence_band", """
SELECT event_id, CAST(round_even(value, 0) AS BIGINT) AS forecast_aqi,
       greatest(0, CAST(round_even(value, 0) AS BIGINT) - 5) AS confidence_lower,
       CAST(round_even(value, 0) AS BIGINT) + 5 AS confidence_upper,
       round(value * 0.92, 9) AS band_low, round(value * 1.08, 9) AS band_high
FROM events
""")
def q_confidence_band(spark, sf):
    """Integer forecast with the +-round(RMSE) band and the chart's x0.92 / x1.08 band."""
    df = rows(spark, sf).withColumn("forecast_aqi", C.round_half_even_int("value"))
    lo, hi = C.confidence_band("forecast_aqi")
    blo, bhi = C.multiplicative_band("value")
    return df.select("event_id", "forecast_aqi", lo.cast("bigint").alias("confidence_lower"),
                     hi.alias("confidence_upper"), F.round(blo, 9).alias("band_low"),
                     F.round(bhi, 9).alias("band_high"))


_ALERT_SQL = "CAST(round_even(value, 0) AS BIGINT)"


@register("alert_level", f"""
SELECT event_id,
       CASE WHEN {_ALERT_SQL} <= 50 THEN 'success' WHEN {_ALERT_SQL} <= 150 THEN 'warning' ELSE 'danger' END AS severity,
       CASE WHEN {_ALERT_SQL} <= 50 THEN '{C.ALERT_RULES[0][2]}'
            WHEN {_ALERT_SQL} <= 100 THEN '{C.ALERT_RULES[1][2]}'
            WHEN {_ALERT_SQL} <= 150 THEN '{C.ALERT_RULES[2][2]}'
            ELSE 'Forecast AQI of ' || CAST({_ALERT_SQL} AS VARCHAR) || ' is ' || ({_cont_sql(_ALERT_SQL)}) ||
                 '. Avoid prolonged outdoor activities. Wear N95 masks if going out.' END AS message
FROM events
""")
def q_alert_level(spark, sf):
    df = rows(spark, sf).withColumn("f", C.round_half_even_int("value"))
    sev, msg = C.alert_level("f", C.category_continuous("f"))
    return df.select("event_id", sev.alias("severity"), msg.alias("message"))


@register("kpi_class", f"""
SELECT event_id,
       CASE WHEN value < 25 THEN 'good' WHEN value < 55 THEN 'moderate' ELSE 'unhealthy' END AS pm25_class,
       CASE WHEN {_ALERT_SQL} <= 50 THEN 'good' WHEN {_ALERT_SQL} <= 100 THEN 'moderate' ELSE 'unhealthy' END AS aqi_class
FROM events
""")
def q_kpi_class(spark, sf):
    df = rows(spark, sf)
    return df.select("event_id", C.kpi_class_pm25("value").alias("pm25_class"),
                     C.kpi_class_aqi(C.round_half_even_int("value")).alias("aqi_class"))


ERR_CTE = f"""e AS (SELECT event_id, user_id AS series_id, value AS actual, lag(value, 1) {WSQL} AS predicted FROM events),
err AS (SELECT *, actual - predicted AS error, abs(actual - predicted) AS abs_err FROM e WHERE predicted IS NOT NULL)"""


def _errors(spark, sf):
    """Persistence errors per series."""
    df = rwin(rows(spark, sf), [W.lag("value", 1, "predicted")]).where(F.col("predicted").isNotNull())
    return df.select("event_id", "series_id", F.col("value").alias("actual"), "predicted",
                     (F.col("value") - F.col("predicted")).alias("error"),
                     F.abs(F.col("value") - F.col("predicted")).alias("abs_err"))


_ERR_OUT = ["event_id", "series_id", "actual", "predicted", "error", "abs_err"]


@register("best_errors", f"""
WITH {ERR_CTE}
SELECT event_id, series_id, actual, predicted, round(error, 9) AS error, round(abs_err, 9) AS abs_err
FROM (SELECT * FROM err ORDER BY abs_err, event_id LIMIT 10)
""")
def q_best_errors(spark, sf):
    """Ten smallest absolute errors, tie-broken by event id."""
    return _round_all(R.top_k(_errors(spark, sf), 10, "abs_err", ["event_id"], descending=False))


@register("worst_errors", f"""
WITH {ERR_CTE}
SELECT event_id, series_id, actual, predicted, round(error, 9) AS error, round(abs_err, 9) AS abs_err
FROM (SELECT * FROM err ORDER BY abs_err DESC, event_id LIMIT 10)
""")
def q_worst_errors(spark, sf):
    return _round_all(R.top_k(_errors(spark, sf), 10, "abs_err", ["event_id"]))


@register("worst_rows_context", f"""
WITH {ERR_CTE},
w AS (SELECT event_id, abs_err FROM err ORDER BY abs_err DESC, event_id LIMIT 10)
SELECT w.event_id, e.ts, e.event_type, e.props, round(w.abs_err, 9) AS abs_err
FROM w JOIN events e USING (event_id)
""")
def q_worst_rows_context(spark, sf):
    """Worst errors joined back to their source rows by key (J6); the 10-row side is broadcast."""
    worst = R.top_k(_errors(spark, sf), 10, "abs_err", ["event_id"]).select("event_id", r9("abs_err"))
    src = V.table(spark, sf, "events").select("event_id", "ts", "event_type", "props")
    return src.join(F.broadcast(worst), "event_id").select("event_id", "ts", "event_type", "props", "abs_err")


@register("head_n", """
SELECT event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 300
""")
def q_head_n(spark, sf):
    return R.head_n(rows(spark, sf).select("event_id", "ts", "value"), 300, ["ts", "event_id"])


@register("seeded_sample", """
SELECT event_id, value FROM events ORDER BY md5('42:' || CAST(event_id AS VARCHAR)), event_id LIMIT 2000
""")
def q_seeded_sample(spark, sf):
    """Exact-size seeded sample without replacement."""
    return R.seeded_sample(rows(spark, sf).select("event_id", "value"), 2000, "event_id", 42)


@register("histogram20", """
WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / (hi - lo) * 20), 19) END AS INTEGER) AS bin,
             lo, hi FROM events, r)
SELECT bin, round(lo + bin * ((hi - lo) / 20), 9) AS bin_lo, round(lo + (bin + 1) * ((hi - lo) / 20), 9) AS bin_hi,
       count(*) AS count
FROM b GROUP BY bin, lo, hi
""")
def q_histogram20(spark, sf):
    return _round_all(A.histogram(rows(spark, sf), "value", 20))


def _advice_case() -> str:
    parts = [f"WHEN '{k}' THEN '{v}'" for k, v in J.FALLBACK_ADVICE.items()]
    return f"CASE category {' '.join(parts)} ELSE '{J.FALLBACK_ADVICE[J.ADVICE_DEFAULT_CATEGORY]}' END"


_HDR_A, _HDR_B = J.ADVICE_HEADER.split("%s")[0], J.ADVICE_HEADER.split("%s")[1]
_HDR_C = J.ADVICE_HEADER.split("%s")[2]


@register("advice_lookup", f"""
WITH l AS (SELECT user_id, value FROM (SELECT user_id, value,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1),
c AS (SELECT user_id AS series_id, CAST(round_even(value, 0) AS BIGINT) AS aqi FROM l),
k AS (SELECT *, {_cont_sql("aqi")} AS category,
             CASE WHEN aqi <= 50 THEN '#38a169' WHEN aqi <= 100 THEN '#d69e2e' WHEN aqi <= 150 THEN '#dd6b20'
                  WHEN aqi <= 200 THEN '#e53e3e' WHEN aqi <= 300 THEN '#805ad5' ELSE '#63171b' END AS color FROM c)
SELECT series_id, aqi, category, color,
       '{_HDR_A}' || category || '{_HDR_B}' || CAST(aqi AS VARCHAR) || '{_HDR_C}' || ({_advice_case()}) AS advice
FROM k
""")
def q_advice_lookup(spark, sf):
    """Newest reading per series -> category, colour and fallback advice text."""
    last = R.latest(rows(spark, sf).select("series_id", "ts", "event_id", "value"), KEYS, ORDER)
    df = last.select("series_id", C.round_half_even_int("value").alias("aqi"))
    df = df.withColumn("category", C.category_continuous("aqi")).withColumn("color", C.category_color("aqi"))
    return J.with_advice(df, "category", "aqi").select("series_id", "aqi", "category", "color", "advice")


@register("rounding", """
SELECT event_id, round_even(value, 1) AS value_1dp, CAST(round_even(value, 0) AS BIGINT) AS value_int,
       round_even(value / 3, 2) AS third_2dp
FROM events
""")
def q_rounding(spark, sf):
    """Half-even rounding to 1 dp, integer and 2 dp (C14)."""
    df = rows(spark, sf)
    return df.select("event_id", F.bround("value", 1).alias("value_1dp"),
                     C.round_half_even_int("value").alias("value_int"),
                     F.bround(F.col("value") / 3, 2).alias("third_2dp"))


@register("coerce_numeric", """
SELECT event_id, coalesce(TRY_CAST(value AS DOUBLE), 0.0) AS value_num,
       coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k_num,
       coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) AS type_num
FROM events
""")
def q_coerce_numeric(spark, sf):
    """``to_numeric(errors='coerce').fillna(0)`` via try_cast."""
    df = rows(spark, sf).withColumn("k", F.get_json_object("props", "$.k"))
    return df.select("event_id", coerce_numeric("value").alias("value_num"), coerce_numeric("k").alias("k_num"),
                     coerce_numeric("event_type").alias("type_num"))


_IMP_FEATURES = [("value_lag_1", "lag", 1), ("value_lag_2", "lag", 2), ("value_lag_3", "lag", 3),
                 ("value_roll_mean_6", "mean", 6), ("value_roll_mean_24", "mean", 24),
                 ("value_roll_std_24", "std", 24)]


def _imp_sql(name: str, kind: str, n: int) -> str:
    if kind == "lag":
        return f"lag(value, {n}) {WSQL} AS {name}"
    fn = {"mean": "avg", "std": "stddev_samp"}[kind]
    return f"{fn}(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS {name}"


@register("topk_importance", f"""
WITH f AS (SELECT value, {", ".join(_imp_sql(*t) for t in _IMP_FEATURES)} FROM events),
c AS ({" UNION ALL ".join(f"SELECT '{nm}' AS feature, abs(corr({nm}, value)) AS importance FROM f" for nm, _, _ in _IMP_FEATURES)})
SELECT feature, round(importance, 9) AS importance,
       CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank
FROM c ORDER BY importance DESC, feature LIMIT 5
""")
def q_topk_importance(spark, sf):
    """Leak-free per-series features ranked by |corr| with the target; top 5 (L4 on a groupBy ranking)."""
    exprs = [W.lag("value", n, nm) if k == "lag" else
             W.rolling("value", n, k, nm, include_current=False) for nm, k, n in _IMP_FEATURES]
    f = rwin(rows(spark, sf), exprs)
    names = [nm for nm, _, _ in _IMP_FEATURES]
    one = f.agg(*[F.abs(F.corr(nm, "value")).alias(nm) for nm in names])  # a single pass, then one row to unpivot
    ranked = one.unpivot([], names, "feature", "importance")
    top = R.top_k(ranked, 5, "importance", ["feature"])
    from pyspark.sql import Window
    # at most 5 rows reach this window (bounded by k)
    w = Window.orderBy(F.desc("importance"), "feature")
    return top.select("feature", r9("importance"), F.row_number().over(w).cast("int").alias("rank"))


_FEAT_ROWS = ([("lag", n) for n in (1, 2, 3, 6, 12, 24, 48, 72)]
              + [("mean", n) for n in (3, 6, 12, 24, 48)] + [("std", 24), ("min", 24), ("max", 24), ("sum", 24)])


def _feat_name(kind: str, n: int) -> str:
    return f"value_lag_{n}" if kind == "lag" else f"value_roll_{kind}_{n}"


def _feat_sql(kind: str, n: int) -> str:
    if kind == "lag":
        return f"round(lag(value, {n}) {WSQL}, 9) AS {_feat_name(kind, n)}"
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum"}[kind]
    return f"round({fn}(value) {_rframe(n)}, {6 if kind == 'std' else 9}) AS {_feat_name(kind, n)}"


@register("features_rows", f"""
SELECT event_id, user_id AS series_id, {", ".join(_feat_sql(k, n) for k, n in _FEAT_ROWS)} FROM events
""")
def q_features_rows(spark, sf):
    """The full lag/rolling block of the feature table over every series in one window stage."""
    exprs = [W.lag("value", n, _feat_name(k, n)) if k == "lag" else W.rolling("value", n, k, _feat_name(k, n))
             for k, n in _FEAT_ROWS]
    out = rwin(rows(spark, sf), exprs)
    return _round_all(out.select("event_id", "series_id", *[_feat_name(k, n) for k, n in _FEAT_ROWS]),
                      six=tuple(_feat_name(k, n) for k, n in _FEAT_ROWS if k == "std"))


@register("lineitem_metrics", """
SELECT l_returnflag, l_linestatus, count(*) AS n,
       round(avg(abs(l_extendedprice * (1 - l_discount) - l_extendedprice)), 9) AS mae,
       round(sqrt(avg((l_extendedprice * (1 - l_discount) - l_extendedprice) * (l_extendedprice * (1 - l_discount) - l_extendedprice))), 9) AS rmse,
       round(1 - sum((l_extendedprice * (1 - l_discount) - l_extendedprice) * (l_extendedprice * (1 - l_discount) - l_extendedprice))
             / nullif(count(*) * var_pop(l_extendedprice * (1 - l_discount)), 0), 9) AS r2
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def q_lineitem_metrics(spark, sf):
    """MAE / RMSE / R^2 of gross price as a predictor of net revenue per status group (A7 at scale)."""
    li = V.table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.col("l_extendedprice").alias("gross"))
    return _round_all(A.regression_metrics(li, "net", "gross", keys=["l_returnflag", "l_linestatus"]))


@register("lag_rows_halo", f"""
SELECT event_id, user_id AS series_id, round(lag(value, 1) {WSQL}, 9) AS value_lag_1,
       round(lag(value, 24) {WSQL}, 9) AS value_lag_24, round(lead(value, 24) {WSQL}, 9) AS value_lead_24,
       round(avg(value) {_rframe(24)}, 9) AS value_roll_mean_24
FROM events
""")
def q_lag_rows_halo(spark, sf):
    """Same lags as ``lag_rows`` with every series treated as hot: 60-row chunks
    with a 24-row halo on each side, i.e. the skew path, checked against the
    plain window of the oracle."""
    exprs = [W.lag("value", 1, "value_lag_1"), W.lag("value", 24, "value_lag_24"),
             W.lead("value", 24, "value_lead_24"), W.rolling("value", 24, "mean", "value_roll_mean_24")]
    # rows are written on the way: only the columns that the windows read
    out = rwin(rows(spark, sf).select("event_id", "series_id", "ts", "value"), exprs, strategy="auto", chunk_rows=60)
    return out.select("event_id", "series_id", r9("value_lag_1"), r9("value_lag_24"), r9("value_lead_24"),
                      r9("value_roll_mean_24"))


@register("hourly_rollup", """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type,
       round(avg(value), 9) AS mean, max(value) AS max, count(*) AS n
FROM events GROUP BY 1, 2, 3
""")
def q_hourly_rollup(spark, sf):
    """The streaming roll-up's transformation (T2) applied to the whole table as a batch."""
    from chronoframe.streaming.rollup import hourly_rollup
    return _round_all(hourly_rollup(V.table(spark, sf, "events")))


@register("impute_rows_median", f"""
WITH f AS (SELECT event_id, user_id, lag(value, 1) {WSQL} AS value_lag_1, lag(value, 24) {WSQL} AS value_lag_24
           FROM events),
m AS (SELECT user_id, median(value_lag_1) AS m1, median(value_lag_24) AS m24 FROM f GROUP BY user_id)
SELECT f.event_id, f.user_id AS series_id, round(coalesce(f.value_lag_1, m.m1), 9) AS value_lag_1,
       round(coalesce(f.value_lag_24, m.m24), 9) AS value_lag_24
FROM f JOIN m USING (user_id)
""")
def q_impute_rows_median(spark, sf):
    """Warm-up nulls of per-series lags filled with that series' exact median (P15 per series)."""
    from chronoframe.operators.nulls import fill_with_medians
    f = rwin(rows(spark, sf), [W.lag("value", 1, "value_lag_1"), W.lag("value", 24, "value_lag_24")])
    f = f.select("event_id", "series_id", "value_lag_1", "value_lag_24")
    out = fill_with_medians(f, ["value_lag_1", "value_lag_24"], keys=KEYS)
    return out.select("event_id", "series_id", r9("value_lag_1"), r9("value_lag_24"))
