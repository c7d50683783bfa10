"""R3 (orders by day) calendar queries and the time-zone twin on events
(C1-C7, C10, C31, S6, J2, U1, A6, A18)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from chronoframe.functions import calendar as cal
from chronoframe.functions import encode
from chronoframe.operators import aggregates as A
from chronoframe.operators import joins as J
from chronoframe.plans.registry import _round_all, register
from chronoframe.sources import views as V

TZ = "Asia/Kolkata"


def orders(spark, sf):
    return V.orders_by_day(spark, sf)


def shifted_festival_dates(years_back: int = 25) -> list[str]:
    """The batch festival list moved into the orders' date range (year - 25)."""
    out = []
    for d in J.DIWALI_DATES + J.HOLI_DATES + J.GANESH_DATES:
        y, rest = d.split("-", 1)
        out.append(f"{int(y) - years_back}-{rest}")
    return out


_CAL_SQL = """CAST(hour({t}) AS INTEGER) AS hour, CAST(isodow({t}) - 1 AS INTEGER) AS day_of_week,
       CAST(month({t}) AS INTEGER) AS month, CAST(weekofyear({t}) AS INTEGER) AS week_of_year,
       CAST(year({t}) AS INTEGER) AS year, CAST(dayofyear({t}) AS INTEGER) AS day_of_year,
       CAST(isodow({t}) - 1 >= 5 AS INTEGER) AS is_weekend"""
_CAL_COLS = ["hour", "day_of_week", "month", "week_of_year", "year", "day_of_year", "is_weekend"]


@register("calendar", f"""
SELECT o_orderkey, {_CAL_SQL.format(t="o_orderdate")} FROM orders
""")
def q_calendar(spark, sf):
    """hour, Monday=0 weekday, month, ISO week, year, day of year, weekend."""
    return cal.with_calendar(orders(spark, sf), "o_orderdate").select("o_orderkey", *_CAL_COLS)


_CYC = [("hour", "hour({t})", 24), ("month", "month({t})", 12), ("dow", "(isodow({t}) - 1)", 7)]


@register("cyclical", f"""
SELECT o_orderkey, {", ".join(f"round(sin({2 * math.pi!r} * {e.format(t='o_orderdate')} / {p}), 9) + 0.0 AS {n}_sin, "
                              f"round(cos({2 * math.pi!r} * {e.format(t='o_orderdate')} / {p}), 9) + 0.0 AS {n}_cos" for n, e, p in _CYC)}
FROM orders
""")
def q_cyclical(spark, sf):
    df = cal.with_cyclical(cal.with_calendar(orders(spark, sf), "o_orderdate"))
    return _round_all(df.select("o_orderkey", *[f"{n}_{f}" for n, _, _ in _CYC for f in ("sin", "cos")]))


_SEASON_SQL = ("CASE WHEN month(o_orderdate) IN (6, 7, 8, 9) THEN 'monsoon' "
               "WHEN month(o_orderdate) IN (10, 11) THEN 'post_monsoon' "
               "WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' ELSE 'summer' END")


@register("season", f"""
SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month, {_SEASON_SQL} AS season FROM orders
""")
def q_season(spark, sf):
    df = orders(spark, sf).withColumn("month", F.month("o_orderdate"))
    return df.select("o_orderkey", "month", encode.season("month").alias("season"))


@register("season_onehot", f"""
WITH s AS (SELECT o_orderkey, {_SEASON_SQL} AS season FROM orders)
SELECT o_orderkey, CAST(season = 'post_monsoon' AS INTEGER) AS season_post_monsoon,
       CAST(season = 'summer' AS INTEGER) AS season_summer, CAST(season = 'winter' AS INTEGER) AS season_winter
FROM s
""")
def q_season_onehot(spark, sf):
    df = orders(spark, sf).withColumn("season", encode.season(F.month("o_orderdate")))
    return encode.season_onehot(df).select("o_orderkey", "season_post_monsoon", "season_summer", "season_winter")


@register("season_box", f"""
WITH s AS (SELECT {_SEASON_SQL} AS season, o_totalprice AS v FROM orders),
q AS (SELECT season, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
      FROM s GROUP BY season),
j AS (SELECT s.season, s.v, q.q1, q.q3, q.q3 - q.q1 AS iqr FROM s JOIN q USING (season))
SELECT q.season, round(q.q1, 6) AS q1, round(q.median, 6) AS median, round(q.q3, 6) AS q3,
       round(q.q3 - q.q1, 6) AS iqr, a.n, round(a.whisker_lo, 6) AS whisker_lo, round(a.whisker_hi, 6) AS whisker_hi,
       a.n_outliers
FROM q JOIN (SELECT season, count(*) AS n,
                    min(CASE WHEN v >= q1 - 1.5 * iqr AND v <= q3 + 1.5 * iqr THEN v END) AS whisker_lo,
                    max(CASE WHEN v >= q1 - 1.5 * iqr AND v <= q3 + 1.5 * iqr THEN v END) AS whisker_hi,
                    count(*) FILTER (WHERE NOT (v >= q1 - 1.5 * iqr AND v <= q3 + 1.5 * iqr)) AS n_outliers
             FROM j GROUP BY season) a USING (season)
""")
def q_season_box(spark, sf):
    """Box statistics of order totals per season with exact quartiles."""
    df = orders(spark, sf).withColumn("season", encode.season(F.month("o_orderdate")))
    out = A.box_stats(df, "o_totalprice", "season")
    return _round_all(out.select("season", "q1", "median", "q3", "iqr", "n", "whisker_lo", "whisker_hi",
                                 "n_outliers"), digits=6)


def _fest_sql() -> str:
    vals = ", ".join(f"(DATE '{d}')" for d in shifted_festival_dates())
    return (f"f0 AS (SELECT d FROM (VALUES {vals}) t(d)), "
            "fest AS (SELECT DISTINCT d AS date FROM (SELECT d FROM f0 UNION ALL SELECT CAST(d + INTERVAL 1 DAY AS DATE) FROM f0))")


@register("festival_days", f"""
WITH {_fest_sql()}
SELECT f.date, count(*) AS n_orders FROM fest f JOIN orders o ON CAST(o.o_orderdate AS DATE) = f.date GROUP BY f.date
""")
def q_festival_days(spark, sf):
    """Union-distinct of festival days and day+1 (U1, C10), kept where orders exist."""
    fest = J.festival_dates(spark, shifted_festival_dates())
    o = orders(spark, sf).select(F.to_date("o_orderdate").alias("date"))
    return o.join(F.broadcast(fest), "date").groupBy("date").agg(F.count(F.lit(1)).alias("n_orders"))


@register("is_festival", f"""
WITH {_fest_sql()}
SELECT o.o_orderkey, o.o_orderdate, CAST(f.date IS NOT NULL AS INTEGER) AS is_festival
FROM orders o LEFT JOIN fest f ON CAST(o.o_orderdate AS DATE) = f.date
""")
def q_is_festival(spark, sf):
    """Festival membership flag per row via a broadcast literal set."""
    fest = J.festival_dates(spark, shifted_festival_dates())
    o = orders(spark, sf).select("o_orderkey", "o_orderdate")
    return J.flag_festival(o, fest, "o_orderdate")


@register("day_label", """
SELECT o_orderkey, strftime(o_orderdate, '%a %d %b') AS day_label FROM orders
""")
def q_day_label(spark, sf):
    return orders(spark, sf).select("o_orderkey", cal.day_label("o_orderdate").alias("day_label"))


@register("tz_calendar", f"""
WITH l AS (SELECT event_id, CAST(timezone('{TZ}', timezone('UTC', ts)) AS TIMESTAMP) AS local_time FROM events)
SELECT event_id, local_time, CAST(local_time AS DATE) AS local_date,
       CAST(hour(local_time) AS INTEGER) AS hour, CAST(isodow(local_time) - 1 AS INTEGER) AS day_of_week
FROM l
""")
def q_tz_calendar(spark, sf):
    """Calendar features in an explicit zone from UTC instants."""
    ev = V.table(spark, sf, "events").select("event_id", cal.to_local("ts", TZ).alias("local_time"))
    return ev.select("event_id", "local_time", F.to_date("local_time").alias("local_date"),
                     F.hour("local_time").alias("hour"), cal.weekday0("local_time").alias("day_of_week"))
