"""Seven-day scenario walk and comparison with an external daily forecast
(A1, A15, A17, J3-J5, M11, M13, P13, P14, C14, C18, C25, C31).

The walk is a per-row higher-order ``aggregate`` over the noise array, so
each series' 7-step recursion runs inside one expression -- no driver loop,
no Python UDF.  The noise values are parameters (the reference draws them
from a seeded generator; these are the values it draws).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.functions.calendar import day_label
from chronoframe.functions.categories import category_rounded
from chronoframe.operators import ranking as R
from chronoframe.operators.keyed import join_keyed

# ---- fixed values that must match the reference ------------------------------
ALPHA = 0.6
# seeded N(0, 4) draws used by the walk, in order
NOISE = [1.9868566120449307, -0.5530572046847386, 2.59075415240277, 6.092119425632101,
         -0.9366134988933439, -0.9365478277967222, 6.316851262029566]
HISTORY_ROWS = 48
# -----------------------------------------------------------------------------


def date_spine(spark: SparkSession, start: str, days: int) -> DataFrame:
    """``days`` consecutive dates from ``start`` with ``day_offset`` 1..days."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)),
                                                      F.date_add(F.to_date(F.lit(start)), days - 1))).alias("date"))\
        .withColumn("day_offset", F.datediff("date", F.to_date(F.lit(start))) + 1)


def current_and_history(feed: DataFrame, now: str, value_col: str = "us_aqi",
                        keys: Sequence[str] = ()) -> DataFrame:
    """Per series: ``current`` = int(newest value at or before ``now``) and
    ``mu`` = mean of the last 48 rows up to it (fallback ``current`` when empty) (A17)."""
    keys = list(keys)
    past = R.as_of(feed, now)
    cur = R.latest(past.select(*keys, "time", value_col), keys).select(
        *keys, F.col(value_col).cast("int").alias("current"))
    hist = R.tail_n(past.select(*keys, "time", value_col), HISTORY_ROWS, keys)
    mu = hist.groupBy(*keys).agg(F.avg(value_col).alias("_mu"), F.count(F.lit(1)).alias("_hn"))
    if keys:
        out = join_keyed(cur, mu, keys, "left")
    else:
        out = cur.withColumn("_g", F.lit(0)).join(mu.withColumn("_g", F.lit(0)), "_g", "left").drop("_g")
    return out.select(*keys, "current",
                      F.when(F.coalesce(F.col("_hn"), F.lit(0)) > 0, F.col("_mu"))
                      .otherwise(F.col("current").cast("double")).alias("mu"))


def walk(state: DataFrame, noise: Sequence[float] = NOISE, alpha: float = ALPHA,
         keys: Sequence[str] = ()) -> DataFrame:
    """``v = max(0, round_half_even(alpha*v + (1-alpha)*mu + e, 1))`` for each noise value."""
    eps = F.array(*[F.lit(float(e)) for e in noise])
    beta = 1 - alpha
    mu = F.col("mu")
    init = F.array(F.col("current").cast("double"))

    def step(acc, e):
        v = F.element_at(acc, -1)
        nxt = F.greatest(F.lit(0.0), F.bround(v * alpha + mu * beta + e, 1))
        return F.concat(acc, F.array(nxt))

    path = F.aggregate(eps, init, step)
    return state.select(*keys, F.posexplode(F.slice(path, 2, len(noise))).alias("_i", "model_aqi")).select(
        *keys, (F.col("_i") + 1).cast("int").alias("day_offset"), "model_aqi")


def daily_max_on_spine(forecast: DataFrame, spine: DataFrame, current: DataFrame,
                       value_col: str = "us_aqi", time_col: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """Daily max of the hourly forecast on the spine dates (A1, J3), left-joined
    to the spine of each series in ``current`` (J4), forward filled without
    limit (P13, spine-sized window), then the current value (P14), rounded
    half-even to an integer (C14)."""
    keys = list(keys)
    days = forecast.select(*keys, F.to_date(time_col).alias("date"), F.col(value_col).alias("_v"))
    days = days.join(F.broadcast(spine.select("date")), "date", "left_semi")
    dmax = days.groupBy(*keys, "date").agg(F.max("_v").alias("_mx"))
    # every series gets the handful of spine dates as one array: a generator, not a join
    dates = spine.agg(F.sort_array(F.collect_list(F.struct("day_offset", "date"))).alias("_days"))
    wide = (current.select(*keys, "current").withColumn("_g", F.lit(0))
            .join(F.broadcast(dates.withColumn("_g", F.lit(0))), "_g").select(*keys, "current", F.inline("_days")))
    j = join_keyed(wide, dmax, [*keys, "date"], "left")
    # the spine is a fixed handful of dates, so a window over the dates of one series is bounded
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("_ff", F.last("_mx", ignorenulls=True).over(w))
    api = F.bround(F.coalesce(F.col("_ff"), F.col("current").cast("double")), 0).cast("bigint")
    return j.select(*keys, "date", "day_offset", api.alias("api_aqi"), F.col("_mx").isNull().cast("int").alias("is_filled"))


def compare(api: DataFrame, model: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Join by series and day offset (J5) and derive categories, delta and label."""
    j = join_keyed(api, model, [*keys, "day_offset"])
    return j.select(*keys, "date", "api_aqi", "model_aqi",
                    category_rounded("api_aqi").alias("api_category"),
                    category_rounded("model_aqi").alias("model_category"),
                    (F.col("model_aqi") - F.col("api_aqi")).alias("delta"),
                    day_label("date").alias("day_label"))


def summary(cmp: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average official / model value, max absolute delta, agreement days, per series."""
    return cmp.groupBy(*keys).agg(F.avg("api_aqi").alias("avg_api"), F.avg("model_aqi").alias("avg_model"),
                                  F.max(F.abs("delta")).alias("max_abs_delta"),
                                  F.count_if(F.col("api_category") == F.col("model_category")).alias("agree_days"))
