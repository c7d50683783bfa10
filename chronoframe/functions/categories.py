"""AQI categories, bands, alerts and status classifiers.

The three category rules are deliberately separate: they disagree on
50.4, on negatives, on 0 and on values above 500.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that must match the reference ------------------------------
CATEGORY_LABELS = [
    "Good",
    "Moderate",
    "Unhealthy for Sensitive Groups",
    "Unhealthy",
    "Very Unhealthy",
    "Hazardous",
]
# upper bounds of the continuous "<=" chain; anything else is Hazardous
CONTINUOUS_UPPER = [50, 100, 150, 200, 300]
# integer ranges used after rounding (lo, hi, label); unmatched -> Hazardous
ROUNDED_RANGES = [
    (0, 50, "Good"),
    (51, 100, "Moderate"),
    (101, 150, "Unhealthy for Sensitive Groups"),
    (151, 200, "Unhealthy"),
    (201, 300, "Very Unhealthy"),
    (301, 500, "Hazardous"),
]
# right-closed evaluation bins and their short labels
BIN_EDGES = [0, 50, 100, 150, 200, 300, 500]
BIN_LABELS = ["Good", "Moderate", "Sensitive", "Unhealthy", "Very Unhealthy", "Hazardous"]
# colours by rounded AQI upper bound (<=), last one is the default
CATEGORY_COLORS = [(50, "#38a169"), (100, "#d69e2e"), (150, "#dd6b20"),
                   (200, "#e53e3e"), (300, "#805ad5")]
DEFAULT_COLOR = "#63171b"
MODEL_RMSE = 5.11
# alert levels: (upper bound inclusive, severity, message); the last branch
# interpolates the value and the category
ALERT_RULES = [
    (50, "success", "Air quality is expected to remain Good for the next 24 hours. "
                    "Safe for all activities outdoors."),
    (100, "warning", "Air quality forecast is Moderate. Unusually sensitive individuals "
                     "should consider reducing prolonged outdoor exertion."),
    (150, "warning", "Forecast is Unhealthy for Sensitive Groups. Children, elderly, and those "
                     "with respiratory conditions should limit outdoor exposure."),
]
ALERT_DANGER_TEMPLATE = ("Forecast AQI of %d is %s. Avoid prolonged outdoor activities. "
                         "Wear N95 masks if going out.")
# pollutant bar: value / limit below these bounds, else the last colour
RATIO_COLORS = [(0.5, "#38a169"), (1.0, "#d69e2e")]
RATIO_DEFAULT_COLOR = "#e53e3e"
# card classes: PM2.5 strictly below, AQI up to the bound, else the last class
PM25_CLASSES = [(25, "good"), (55, "moderate")]
AQI_CLASSES = [(50, "good"), (100, "moderate")]
CLASS_DEFAULT = "unhealthy"
# -----------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def category_continuous(col, null_label: str | None = None) -> Column:
    """``<=`` chain on the raw value (C17): 50.4 -> Moderate.

    The reference maps NaN to Hazardous because every comparison is false;
    we make the choice explicit through ``null_label`` (default: null).
    """
    x = _c(col)
    expr = None
    for upper, label in zip(CONTINUOUS_UPPER, CATEGORY_LABELS):
        expr = F.when(x <= upper, label) if expr is None else expr.when(x <= upper, label)
    expr = expr.when(x.isNotNull(), CATEGORY_LABELS[-1])
    return expr.otherwise(F.lit(null_label))


def round_half_even_int(col) -> Column:
    """Python ``int(round(x))`` (C14 / C15): banker's rounding then int."""
    return F.bround(_c(col), 0).cast("bigint")


def category_rounded(col) -> Column:
    """Round half-even to an integer, then integer ranges; default Hazardous, null for null."""
    r = round_half_even_int(col)
    expr = None
    for lo, hi, label in ROUNDED_RANGES:
        cond = (r >= lo) & (r <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return F.when(r.isNotNull(), expr.otherwise(F.lit("Hazardous")))


def category_binned(col) -> Column:
    """Right-closed bins (0,50] ... (300,500]; outside -> null."""
    x = _c(col)
    expr = None
    for lo, hi, label in zip(BIN_EDGES[:-1], BIN_EDGES[1:], BIN_LABELS):
        cond = (x > lo) & (x <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(F.lit(None).cast("string"))


def category_color(col) -> Column:
    """Colour by rounded value; null for null (C20)."""
    r = round_half_even_int(col)
    expr = None
    for upper, colour in CATEGORY_COLORS:
        expr = F.when(r <= upper, colour) if expr is None else expr.when(r <= upper, colour)
    return F.when(r.isNotNull(), expr.otherwise(DEFAULT_COLOR))


def confidence_band(pred_col, rmse: float = MODEL_RMSE) -> tuple[Column, Column]:
    """``max(0, p - round(rmse))``, ``p + round(rmse)`` (C16); ``p`` is already an integer."""
    width = int(round(rmse))
    p = _c(pred_col)
    # ``greatest`` skips nulls, so guard it: a missing forecast has no band
    return F.when(p.isNotNull(), F.greatest(F.lit(0), p - width)), p + width


def multiplicative_band(col, low: float = 0.92, high: float = 1.08) -> tuple[Column, Column]:
    """Chart band ``x*0.92`` .. ``x*1.08``."""
    return _c(col) * low, _c(col) * high


def alert_level(forecast_col, category_col) -> tuple[Column, Column]:
    """(severity, message) for a forecast integer AQI; null for null."""
    f = _c(forecast_col)
    sev = msg = None
    for upper, s, m in ALERT_RULES:
        sev = F.when(f <= upper, s) if sev is None else sev.when(f <= upper, s)
        msg = F.when(f <= upper, m) if msg is None else msg.when(f <= upper, m)
    sev = sev.otherwise("danger")
    msg = msg.otherwise(F.format_string(ALERT_DANGER_TEMPLATE, f, _c(category_col)))
    return F.when(f.isNotNull(), sev), F.when(f.isNotNull(), msg)


def _steps(x: Column, steps, default: str, inclusive: bool) -> Column:
    """First label whose bound ``x`` keeps; null for null."""
    out = F.lit(default)
    for bound, label in reversed(steps):
        out = F.when(x <= bound if inclusive else x < bound, F.lit(label)).otherwise(out)
    return F.when(x.isNotNull(), out)


def ratio_status(value_col, limit_col) -> Column:
    """Pollutant bar colour by value/limit."""
    return _steps(_c(value_col) / _c(limit_col), RATIO_COLORS, RATIO_DEFAULT_COLOR, inclusive=False)


def pct_of_limit(value_col, limit_col) -> Column:
    """``min(int(v/limit*100), 100)`` with truncation; null for null."""
    pct = (_c(value_col) / _c(limit_col) * 100).cast("int")
    return F.when(pct.isNotNull(), F.least(pct, F.lit(100)))  # ``least`` skips nulls


def kpi_class_pm25(col) -> Column:
    """PM2.5 card class."""
    return _steps(_c(col), PM25_CLASSES, CLASS_DEFAULT, inclusive=False)


def kpi_class_aqi(col) -> Column:
    """Forecast card class."""
    return _steps(_c(col), AQI_CLASSES, CLASS_DEFAULT, inclusive=True)
