"""Category rules, bands and golden values from the reference tests."""

from pyspark.sql import functions as F

from chronoframe.functions import categories as C
from chronoframe.functions import encode

GOLDEN = [(0, "Good"), (50, "Good"), (51, "Moderate"), (100, "Moderate"), (101, "Unhealthy for Sensitive Groups"),
          (150, "Unhealthy for Sensitive Groups"), (151, "Unhealthy"), (200, "Unhealthy"), (201, "Very Unhealthy"),
          (300, "Very Unhealthy"), (301, "Hazardous"), (500, "Hazardous")]


def _eval(spark, values, fn):
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "x double")
    return [r[0] for r in df.select(fn("x")).collect()]


def test_golden_boundaries_all_three_agree_on_integers(spark):
    vals = [v for v, _ in GOLDEN]
    exp = [c for _, c in GOLDEN]
    assert _eval(spark, vals, C.category_continuous) == exp
    assert _eval(spark, vals, C.category_rounded) == exp


def test_rules_disagree_where_the_reference_does(spark):
    vals = [50.4, -1.0, 0.0, 500.5, None]
    assert _eval(spark, vals, C.category_continuous) == ["Moderate", "Good", "Good", "Hazardous", None]
    assert _eval(spark, vals, C.category_rounded) == ["Good", "Hazardous", "Good", "Hazardous", None]  # no label for null
    assert _eval(spark, vals, C.category_binned) == ["Moderate", None, None, None, None]


def test_confidence_band_golden(spark):
    df = spark.createDataFrame([(p,) for p in [30, 75, 120, 180, 250, 1, 2, 3, 4]], "p bigint")
    lo, hi = C.confidence_band("p")
    rows = df.select("p", lo.alias("lo"), hi.alias("hi")).collect()
    for r in rows:
        assert r.lo == max(0, r.p - 5) and r.hi == r.p + 5 and r.lo >= 0 and r.lo <= r.hi


def test_half_even_integer_rounding(spark):
    assert _eval(spark, [0.5, 1.5, 2.5, -0.5], C.round_half_even_int) == [0, 2, 2, 0]


def test_wind_sector_bins(spark):
    got = _eval(spark, [0, 44.9, 45, 359.9, 360, -1, None], encode.wind_sector)
    assert got == ["N", "N", "NE", "NW", "nan", "nan", "nan"]


def test_season_mapping(spark):
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    got = [r[0] for r in df.select(encode.season("m")).orderBy("m").collect()]
    assert got == ["winter", "winter", "summer", "summer", "summer", "monsoon", "monsoon", "monsoon", "monsoon",
                   "post_monsoon", "post_monsoon", "winter"]


def test_alert_and_status(spark):
    df = spark.createDataFrame([(40,), (90,), (140,), (220,)], "f bigint")
    sev, msg = C.alert_level("f", C.category_continuous("f"))
    rows = df.select(sev, msg).collect()
    assert [r[0] for r in rows] == ["success", "warning", "warning", "danger"]
    assert rows[3][1].startswith("Forecast AQI of 220 is Very Unhealthy")
