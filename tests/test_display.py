"""Texts, badges and labels on odd rows."""

import datetime as dt

from chronoframe.functions import calendar as cal
from chronoframe.operators import joins as J
from chronoframe.plans import q_display as D


def test_badge_of_known_unknown_and_null(spark):
    df = spark.createDataFrame([(1, "Good"), (2, "Odd"), (3, None), (4, "Hazardous"), (4, "Hazardous")], "id int, cat string")
    got = sorted((r.id, r.badge_color, r.badge) for r in J.with_badge(df, "cat").collect())
    assert got == [(1, "#38a169", "badge-good"), (2, None, "badge-moderate"), (3, None, None),
                   (4, "#c53030", "badge-hazardous"), (4, "#c53030", "badge-hazardous")]


def test_prompt_holds_value_and_category(spark):
    df = spark.createDataFrame([(120, "Unhealthy"), (None, "Good"), (3, None)], "aqi int, cat string")
    texts = [r.prompt for r in J.with_prompt(df, "cat", "aqi").collect()]
    assert texts[1:] == [None, None]
    assert "\nAQI: 120\nCategory: Unhealthy\n" in texts[0] and texts[0].endswith("Keep it concise and practical.")


def test_clock_labels_at_midnight_and_noon(spark):
    times = [dt.datetime(2024, 1, 5, 0, 5), dt.datetime(2024, 1, 5, 12, 0), None]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    got = [r[0] for r in df.select(cal.day_label("t", "dd MMM yyyy, hh:mm a 'IST'")).collect()]
    assert got == ["05 Jan 2024, 12:05 AM IST", "05 Jan 2024, 12:00 PM IST", None]


def test_leaderboard_text_row(spark):
    cv = spark.createDataFrame([(2.236, 0.985, 5.28, 2.3, 0.979, 0.0215)],
                               "mae_mean double, mae_std double, rmse_mean double, rmse_std double, r2_mean double, r2_std double")
    rows = spark.createDataFrame([(21115,)], "n_rows long")
    last = D.leaderboard_text(cv, rows, "own").collect()[-1]
    assert tuple(last) == ("own", "2.24 ±0.98", "5.28 ±2.30", "0.979 ±0.022", "~21,115")


def test_limits_cover_all_pollutants(spark):
    names = [p for p, *_ in J.POLLUTANT_LIMITS]
    df = spark.createDataFrame([(1, *[float(i) for i in range(6)]), (2, *[None] * 6)], "id int, " + ", ".join(f"{n} double" for n in names))
    got = J.pollutant_long(df, ["id"]).collect()
    assert sorted(r.pollutant for r in got) == sorted(names) and {r.id for r in got} == {1}
