"""Spark vs DuckDB oracle on a representative subset, on the gappy sf0.001 tables
(missing hours, sparse series), using the same comparison as scripts/oracle_check.py."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import ROOT, SF001

_spec = importlib.util.spec_from_file_location("oracle_check", os.path.join(ROOT, "scripts", "oracle_check.py"))
oc = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(oc)

KEYS = ["lag_aqi", "lag_time_aqi", "features_batch", "impute_median_pre", "cv_summary", "scenario_compare",
        "lag_rows_halo", "season_box", "tz_calendar", "time_spine", "current_conditions", "gap_fill",
        "describe_quantiles", "confusion_matrix", "worst_rows_context", "hourly_rollup"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in oc.TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    sdf = entry.queries()[key](spark, SF001)
    spdf = sdf.toPandas()
    dpdf = duck.sql(entry.oracle_sql()[key]).df()
    assert sorted(spdf.columns) == sorted(dpdf.columns)
    cols = sorted(spdf.columns)
    assert oc.rows_of(spdf, cols) == oc.rows_of(dpdf, cols)
