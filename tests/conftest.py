import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from chronoframe.session import get_session
    s = get_session("local[*]", app="chronoframe-tests", shuffle_partitions=8,
                    extra={"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def synthetic_pdf():
    """Hourly frame like the reference's unit-test fixture (seeded, no nulls)."""
    import numpy as np
    import pandas as pd
    n = 200
    rng = np.random.default_rng(42)
    return pd.DataFrame({
        "time": pd.date_range("2023-01-01", periods=n, freq="h"),
        "us_aqi": rng.uniform(20, 200, n),
        "pm2_5": rng.uniform(5, 80, n),
        "pm10": rng.uniform(10, 120, n),
        "precipitation": rng.uniform(0, 5, n),
        "wind_speed_10m": rng.uniform(0, 20, n),
        "wind_direction_10m": rng.uniform(0, 359, n),
        "relative_humidity_2m": rng.uniform(40, 95, n),
        "boundary_layer_height": rng.uniform(200, 2000, n),
        "temperature_2m": rng.uniform(20, 40, n),
        "surface_pressure": rng.uniform(990, 1020, n),
    })


@pytest.fixture(scope="session")
def synthetic(spark, synthetic_pdf):
    df = spark.createDataFrame(synthetic_pdf)
    return df.withColumn("time", df["time"].cast("timestamp_ntz"))


def tmpdir_new():
    import tempfile
    return tempfile.mkdtemp(prefix="chronoframe-test-", dir="/tmp")
