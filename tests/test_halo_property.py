"""Property: for any chunk size above the total look-back + look-ahead, the halo
plan returns exactly the plain per-series window (random lengths, nulls, lags)."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoframe.operators import windows as W


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lengths=st.lists(st.integers(1, 120), min_size=1, max_size=3), back=st.integers(1, 12),
       fwd=st.integers(0, 6), slack=st.integers(1, 30), seed=st.integers(0, 10_000))
def test_halo_equals_series(spark, lengths, back, fwd, slack, seed):
    rng = np.random.default_rng(seed)
    frames = []
    for i, n in enumerate(lengths):
        v = rng.uniform(0, 10, n)
        v[rng.random(n) < 0.3] = np.nan
        frames.append(pd.DataFrame({"series_id": i, "time": pd.date_range("2024-01-01", periods=n, freq="7min"),
                                    "v": v}))
    pdf = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz")) \
        .withColumn("v", F.nanvl("v", F.lit(None)))
    stage1 = [W.lag("v", back, "l"), W.rolling("v", back + 1, "mean", "m")]
    if fwd:
        stage1.append(W.lead("v", fwd, "f"))
    stages = [stage1, [W.ffill("l", 2, "lf")]]
    kw = dict(keys=["series_id"], order=["time"])
    chunk = back + 2 + fwd + slack
    a = W.window_features(df, stages, strategy="series", **kw).orderBy("series_id", "time").toPandas()
    b = W.window_features(df, stages, strategy="halo", chunk_rows=chunk, bucket=3_600_000_000, **kw)
    pd.testing.assert_frame_equal(a, b.orderBy("series_id", "time").toPandas())
