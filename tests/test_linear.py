"""Linear models from cross products against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import linear as L
from chronoframe.operators import splits as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    n = 240
    x = rng.normal(size=(n, 4)) * [1, 50, 0.01, 3] + [1e6, 0, 5, -2]
    y = x @ [0.5, -0.02, 30, 1] + rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, time=pd.date_range("2024-01-01", periods=n, freq="h"))
    pdf.loc[[3, 50], "b"] = None
    pdf.loc[[9], "y"] = None
    df = spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz"))
    df = df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in "by"}).repartition(5)
    return df, pdf.dropna().reset_index(drop=True)


def plain_fit(x, y, l2=0.0):
    xm, ym = x.mean(axis=0), y.mean()
    b = np.linalg.solve((x - xm).T @ (x - xm) + l2 * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    return ym - xm @ b, b


@pytest.mark.parametrize("l2", [0.0, 25.0])
def test_fit_matches_least_squares(rows, l2):
    df, pdf = rows
    m = L.fit_linear(df, list("abcd"), "y", l2)
    a, b = plain_fit(pdf[list("abcd")].to_numpy(), pdf["y"].to_numpy(), l2)
    assert m.n == len(pdf) and m.slopes == pytest.approx(list(b), rel=1e-7) and m.intercept == pytest.approx(a, rel=1e-6)


def test_grams_of_segments_add_up(rows):
    df, _ = rows
    parts = L.cross_products(df, list("abcd"), F.hour("time"))
    whole = L.cross_products(df, list("abcd"))[0]
    total = parts[0]
    for h in range(1, 24):
        total = total + parts[h]
    assert total.n == whole.n and np.allclose(total.centred(), whole.centred(), rtol=1e-9)


def test_folds_in_closed_form_equal_the_expanded_ones(spark):
    for n, k, gap in ((50, 5, 3), (7, 5, 0), (4, 5, 1), (100, 3, 24), (31, 4, 40)):
        df = spark.range(n).withColumnRenamed("id", "time")
        want = {(r.time, r.fold, r.role) for r in S.expanding_folds(df, k, gap).collect()} if n > k else set()
        since, test = S.fold_columns(k, gap)
        got = set()
        for r in S.with_positions(df).select("time", since.alias("s"), test.alias("t")).collect():
            got |= {(r.time, f, "train") for f in range(r.s, k)} if r.s is not None else set()
            got |= {(r.time, r.t, "test")} if r.t is not None else set()
        assert got == want, (n, k, gap)


@pytest.mark.parametrize("chunk_rows", [1_000_000, 60])
def test_cv_matches_fold_by_fold(rows, chunk_rows):
    df, pdf = rows
    got = {r.fold: r for r in L.linear_cv(df, list("abcd"), "y", 5, 24, chunk_rows=chunk_rows).collect()}
    n, ts = len(pdf), len(pdf) // 6
    for i in range(5):
        start = n - (5 - i) * ts
        train, test = pdf[:start - 24], pdf[start:start + ts]
        a, b = plain_fit(train[list("abcd")].to_numpy(), train["y"].to_numpy())
        err = test["y"].to_numpy() - a - test[list("abcd")].to_numpy() @ b
        assert got[i].n_train == len(train) and got[i].n == ts
        assert got[i].mae == pytest.approx(np.abs(err).mean(), rel=1e-6) and got[i].rmse == pytest.approx(np.sqrt((err ** 2).mean()), rel=1e-6)


def test_cv_of_series_and_of_few_rows(spark, rows):
    df, _ = rows
    both = df.withColumn("s", F.lit("p")).unionByName(df.withColumn("s", F.lit(None).cast("string")))
    one = {r.fold: (r.n_train, r.n, r.rmse) for r in L.linear_cv(df, ["a", "b"], "y").collect()}
    two = {r.fold: (r.n_train, r.n, r.rmse) for r in L.linear_cv(both, ["a", "b"], "y", keys=["s"]).collect()}
    assert {k: (2 * a, 2 * b, pytest.approx(c)) for k, (a, b, c) in one.items()} == two
    assert L.linear_cv(df.limit(3), ["a"], "y").count() == 0 and L.linear_cv(df.limit(0), ["a"], "y").count() == 0


def test_backtest_matches_horizon_by_horizon(rows):
    df, pdf = rows
    full = df.where("b is not null and y is not null")
    got = {(r.h, r.method): r for r in L.linear_horizon_backtest(full, ["y", "a"], "y", (1, 7)).collect()}
    for h in (1, 7):
        y = pdf["y"].to_numpy()
        d = pdf.assign(t=np.append(y[h:], [np.nan] * h)).dropna()
        cut = int(len(d) * 0.8)
        a, b = plain_fit(d[["y", "a"]].to_numpy()[:cut], d["t"].to_numpy()[:cut])
        test = d[cut:]
        model = test["t"] - a - test[["y", "a"]].to_numpy() @ b
        assert got[h, "model"].n == len(test) and got[h, "model"].rmse == pytest.approx(np.sqrt((model ** 2).mean()), rel=1e-6)
        assert got[h, "persistence"].mae == pytest.approx((test["t"] - test["y"]).abs().mean())


def test_search_keeps_the_best_penalty(rows):
    df, _ = rows
    train, val = df.where("time < '2024-01-08'"), df.where("time >= '2024-01-08'")
    out = L.ridge_search(train, val, list("abcd"), "y", [0.0, 1.0, 1e5, 1e9], rungs=2).collect()
    rung = {r.trial: r.rung for r in out}
    assert sorted(rung.values()) == [1, 1, 2, 2] and [r.best for r in out].count(True) == 1
    best = next(r for r in out if r.best)
    assert best.n == val.dropna().count() and best.rmse == min(r.rmse for r in out if r.rung == 2)
    with pytest.raises(ValueError):
        L.ridge_search(df.limit(0), val, ["a"], "y", [0.0])


def test_permutation_moves_only_its_feature(rows):
    df, pdf = rows
    clean = df.dropna()
    mixed = L.permuted_rows(clean, list("abcd"), sample_rows=100).toPandas()
    base = mixed[mixed["feature"].isna()].set_index("time")
    assert len(base) == 100 and len(mixed) == 500
    for c in "abcd":
        own = mixed[mixed["feature"] == c].set_index("time").loc[base.index]
        assert sorted(own[c]) == sorted(base[c]) and (own[c] != base[c]).sum() > 80
        for other in set("abcd") - {c}:
            assert (own[other] == base[other]).all()
    model = L.LinearModel(["a", "b", "c", "d"], 0.0, [0.0, 0.0, 0.0, 1.0])
    gain = {r.feature: r.rmse_increase for r in L.permutation_importance(model.transform, df, list("abcd"), "d", sample_rows=100).collect()}
    assert gain["a"] == gain["b"] == gain["c"] == 0.0 and gain["d"] > 1


def test_rank_finds_planted_identities(spark, rows):
    df, _ = rows
    planted = df.withColumn("s", F.col("y") * 2 + F.col("a") - F.col("d")).withColumn("e", F.lit(4.0)).withColumn("a2", F.col("a") * 3)
    got = {r.feature: r.coefficient for r in L.leakage_by_rank(planted, ["s", "a", "b", "c", "d", "e", "a2"], "y").collect() if r.determines}
    assert got == {"s": pytest.approx(0.5), "a": pytest.approx(-0.5), "d": pytest.approx(0.5)}
    assert not any(r.determines for r in L.leakage_by_rank(df, list("abcd"), "y").collect())
    assert not any(r.determines for r in L.leakage_by_rank(df.withColumn("y", F.lit(1.0)), list("abcd"), "y").collect())
    assert not any(r.determines for r in L.leakage_by_rank(df.limit(0), list("abcd"), "y").collect())
