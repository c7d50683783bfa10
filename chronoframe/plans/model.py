"""Modelling dataflows on MLlib.

The learner is ``pyspark.ml.regression.GBTRegressor`` (the reference's external
boosting library is not part of this stack; MLlib has no L1/L2 leaf penalty,
so scores differ from the reference).  Everything that touches rows is a Spark job: feature assembly,
fits, scoring, metrics, fold assignment and permutation importance.  The
driver only loops over a handful of folds / search trials and holds metric
rows.
"""

from __future__ import annotations

import math
import random
from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.functions.categories import MODEL_RMSE, category_continuous, confidence_band
from chronoframe.functions.numeric import coerce_numeric
from chronoframe.operators import aggregates as A
from chronoframe.operators import nulls
from chronoframe.operators import ranking as R
from chronoframe.operators import splits as S
from chronoframe.operators import windows as W
from chronoframe.plans.features import EXCLUDE_COLUMNS, TARGET
from chronoframe.plans.scenario import HISTORY_ROWS

# reference defaults mapped onto MLlib parameters
DEFAULT_PARAMS = {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8,
                  "featureSubsetStrategy": "0.8"}
# search space (MLlib-expressible part of the reference's space)
SEARCH_SPACE = {"maxIter": (300, 1200, 100), "maxDepth": (3, 9), "stepSize": (0.01, 0.15),
                "subsamplingRate": (0.6, 1.0), "featureSubset": (0.5, 1.0), "minInstancesPerNode": (1, 10),
                "minInfoGain": (0.0, 1.0)}


# --------------------------------------------------------------------------- audit

def leakage_audit(df: DataFrame, target: str = TARGET, keys: Sequence[str] = (),
                  order: Sequence[str] = ("time",), strategy: str = "auto",
                  feature_list: Sequence[str] = ()) -> DataFrame:
    """Target-leakage audit (M12): count of excluded columns in the feature list
    and the max residual of ``y = 3*mean3 - lag1 - lag2`` with the current row
    inside / outside the rolling frame."""
    r = W.window_features(df, [W.lag(target, 1, "_l1"), W.lag(target, 2, "_l2"),
                               W.rolling(target, 3, "mean", "_m3"),
                               W.rolling(target, 3, "mean", "_m3lf", include_current=False)],
                          keys=keys, order=order, strategy=strategy)
    ok = r.where(nulls.complete_flag([target, "_l1", "_l2", "_m3lf"]))
    leaked = len([c for c in feature_list if c in EXCLUDE_COLUMNS])
    resid = lambda m: F.abs(3 * F.col(m) - F.col("_l1") - F.col("_l2") - F.col(target))
    return ok.agg(F.count(F.lit(1)).alias("n_checked"),
                  F.max(resid("_m3")).alias("max_identity_error"),
                  F.max(resid("_m3lf")).alias("leak_free_max_identity_error"),
                  F.lit(leaked).cast("int").alias("leaked_columns"))


# --------------------------------------------------------------------------- design matrix / fit

def design_matrix(df: DataFrame, feature_cols: Sequence[str], target: str = TARGET) -> DataFrame:
    """Complete cases, assembled ``features`` vector + ``label`` (M1)."""
    clean = nulls.complete_cases(df, [*feature_cols, target])
    asm = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="error")
    return asm.transform(clean.withColumn("label", F.col(target).cast("double")))


def make_regressor(params: dict | None = None, seed: int = 42) -> GBTRegressor:
    p = dict(DEFAULT_PARAMS)
    p.update(params or {})
    return GBTRegressor(featuresCol="features", labelCol="label", predictionCol="prediction", seed=seed, **p)


def fit(df: DataFrame, feature_cols: Sequence[str], target: str = TARGET, params: dict | None = None) -> PipelineModel:
    """Assemble + boosted trees as one persisted pipeline."""
    asm = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="error")
    gbt = make_regressor(params)
    clean = nulls.complete_cases(df, [*feature_cols, target]).withColumn("label", F.col(target).cast("double"))
    return Pipeline(stages=[asm, gbt]).fit(clean)


def fit_early_stopping(train: DataFrame, val: DataFrame, feature_cols: Sequence[str], target: str = TARGET,
                       params: dict | None = None, tol: float = 0.01) -> PipelineModel:
    """Fit on ``train`` while monitoring ``val`` through ``validationIndicatorCol``:
    boosting stops once the validation error stops improving by ``tol`` (M4's
    early stopping)."""
    both = (train.withColumn("_is_val", F.lit(False)).unionByName(val.withColumn("_is_val", F.lit(True)),
                                                                   allowMissingColumns=True))
    asm = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="error")
    gbt = make_regressor(params).setValidationIndicatorCol("_is_val")
    gbt._set(validationTol=tol)
    clean = nulls.complete_cases(both, [*feature_cols, target]).withColumn("label", F.col(target).cast("double"))
    return Pipeline(stages=[asm, gbt]).fit(clean)


def write_importance_csv(imp: DataFrame, path: str) -> None:
    """Importance table sink (S13): one small CSV with header, rows sorted descending."""
    imp.orderBy(F.desc("importance"), "feature").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_importance_csv(spark: SparkSession, path: str) -> DataFrame:
    """Importance table scan (S13) with an explicit schema."""
    return spark.read.schema("feature string, importance double").option("header", True).csv(path)


def save_model(model: PipelineModel, path: str, feature_list: Sequence[str]) -> None:
    """Persist the pipeline and its ordered feature list side by side."""
    model.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(i, c) for i, c in enumerate(feature_list)], "pos int, feature string") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load_model(path: str) -> tuple[PipelineModel, list[str]]:
    """Load a saved pipeline and feature list; a missing artefact is an error."""
    spark = SparkSession.getActiveSession()
    model = PipelineModel.load(f"{path}/pipeline")
    rows = spark.read.parquet(f"{path}/features").orderBy("pos").collect()  # one row per feature name
    return model, [r.feature for r in rows]


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df)


def evaluate(model: PipelineModel, df: DataFrame, feature_cols: Sequence[str], target: str = TARGET) -> DataFrame:
    """Test-set metrics as a one-row DataFrame (M6)."""
    clean = nulls.complete_cases(df, [*feature_cols, target])
    return A.regression_metrics(model.transform(clean), target, "prediction")


# --------------------------------------------------------------------------- CV / search

def cross_validate(df: DataFrame, feature_cols: Sequence[str], target: str = TARGET, params: dict | None = None,
                   n_splits: int = 5, gap: int = 24, keys: Sequence[str] = (),
                   order: Sequence[str] = ("time",)) -> tuple[DataFrame, DataFrame]:
    """Expanding-window CV with a gap (M3).  ``CrossValidator(foldCol=)`` would
    train on all other folds, which is wrong for time series, so each fold is
    its own fit.  Positions are computed once and materialised (reliable
    checkpoint); each fold is then two range filters on the position, so the
    data is never duplicated per fold.  Returns (per-fold, summary)."""
    from chronoframe.session import cut_lineage
    clean = nulls.complete_cases(df, [*feature_cols, target])
    pos = cut_lineage(S.with_positions(clean, keys, order))
    ts = F.floor(F.col("n") / (n_splits + 1))
    rows = []
    for i in range(n_splits):
        start = F.col("n") - (n_splits - i) * ts
        train = pos.where(F.col("pos") < start - gap)
        test = pos.where((F.col("pos") >= start) & (F.col("pos") < start + ts))
        m = fit(train, feature_cols, target, params)
        met = A.regression_metrics(m.transform(test), target, "prediction")
        rows.append(met.withColumn("fold", F.lit(i)))
    per_fold = rows[0]
    for r in rows[1:]:
        per_fold = per_fold.unionByName(r)
    return per_fold, A.fold_summary(per_fold)


def random_search(train: DataFrame, val: DataFrame, feature_cols: Sequence[str], target: str = TARGET,
                  n_trials: int = 10, seed: int = 42, space: dict | None = None) -> tuple[dict, float]:
    """Seeded random search minimising validation RMSE (M4; TPE itself not built).

    Each trial is a Spark fit; only the (params, rmse) pairs live on the driver.
    """
    sp = dict(SEARCH_SPACE)
    sp.update(space or {})
    rng = random.Random(seed)
    best, best_rmse = None, float("inf")
    for _ in range(n_trials):
        lo, hi, step = sp["maxIter"]
        slo, shi = sp["stepSize"]
        p = {"maxIter": rng.randrange(lo, hi + 1, step),
             "maxDepth": rng.randint(*sp["maxDepth"]),
             "stepSize": 10 ** rng.uniform(math.log10(slo), math.log10(shi)),
             "subsamplingRate": rng.uniform(*sp["subsamplingRate"]),
             "featureSubsetStrategy": str(round(rng.uniform(*sp["featureSubset"]), 3)),
             "minInstancesPerNode": rng.randint(*sp["minInstancesPerNode"]),
             "minInfoGain": rng.uniform(*sp["minInfoGain"])}
        m = fit_early_stopping(train, val, feature_cols, target, p)
        rmse = evaluate(m, val, feature_cols, target).first()["rmse"]
        if rmse is not None and rmse < best_rmse:
            best, best_rmse = p, rmse
    return best or dict(DEFAULT_PARAMS), best_rmse


def importance_table(model: PipelineModel, feature_cols: Sequence[str]) -> DataFrame:
    """Gain-type importances with names, descending."""
    gbt = model.stages[-1]
    vals = gbt.featureImportances.toArray().tolist()
    s = SparkSession.getActiveSession()
    return s.createDataFrame(list(zip(list(feature_cols), [float(v) for v in vals])),
                             "feature string, importance double").orderBy(F.desc("importance"), "feature")


def permutation_importance(model: PipelineModel, df: DataFrame, feature_cols: Sequence[str],
                           target: str = TARGET, sample_rows: int = 2000, seed: int = 42,
                           key_col: str = "time") -> DataFrame:
    """Mean-attribution re-aim (M9): RMSE increase when one feature is shuffled
    inside a seeded sample, all features in one scoring job."""
    from chronoframe.operators.linear import permutation_importance as permuted
    return permuted(model.transform, df, feature_cols, target, key_col, sample_rows, seed).orderBy(F.desc("rmse_increase"), "feature")


# --------------------------------------------------------------------------- live scoring

def score_latest(model: PipelineModel, feats: DataFrame, feature_list: Sequence[str], now: str,
                 keys: Sequence[str] = (), target: str = TARGET, rmse: float = MODEL_RMSE) -> DataFrame:
    """Newest row per series at or before ``now`` -> prediction record (M8).

    Fields: current_aqi, forecast_aqi (half-even integer), category,
    timestamp, forecast_timestamp (+24 h), confidence_lower/upper, and history:
    the last 48 readings of the series up to it, oldest first.
    """
    past = R.as_of(feats, now)
    row = R.latest(past, keys)
    # 48 rows per series meet here
    history = R.tail_n(past.select(*keys, "time", target), HISTORY_ROWS, keys).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("time", F.col(target).alias(target)))).alias("history"))
    aligned = row.select(*keys, "time", F.col(target).alias("_y"),
                         *[coerce_numeric(F.col(c)).alias(c) if c in row.columns else F.lit(0.0).alias(c)
                           for c in feature_list])
    scored = model.transform(aligned)
    pred = F.bround("prediction", 0).cast("bigint")
    lo, hi = confidence_band(pred, rmse)
    out = scored.select(*keys, F.col("_y").cast("int").alias("current_aqi"), pred.alias("forecast_aqi"),
                         category_continuous(pred).alias("category"), F.col("time").alias("timestamp"),
                         (F.col("time") + F.expr("INTERVAL 24 HOURS")).alias("forecast_timestamp"),
                         lo.alias("confidence_lower"), hi.alias("confidence_upper"))
    return nulls.attach_group_row(out, history, keys)


def direct_horizon_backtest(df: DataFrame, feature_cols: Sequence[str], horizons: Sequence[int] = (6, 12, 24, 48),
                            target: str = TARGET, params: dict | None = None, keys: Sequence[str] = (),
                            order: Sequence[str] = ("time",), strategy: str = "auto") -> DataFrame:
    """Per horizon: lead target, complete cases, positional 80/20, fit, score,
    baseline (y(t) as forecast) vs model metrics (M10)."""
    from chronoframe.session import cut_lineage
    # every horizon reads the same lead frame: materialise it once
    leads = cut_lineage(W.window_features(df, [W.lead(target, h, f"_t{h}") for h in horizons],
                                          keys=keys, order=order, strategy=strategy))
    results = []
    for h in horizons:
        d = nulls.complete_cases(leads, [*feature_cols, target, f"_t{h}"]).withColumn("_target", F.col(f"_t{h}"))
        sp = S.positional_split(d, 0.8, keys, order)
        m = fit(sp.where(F.col("split") == "train"), feature_cols, "_target", params)
        test = m.transform(sp.where(F.col("split") == "test"))
        base = A.regression_metrics(test, "_target", target).withColumn("method", F.lit("persistence"))
        mod = A.regression_metrics(test, "_target", "prediction").withColumn("method", F.lit("model"))
        results.append(base.unionByName(mod).withColumn("h", F.lit(h)))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
