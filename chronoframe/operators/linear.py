"""Linear models from distributed cross products.

One pass adds up, per segment of the rows, the products of all columns
(:func:`cross_products`): each task keeps one small matrix per segment, and
only those matrices reach the driver (``columns^2`` numbers each).  Everything
that a linear fit needs follows from them without touching rows again: a fit on
any union of segments, a whole ridge path, several targets, or the question
which features determine the target.  Rows are read a second time only to
score them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.operators import aggregates as A
from chronoframe.operators import nulls
from chronoframe.operators import ranking as R
from chronoframe.operators import splits as S
from chronoframe.operators import windows as W
from chronoframe.session import cut_lineage


# --------------------------------------------------------------------------- cross products

@dataclass
class Gram:
    """Products of ``[1, columns - shift]`` summed over rows; grams of disjoint rows add up."""

    columns: list[str]
    shift: np.ndarray
    sums: np.ndarray

    def __add__(self, other: "Gram") -> "Gram":
        return Gram(self.columns, self.shift, self.sums + other.sums)

    @property
    def n(self) -> int:
        return int(round(self.sums[0, 0]))

    def means(self) -> np.ndarray:
        return self.shift + self.sums[0, 1:] / max(self.n, 1)

    def centred(self) -> np.ndarray:
        """Sums of squares and products about the means of these rows."""
        first = self.sums[0, 1:]
        return self.sums[1:, 1:] - np.outer(first, first) / max(self.n, 1)


def cross_products(df: DataFrame, columns: Sequence[str], segment: Column | None = None) -> dict[int, Gram]:
    """Grams of the complete rows, by the integer ``segment`` (one for all rows if none).

    A first aggregate takes the means, about which the products are formed, so
    large offsets cost no digits.  The number of segments is that of folds or
    horizons, never one that grows with the rows.
    """
    columns = list(columns)
    rows = nulls.complete_cases(df.select(*[F.col(c).cast("double").alias(c) for c in columns],
                                          (segment if segment is not None else F.lit(0)).cast("int").alias("_segment")),
                                [*columns, "_segment"])
    means = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    shift = np.array([m if m is not None else 0.0 for m in means])
    width = len(columns) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([np.ones(batch.num_rows), *(batch.column(i).to_numpy() - shift[i] for i in range(width - 1))])
            part = batch.column(width - 1).to_numpy()
            for s in np.unique(part).tolist():
                own = x[part == s]
                found[s] = found.get(s, 0.0) + own.T @ own
        if found:
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(list(found), len(i)), pa.int32()), pa.array(np.tile(i, len(found)), pa.int32()),
                 pa.array(np.tile(j, len(found)), pa.int32()), pa.array(np.concatenate([m[i, j] for m in found.values()]))],
                names=["s", "i", "j", "v"])

    sums = rows.mapInArrow(run, "s int, i int, j int, v double").groupBy("s", "i", "j").agg(F.sum("v").alias("v")).collect()
    out: dict[int, Gram] = {}
    for r in sums:
        g = out.setdefault(r["s"], Gram(columns, shift, np.zeros((width, width))))
        g.sums[r["i"], r["j"]] = g.sums[r["j"], r["i"]] = r["v"]
    return out


@dataclass
class LinearModel:
    """``prediction = intercept + sum(slope * feature)``; ``transform`` adds it like a fitted MLlib model."""

    features: list[str]
    intercept: float
    slopes: list[float] = field(default_factory=list)
    n: int = 0

    def column(self) -> Column:
        out = F.lit(self.intercept)
        for c, b in zip(self.features, self.slopes):
            out = out + F.col(c) * F.lit(b)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.column())


def solve(gram: Gram, features: Sequence[str], target: str, l2: float = 0.0) -> LinearModel:
    """Least squares of ``target`` on ``features`` with penalty ``l2`` on the slopes; the shortest one where not unique."""
    at = [gram.columns.index(c) for c in features]
    y = gram.columns.index(target)
    s, m = gram.centred(), gram.means()
    scale = np.sqrt(np.maximum(np.diag(s)[at], 0.0))
    scale[scale == 0] = 1.0
    left = s[np.ix_(at, at)] / np.outer(scale, scale) + np.diag(l2 / scale ** 2)
    slopes = np.linalg.lstsq(left, s[at, y] / scale, rcond=1e-13)[0] / scale
    return LinearModel(list(features), float(m[y] - slopes @ m[at]), [float(b) for b in slopes], gram.n)


def fit_linear(df: DataFrame, features: Sequence[str], target: str, l2: float = 0.0) -> LinearModel:
    """Closed-form fit on the complete rows (M1, M2, M5); a table without complete rows gives a constant zero."""
    grams = cross_products(df, [*features, target])
    if not grams:
        return LinearModel(list(features), 0.0, [0.0] * len(features), 0)
    return solve(grams[0], features, target, l2)


def _model_rows(df: DataFrame, models: dict[int, LinearModel], name: str, features: Sequence[str]) -> DataFrame:
    """One row per model; a fold or horizon each."""
    schema = f"{name} int, n_train long, intercept double, " + ", ".join(f"`slope_{c}` double" for c in features)
    return df.sparkSession.createDataFrame([(k, m.n, m.intercept, *m.slopes) for k, m in models.items()], schema)


def _predicted(rows: DataFrame, models: DataFrame, name: str, features: Sequence[str]) -> DataFrame:
    """Rows with the prediction of their own fold's or horizon's model (one broadcast row each)."""
    joined = rows.join(F.broadcast(models), name)
    out = F.col("intercept")
    for c in features:
        out = out + F.col(f"slope_{c}") * F.col(c)
    return joined.withColumn("prediction", out)


# --------------------------------------------------------------------------- M3

def linear_cv(df: DataFrame, features: Sequence[str], target: str, n_splits: int = 5, gap: int = 24, keys: Sequence[str] = (),
              order: Sequence[str] = ("time",), l2: float = 0.0, chunk_rows: int = W.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Expanding-window cross-validation of a linear model (M3): one row per fold.

    A row enters the training set at some fold and stays in it, so products are
    summed by that first fold in one pass and added up along the folds.  Test
    rows have one fold each; they are scored in a second pass.
    """
    clean = nulls.complete_cases(df, [*features, target])
    pos = cut_lineage(S.with_positions(clean, keys, order, chunk_rows=chunk_rows).select(*keys, *order, *dict.fromkeys([*features, target]), "pos", "n"))
    since, test = S.fold_columns(n_splits, gap)
    grams = cross_products(pos.where(since < n_splits), [*features, target], since)
    models, total = {}, None
    for fold in range(n_splits):
        own = grams.get(fold)
        total = own if total is None else total + own if own is not None else total
        if total is not None:
            models[fold] = solve(total, features, target, l2)
    table = _model_rows(df, models, "fold", features)
    tested = _predicted(pos.withColumn("fold", test).where(F.col("fold").isNotNull()), table, "fold", features)
    return table.join(A.regression_metrics(tested, target, "prediction", ["fold"]), "fold")


# --------------------------------------------------------------------------- M10

def linear_horizon_backtest(df: DataFrame, features: Sequence[str], target: str, horizons: Sequence[int] = (6, 12, 24, 48),
                            keys: Sequence[str] = (), order: Sequence[str] = ("time",), train_share: float = 0.8, l2: float = 0.0,
                            strategy: str = "auto", chunk_rows: int = W.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Direct-horizon backtest (M10): persistence and a linear model per horizon, all horizons in the same passes.

    All lead targets come from one window; every row stands once for each
    horizon whose target it has, positions count inside the horizon, and the
    products of all horizons are summed in one pass.
    """
    names = [f"_lead_{h}" for h in horizons]
    leads = W.window_features(df, [W.lead(target, h, n) for h, n in zip(horizons, names)], keys=keys, order=order, strategy=strategy)
    clean = nulls.complete_cases(leads, [*features, target])
    long = clean.select(*keys, *order, *dict.fromkeys([*features, target]), F.explode(F.array(
        *[F.struct(F.lit(h).alias("h"), F.col(n).alias("y")) for h, n in zip(horizons, names)])).alias("_t"))
    long = long.select("*", "_t.h", F.col("_t.y").alias("_y")).drop("_t").where(F.col("_y").isNotNull())
    rows = cut_lineage(S.with_positions(long, [*keys, "h"], order, chunk_rows=chunk_rows))
    train = F.col("pos") < F.floor(F.col("n") * F.lit(train_share))
    rows = rows.withColumn("_train", train).drop("pos", "n")
    grams = cross_products(rows.where("_train"), [*dict.fromkeys([*features, "_y"])], F.col("h"))
    table = _model_rows(df, {h: solve(g, features, "_y", l2) for h, g in grams.items()}, "h", features)
    tested = _predicted(rows.where("not _train"), table, "h", features)
    both = tested.select("h", "_y", F.explode(F.array(
        F.struct(F.lit("persistence").alias("method"), F.col(target).alias("p")),
        F.struct(F.lit("model").alias("method"), F.col("prediction").alias("p")))).alias("_m")).select("h", "_y", "_m.method", "_m.p")
    return A.regression_metrics(both, "_y", "p", ["h", "method"]).join(F.broadcast(table), "h")


# --------------------------------------------------------------------------- M4

def ridge_search(train: DataFrame, val: DataFrame, features: Sequence[str], target: str, penalties: Sequence[float],
                 key_col: str = "time", rungs: int = 3, seed: int = 42) -> DataFrame:
    """Search over ridge penalties (M4): ``trial``, ``l2``, ``rung``, ``n``, ``rmse``, ``best``.

    The training products are summed once and give all trials' models.  The
    validation rows are dealt into slices by a seeded hash of their key; a rung
    scores the surviving trials on the slices it adds, all of them in one pass
    (an array of predictions per row), and the worse half is dropped.  The last
    rung has seen all rows.  Ties go to the earlier trial.
    """
    gram = cross_products(train, [*features, target]).get(0)
    if gram is None:
        raise ValueError("no complete training rows")
    models = [solve(gram, features, target, l2) for l2 in penalties]
    clean = nulls.complete_cases(val, [*features, target])
    slice_ = F.position(F.substring(R.sample_key(seed, key_col), 1, 1), F.lit("0123456789abcdef")) - 1
    edges = [0] + [16 >> (rungs - 1 - r) for r in range(rungs)]
    alive, sse, seen, rung = list(range(len(models))), [0.0] * len(models), [0] * len(models), [0] * len(models)
    for r in range(rungs):
        part = clean.withColumn("_slice", slice_).where((F.col("_slice") >= edges[r]) & (F.col("_slice") < edges[r + 1]))
        scored = part.select(F.col(target).alias("_y"), F.array(*[models[t].column() for t in alive]).alias("_p"))
        error = [F.get("_p", F.lit(i)) - F.col("_y") for i in range(len(alive))]
        got = scored.agg(F.count(F.lit(1)), *[F.sum(e * e) for e in error]).first()
        for i, t in enumerate(alive):
            seen[t], sse[t], rung[t] = seen[t] + got[0], sse[t] + (got[i + 1] or 0.0), r + 1
        if r < rungs - 1:
            alive = sorted(sorted(alive, key=lambda t: (sse[t], t))[:max(1, len(alive) // 2)])
    best = min(alive, key=lambda t: (sse[t], t))
    rows = [(t, float(l2), rung[t], seen[t], (sse[t] / seen[t]) ** 0.5 if seen[t] else None, t == best) for t, l2 in enumerate(penalties)]
    return train.sparkSession.createDataFrame(rows, "trial int, l2 double, rung int, n long, rmse double, best boolean")


# --------------------------------------------------------------------------- M9, A20

def permuted_rows(df: DataFrame, features: Sequence[str], key_col: str = "time", sample_rows: int = 2000, seed: int = 42) -> DataFrame:
    """The seeded sample once as it is (``feature`` null) and once for each feature with that column permuted.

    Every feature has its own order of the sample; the i-th row gets the value
    of the i-th row in that order, which is one join of ranks for all features.
    The sample is bounded by ``sample_rows``, and so is a feature's ranking.
    """
    base = R.seeded_sample(nulls.complete_cases(df, features), sample_rows, key_col, seed)
    base = cut_lineage(base.withColumn("_i", F.row_number().over(Window.orderBy(R.sample_key(seed, key_col), key_col))))
    values = base.select("_i", F.col(key_col).alias("_k"), F.explode(F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])).alias("_f"))
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.col("feature"), F.lit(":"), F.col("_k").cast("string")))
    donors = values.select("_i", "_k", "_f.feature", "_f.value").withColumn(
        "_i", F.row_number().over(Window.partitionBy("feature").orderBy(shuffled, "_k")))
    mixed = base.join(donors.select("_i", "feature", "value"), "_i")
    mixed = mixed.withColumns({c: F.when(F.col("feature") == c, F.col("value")).otherwise(F.col(c)) for c in features}).drop("value")
    return base.withColumn("feature", F.lit(None).cast("string")).unionByName(mixed).drop("_i")


def permutation_importance(transform: Callable[[DataFrame], DataFrame], df: DataFrame, features: Sequence[str], target: str,
                           key_col: str = "time", sample_rows: int = 2000, seed: int = 42) -> DataFrame:
    """``feature``, ``rmse_increase``: error added by permuting a feature (M9), all features scored by one job."""
    # the target stays as it is, also if it is one of the features
    clean = nulls.complete_cases(df, [*features, target]).withColumn("_actual", F.col(target))
    scored = transform(permuted_rows(clean, features, key_col, sample_rows, seed))
    rmse = cut_lineage(A.regression_metrics(scored, "_actual", "prediction", ["feature"]).select("feature", "rmse"))
    base = rmse.where(F.col("feature").isNull()).select(F.col("rmse").alias("_base"))
    return rmse.where(F.col("feature").isNotNull()).join(F.broadcast(base)).select(
        "feature", (F.col("rmse") - F.col("_base")).alias("rmse_increase"))


# --------------------------------------------------------------------------- M12

def determining_features(gram: Gram, features: Sequence[str], target: str, tol: float = 1e-10) -> dict[str, float]:
    """A least set of features that determines the target exactly, with its coefficients; empty if there is none.

    The target is determined if the rank of the products does not rise with it:
    the share of its variance that all features leave is at most ``tol``.
    Features are then left out one by one, last first, while that stays so.
    """
    at = {c: gram.columns.index(c) for c in gram.columns}
    s = gram.centred()
    scale = np.sqrt(np.maximum(np.diag(s), 0.0))
    # a column whose spread is rounding noise is constant
    alive = [c for c in features if scale[at[c]] > 1e-12 * max(1.0, float(np.abs(gram.means()[at[c]]))) * max(gram.n, 1) ** 0.5]
    if not scale[at[target]]:
        return {}
    safe = np.where(scale > 0, scale, 1.0)
    r = s / np.outer(safe, safe)

    def left(chosen: list[str]) -> float:
        i, y = [at[c] for c in chosen], at[target]
        b = np.linalg.lstsq(r[np.ix_(i, i)], r[i, y], rcond=1e-13)[0]
        return float(r[y, y] - 2 * b @ r[i, y] + b @ r[np.ix_(i, i)] @ b)

    if not alive or left(alive) > tol:
        return {}
    for c in reversed(list(alive)):
        rest = [x for x in alive if x != c]
        if rest and left(rest) <= tol:
            alive = rest
    model = solve(gram, alive, target)
    return dict(zip(alive, model.slopes))


def leakage_by_rank(df: DataFrame, features: Sequence[str], target: str, tol: float = 1e-10) -> DataFrame:
    """``feature``, ``determines``, ``coefficient`` of every feature (M12); no feature determines the target in a clean table."""
    gram = cross_products(df, [*features, target]).get(0)
    found = determining_features(gram, features, target, tol) if gram is not None else {}
    return df.sparkSession.createDataFrame([(c, c in found, found.get(c)) for c in features], "feature string, determines boolean, coefficient double")
