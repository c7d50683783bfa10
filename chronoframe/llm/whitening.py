"""Embedding whitening by QDWH spectral divide-and-conquer.

Entries become integers, so the cross products of all vectors are exact sums
that any number of tasks can add up in any order; the covariance comes from
them by integer arithmetic, hence it is the one of centred vectors without a
rounding on the way.  Its eigenvectors are found by spectral
divide-and-conquer: the polar factor of the shifted matrix (QDWH iteration) is
its matrix sign, which gives the projector on the eigenvalues above the shift;
bases of the projector's range and of the complement split the matrix in two,
until single components are left.  The components, not the rows, are sent to
the tasks that whiten the vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import materialize

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
EPS = float(np.finfo(np.float64).eps)
#: Exact sums travel as limbs of so many bits; four of them hold any cross product of long numbers.
LIMB_BITS, LIMBS = 40, 4
LIMIT = float(1 << 62)
#: Numbers of components that are sent to the tasks at a time (32 MB).
MODEL_NUMBERS = 4_000_000
BATCH_ROWS = 4096


# --------------------------------------------------------------------------- spectral divide-and-conquer

def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley iteration."""
    n = len(a)
    scale = np.linalg.norm(a)
    x, one = a / scale, np.eye(n)
    try:
        low = min(1.0, max(EPS, 1.0 / np.linalg.norm(np.linalg.inv(x))))
    except np.linalg.LinAlgError:
        low = EPS
    for _ in range(40):
        sq = low * low
        d = (4.0 * (1.0 - sq) / (sq * sq)) ** (1.0 / 3.0)
        root = math.sqrt(1.0 + d)
        wa = root + 0.5 * math.sqrt(max(0.0, 8.0 - 4.0 * d + 8.0 * (2.0 - sq) / (sq * root)))
        wb = (wa - 1.0) ** 2 / 4.0
        wc = wa + wb - 1.0
        if wc > 100.0:
            q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, one]))
            new = (wb / wc) * x + ((wa - wb / wc) / math.sqrt(wc)) * (q[:n] @ q[n:].T)
        else:
            # x / (1 + c x'x): the Cholesky form, safe once the weights are moderate
            half = np.linalg.cholesky(one + wc * (x.T @ x))
            new = (wb / wc) * x + (wa - wb / wc) * np.linalg.solve(half.T, np.linalg.solve(half, x.T)).T
        new = (new + new.T) / 2.0
        low = min(1.0, low * (wa + wb * sq) / (1.0 + wc * sq))
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= (5.0 * EPS) ** (1.0 / 3.0) and abs(1.0 - low) <= 10.0 * EPS:
            break
    return x


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Values inside the spectrum: the diagonal's median and mean, then points ever farther to both sides."""
    diagonal = np.diag(a)
    mean = float(diagonal.mean())
    yield float(np.median(diagonal))
    yield mean
    spread = float(np.linalg.norm(a - mean * np.eye(len(a)))) / math.sqrt(len(a))
    for i in range(1, 25):
        step = spread * ((i * 0.6180339887498949) % 1.0)
        yield mean + step
        yield mean - step


def _split(a: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of two invariant subspaces; the first belongs to the larger eigenvalues."""
    n, best = len(a), None
    draw = np.random.default_rng(n).standard_normal((n, n))
    for shift in _shifts(a):
        moved = a - shift * np.eye(n)
        if not np.linalg.norm(moved):
            continue
        above = (polar_factor(moved) + np.eye(n)) / 2.0
        k = round(float(np.trace(above)))
        if not 0 < k < n:
            continue
        first = np.linalg.qr(above @ draw[:, :k])[0]
        first = np.linalg.qr(above @ first)[0]
        rest = draw[:, k:] - above @ draw[:, k:]
        for _ in range(2):
            rest = np.linalg.qr(rest - first @ (first.T @ rest))[0]
        wrong = float(np.linalg.norm(rest.T @ a @ first))
        if best is None or wrong < best[0]:
            best = (wrong, first, rest)
        if wrong <= 8.0 * EPS * size * math.sqrt(n):
            break
    if best is None:
        raise ArithmeticError("no shift splits the spectrum")
    return best[1], best[2]


def components(a: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    size = float(np.linalg.norm(a))

    def divide(b: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(b)
        diagonal = np.diag(b)
        if n == 1 or np.linalg.norm(b - np.diag(diagonal)) <= EPS * size:
            order = np.argsort(-diagonal, kind="stable")[:need]
            return diagonal[order], np.eye(n)[:, order]
        first, rest = _split(b, size)
        upper = first.T @ b @ first
        values, vectors = divide((upper + upper.T) / 2.0, min(need, len(upper)))
        found = first @ vectors
        if need > len(upper):
            lower = rest.T @ b @ rest
            more, vectors = divide((lower + lower.T) / 2.0, need - len(upper))
            values, found = np.concatenate([values, more]), np.hstack([found, rest @ vectors])
        return values, found

    values, vectors = divide((a + a.T) / 2.0, min(want, len(a)))
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# --------------------------------------------------------------------------- exact sums

def _integers(vectors: np.ndarray) -> np.ndarray:
    """``floor(64 c)`` of every entry as long (beyond 2^62 cut to that)."""
    return np.clip(np.floor(SCALE * vectors), -LIMIT, LIMIT).astype(np.int64)


def _cross(z: np.ndarray) -> np.ndarray:
    """Exact ``z'z`` as Python integers."""
    top = int(np.abs(z).max(initial=0))
    if top * top * len(z) < 1 << 53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)  # every partial sum is an exact double
    if top < 1 << 50:
        low, high = z & 0xFFFF, z >> 16  # z = high 2^16 + low
        h, l = high.astype(object), low.astype(object)
        return (h.T @ h) * (1 << 32) + (h.T @ l + l.T @ h) * (1 << 16) + l.T @ l
    f = z.astype(object)
    return f.T @ f


def _limbs(values: list[int]) -> list[list[int]]:
    """Limbs of signed numbers, least first; the last one keeps the sign."""
    mask, out = (1 << LIMB_BITS) - 1, []
    for _ in range(LIMBS - 1):
        out.append([v & mask for v in values])
        values = [v >> LIMB_BITS for v in values]
    return [*out, values]


def _by_length(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Rows of equal length as matrices; null-free arrays of doubles are expected."""
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH_ROWS):
            batch = whole.slice(at, BATCH_ROWS)
            lists = batch.column(column)
            lengths = np.diff(np.asarray(lists.offsets))
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d)) if len(lengths) and (lengths != d).any() else batch
                yield d, part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)


_SUM_SCHEMA = "d int, i int, j int, " + ", ".join(f"l{x} long" for x in range(LIMBS))


def valid_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``vec`` (doubles) of the rows whose vector is not null and has finite entries only."""
    vec = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(key).cast("long").alias("id"), vec.alias("vec")).filter(F.col("vec").isNotNull() & good & (F.size("vec") > 0))


def exact_sums(vectors: DataFrame) -> DataFrame:
    """Per length ``d``: counts (i = j = -1), sums (j = -1) and cross products (i <= j), in limbs.

    One row per task and entry before the shuffle: d (d + 3) / 2 + 1 numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for d, _, values in _by_length(batches, 0):
            z = _integers(values)
            have = found.setdefault(d, [0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)])
            have[0] += len(z)
            have[1] += (z >> 32).sum(axis=0).astype(object) * (1 << 32) + (z & 0xFFFFFFFF).sum(axis=0).astype(object)
            have[2] += _cross(z)
        for d, (n, sums, cross) in found.items():
            i, j = np.triu_indices(d)
            left, right = [-1, *range(d), *i.tolist()], [-1] * (d + 1) + j.tolist()
            limbs = _limbs([n, *sums.tolist(), *cross[i, j].tolist()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * len(left), pa.int32()), pa.array(left, pa.int32()), pa.array(right, pa.int32()),
                 *[pa.array(x, pa.int64()) for x in limbs]], names=["d", "i", "j", *[f"l{x}" for x in range(LIMBS)]])

    parts = vectors.select("vec").mapInArrow(run, _SUM_SCHEMA)
    return parts.groupBy("d", "i", "j").agg(*[F.sum(f"l{x}").alias(f"l{x}") for x in range(LIMBS)])


# --------------------------------------------------------------------------- model

@dataclass(frozen=True)
class Model:
    """Whitening of vectors of one length."""

    n: int
    sums: list[int]            # of floor(64 c), without the shift
    vectors: np.ndarray        # components as rows
    values: np.ndarray         # their eigenvalues
    explained: np.ndarray
    identity_error: float | None = None

    def usable(self) -> np.ndarray:
        """Components whose eigenvalue is above rounding: the others have no scale to divide by."""
        top = float(self.values.max(initial=0.0))
        return self.values > max(self.vectors.shape[1] * EPS * top, 0.0)

    def whiten(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Whitened components (NaN where there is no variance) and exact deviations of a matrix of vectors."""
        z, s = _integers(x), self.sums
        bound = 2 * (max((abs(v) for v in s), default=0) + self.n * (int(np.abs(z).max(initial=0)) + 1))
        if bound * bound * x.shape[1] < 1 << 62:
            t = z * self.n - np.array(s, dtype=np.int64)
            deviation = (t * t).sum(axis=1).tolist()
            y = t / self.n
        else:
            t = z.astype(object) * self.n - np.array(s, dtype=object)
            deviation = [v if v < 1 << 63 else None for v in (t * t).sum(axis=1).tolist()]
            y = np.array([[float(Fraction(int(v), self.n)) for v in row] for row in t], dtype=np.float64)
        scale = np.where(self.usable(), np.sqrt(np.where(self.usable(), self.values, 1.0)), np.nan)
        return (y @ self.vectors.T) / scale, deviation


_MODEL_SCHEMA = "d int, n long, sums array<string>, vectors array<double>, `values` array<double>, explained array<double>"


def fit(vectors: DataFrame, want: int = COMPONENTS) -> DataFrame:
    """Model rows, one per length of vector.  A task holds the d (d + 1) / 2 sums of one length, never rows."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        d = key[0].as_py()
        limbs = [group.column(f"l{x}").to_pylist() for x in range(LIMBS)]
        total = [sum(limb << (LIMB_BITS * x) for x, limb in enumerate(four)) for four in zip(*limbs, strict=True)]
        n, sums, cross = 0, [0] * d, [[0] * d for _ in range(d)]
        for i, j, v in zip(group.column("i").to_pylist(), group.column("j").to_pylist(), total, strict=True):
            if i < 0:
                n = v
            elif j < 0:
                sums[i] = v
            else:
                cross[i][j] = cross[j][i] = v
        # n^2 V = n C - S S': what centred vectors give, in integers
        cov = np.array([[(n * c - a * b) / (n * n) for c, b in zip(row, sums, strict=True)] for a, row in zip(sums, cross, strict=True)])
        trace = float(np.trace(cov))
        found, basis = components(cov, want)
        found = np.maximum(found, 0.0)
        share = found / trace if trace else np.zeros(len(found))
        return pa.table({"d": pa.array([d], pa.int32()), "n": pa.array([n], pa.int64()), "sums": pa.array([[str(v) for v in sums]]),
                         "vectors": pa.array([basis.T.ravel().tolist()], pa.list_(pa.float64())),
                         "values": pa.array([found.tolist()], pa.list_(pa.float64())),
                         "explained": pa.array([share.tolist()], pa.list_(pa.float64()))})

    return exact_sums(vectors).groupBy("d").applyInArrow(run, _MODEL_SCHEMA)


def _model_batches(models: DataFrame, room: int) -> Iterator[dict[int, Model]]:
    """Models by length, as many at a time as ``room`` numbers hold; there are at most as many as the longest vector has entries."""
    sizes = sorted((r["d"], r["s"]) for r in models.select("d", F.size("vectors").alias("s")).collect())
    while sizes:
        taken, used = [], 0
        while sizes and (not taken or used + sizes[0][1] <= room):
            d, s = sizes.pop(0)
            taken.append(d)
            used += s
        yield {r["d"]: Model(r["n"], [int(v) for v in r["sums"]], np.array(r["vectors"]).reshape(-1, r["d"]), np.array(r["values"]),
                             np.array(r["explained"])) for r in models.filter(F.col("d").isin(taken)).collect()}


def _identity_errors(vectors: DataFrame, models: dict[int, Model]) -> dict[int, float | None]:
    """Largest entry of the whitened vectors' covariance minus the identity, over components with variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for d, _, x in _by_length(batches, 0):
            w = models[d].whiten(x)[0][:, models[d].usable()]
            have = found.setdefault(d, [0.0, 0.0])
            have[0] = have[0] + w.sum(axis=0)
            have[1] = have[1] + w.T @ w
        for d, (sums, cross) in found.items():
            k = len(sums)
            rows = [(d, i, -1, v) for i, v in enumerate(sums.tolist())] + [(d, i, j, cross[i, j]) for i in range(k) for j in range(i, k)]
            yield pa.RecordBatch.from_pylist([dict(zip(("d", "i", "j", "v"), r, strict=True)) for r in rows],
                                             schema=pa.schema([("d", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())]))

    # components^2 / 2 numbers for a length, at most MODEL_NUMBERS in all
    found = (vectors.select("vec").mapInArrow(run, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect())
    sums = {(r["d"], r["i"]): r["v"] for r in found if r["j"] < 0}
    out: dict[int, float | None] = dict.fromkeys(models)
    for r in found:
        if r["j"] >= 0:
            n, d = models[r["d"]].n, r["d"]
            off = abs(r["v"] / n - sums[d, r["i"]] / n * (sums[d, r["j"]] / n) - (r["i"] == r["j"]))
            out[d] = max(out[d] or 0.0, off)
    return out


ROW_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", want: int = COMPONENTS, room: int = MODEL_NUMBERS) -> DataFrame:
    """A row for every valid vector and component, with the columns of :data:`ROW_SCHEMA`.

    Vectors that are null or hold null or non-finite entries are left out, and
    empty ones have no component.  Rows without a key and repeated rows count
    like others.  Vectors of different lengths are spaces of their own.  Where
    a component has no variance (eigenvalue at rounding level, as in one row or
    equal rows) ``whitened`` is null; ``deviation`` is null where it exceeds a
    long.  An empty table gives no rows; other columns are not read.
    """
    vectors = materialize(valid_vectors(rows, key, vector), "vectors")
    models = materialize(fit(vectors, want), "model")
    out = rows.sparkSession.createDataFrame([], ROW_SCHEMA)
    for batch in _model_batches(models, room):
        own = vectors.filter(F.size("vec").isin(list(batch)))
        errors = _identity_errors(own, batch)
        out = out.unionByName(own.mapInArrow(_whitener(batch, errors), ROW_SCHEMA))
    return out


def _whitener(models: dict[int, Model], errors: dict[int, float | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, part, x in _by_length(batches, 1):
            model = models[d]
            w, deviation = model.whiten(x)
            rows, k = w.shape
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n, dtype=np.int64)),
                 pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                 pa.array(w.ravel(), pa.float64(), from_pandas=True), pa.array(np.tile(model.explained, rows)),
                 pa.array([errors[d]] * (rows * k), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run
