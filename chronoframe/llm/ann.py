"""Approximate nearest neighbours by cross-polytope hashing.

Every table turns unit vectors by its own pseudo-rotations (three rounds of
random signs and a fast Hadamard transform) and assigns them to the nearest
signed axis of each; the axes together are the bucket.  The number of rotations
follows the number of vectors, so a bucket keeps about one to two of them at
any size.  Queries probe, in each table, the buckets whose axes they miss by
least; the vectors looked at grow with the 0.4th power of the table, so the
share of it that is scored falls as it grows.  Candidates are scored exactly, in
double precision, where their bucket lies, and only the best of each group of
buckets leave it.

Equal vectors are one class in the index, so a vector with any number of
copies costs one entry; a class keeps its smallest keys, as ties go to those.
Groups of buckets and their queries are split by salt above a bound.  Vectors
of all lengths go through one plan: length and number of its vectors travel
with each row, and the settings are worked out from them where they are needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.common import materialize

#: Tables, rows of a group of buckets, classes to a bucket, and classes to look at in one table of 10,000.
TABLES, GROUP_ROWS, BUCKET_ROWS, LOOK = 40, 4096, 1, 32


@dataclass(frozen=True)
class Settings:
    width: int                # padded to a power of two
    axes: tuple[int, ...]     # signed axes of each rotation
    probes: int
    inner: int                # buckets of a group

    @property
    def buckets(self) -> int:
        return math.prod(self.axes)


@lru_cache(maxsize=1024)
def settings(classes: int, dim: int) -> Settings:
    """Rotations until a bucket holds ``BUCKET_ROWS`` to twice as many classes, and the probes for them."""
    width = 1 << max(dim - 1, 1).bit_length()
    left, axes = max(2.0, classes / BUCKET_ROWS), []
    while left >= 2:
        axes.append(min(2 * width, 1 << int(math.log2(left))))
        left /= axes[-1]
    buckets, inner = math.prod(axes), 1
    for n in reversed(axes[1:]):
        if inner * n * classes > GROUP_ROWS * buckets:
            break
        inner *= n
    look = LOOK * (classes / 10_000) ** 0.4
    return Settings(width, tuple(axes), min(buckets, math.ceil(max(look, 8.0) * buckets / classes)), inner)


def _rotate(x: np.ndarray, seed: list[int]) -> np.ndarray:
    rng = np.random.default_rng(seed)
    n, d = x.shape
    for _ in range(3):
        x = x * rng.choice(np.array([-1.0, 1.0]), d)
        h = 1
        while h < d:
            y = x.reshape(n, -1, 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
            h *= 2
        x = x / math.sqrt(d)
    return x


def _signed(x: np.ndarray) -> np.ndarray:
    """Column 2i and 2i+1: how far a row points along axis i, and against it."""
    return np.stack([x, -x], axis=2).reshape(len(x), -1)


def _unit(x: np.ndarray, width: int) -> np.ndarray:
    # scaled first, so that neither huge nor tiny components overflow the norm
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _axes(x: np.ndarray, s: Settings, table: int) -> Iterator[np.ndarray]:
    """Scores of the signed axes under each rotation of a table."""
    for j, n in enumerate(s.axes):
        yield _signed(_rotate(x, [table, j])[:, : n // 2])


def bucket(x: np.ndarray, s: Settings, table: int) -> np.ndarray:
    """Bucket of every row: its nearest signed axes, read as the digits of a number."""
    code = np.zeros(len(x), np.int64)
    for a in _axes(x, s, table):
        code = code * a.shape[1] + a.argmax(axis=1)
    return code


def _least(cost: np.ndarray, n: int) -> np.ndarray:
    return np.argpartition(cost, n - 1, axis=1)[:, :n] if n < cost.shape[1] else np.broadcast_to(np.arange(cost.shape[1]), cost.shape)


def probe(x: np.ndarray, s: Settings, table: int) -> np.ndarray:
    """For every row the ``s.probes`` buckets that it misses by least, in no order.

    The best sums over some rotations begin with best sums over fewer of them,
    so each rotation extends the best beginnings only.
    """
    cost, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for a in _axes(x, s, table):
        miss = (a.max(axis=1, keepdims=True) - a) ** 2
        axis = _least(miss, min(s.probes, a.shape[1]))
        total = (cost[:, :, None] + np.take_along_axis(miss, axis, 1)[:, None, :]).reshape(len(x), -1)
        codes = (code[:, :, None] * a.shape[1] + axis[:, None, :]).reshape(len(x), -1)
        near = _least(total, min(s.probes, total.shape[1]))
        cost, code = np.take_along_axis(total, near, 1), np.take_along_axis(codes, near, 1)
    return code


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with largest component 1, and their norms."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, np.sqrt((x * x).sum(axis=1))


def valid_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id``, ``vec`` of the vectors that take part, each pair once."""
    v = F.col("vec")
    fine = (v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec")).filter(
        F.col("id").isNotNull() & F.coalesce(fine, F.lit(False))).distinct()


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else pc.list_flatten(column).to_numpy()
    return flat.astype(np.float64).reshape(len(column), -1)


def _by_length(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[tuple[pa.RecordBatch, Settings]]:
    """Parts of the batches with vectors of one length, of at most about ``cells`` numbers, and their settings."""
    for batch in batches:
        for d in pc.unique(batch.column("d")).to_pylist():
            own = batch.filter(pc.equal(batch.column("d"), d))
            s = settings(own.column("n")[0].as_py(), d)
            step = max(1, cells // max(s.width, s.probes * min(s.probes, 2 * s.width)))
            for at in range(0, own.num_rows, step):
                yield own.slice(at, step), s


_CELLS = 1 << 20


def _index(classes: DataFrame, tables: int, kind: str) -> DataFrame:
    """Bucket of every class in every table, as one row for each pair of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, s in _by_length(batches, _CELLS):
            x = _unit(_matrix(part.column("vec")), s.width)
            code = np.stack([bucket(x, s, t) for t in range(tables)], axis=1).ravel()
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays(
                [part.column("d"), part.column("cid"), part.column("low"), part.column("vec"),
                 pa.ListArray.from_arrays(ends, pa.array(code // s.inner)), pa.ListArray.from_arrays(ends, pa.array(code % s.inner))],
                names=["d", "cid", "low", "vec", "areas", "fines"])

    # written once, as sizes and rows of the groups are both read from it; hashes travel without copies of the vectors
    codes = materialize(classes.select("d", "n", "cid", "low", "vec").mapInArrow(
        run, f"d int, cid long, low long, vec {kind}, areas array<long>, fines array<long>"), "codes")
    return codes.select("d", "cid", "low", "vec", F.posexplode(F.arrays_zip("areas", "fines")).alias("table", "at")).select(
        "d", "table", F.col("at.areas").alias("area"), F.col("at.fines").alias("fine"), "cid", "low", "vec")


def _probes(queries: DataFrame, tables: int, kind: str) -> DataFrame:
    """Groups of buckets that a query looks into in a table, with its buckets there, as one row for each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, s in _by_length(batches, _CELLS):
            x = _unit(_matrix(part.column("vec")), s.width)
            for t in range(tables):
                code = np.sort(probe(x, s, t), axis=1)
                area, who = (code // s.inner).ravel(), np.repeat(np.arange(len(x)), code.shape[1])
                first = np.flatnonzero(np.r_[True, (area[1:] != area[:-1]) | (who[1:] != who[:-1])])
                fines = pa.ListArray.from_arrays(pa.array(np.r_[first, len(area)].astype(np.int32)), pa.array((code % s.inner).ravel()))
                ends = pa.array(np.searchsorted(who[first], np.arange(len(x) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("d"), pa.array(np.full(len(x), t, np.int32)), part.column("cid"), part.column("vec"),
                     pa.ListArray.from_arrays(ends, pa.array(area[first])), pa.ListArray.from_arrays(ends, fines)],
                    names=["d", "table", "qid", "vec", "areas", "fines"])

    looks = materialize(queries.select("d", "n", "cid", "vec").mapInArrow(
        run, f"d int, table int, qid long, vec {kind}, areas array<long>, fines array<array<long>>"), "looks")
    return looks.select("d", "table", "qid", "vec", F.explode(F.arrays_zip("areas", "fines")).alias("at")).select(
        "d", "table", F.col("at.areas").alias("area"), F.col("at.fines").alias("fines"), "qid", "vec")


def _rerank(members: DataFrame, probes: DataFrame, keep: int) -> DataFrame:
    """``qid``, ``cid``, ``low``, ``score``: the best ``keep`` classes of each query in each group of buckets."""
    place = ["d", "table", "area"]
    size = lambda df, n: df.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias(n))
    # only groups to be split are listed, a place that isn't has one part; written, so that the planner knows their size
    ms = materialize(size(members, "ms").filter("ms > 1"), "member-parts")
    qs = materialize(size(probes, "qs").filter("qs > 1"), "query-parts")
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    both = lambda df: df.join(qs, place, "left").join(ms, place, "left").withColumns({"ms": one("ms"), "qs": one("qs")})
    left = (both(members).withColumn("mi", F.pmod(F.xxhash64("cid"), "ms").cast("int"))
            .withColumn("qi", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
            .select(*place, "mi", "qi", "fine", "cid", "low", "vec"))
    right = (both(probes).withColumn("qi", F.pmod(F.xxhash64("qid"), "qs").cast("int"))
             .withColumn("mi", F.explode(F.sequence(F.lit(0), F.col("ms") - 1)))
             .select(*place, "mi", "qi", "fines", "qid", "vec"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if a.num_rows and b.num_rows:
            a = a.sort_by("fine")
            fine, cid, low = (a.column(c).to_numpy() for c in ("fine", "cid", "low"))
            x, norm = _scaled(_matrix(a.column("vec")))
            # as many queries at once as keep their pairs within bounds
            step = max(1, _CELLS * 4 // (a.num_rows * x.shape[1]))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                q, qnorm = _scaled(_matrix(part.column("vec")))
                lists = part.column("fines")
                if lists.null_count:  # queries for all members
                    spots, who = np.tile(np.arange(len(fine)), len(q)), np.repeat(np.arange(len(q)), len(fine))
                else:
                    wanted, owner = pc.list_flatten(lists).to_numpy(), pc.list_parent_indices(lists).to_numpy()
                    begin, end = np.searchsorted(fine, wanted, "left"), np.searchsorted(fine, wanted, "right")
                    n = end - begin
                    spots = np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    who = np.repeat(owner, n)
                if not len(spots):
                    continue
                score = (x[spots] * q[who]).sum(axis=1) / (qnorm[who] * norm[spots])
                order = np.lexsort((low[spots], -score, who))
                who, spots, score = who[order], spots[order], score[order]
                top = np.arange(len(who)) - np.searchsorted(who, who, "left") < keep
                found.append((part.column("qid").to_numpy()[who[top]], cid[spots[top]], low[spots[top]], score[top]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table(columns, names=["qid", "cid", "low", "score"])

    keys = [*place, "mi", "qi"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "qid long, cid long, low long, score double")


def nearest(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5,
            tables: int = TABLES) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found for every key divisible by ``every``.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows without a key, take no part; vectors are compared with others of
    their own length only; a repeated pair of key and vector counts once; an
    empty table gives no rows.  Queries for which the tables hold fewer than
    ``k`` candidates are compared with all rows, in blocks.
    """
    valid = materialize(valid_vectors(rows, key, vector), "vectors")
    kind = valid.schema["vec"].dataType.simpleString()
    few = Window.partitionBy("vec").orderBy("id")
    sets = (valid.withColumn("i", F.row_number().over(few)).filter(F.col("i") <= k + 1)  # bounded copies, before they meet
            .groupBy("vec").agg(F.min("id").alias("low"), F.sort_array(F.collect_list("id")).alias("ids"))
            .withColumn("cid", F.xxhash64("vec")).withColumn("d", F.size("vec")))
    alone = materialize(sets, "sets")
    lengths = materialize(alone.groupBy("d").agg(F.count(F.lit(1)).alias("n")), "lengths")
    classes = alone.join(lengths, "d")
    asked = materialize(valid.filter(F.col("id") % every == 0).withColumn("cid", F.xxhash64("vec")), "queries")
    distinct = asked.select("cid", "vec").distinct().withColumn("d", F.size("vec")).join(lengths, "d")
    found = materialize(_rerank(_index(classes, tables, kind), _probes(distinct, tables, kind), k + 1), "found")
    # the query's own class may hold nothing but the query
    seen = found.select("qid", "cid").distinct().join(alone.select("cid", F.size("ids").alias("copies")), "cid").groupBy("qid").agg(
        F.sum("copies").alias("rows"))
    rare = materialize(distinct.join(seen.filter(F.col("rows") > k), distinct["cid"] == seen["qid"], "left_anti"), "rare")
    if not rare.isEmpty():
        blocks = F.ceil(F.col("n") / GROUP_ROWS).cast("long")
        flat = classes.join(rare.select("d").distinct(), "d", "left_semi").select(
            "d", F.lit(0).alias("table"), F.pmod(F.xxhash64("cid"), blocks).alias("area"), F.lit(0).cast("long").alias("fine"), "cid", "low", "vec")
        all_ = rare.select("d", F.lit(0).alias("table"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("area"),
                           F.lit(None).cast("array<long>").alias("fines"), F.col("cid").alias("qid"), "vec")
        found = found.unionByName(_rerank(flat, all_, k + 1))
    ranked = Window.partitionBy("qid").orderBy(F.desc("score"), "low")
    best = (found.groupBy("qid", "cid").agg(F.max("score").alias("score"), F.min("low").alias("low"))
            .withColumn("i", F.row_number().over(ranked)).filter(F.col("i") <= k + 1))
    wide = (best.join(alone.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
            .join(asked.select(F.col("id").alias("query_id"), F.col("cid").alias("qid")), "qid").filter("vec_id != query_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return wide.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
