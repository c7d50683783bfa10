"""Near-duplicate groups from SuperMinHash signatures.

* Every document's set of word shingles is sketched with SuperMinHash: each
  shingle spreads the ranks 0..m-1 over the m signature places by its own
  random permutation, place by place; a place keeps the least rank plus a
  random fraction, and a document stops as soon as no later rank can win.
* Documents with the same set form a class (digest of the whole set); from
  here on there is one row per class, however many copies it has.
* Signature bands put classes into buckets.  A bucket never emits its pairs:
  each member is paired with the bucket's most connected member, the pair is
  verified on the full sets, and verified links are merged to components.
* Only buckets that still hold several components are looked at again.  A
  shingle that no other such class has cannot be shared, which bounds the
  overlap of a class from above; members that cannot reach the threshold with
  anyone leave, and what remains is compared block by block on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.common import materialize
from chronoframe.llm.components import components
from chronoframe.llm.tokens import mix

#: 24 bands of 4 places: a pair at similarity 0.8 shares no band with probability 3e-6.
PLACES, BANDS = 96, 24
SLICE_BYTES = 1 << 19
#: Members of a block; two blocks meet in one task.
BLOCK = 1024

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTERS = mix(np.arange(256, dtype=np.uint64)) | np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C55)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _FACTOR)]))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of all texts, lower-casing A-Z, and the number of words of each text."""
    flat = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    solid = ~_SPACE[flat]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    size = stop - start
    spots = np.flatnonzero(solid)
    first = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        place = np.arange(len(spots)) - np.repeat(first, size)
        parts = _LETTERS[flat[spots]] * _powers(int(size.max()))[place]
        words = mix(np.add.reduceat(parts, first) + size.astype(np.uint64))
    return words, np.diff(np.searchsorted(start, ends), prepend=0)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text; fewer words than ``width`` make one shingle."""
    if not texts:
        return []
    words, counts = word_hashes(texts)
    out, at = [], 0
    with np.errstate(over="ignore"):
        if len(words) >= width:
            rolled = words[: len(words) - width + 1].copy()
            for k in range(1, width):
                rolled = mix(rolled) + words[k: len(words) - width + 1 + k]
            rolled = mix(rolled)
        for n in counts.tolist():
            if n >= width:
                out.append(np.unique(rolled[at:at + n - width + 1]))
            elif n:
                h = np.uint64(n)
                for w in words[at:at + n]:
                    h = mix(np.array([h]))[0] + w
                out.append(mix(np.array([h ^ np.uint64(0x5DEECE66D)])))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            at += n
    return out


def super_minhash(sets: list[np.ndarray], places: int) -> np.ndarray:
    """Signatures, one row per set; a set without elements has infinite places."""
    sizes = np.array([len(s) for s in sets])
    best = np.full(len(sets) * places, np.inf)
    element = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    perm = None
    with np.errstate(over="ignore"):
        for j in range(places):
            if not len(element):
                break
            r = mix(element + np.uint64(j) * np.uint64(0xD1B54A32D192ED03))
            pick = j + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)
            if perm is None:
                place = pick
            else:
                row = np.arange(len(element))
                place = perm[row, pick].astype(np.int64)
                perm[row, pick] = perm[:, j]
                perm[:, j] = place
            np.minimum.at(best, owner * places + place, j + (r >> np.uint64(32)) / 2.0 ** 32)
            # later ranks are at least j + 1: a set whose places all hold less is done
            more = best.reshape(-1, places).max(axis=1) > j + 1
            live = more[owner]
            if perm is None:
                element, owner, pick = element[live], owner[live], pick[live]
                perm = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int32), (len(element), 1))
                perm[np.arange(len(element)), pick] = 0
                perm[:, 0] = pick
            elif not live.all():
                element, owner, perm = element[live], owner[live], perm[live]
    return best.reshape(-1, places)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    rows = signatures.shape[1] // bands
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2]).copy()
        for k in range(rows):
            key = mix(key + bits[:, :, k])
    return key.view(np.int64)


def digest(elements: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set; sets with the same digest and size count as equal."""
    with np.errstate(over="ignore"):
        a = mix(elements).sum(dtype=np.uint64)
        b = mix(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of about SLICE_BYTES of text; the texts are views of the batch."""
    texts = [t.as_buffer() or b"" for t in batch.column(column)]
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_BYTES:
            yield batch.slice(at, i - at), texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield batch.slice(at), texts[at:]


def sketch(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text",
           places: int = PLACES, bands: int = BANDS) -> DataFrame:
    """``doc_id``, ``h`` (hash of the text), ``n`` (set size), ``d1``, ``d2`` (digest) and ``bands`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _slices(batch, 2):
                sets = shingle_sets(texts, width)
                keys = band_keys(super_minhash(sets, places), bands)
                d = [digest(s) for s in sets]
                flat = pa.array(keys.reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in d], pa.int64()),
                     pa.array([y for _, y in d], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), flat)],
                    names=["doc_id", "h", "n", "d1", "d2", "bands"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, h long, n long, d1 long, d2 long, bands array<long>")


def _wanted_texts(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``cid``, ``d1``, ``d2`` and the text of each class in ``wanted``; only repeats of the representative row give more rows."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return rows.join(wanted, (rows["h"] == wanted["h"]) & rows["k"].eqNullSafe(wanted["rep"])).select("cid", "d1", "d2", "text")


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """``cid`` and its shingles as binary, one row for each class in ``wanted`` (cid, rep, h, d1, d2)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), set()
        for batch in batches:
            for part, texts in _slices(batch, 3):
                cid, d1, d2 = (part.column(i).to_pylist() for i in range(3))
                fresh = [i for i, c in enumerate(cid) if c not in done]
                mine = {}
                for i, s in zip(fresh, shingle_sets([texts[i] for i in fresh], width), strict=True):
                    if digest(s) == (d1[i], d2[i]):  # another text may have the representative's hash
                        mine.setdefault(cid[i], s.tobytes())
                done.update(mine)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(mine), pa.int64()), pa.array([task] * len(mine), pa.int32()), pa.array(list(mine.values()), pa.binary())],
                    names=["cid", "task", "elements"])

    sets = materialize(_wanted_texts(docs, wanted, key, text).mapInArrow(run, "cid long, task int, elements binary"), "sets")
    # the representative row may be repeated in several tasks: the first one's set stays
    seen = sets.groupBy("cid").agg(F.min("task").alias("least"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    again = materialize(sets.select("cid", "task").join(seen, "cid").filter("task != least").select("cid", "task"), "again")
    return sets.join(again, ["cid", "task"], "left_anti").select("cid", "elements")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    left = sets.select(F.col("cid").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _bound_fits(c: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether an overlap of at most ``c`` can reach the threshold for set sizes ``n`` and ``m``."""
    return c * (100 + percent) >= (n + m) * percent


def _cross_links(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that share a bucket and lie in different components.

    ``held``: band, key, cid, n, comp of the buckets with several components.
    Members that cannot reach the threshold with anyone leave first.  The
    others of a bucket are dealt to blocks, a task compares two blocks by the
    full sets, and only links leave it.
    """
    ids = held.select("cid").distinct()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.frombuffer(raw, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), cid))], names=["h", "cid"])

    lone = (sets.join(ids, "cid").select("cid", "elements").mapInArrow(spread, "h long, cid long")
            .groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("cid").alias("cid")).filter("k = 1")
            .groupBy("cid").agg(F.count(F.lit(1)).alias("lone")))
    rated = (held.join(lone, "cid", "left")
             .select("band", "key", "cid", "n", "comp", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("c")))
    # the smallest partner that the size bound allows is the easiest one
    floor = rated.groupBy("band", "key").agg(F.min("n").alias("low"))
    rated = materialize(rated.join(floor, ["band", "key"]).filter(_bound_fits(
        F.col("c"), F.col("n"), F.greatest("low", F.col("n") * percent / 100), percent)).drop("low"), "rated")
    mixed = rated.groupBy("band", "key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).filter("lo != hi")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = (rated.join(mixed.select("band", "key", "blocks"), ["band", "key"]).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("band", "key", "cid", "comp", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")))
    full = dealt.join(sets, "cid").select("band", "key", "x", "y", "own", "cid", "comp", "elements")

    def compare(group: pa.Table) -> pa.Table:
        cid, comp, own = (group.column(c).to_numpy() for c in ("cid", "comp", "own"))
        both = group.column("x")[0].as_py() == group.column("y")[0].as_py()
        a, b = linked_pairs([np.frombuffer(e.as_buffer(), dtype=np.uint64) for e in group.column("elements")], percent)
        keep = (comp[a] != comp[b]) & (both | (own[a] != own[b]))  # within one block only its own group compares
        a, b = cid[a[keep]], cid[b[keep]]
        return pa.table([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    return full.groupBy("band", "key", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def linked_pairs(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of sets whose Jaccard similarity reaches the threshold.

    Overlaps are counted by matrix products over slices of the shared elements,
    so memory is bounded by the number of sets.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    found, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    shared = (times > 1)[place]
    who, column = np.repeat(np.arange(n), size)[shared], rank[place[shared]]
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    overlap = np.zeros((n, n), dtype=np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        i, j = np.searchsorted(column, [at, at + 2048])
        part = np.zeros((n, 2048), dtype=np.float32)
        part[who[i:j], column[i:j] - at] = 1
        overlap += part @ part.T
    union = size[:, None] + size[None, :] - overlap
    return np.nonzero(np.triu(100 * overlap >= percent * union, k=1))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    ``component_id`` is the least key reachable over links of at least
    ``percent`` / 100 Jaccard similarity; ``kept`` marks the rows whose key it
    is (:func:`drop_near_duplicates` chooses one row of these).
    Null and blank texts have no shingles and are linked with nothing; repeated
    rows of one key and text carry the same verdict; rows with a null key are
    linked like all others, but a null key never names a component while
    another key does; an empty table gives no rows.
    """
    return _judged(docs, width, percent, key, text).drop("h", "chosen")


def _judged(docs: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """The rows of :func:`near_duplicates` with ``h``, the hash of their text, and ``chosen``, whether it is the text that stays."""
    cid = F.xxhash64("d1", "d2", "n").alias("cid")
    rows = materialize(sketch(docs, width, key, text).withColumn("cid", cid), "sketch")
    # one row per class; all of its rows have the same bands
    classes = materialize(rows.filter("n > 0").groupBy("cid").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("rep"), F.first("n").alias("n"), F.first("d1").alias("d1"), F.first("d2").alias("d2"),
        F.first("bands").alias("bands")).select(
            "cid", F.col("rep.doc_id").alias("rep"), F.col("rep.h").alias("h"), "n", "d1", "d2", "bands"), "classes")
    entries = classes.select("cid", "n", F.posexplode("bands").alias("band", "key"))
    shared = entries.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = materialize(entries.join(shared, ["band", "key"]), "members")
    # the member of most and largest buckets is the likeliest neighbour of the others
    score = members.groupBy("cid").agg(F.sum("size").alias("score"))
    scored = members.join(score, "cid").select("band", "key", "cid", "n", "score")
    hubs = scored.groupBy("band", "key").agg(F.max(F.struct("score", "cid", "n")).alias("hub")).select(
        "band", "key", F.col("hub.cid").alias("hub"), F.col("hub.n").alias("m"))
    stars = (members.join(hubs, ["band", "key"]).filter((F.col("cid") != F.col("hub")) & _sizes_fit(F.col("n"), F.col("m"), percent))
             .select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct())
    stars = materialize(stars, "stars")
    wanted = members.select("cid").distinct().join(classes.select("cid", "rep", "h", "d1", "d2"), "cid")
    sets = _full_sets(docs, wanted, width, key, text)
    links = materialize(_verified(stars, sets, percent), "links")
    comp = components(links)
    placed = members.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select(
        "band", "key", "cid", "n", F.coalesce("root", "cid").alias("comp"))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("band", "key")
    held = materialize(placed.join(mixed, ["band", "key"]), "held")
    more = materialize(_cross_links(held, sets, percent), "more")
    comp = components(links.unionByName(more)).withColumnRenamed("node", "cid")
    rooted = classes.select("cid", "rep", "h").join(comp, "cid", "left").select("cid", "rep", "h", F.coalesce("root", "cid").alias("root"))
    least = rooted.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "h")).alias("first"))
    named = rooted.join(least, "root").select("cid", F.col("first.rep").alias("component_id"), F.col("first.h").alias("chosen"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(named, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "h", "chosen").select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "h",
        F.coalesce(F.col("h") == F.col("chosen"), F.lit(True)).alias("chosen"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each group; of rows equal in key and text the one of least row hash."""
    kept = _judged(docs, width, percent, key, text).filter("kept and chosen").select(F.col("doc_id").alias("_a"), F.col("h").alias("_b")).distinct()
    packed = docs.select(F.struct("*").alias("_row"), F.col(key).cast("long").alias("_k"), F.xxhash64(F.col(text)).alias("_h"))
    once = packed.join(kept, packed["_k"].eqNullSafe(kept["_a"]) & (packed["_h"] == kept["_b"]), "left_semi").withColumn(
        "_i", F.row_number().over(Window.partitionBy("_k", "_h").orderBy(F.xxhash64("_row"))))
    return once.filter("_i = 1").select("_row.*")
