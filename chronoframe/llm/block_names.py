"""Exact copies by deterministic block naming.

A text without white space is cut into blocks of a fixed number of bytes.  The
distinct blocks are sorted into integer names; then the names of adjacent
blocks are paired, the distinct pairs sorted into new names, and so on, until
every document has one name.  Equal names mean equal texts: a name stands for
one block or one pair of names, never for a hash value.

Only the first round moves text, each distinct block of a task once.  A block
is found again by a 128-bit handle, so that the rows of documents need not
carry their blocks through a join; whether each handle has one block is checked
on the sorted blocks, and if one had two, the round is repeated with another
seed.  All later rounds move integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.common import SPACES, materialize
from chronoframe.operators.keyed import join_keyed

BLOCK_BYTES = 4096
#: Rows of a batch that are held as Python objects at a time.
SLICE_ROWS = 512
Handle = Callable[[bytes, int], bytes]


def wide_handle(block: bytes, seed: int) -> bytes:
    return xxhash.xxh3_128_digest(block, seed)


def _flat_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches, with their texts as UTF-8 bytes without white space."""
    spaces = SPACES.encode()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            texts = part.column(column).cast(pa.binary()).to_pylist()
            yield part, [(t or b"").translate(None, spaces) for t in texts]


def _cut(text: bytes, size: int) -> list[bytes]:
    return [text[i:i + size] for i in range(0, len(text), size)] or [b""]


def _documents(docs: DataFrame, key: str, text: str, size: int, handle: Handle, seed: int) -> DataFrame:
    """A row for each document: its key, length, digest and the handles of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, flat in _flat_slices(batches, 1):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pc.fill_null(pc.utf8_length(part.column(1)), 0).cast(pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in flat]),
                 pa.array([[handle(b, seed) for b in _cut(t, size)] for t in flat], pa.list_(pa.binary()))],
                names=["doc_id", "chars", "sha", "handles"])

    return (docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, chars long, sha string, handles array<binary>")
            .withColumn("rid", F.monotonically_increasing_id()))


def _blocks(docs: DataFrame, text: str, size: int, handle: Handle, seed: int) -> DataFrame:
    """Handles and blocks of all texts; repeats within a slice are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, flat in _flat_slices(batches, 0):
            once = list({b: None for t in flat for b in _cut(t, size)})
            yield pa.RecordBatch.from_arrays([pa.array([handle(b, seed) for b in once], pa.binary()), pa.array(once, pa.binary())],
                                             names=["handle", "block"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "handle binary, block binary")


def _named(distinct: DataFrame, order: list[str], first: int) -> DataFrame:
    """Integer names from ``first`` on: rising with ``order`` inside every partition of the distinct rows."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id() + F.lit(first))


def _next_free(names: DataFrame) -> int:
    return (names.agg(F.max("name")).first()[0] or 0) + 1


def _collected(rows: DataFrame) -> DataFrame:
    """Names of every document in the order of their places."""
    inside = F.array_sort(F.collect_list(F.struct("at", "name")))
    return rows.groupBy("rid").agg(F.transform(inside, lambda x: x["name"]).alias("names"))


def block_identities(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = BLOCK_BYTES,
                     handle: Handle = wide_handle) -> DataFrame:
    """``rid``, ``doc_id``, ``chars``, ``sha`` and ``identity`` of every row of ``docs``.

    ``identity`` is equal for two rows exactly if their texts without white
    space are equal; ``rid`` numbers the rows, ``chars`` counts code points of
    the whole text, ``sha`` is the SHA-256 of the text without white space.
    """
    seed = 0
    while True:
        rows = materialize(_documents(docs, key, text, size, handle, seed), "rows")
        distinct = _blocks(docs, text, size, handle, seed).distinct()
        names = materialize(_named(distinct, ["block"], 0).select("handle", "name"), "names")
        if names.groupBy("handle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            break
        seed += 1
    first = _next_free(names)
    state = materialize(_collected(
        rows.select("rid", F.posexplode("handles").alias("at", "handle")).join(names, "handle")), "state")
    done = [state.filter(F.size("names") == 1)]
    while not (open_ := state.filter(F.size("names") > 1)).isEmpty():
        pairs = open_.select("rid", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.ceil(F.size("names") / 2).cast("int") - 1),
            lambda i: F.struct(F.get("names", 2 * i).alias("a"), F.coalesce(F.get("names", 2 * i + 1), F.lit(-1)).alias("b")))).alias(
                "at", "pair")).select("rid", "at", "pair.a", "pair.b")
        names = materialize(_named(pairs.select("a", "b").distinct(), ["a", "b"], first), "names")
        first = _next_free(names)
        state = materialize(_collected(pairs.join(names, ["a", "b"])), "state")
        done.append(state.filter(F.size("names") == 1))
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return rows.drop("handles").join(every.select("rid", F.get("names", F.lit(0)).alias("identity")), "rid")


def exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = BLOCK_BYTES,
                 handle: Handle = wide_handle) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and ``identity`` for every row.

    Of equal texts the row with the most code points in its original text stays,
    then the smallest key, a null key last; of repeated rows one stays.  Null
    and empty texts and texts of white space alone are one group.  An empty
    table gives no rows; other columns are not read.
    """
    rows = materialize(block_identities(docs, key, text, size, handle), "identities")
    best = F.min(F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid").alias("rid")))
    # written first: the join then starts from plain shuffles, whose hot partitions can be split
    groups = materialize(rows.groupBy("identity").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")), "groups")
    return rows.join(groups, "identity").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"), "identity")


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows equal in key and text the one of least row hash."""
    flat = F.sha2(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACES, ""), 256)
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("doc_id"), flat.alias("text_sha256"),
                         F.coalesce(F.char_length(F.col(text).cast("string")), F.lit(0)).alias("chars"))
    stay = exact_copies(docs, key, text).filter("kept").select("doc_id", "text_sha256")
    # one key may hold several rows of a group: the longest text, then the least row hash
    first = Window.partitionBy("text_sha256").orderBy(F.desc("chars"), F.xxhash64("row"))
    return (join_keyed(marked, stay, ["doc_id", "text_sha256"], "left_semi")
            .withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("row.*"))


ORACLE = r"""
WITH flat AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(body) AS text_sha256
FROM flat
WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST)
"""
