"""Packed token matrices by best-fit-decreasing with a segment tree.

Documents are cut losslessly into pieces of at most one row of the matrix.
Pieces are spread over buckets of about ``rows_each`` rows; within a bucket
they are placed longest first, each into the open row whose free space is the
smallest that still fits.  A segment tree over free space finds it in
``log2(capacity)`` steps.

A row of the result is one row of the id matrix: ids padded to the capacity,
position numbers that restart at every segment, and the cumulative segment
lengths, ready for attention kernels that take variable lengths.  Ids and
positions are little-endian unsigned 16-bit numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.tokens import END_ID, VOCABULARY, bucket_count, token_pieces

CAPACITY, ROWS_EACH, PAD_ID = 2048, 256, 0
ROW_SCHEMA = ("row_id long, n_tokens int, doc_ids array<long>, starts array<long>, doc_tokens array<long>, "
              "cu_seqlens array<int>, input_ids binary, position_ids binary")
_ARROW = pa.schema([("row_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                    ("starts", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
                    ("cu_seqlens", pa.list_(pa.int32())), ("input_ids", pa.binary()), ("position_ids", pa.binary())])


class FreeSpace:
    """Open rows by free space, in a segment tree that counts them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, space: int, by: int) -> None:
        at = self.leaves + space
        while at:
            self.count[at] += by
            at >>= 1

    def add(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        self._change(space, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Row with the least free space of ``need`` or more, and that space; it is removed."""
        at = self.leaves + need
        if not self.count[at]:
            # up to the first right sibling that holds rows, then down its left edge
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at *= 2
                if not self.count[at]:
                    at += 1
        space = at - self.leaves
        self._change(space, -1)
        return self.rows[space].pop(), space


def best_fit(loads: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices of ``loads``, which come in falling order."""
    tree, rows = FreeSpace(capacity), []
    for i, load in enumerate(loads):
        found = tree.take(load)
        if found is None:
            rows.append([i])
            found = (len(rows) - 1, capacity)
        else:
            rows[found[0]].append(i)
        if found[1] > load:
            tree.add(found[1] - load, found[0])
    return rows


def pack_matrix(docs: DataFrame, capacity: int = CAPACITY, rows_each: int = ROWS_EACH, key: str = "doc_id",
                text: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, pad_id: int = PAD_ID) -> DataFrame:
    """One row per matrix row.

    A null or empty text gives one piece with the end id; repeated rows give a
    piece each; an empty table gives no rows.
    """
    if not 0 < capacity <= 1 << 16:
        raise ValueError("positions have 16 bits: the capacity must be 1 to 65536")
    pieces = token_pieces(docs, capacity, bucket_count(docs, capacity * rows_each, text), key, text, vocabulary, end_id)

    def pack(group: pa.Table) -> pa.Table:
        loads, starts = group.column("length").to_pylist(), group.column("start").to_pylist()
        keys, totals = group.column("doc_id").to_pylist(), group.column("doc_tokens").to_pylist()
        ids = group.column("ids").to_pylist()
        order = sorted(range(len(loads)), key=lambda i: (-loads[i], keys[i] is None, keys[i] or 0, starts[i]))
        bucket, out = group.column("bucket")[0].as_py(), []
        for r, members in enumerate(best_fit([loads[i] for i in order], capacity)):
            chosen = [order[m] for m in members]
            cu = np.cumsum([0] + [loads[i] for i in chosen])
            row = np.full(capacity, pad_id, dtype="<u2")
            row[:cu[-1]] = np.frombuffer(b"".join(ids[i] for i in chosen), dtype="<u2")
            positions = np.zeros(capacity, dtype="<u2")
            positions[:cu[-1]] = np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))
            out.append({"row_id": (bucket << 24) + r, "n_tokens": int(cu[-1]), "doc_ids": [keys[i] for i in chosen],
                        "starts": [starts[i] for i in chosen], "doc_tokens": [totals[i] for i in chosen],
                        "cu_seqlens": cu.tolist(), "input_ids": row.tobytes(), "position_ids": positions.tobytes()})
        return pa.Table.from_pylist(out, schema=_ARROW)

    return pieces.groupBy("bucket").applyInArrow(pack, ROW_SCHEMA)


def write_matrix(packed: DataFrame, path: str) -> None:
    """Write the matrix as Parquet; ids and positions are plain binary columns of equal width."""
    packed.write.mode("overwrite").parquet(path)


def unpack_documents(packed: DataFrame) -> DataFrame:
    """Pieces of the matrix again: doc_id, start, length, doc_tokens and ids."""
    one = packed.select("input_ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "starts", "doc_tokens")).alias("i", "s"))
    begin, end = F.get("cu_seqlens", F.col("i")), F.get("cu_seqlens", F.col("i") + 1)
    return one.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.starts").alias("start"), (end - begin).cast("long").alias("length"),
                      F.col("s.doc_tokens").alias("doc_tokens"),
                      F.substring("input_ids", begin * 2 + 1, (end - begin) * 2).alias("ids"))
