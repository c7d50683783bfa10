"""Near-equal packing windows by Karmarkar-Karp multiway differencing.

Every document becomes pieces of at most one window; the pieces are spread
over buckets of about ``windows_each`` windows, and each bucket is balanced on
its own: every piece starts as a partial partition holding one load, the two
partitions with the largest imbalance are merged again and again, the heaviest
part of one on the lightest part of the other, until one partition is left.
If its heaviest part exceeds the capacity, the bucket is balanced again over
one window more.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.tokens import END_ID, VOCABULARY, bucket_count, token_pieces

CAPACITY, WINDOWS_EACH = 4096, 128
WINDOW_SCHEMA = ("sequence_id long, n_tokens long, segments array<struct<doc_id:long,start:long,length:long,"
                 "doc_tokens:long,offset:long>>, ids binary")


def differencing(loads: np.ndarray, parts: int) -> list[list[int]]:
    """Indices of ``loads`` in each of ``parts`` near-equal parts.

    A partial partition holds its non-empty parts alone, heaviest first, so all
    of them together never hold more numbers than there are loads.
    """
    n = len(loads)
    if n == 0:
        return [[] for _ in range(parts)]
    left, right = list(range(n)), [-1] * n  # bags: leaves first, then pairs of bags
    heap = [(-int(loads[i]) if parts > 1 else 0, at, [int(loads[i])], [int(i)]) for at, i in enumerate(np.argsort(-loads, kind="stable"))]
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a, abags = heapq.heappop(heap)
        _, _, b, bbags = heapq.heappop(heap)
        over = len(a) + len(b) - parts  # so many parts of one meet a part of the other
        if over > 0:
            # heaviest meets lightest: the last parts of a with the last ones of b, in opposite order
            sums, bags = a[:len(a) - over], abags[:len(a) - over]
            for x in range(over):
                i, j = len(a) - over + x, len(b) - 1 - x
                bags.append(len(left))
                left.append(abags[i])
                right.append(bbags[j])
                sums.append(a[i] + b[j])
            sums, bags = sums + b[:len(b) - over][::-1], bags + bbags[:len(b) - over][::-1]
        else:
            sums, bags = a + b[::-1], abags + bbags[::-1]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, bags = [sums[i] for i in order], [bags[i] for i in order]
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == parts else 0)), serial, sums, bags))
        serial += 1
    out: list[list[int]] = []
    for bag in heap[0][3]:
        items, todo = [], [bag]
        while todo:
            x = todo.pop()
            if x < n:
                items.append(x)
            else:
                todo += [left[x], right[x]]
        out.append(sorted(items))
    return out + [[] for _ in range(parts - len(out))]


def balance(loads: np.ndarray, capacity: int) -> list[list[int]]:
    """Parts of at most ``capacity``; their number rises while one is too full."""
    full = loads >= capacity
    rest = np.flatnonzero(~full)
    parts = max(1, -(-int(loads[rest].sum()) // capacity))
    while True:
        found = differencing(loads[rest], parts)
        if all(loads[rest[p]].sum() <= capacity for p in found):
            break
        parts += 1
    return [[int(i)] for i in np.flatnonzero(full)] + [[int(rest[i]) for i in p] for p in found if p]


def pack_windows(docs: DataFrame, capacity: int = CAPACITY, windows_each: int = WINDOWS_EACH, key: str = "doc_id",
                 text: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row per window: its segments and their ids as little-endian unsigned 32-bit numbers.

    Null and empty texts give a piece with the end id alone; repeated rows give
    a piece each; an empty table gives no window.
    """
    pieces = token_pieces(docs, capacity, bucket_count(docs, capacity * windows_each, text), key, text, vocabulary, end_id)

    def pack(group: pa.Table) -> pa.Table:
        loads = group.column("length").to_numpy()
        starts = group.column("start").to_numpy()
        keys = group.column("doc_id").to_pylist()
        ids = group.column("ids").to_pylist()
        totals = group.column("doc_tokens").to_numpy()
        order = sorted(range(len(loads)), key=lambda i: (-loads[i], keys[i] is None, keys[i] or 0, starts[i]))
        bucket = group.column("bucket")[0].as_py()
        rows = []
        for w, members in enumerate(balance(loads[order], capacity)):
            at, segments, chosen = 0, [], [order[m] for m in members]
            for i in chosen:
                segments.append({"doc_id": keys[i], "start": int(starts[i]), "length": int(loads[i]),
                                 "doc_tokens": int(totals[i]), "offset": at})
                at += int(loads[i])
            body = np.frombuffer(b"".join(ids[i] for i in chosen), dtype="<u2").astype("<u4").tobytes()
            rows.append({"sequence_id": (bucket << 24) + w, "n_tokens": at, "segments": segments, "ids": body})
        return pa.Table.from_pylist(rows, schema=_ARROW)

    return pieces.groupBy("bucket").applyInArrow(pack, WINDOW_SCHEMA)


_SEGMENT = pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "offset")])
_ARROW = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("segments", pa.list_(_SEGMENT)), ("ids", pa.binary())])


def window_digest(windows: DataFrame) -> DataFrame:
    """One row per piece; the checksum is taken from the packed ids."""
    one = windows.select("sequence_id", "ids", F.explode("segments").alias("s"))
    return one.select(
        "s.doc_id", "s.start", "s.length",
        F.crc32(F.substring("ids", (F.col("s.offset") * 4 + 1).cast("int"), (F.col("s.length") * 4).cast("int"))).alias("ids_crc32"),
        "s.doc_tokens", "sequence_id", "s.offset")
