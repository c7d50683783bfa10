"""Prefix trie of conversations from digests of blocks of turns.

A conversation is cut into blocks of :data:`BLOCK_TURNS` turns.  Conversations
are grouped by successive block digests first: a block's key stands for all
turns up to its end, so equal keys mean a shared prefix.  Where every
conversation that reaches a block goes on through the same block, its turns
form an unbranched chain and stay one row.  Only where siblings diverge inside
a block, its turns are taken one by one.

The keys of blocks come from groups of :data:`FAN` digests, whose own digests
are grouped again, so no task walks along a whole conversation.  Sums over
subtrees are found by doubling the distance to the ancestor in every round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.common import materialize
from chronoframe.operators.windows import DEFAULT_CHUNK_ROWS, RangeBuckets, heavy_keys, with_ordinal

BLOCK_TURNS, FAN = 4, 64
#: Keys of a node's end members are joined in slices of so many neighbouring numbers.
SLICE_BITS = 13
ROOT = bytearray(32)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _joined(digests: Column) -> Column:
    """Bytes of an array of digests, one after the other."""
    return F.aggregate(digests, F.lit(bytearray()), lambda a, d: F.concat(a, d))


def turn_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """``conv``, ``pos`` (from 0), ``digest`` of role and text, ``size`` (UTF-8 bytes of the text).

    Null roles and texts are empty; rows without a conversation are left out;
    turns are ordered with null first, equal turn numbers by their digest.
    """
    said, body = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
        _sha(F.octet_length(said).cast("string").cast("binary"), F.lit(bytearray(b":")), said.cast("binary"),
             body.cast("binary")).alias("digest"),
        F.octet_length(body).cast("long").alias("size"))
    rows = materialize(rows, "turns")
    if heavy_keys(rows, ["conv"], chunk_rows).isEmpty():
        placed = rows.withColumn("pos", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "digest")).cast("long") - 1)
    else:
        placed = with_ordinal(rows, ["conv"], ["turn", "digest"], RangeBuckets(max(1, chunk_rows // 4)), "pos")
    return materialize(placed.select("conv", F.col("pos").cast("long").alias("pos"), "digest", "size"), "turns")


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Conversations whose first ``crc32(conv) % most`` turns come from the conversation ``conv - conv % every``."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    base = F.col("conv") - F.col("conv") % every
    heads = turns.filter((F.col("conv") % every == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv", "base")
    led = turns.select("conv").distinct().withColumn("base", base).withColumn("h", h).join(heads, "base").filter("pos < h")
    there = heads.groupBy("base").agg(F.count(F.lit(1)).alias("there"))
    own = turns.withColumn("base", base).withColumn("h", h).filter("pos >= h").join(there, "base", "left")
    return led.select("conv", "pos", "digest", "size").unionByName(
        own.select("conv", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("there", F.lit(0)))).alias("pos"), "digest", "size"))


def _prefix_keys(items: DataFrame, fan: int, level: int = 0) -> DataFrame:
    """``items``: conv, at (from 0), digest, and a column ``more``.  Adds ``key`` of all digests up to ``at`` and the ``parent`` before it."""
    top = items.agg(F.max("at")).first()[0] or 0
    inside = F.array_sort(F.collect_list(F.struct("at", "digest", "more")))
    groups = items.groupBy("conv", F.expr(f"at div {fan}").alias("g")).agg(inside.alias("items"))
    groups = groups.withColumn("digests", F.transform("items", lambda x: x["digest"]))
    if top < fan:
        based = groups.withColumns({"base": F.lit(ROOT), "whole": F.lit(None).cast("binary")})
    else:
        groups = materialize(groups, "groups")
        upper = groups.select("conv", F.col("g").alias("at"), _sha(_joined(F.col("digests"))).alias("digest"), F.lit(None).cast("int").alias("more"))
        names = _prefix_keys(upper, fan, level + 1).select("conv", F.col("at").alias("g"), F.col("parent").alias("base"), F.col("key").alias("whole"))
        based = groups.join(names, ["conv", "g"])
    tag = F.lit(bytearray([level + 1]))

    def key(i: Column) -> Column:
        # the end of a full group goes by the group's own key, which the next group starts from
        return F.when(i < 0, F.col("base")).when((i == fan - 1) & F.col("whole").isNotNull(), F.col("whole")).otherwise(
            _sha(tag, F.col("base"), _joined(F.slice("digests", F.lit(1), i + 1))))

    out = based.select("conv", "base", "whole", "digests", F.posexplode("items").alias("i", "x"))
    keyed = out.select("conv", F.col("x.at").alias("at"), F.col("x.more").alias("more"),
                       key(F.col("i") - 1).alias("parent"), key(F.col("i")).alias("key"))
    return materialize(keyed, "keys")


def _node_key(parent: Column, digests: Column, key: Column, n: Column, size: int) -> Column:
    """Key of the ``n``-th turn of a block: a full block's key, else a digest of the turns so far."""
    return F.when(n == size, key).otherwise(_sha(F.lit(bytearray(1)), parent, _joined(F.slice(digests, F.lit(1), n))))


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """``key``, ``saved``, ``leaves``: own values and those of all descendants.

    ``nodes``: key, parent (null below the root), saved, leaves.  Every round
    adds the sums of the nodes ``2^k`` steps below and doubles the step.
    """
    now = nodes.withColumnRenamed("parent", "anc")
    while not (far := now.filter(F.col("anc").isNotNull())).isEmpty():
        add = far.groupBy("anc").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l")).withColumnRenamed("anc", "key")
        jump = now.select(F.col("key").alias("anc"), F.col("anc").alias("next"))
        now = materialize(
            now.join(add, "key", "left").join(jump, "anc", "left").select(
                "key", F.col("next").alias("anc"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
                (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves")), "sums")
    return now.select("key", "saved", "leaves")


def _end_digests(ends: DataFrame) -> DataFrame:
    """``key``, ``ends_sha256``: SHA-256 of the comma-joined ids, rising; a node's ids pass its task as joined slices."""
    slices = ends.groupBy("key", F.shiftright("conv", SLICE_BITS).alias("part")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, hashlib.sha256()
        for batch in batches:
            keys, digests = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key == last:
                    state.update(b",")
                else:
                    if last is not None:
                        keys.append(last)
                        digests.append(state.hexdigest())
                    last, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    ordered = slices.repartition("key").sortWithinPartitions("key", "part")
    return ordered.select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK_TURNS, fan: int = FAN) -> DataFrame:
    """One row per node of the trie over ``turns`` (conv, pos from 0, digest, size); ``convs`` lists all ``conv``.

    Conversations of ``convs`` without turns are members of the root alone.  No
    conversation gives no node.  The result holds no texts; ``depth`` and
    ``conv_id`` name a node's turn (turn ``depth`` of ``conv_id``).
    """
    total = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv")).first()
    inside = F.array_sort(F.collect_list(F.struct("pos", "digest", "size")))
    blocks = turns.groupBy("conv", F.expr(f"pos div {block}").alias("at")).agg(inside.alias("x"))
    items = materialize(blocks.select(
        "conv", "at", F.struct(F.transform("x", lambda t: t["digest"]).alias("digests"), F.transform("x", lambda t: t["size"]).alias("sizes")).alias("more"))
        .withColumn("digest", _sha(_joined(F.col("more.digests")))), "blocks")
    keyed = _prefix_keys(items, fan)

    # distinct blocks, with the conversations that take them and those that reach their start
    distinct = materialize(keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.first("parent").alias("parent"), F.first("at").alias("at"),
        F.first("more").alias("more")).select("key", "parent", "at", "n", "conv", "more.digests", "more.sizes"), "distinct")
    reach = distinct.filter(F.size("sizes") == block).select(F.col("key").alias("parent"), F.col("n").alias("reach"))
    first = distinct.filter("at = 0").withColumn("reach", F.lit(total["n"] or 0))
    met = first.unionByName(distinct.filter("at > 0").join(reach, "parent").select(*first.columns))
    met = materialize(met.withColumn("full", F.size("sizes")), "met")

    def node(n: Column) -> Column:
        return _node_key(F.col("parent"), F.col("digests"), F.col("key"), n, block)

    chains = met.filter("n = reach").select(
        node(F.col("full")).alias("key"), "parent", (F.col("at") * block).alias("above"), "n", "conv", "sizes")
    turn = met.filter("n < reach").select("*", F.explode(F.sequence(F.lit(1), F.col("full"))).alias("j")).select(
        node(F.col("j")).alias("key"), F.when(F.col("j") == 1, F.col("parent")).otherwise(node(F.col("j") - 1)).alias("parent"),
        (F.col("at") * block + F.col("j") - 1).alias("above"), "n", "conv", F.get("sizes", F.col("j") - 1).alias("size"))
    single = turn.groupBy("key").agg(F.first("parent").alias("parent"), F.first("above").alias("above"), F.sum("n").alias("n"),
                                     F.min("conv").alias("conv"), F.array(F.first("size")).alias("sizes"))
    nodes = chains.unionByName(single)
    nodes = materialize(nodes.withColumn("parent", F.when(F.col("parent") != F.lit(ROOT), F.col("parent"))), "nodes")

    below = nodes.filter("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("kids")).withColumnRenamed("parent", "key")
    weight = (F.col("n") - 1) * F.aggregate("sizes", F.lit(0).cast("long"), lambda a, s: a + s)
    nodes = materialize(nodes.join(below, "key", "left").withColumn("kids", F.coalesce("kids", F.lit(0).cast("long"))), "nodes")
    sums = _subtree_sums(nodes.select("key", "parent", weight.alias("saved"), (F.col("kids") == 0).cast("long").alias("leaves")))

    last = keyed.groupBy("conv").agg(F.max(F.struct("at", "parent", "key", F.col("more.digests").alias("digests"))).alias("e")).select(
        "conv", _node_key(F.col("e.parent"), F.col("e.digests"), F.col("e.key"), F.size("e.digests"), block).alias("key"))
    ends = last.unionByName(convs.join(last, "conv", "left_anti").select("conv", F.lit(ROOT).alias("key")))
    digests = materialize(_end_digests(ends), "ends")

    up = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("up"))
    whole = (nodes.join(sums, "key").join(digests, "key", "left").join(up, "parent", "left")
             .withColumn("up", F.coalesce("up", F.lit(total["conv"]))))
    length, at = F.size("sizes"), F.col("j")
    spread = whole.select("*", F.explode(F.sequence(F.lit(1), length)).alias("j")).select(
        F.col("conv").alias("conv_id"), (F.col("above") + at).cast("long").alias("depth"),
        F.when(at == 1, F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(at < length, F.lit(1)).otherwise(F.col("kids")).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * F.aggregate(F.slice("sizes", F.lit(1), at - 1), F.lit(0).cast("long"),
                                                         lambda a, s: a + s)).alias("saved_tokens"),
        F.when((at == length) & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(F.lit(EMPTY_SHA)).alias("ends_sha256"))
    whole_tree = nodes.agg(F.sum(F.when(F.col("parent").isNull(), 1).otherwise(0)).alias("kids"),
                           F.sum(F.when(F.col("kids") == 0, 1).otherwise(0)).alias("leaves"), F.sum(weight).alias("saved"))
    kids = F.coalesce("kids", F.lit(0)).cast("long")
    root = whole_tree.filter(F.lit(bool(total["n"]))).select(
        F.lit(total["conv"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total["n"] or 0).cast("long").alias("n_convs"),
        kids.alias("n_children"), F.when(kids == 0, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"))
    none = digests.filter(F.col("key") == F.lit(ROOT)).agg(F.max("ends_sha256").alias("ends_sha256"))
    root = root.join(F.broadcast(none), F.lit(True)).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)))
    return root.unionByName(spread)


def conversation_trie(conversations: DataFrame, block: int = BLOCK_TURNS, fan: int = FAN,
                      chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Trie of the rebuilt conversations (:func:`rebuilt`), with the columns of :func:`prefix_trie`.

    Null roles and texts are empty, rows without ``conv_id`` are left out, equal
    turn numbers are ordered by the digest of role and text (repeated rows are
    turns of their own), an empty table gives no rows, other columns are not read.
    """
    turns = turn_rows(conversations, chunk_rows=chunk_rows)
    return prefix_trie(materialize(rebuilt(turns), "rebuilt"), materialize(turns.select("conv").distinct(), "convs"), block, fan)


def plain_trie(conversations: DataFrame) -> DataFrame:
    """Trie of the conversations as they are, with the columns of :func:`prefix_trie`."""
    turns = turn_rows(conversations)
    return prefix_trie(turns, materialize(turns.select("conv").distinct(), "convs"))
