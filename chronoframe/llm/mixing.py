"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources they belong
to); only the pattern sums, at most ``MAX_PATTERNS`` rows, reach the driver.  There a min-cost flow routes words from patterns to
source quotas.  Taking a pattern's documents once costs nothing, the second
time a unit a word, and so on, so words are repeated only where quotas cannot
be met without.  Documents are then taken in the order of their seeded hash: the
place in which a pattern's share ends is found from sums of ever smaller ranges
of hashes, and every document is compared with it.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.llm.common import materialize, word_count

SHARE, MAX_COPIES, WEIGHTS, SEED = 1.5, 2, (5, 2, 1), 20240607
MAX_PATTERNS = 100_000
#: Bits below the ranges of each level: 4,096 ranges, each cut again by 4,096, then single places.
PLACE_BITS = (50, 38, 0)


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most: int = MAX_COPIES) -> dict[str | None, float]:
    """Target of each source: a weighted share, stopped at ``most`` times its size, the excess reshared by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))  # str compares by code point
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            target.update({s: unit * weight[s] for s in open_})
            break
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
        left = max(left, 0.0)
    return target


class _Flow:
    """Maximum flow by blocking flows on level graphs (Dinic), grown by raising capacities."""

    def __init__(self) -> None:
        self.out: list[list[int]] = []
        self.heads: list[int] = []
        self.caps: list[int] = []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def arc(self, a: int, b: int, cap: int) -> int:
        for x, y, c in ((a, b, cap), (b, a, 0)):
            self.out[x].append(len(self.heads))
            self.heads.append(y)
            self.caps.append(c)
        return len(self.heads) - 2

    def augment(self, a: int, b: int) -> None:
        heads, caps, out = self.heads, self.caps, self.out
        while True:
            level = [-1] * len(out)
            level[a], queue = 0, deque([a])
            while queue and level[b] < 0:
                x = queue.popleft()
                for e in out[x]:
                    if caps[e] and level[heads[e]] < 0:
                        level[heads[e]] = level[x] + 1
                        queue.append(heads[e])
            if level[b] < 0:
                return
            at, path = [0] * len(out), []  # next arc to try at each node, arcs from a to the node in hand
            while True:
                x = heads[path[-1]] if path else a
                if x == b:
                    flow = min(caps[e] for e in path)
                    for e in path:
                        caps[e] -= flow
                        caps[e ^ 1] += flow
                    del path[next(i for i, e in enumerate(path) if not caps[e]):]
                    continue
                while at[x] < len(out[x]) and not (caps[out[x][at[x]]] and level[heads[out[x][at[x]]]] == level[x] + 1):
                    at[x] += 1
                if at[x] < len(out[x]):
                    path.append(out[x][at[x]])
                elif path:
                    at[heads[path.pop() ^ 1]] += 1
                else:
                    break


def route(patterns: dict[str, tuple[list, int]], quotas: dict, copies: int = MAX_COPIES) -> dict[str, int]:
    """Words to take from each pattern, by min-cost flow with convex repetition costs.

    ``patterns``: id -> (sources, words); ``quotas``: source -> words.  As many
    quota words as possible are met, at the least cost, where a pattern's words
    cost nothing the first time, one each the second time, and so on.  All cost
    lies on the arcs into the patterns, so a cheapest augmenting path is one
    that enters at the lowest copy: maximum flow with one copy of each pattern,
    grown copy by copy, is the cheapest flow.

    A source whose patterns have no other source needs no flow: its patterns
    are filled evenly copy by copy, in the order of their ids.
    """
    shared = {s for members, _ in patterns.values() if len(members) > 1 for s in members}
    taken: dict[str, int] = {}
    alone: dict = {}
    flow, entry, nodes = _Flow(), {}, {}
    start, end = flow.node(), flow.node()
    for p, (members, words) in sorted(patterns.items()):
        if not members:
            taken[p] = 0
        elif len(members) == 1 and members[0] not in shared:
            alone.setdefault(members[0], []).append((p, words))
        else:
            at = flow.node()
            entry[p] = flow.arc(start, at, 0)
            for s in members:
                if s not in nodes:
                    nodes[s] = flow.node()
                    flow.arc(nodes[s], end, quotas.get(s, 0))
                flow.arc(at, nodes[s], words * copies)
    for s, own in alone.items():
        left = quotas.get(s, 0)
        taken.update((p, 0) for p, _ in own)
        for _ in range(copies):
            for p, words in own:
                more = min(left, words)
                taken[p] += more
                left -= more
    for _ in range(copies if entry else 0):
        for p, e in entry.items():
            flow.caps[e] += patterns[p][1]
        flow.augment(start, end)
    taken.update((p, flow.caps[e + 1]) for p, e in entry.items())
    return taken


def _placed(docs: DataFrame, sources: Column, size: Column, order: list[str], seed: int) -> DataFrame:
    """``_row``, ``pattern`` (canonical text of the source set), ``sources``, ``size`` and ``u``, the seeded place of a row."""
    base = docs.select(F.struct("*").alias("_row"), F.sort_array(F.array_distinct(sources)).alias("sources"),
                       size.cast("long").alias("size"), F.xxhash64(F.lit(seed), *order).bitwiseAND(F.lit((1 << 62) - 1)).alias("u"))
    return base.select("_row", F.to_json(F.struct("sources"), {"ignoreNullFields": "false"}).alias("pattern"), "sources", "size", "u")


def _cuts(thin: DataFrame, plan: DataFrame) -> DataFrame:
    """``pattern``, ``cut``, ``more``: the place in which a pattern's running sum of sizes passes ``rest``, and the words left for it.

    Places are cut into ranges level by level: sums of all ranges of a level are
    one small table, and only the rows of the range that holds the cut go on, so
    no task ranks rows.  Equal rows are one place.
    """
    up = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows, want = thin.filter("size > 0").select("pattern", "u", "size"), plan.select("pattern", "rest")
    for bits in PLACE_BITS:
        sums = rows.groupBy("pattern", F.shiftright("u", bits).alias("part")).agg(F.sum("size").alias("words"))
        upto = sums.select("pattern", "part", "words", F.sum("words").over(up).alias("upto")).join(F.broadcast(want), "pattern")
        held = materialize(upto.filter((F.col("upto") - F.col("words") <= F.col("rest")) & (F.col("rest") < F.col("upto"))).select(
            "pattern", "part", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest")), "cuts")
        # one row per pattern at most
        rows = rows.join(F.broadcast(held.select("pattern", "part")), "pattern").filter(F.shiftright("u", bits) == F.col("part")).drop("part")
        want = held.select("pattern", "rest")
    return held.select("pattern", F.col("part").alias("cut"), F.col("rest").alias("more"))


def mix(docs: DataFrame, sources: Column, size: Column, order: list[str], seed: int = SEED) -> DataFrame:
    """``_row``, ``size``, ``source_size``, ``target`` (of the first source) and ``taken`` words of every row.

    Documents of size 0 take 0.  The document in which a pattern's share ends
    is taken in part, so sums meet the quotas exactly.  Repeated rows are
    documents of their own; rows equal in the columns ``order`` have one place,
    and a share that ends among them takes some of them; the same rows give the
    same mix in any partitioning.  An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    placed = _placed(docs, sources, size, order, seed)
    thin = materialize(placed.drop("_row"), "places")
    found = thin.groupBy("pattern", "sources").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {r["pattern"]: (list(r["sources"]), int(r["words"])) for r in found}
    sizes: dict = {}
    for members, words in patterns.values():
        for s in members:
            sizes[s] = sizes.get(s, 0) + words
    targets = source_targets(sizes)
    taken = route(patterns, {s: round(t) for s, t in targets.items()})
    plan = spark.createDataFrame(
        [(p, taken[p] // w if w else 0, taken[p] % w if w else 0, sizes[m[0]] if m else 0, float(targets[m[0]]) if m else 0.0)
         for p, (m, w) in patterns.items()],
        "pattern string, whole long, rest long, source_size long, target double")
    # both sides have one row per pattern at most, of which there are MAX_PATTERNS at most
    known = F.broadcast(plan.join(F.broadcast(_cuts(thin, plan)), "pattern", "left").drop("rest"))
    rows = placed.drop("sources").join(known, "pattern")
    cols = ["_row", "size", "source_size", "target"]
    once = F.when(F.col("u") < F.col("cut"), F.lit(1)).otherwise(F.lit(0))
    outside = rows.filter(F.col("cut").isNull() | (F.col("u") != F.col("cut")) | (F.col("size") == 0)).select(
        *cols, (F.col("size") * (F.col("whole") + once)).cast("long").alias("taken"))
    # the rows at the cut, equal ones as a rule: what lies before each is a sum over partitions and one inside its own
    at = materialize(rows.filter((F.col("u") == F.col("cut")) & (F.col("size") > 0)).withColumns(
        {"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}), "at")
    inside = Window.partitionBy("pattern", "_part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("pattern").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = at.groupBy("pattern", "_part").agg(F.sum("size").alias("_sum")).select(
        "pattern", "_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    before = F.col("_ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    cut = at.join(parts, ["pattern", "_part"]).withColumn("_before", before).select(*cols, (F.col("whole") * F.col("size") + F.greatest(
        F.lit(0), F.least(F.col("size"), F.col("more") - F.col("_before")))).cast("long").alias("taken"))
    return outside.unionByName(cut)


def mix_rows(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: key, ``size``, ``source_size``, ``target``, ``taken``; texts are read only to count words."""
    thin = materialize(docs.select(F.col(key).alias("k"), F.col(source).alias("s"), word_count(F.col(text)).alias("n"),
                                   F.xxhash64(F.col(text)).alias("h")), "sizes")
    done = mix(thin, F.array("s"), F.col("n"), ["k", "h"])
    return done.select(F.col("_row.k").alias(key), "size", "source_size", "target", "taken")


def take_mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them; one that is taken in part comes whole."""
    done = mix(docs, F.array(source), word_count(F.col(text)), docs.columns)
    copies = F.ceil(F.col("taken") / F.when(F.col("size") > 0, F.col("size"))).cast("int")
    return done.filter("taken > 0").select("_row", F.explode(F.sequence(F.lit(1), copies))).select("_row.*")
