"""Toxicity from a weighted finite-state grammar over clauses.

Small transducers read the word classes of a clause: insult, threat, target,
negation and reported speech.  :func:`compose` builds their product, one table
of transitions, and every insult or threat that it reads emits the state of
the other transducers, that is the pattern it was matched in: aimed at
someone, negated, reported.  A second transducer reads the clause from its end
and turns a match into one that is aimed at someone if a target follows, so
"i will kill you" matches like "you kill".  Each pattern sums the weights of the
lexicon entries that were matched in it; words outside such patterns count
nothing.

The lexicon begins with fixed words and is extended by stems learned from
labels: beginnings of words that stand in toxic documents behind many
different words, so that copies of one document do not make stems, and hardly
ever in clean ones.  A stem costs one prefix entry in the lexicon automaton.
The weights of the patterns are learned by logistic regression on the sums of the
patterns, over training rows that were scored with the stems of the other half of
the training rows; a pattern that the rows hardly show keeps its prior weight.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import materialize

#: Fixed words by class; all lower case.
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb",
           "imbecile", "idioten", "dummkopf", "trottel", "abschaum", "idiote", "imbécile", "débile", "ordure", "idiota",
           "imbécil", "estúpido", "basura")
THREATS = ("kill", "murder", "hurt", "shoot", "stab", "strangle", "destroy", "umbringen", "töten", "tuer", "matar")
TARGETS = ("you", "your", "yours", "he", "she", "him", "her", "they", "them", "their", "du", "dich", "dir", "ihr", "tu",
           "toi", "vous", "ils", "tú", "te", "usted", "ellos")
NEGATIONS = ("not", "no", "never", "nobody", "isn't", "aren't", "don't", "nicht", "kein", "keine", "nie", "pas", "jamais",
             "aucun", "nunca", "jamás", "ningún")
REPORTS = ("said", "says", "wrote", "writes", "called", "claimed", "quoted", "reported", "sagte", "schrieb", "dit", "écrit",
           "dijo", "escribió")

#: Weight of an entry that was not learned, and prior weights of the patterns.
BASE_WEIGHT = 4.0
PRIORS = {"plain": 3.0, "target": 4.0, "negated": 1.5, "reported": 1.5, "threat": 0.5, "threat_target": 4.0}
PATTERNS = tuple(PRIORS)
PRIOR_BIAS, PRIOR_PRECISION = -4.0, 0.05

#: Training rows that are read at most, and the lengths and number of stems.
SAMPLE_ROWS, STEM_LENGTHS, MAX_STEMS = 12_000, (4, 5, 6, 7), 2_000
#: A stem needs this many contexts and documents, and this share of the toxic rows if that is more.
MIN_CONTEXTS, MIN_DOCS, MIN_SHARE, MIN_RATIO, MAX_CLEAN = 3, 2, 0.004, 25.0, 0.002

_CLASSES = ("other", "insult", "threat", "target", "negation", "report")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:\n]")


def flag(on: str, reach: int | None = None) -> tuple[int, dict]:
    """Transducer that remembers a class for the rest of the clause, or for ``reach`` words: states 0..n, 0 is off."""
    n = reach or 1
    moves = {}
    for state in range(n + 1):
        for c in _CLASSES:
            moves[state, c] = n if c == on else (state if reach is None else max(state - 1, 0))
    return n + 1, moves


@dataclass(frozen=True)
class Grammar:
    """Product transducer: next state and emitted pattern for (state, class); state 0 begins a clause."""

    step: dict[tuple[int, str], tuple[int, str | None]] = field(default_factory=dict)
    #: From the end of the clause: next state for (state, class), and the pattern that (state, pattern) becomes.
    back: dict[tuple[int, str], int] = field(default_factory=dict)
    aimed: dict[tuple[int, str], str] = field(default_factory=dict)

    def patterns(self, classes: list[str]) -> list[str | None]:
        state, out = 0, []
        for c in classes:
            state, emitted = self.step[state, c]
            out.append(emitted)
        state = 0
        for i in range(len(classes) - 1, -1, -1):
            if out[i]:
                out[i] = self.aimed.get((state, out[i]), out[i])
            state = self.back[state, classes[i]]
        return out


def compose() -> Grammar:
    """Target, negation (three words) and report flags under the insult and threat emitters, and the target flag from behind."""
    parts = [flag("target"), flag("negation", reach=3), flag("report")]
    states = list(itertools.product(*[range(n) for n, _ in parts]))
    index = {s: i for i, s in enumerate(states)}
    table = {}
    for s in states:
        for c in _CLASSES:
            after = tuple(moves[x, c] for x, (_, moves) in zip(s, parts, strict=True))
            target, negated, reported = (x > 0 for x in s)
            out = None
            if c == "insult":
                out = "reported" if reported else "negated" if negated else "target" if target else "plain"
            elif c == "threat":
                out = "negated" if negated else "reported" if reported else "threat_target" if target else "threat"
            table[index[s], c] = index[after], out
    _, behind = flag("target")
    return Grammar(table, behind, {(1, "plain"): "target", (1, "threat"): "threat_target"})


@dataclass(frozen=True)
class Model:
    """Learned stems with their weights, and the weights of the patterns."""

    stems: dict[str, float]
    bias: float = PRIOR_BIAS
    weights: dict[str, float] = field(default_factory=lambda: dict(PRIORS))

    def score(self, sums: Column) -> Column:
        """Probability from the sums of :data:`PATTERNS`."""
        odds = F.lit(self.bias)
        for i, p in enumerate(PATTERNS):
            odds = odds + F.lit(self.weights[p]) * F.log1p(F.get(sums, F.lit(i)))
        return 1 / (1 + F.exp(-odds))


class Scorer:
    """Clause scores of texts: an automaton of all insults, stems and threats finds the clauses worth reading."""

    def __init__(self, stems: dict[str, float]):
        import ahocorasick
        self.exact = {w: "insult" for w in INSULTS} | {w: "threat" for w in THREATS}
        self.classes = self.exact | {w: c for c, ws in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in ws}
        self.stems, self.sizes = stems, sorted({len(s) for s in stems})
        self.grammar = compose()
        self.finder = ahocorasick.Automaton()
        for w in {*self.exact, *stems}:
            self.finder.add_word(w, len(w))
        self.finder.make_automaton()

    def word(self, w: str) -> tuple[str, float]:
        """Class and weight of a lower-case word."""
        best = max((self.stems.get(w[:n], 0.0) for n in self.sizes if len(w) >= n), default=0.0)
        if w in self.exact:
            return self.exact[w], max(best, BASE_WEIGHT)
        return ("insult", best) if best else (self.classes.get(w, "other"), 0.0)

    def score(self, text: str) -> tuple[list[float], int]:
        """Summed weights of the matches by pattern, and the number of clauses that matched."""
        low, total, n, done = text.lower(), [0.0] * len(PATTERNS), 0, 0
        for end, size in self.finder.iter(low):
            begin = end - size + 1
            if begin < done or (begin and low[begin - 1].isalpha()):
                continue
            left = max(low.rfind(c, done, begin) for c in ".!?;:\n") + 1 or done
            stop = _CLAUSE_END.search(low, end)
            right = stop.start() if stop else len(low)
            words = [self.word(w) for w in _WORD.findall(low, left, right)]
            got = 0.0
            for (_, x), p in zip(words, self.grammar.patterns([c for c, _ in words]), strict=True):
                if p:
                    total[_PLACE[p]] += x
                    got += x
            n, done = n + (got > 0), right
        return total, n


_PLACE = {p: i for i, p in enumerate(PATTERNS)}


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 4 == 2


def _train_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """``t``, ``y``, ``half`` of at most SAMPLE_ROWS labelled documents, held-out ones excluded."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter(
        "k IS NOT NULL AND y IS NOT NULL").filter(~held_out(F.col("k"))).groupBy("k").agg(F.max("y").alias("y"))
    picked = known.orderBy(F.xxhash64(F.lit(7), "k"), "k").limit(SAMPLE_ROWS)  # a sample of bounded size
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(picked), "k")
    return rows.select("t", "y", F.pmod(F.xxhash64(F.lit(11), "k"), F.lit(2)).cast("int").alias("half"))


def learn_stems(train: DataFrame) -> dict[str, float]:
    """Stems and weights from rows ``t``, ``y``; counting is spread over the rows' tasks."""
    def toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = _WORD.findall(text.lower())
                seen = {(w[:n], hash_word(p)) for p, w in zip(["", *words], words, strict=False) for n in STEM_LENGTHS if len(w) >= n}
                if seen:
                    stems, before = zip(*seen, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(stems), pa.array(before, pa.int64())], names=["stem", "before"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = {0: Counter(), 1: Counter()}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count[int(y > 0)].update({w[:n] for w in set(_WORD.findall(text.lower())) for n in STEM_LENGTHS if len(w) >= n})
            for y, c in count.items():
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([y] * len(c), pa.int32()),
                                                      pa.array(list(c.values()), pa.int64())], names=["stem", "y", "n"])

    row = train.agg(F.sum((F.col("y") > 0).cast("long")).alias("bad"), F.count(F.lit(1)).alias("all")).first()
    bad, clean = int(row["bad"] or 0), int(row["all"]) - int(row["bad"] or 0)
    if not bad or not clean:
        return {}
    contexts = (train.filter("y > 0").select("t").mapInArrow(toxic, "stem string, before long")
                .groupBy("stem", "before").count().groupBy("stem").agg(F.count(F.lit(1)).alias("contexts"))
                .filter(F.col("contexts") >= max(MIN_CONTEXTS, MIN_SHARE * bad)))
    counts = (train.select("t", "y").mapInArrow(documents, "stem string, y int, n long").groupBy("stem")
              .agg(F.sum(F.col("n") * F.col("y")).alias("bad"), F.sum(F.col("n") * (1 - F.col("y"))).alias("clean")))
    rate = ((F.col("bad") + 0.5) / bad) / ((F.col("clean") + 0.5) / clean)
    found = (counts.join(contexts, "stem").withColumn("rate", rate)
             .filter((F.col("rate") >= MIN_RATIO) & (F.col("bad") >= max(MIN_DOCS, MIN_SHARE * bad)) & (F.col("clean") <= F.lit(MAX_CLEAN * clean)))
             .orderBy(F.desc("rate"), "stem").limit(MAX_STEMS).collect())
    stems: dict[str, float] = {}
    for r in sorted(found, key=lambda r: (len(r["stem"]), r["stem"])):
        if not any(r["stem"][:n] in stems for n in range(1, len(r["stem"]))):  # the shortest stem stands for the longer ones
            stems[r["stem"]] = min(8.0, math.log(r["rate"]))
    return stems


def hash_word(w: str) -> int:
    import zlib
    return zlib.crc32(w.encode("utf-8", "surrogatepass"))


def _scored(docs: DataFrame, stems: dict[str, float], schema: str) -> DataFrame:
    """First column: text; the others are passed on, followed by ``sums`` (of :data:`PATTERNS`) and ``clauses``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(stems)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = [scorer.score(t or "") for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([x for x, _ in got], pa.list_(pa.float64())),
                                                  pa.array([n for _, n in got], pa.int64())],
                                                 names=[*part.schema.names[1:], "sums", "clauses"])

    return docs.mapInArrow(run, f"{schema}, sums array<double>, clauses long")


def pattern_weights(sums: np.ndarray, toxic: np.ndarray) -> tuple[float, dict[str, float]]:
    """Bias and weight of each pattern by logistic regression on ``log1p`` of the sums; no weight is below 0.

    The prior pulls weights to :data:`PRIORS`; it decides where the rows show
    too little, and alone where they hold one class only.
    """
    center = np.array([PRIOR_BIAS, *PRIORS.values()])
    w, free = center.copy(), np.ones(len(center), dtype=bool)
    if len(toxic) and 0 < toxic.sum() < len(toxic):
        a = np.column_stack([np.ones(len(sums)), np.log1p(sums)])
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
            grad = a.T @ (toxic - p) - PRIOR_PRECISION * (w - center)
            free = (w > 0) | (grad > 0)
            free[0] = True
            hess = (a * (p * (1 - p))[:, None]).T @ a + PRIOR_PRECISION * np.eye(len(w))
            move = np.zeros(len(w))
            move[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
            new = w + move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-9))
            new[1:] = np.maximum(new[1:], 0.0)
            done = np.abs(new - w).max() < 1e-9
            w = new
            if done:
                break
    return float(w[0]), {p: float(x) for p, x in zip(PATTERNS, w[1:], strict=True)}


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Stems and pattern weights from at most :data:`SAMPLE_ROWS` labelled rows, which are written once."""
    train = materialize(_train_rows(docs, labels, key, text, label), "train")
    halves = [_scored(train.filter(f"half = {1 - h}").select("t", "y"), learn_stems(train.filter(f"half = {h}")), "y int")
              for h in (0, 1)]
    # equal sums are one row
    rows = halves[0].unionByName(halves[1]).groupBy("sums", (F.col("y") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()
    sums = np.array([r["sums"] for r in rows]).reshape(len(rows), len(PATTERNS))
    n = np.array([r["n"] for r in rows], dtype=np.int64)
    bias, weights = pattern_weights(np.repeat(sums, n, axis=0), np.repeat(np.array([r["y"] for r in rows], dtype=float), n))
    return Model(learn_stems(train), bias, weights)


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: key, ``held_out``, ``score``, ``predicted``, ``clauses``.

    Null and empty texts match nothing and get the score of no clause; repeated
    rows are scored one by one; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    raw = _scored(docs.select(F.col(text).alias("t"), F.col(key).alias("k")), model.stems, f"k {kind}")
    out = raw.select("k", "clauses", model.score(F.col("sums")).alias("score"))
    return out.select(F.col("k").alias(key), F.coalesce(held_out(F.col("k")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"), "clauses")
