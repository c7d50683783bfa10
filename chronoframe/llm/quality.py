"""Weak-supervision quality filter: rules vote or abstain, EM weighs them.

Every rule looks at counts of one document and votes good (1), bad (-1) or
abstains (0).  The generative model has a latent quality bit, and for each
rule the probability that a cast vote is "bad" given that bit.  Votes of all
documents are first counted by vote pattern: at most ``3 ** len(RULES)`` rows,
whatever the size of the corpus.  Each EM step is one aggregate over that
pattern table; the posterior of a document is then a plain column expression
in its votes, so no join and no Python touches the rows.

Defined results: a null or blank text has no words, every count is 0 and the
base rules fail it; repeated rows are judged one by one; an empty table gives
an empty result and the start values of the model.  Columns of the input are
carried in one struct, so any column names may clash with the names used here.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import SPACES, let, materialize, word_array

#: ASCII characters that are no letters.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())
WINDOW = 8
#: Smoothing and start values: pseudo votes of each rule and class, and their
#: share of "bad".  A rule finds one kind of junk, so most junk passes it too;
#: with these values one cast "bad" outweighs the other rules' "good".
PSEUDO, PSEUDO_BAD, START_PRIOR = 20.0, {1: 0.005, 0: 0.15}, 0.8


def _hits(text: Column, chars: str) -> Column:
    """Number of characters of a regular-expression class; splitting costs far less than replacing."""
    return (F.size(F.split(text, chars)) - 1).cast("long")


def _pairwise(hashes: Column, step: int) -> Column:
    """Hash of every entry with the one ``step`` places on; the last ``step`` entries have no partner."""
    return F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + step)))


def text_features(text: Column) -> Column:
    """Struct of the counts that the rules read, from whole texts.

    ``n_repeat_words`` counts words lying in a window of eight words whose
    64-bit hash occurs twice or more in the same text, all occurrences
    included.  Window hashes are built by doubling (2, 4, 8 words).  Two equal
    windows of eight hold five pairs of equal windows of four, so texts with
    fewer repeats than that need no further work; the others sort their windows.
    """
    clean = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(clean, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def covered(win: Column) -> Column:
        ordered = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = let(ordered, lambda o: F.sort_array(F.transform(
            F.filter(F.transform(o, lambda x, k: F.struct(
                x["i"].alias("i"),
                (F.coalesce(F.get(o, k - 1)["h"] == x["h"], F.lit(False))
                 | F.coalesce(F.get(o, k + 1)["h"] == x["h"], F.lit(False))).alias("twin"))),
                lambda x: x["twin"]), lambda x: x["i"])))
        return let(same, lambda s: F.aggregate(
            F.transform(s, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - p, F.lit(WINDOW)))),
            F.lit(0), lambda a, x: a + x))

    def repeat_words(fours: Column) -> Column:
        eights = F.filter(_pairwise(fours, 4), lambda x, i: i <= F.size(fours) - WINDOW)
        return F.when(F.size(fours) - F.size(F.array_distinct(fours)) < 5, F.lit(0)).otherwise(covered(eights))

    def by_words(words: Column) -> Column:
        # a word of up to three characters without a letter is a mark, not a word
        marks = F.filter(words, lambda x: (F.char_length(x) <= 3) & (F.translate(x, MARKS, "") == ""))
        return F.struct(F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
                        F.size(marks).cast("long").alias("n_mark_words"),
                        let(F.transform(words, lambda x: F.xxhash64(x)), by_hashes).alias("h"))

    def by_hashes(hashes: Column) -> Column:
        fours = let(_pairwise(hashes, 1), lambda twos: _pairwise(twos, 2))
        twins = F.filter(hashes, lambda x, i: (i > 0) & (F.get(hashes, i - 1) == x))
        return F.struct(
            F.size(hashes).cast("long").alias("n_words"),
            F.size(F.array_distinct(hashes)).cast("long").alias("n_distinct"),
            F.size(twins).cast("long").alias("n_stutter"),
            let(fours, repeat_words).cast("long").alias("n_repeat_words"))

    def by_lines(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("long").alias("n_lines"),
                        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    return F.struct(
        let(word_array(text), by_words).alias("w"), let(lines, by_lines).alias("l"),
        _hits(clean, "[#*$%&|<>]").alias("n_symbols"), _hits(clean, "!").alias("n_bangs"),
        _hits(clean, "[A-Z]").alias("n_upper"))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``_row`` (the whole input row) and one column for each count."""
    base = docs.select(F.struct("*").alias("_row"), text_features(F.col(text)).alias("_f"))
    return base.select(
        "_row", *[F.col(f"_f.w.h.{c}") for c in ("n_words", "n_distinct", "n_stutter", "n_repeat_words")],
        *[F.col(f"_f.w.{c}") for c in ("word_chars", "n_mark_words")],
        *[F.col(f"_f.l.{c}") for c in ("n_lines", "n_dup_lines")],
        *[F.col(f"_f.{c}") for c in ("n_symbols", "n_bangs", "n_upper")])


def _rule(value: Column, bad: Column, good: Column) -> Column:
    vote = F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))
    return F.when(value.isNull(), F.lit(0)).otherwise(vote).cast("int")


def rules() -> dict[str, Column]:
    """Vote column of each rule over the columns of :func:`counts`."""
    words = F.col("n_words")
    per_word = lambda c: F.col(c) / F.when(words > 0, words)
    symbols, bangs, repeats = per_word("n_symbols"), per_word("n_bangs"), per_word("n_repeat_words")
    marks, stutter = per_word("n_mark_words"), per_word("n_stutter")
    dirt = (F.col("n_symbols") + F.col("n_bangs")) / F.when(F.col("word_chars") > 0, F.col("word_chars"))
    upper = F.col("n_upper") / F.when(F.col("word_chars") > 0, F.col("word_chars"))
    length = per_word("word_chars")
    dup = F.col("n_dup_lines") / F.when(F.col("n_lines") > 1, F.col("n_lines"))
    # a text of n words draws its distinct words from a vocabulary that grows slower than n
    variety = F.when(words >= 50, F.col("n_distinct") / F.pow(words, F.lit(0.75)))
    return {
        "length": _rule(words, words < 20, words >= 50),
        "symbols": _rule(symbols, symbols > 0.2, symbols <= 0.05),
        "shouting": _rule(bangs, bangs > 0.4, bangs <= 0.05),
        "dirt": _rule(dirt, dirt > 0.1, dirt <= 0.02),
        "marks": _rule(marks, marks > 0.2, marks <= 0.05),
        "stutter": _rule(stutter, stutter > 0.3, stutter <= 0.05),
        "capitals": _rule(upper, upper > 0.5, upper <= 0.15),
        "repeats": _rule(repeats, repeats > 0.3, repeats <= 0.05),
        "lines": _rule(dup, dup > 0.5, dup <= 0.1),
        "word_length": _rule(length, (length < 1.8) | (length > 15), (length >= 2.5) & (length <= 11)),
        "variety": _rule(variety, variety < 0.25, variety >= 0.8),
    }


@dataclass(frozen=True)
class Model:
    """Share of good documents, and P(vote is bad | cast, class) of each rule."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self, votes: Column) -> Column:
        """P(good | votes); ``votes`` is an array with an entry for each rule."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for j, (g, b) in enumerate(zip(self.good, self.bad, strict=True)):
            odds = odds + (F.when(votes[j] < 0, F.lit(math.log(g / b)))
                           .when(votes[j] > 0, F.lit(math.log((1 - g) / (1 - b)))).otherwise(F.lit(0.0)))
        return 1 / (1 + F.exp(-odds))


_STATE = "struct<prior:double,good:array<double>,bad:array<double>>"


def _em_round(state: Column, patterns: Column, n_rules: int) -> Column:
    """One E and M step over ``array<struct<votes, n>>`` as a column expression."""
    weights = F.struct(
        F.log(state["prior"] / (1 - state["prior"])).alias("odds"),
        F.zip_with(state["good"], state["bad"], lambda g, b: F.log(g / b)).alias("no"),
        F.zip_with(state["good"], state["bad"], lambda g, b: F.log((1 - g) / (1 - b))).alias("yes"))

    def share(x: Column, w: Column) -> Column:
        odds = F.aggregate(x["votes"], F.struct(w["odds"].alias("s"), F.lit(0).alias("j")), lambda a, v: F.struct(
            (a["s"] + F.when(v < 0, F.get(w["no"], a["j"])).when(v > 0, F.get(w["yes"], a["j"])).otherwise(F.lit(0.0))).alias("s"),
            (a["j"] + 1).alias("j")), lambda a: a["s"])
        return let(1 / (1 + F.exp(-odds)), lambda p: F.struct(
            x["votes"].alias("votes"), (x["n"] * p).alias("good"), (x["n"] * (1 - p)).alias("bad")))

    def total(r: Column, side: str, hit) -> Column:
        return F.aggregate(r, F.lit(0.0), lambda a, x: a + F.when(hit(x["votes"]), x[side]).otherwise(F.lit(0.0)))

    def rates(r: Column, side: str) -> Column:
        k = 1 if side == "good" else 0
        return F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), lambda j:
                           (total(r, side, lambda v: F.get(v, j) < 0) + PSEUDO * PSEUDO_BAD[k])
                           / (total(r, side, lambda v: F.get(v, j) != 0) + PSEUDO))

    def step(r: Column) -> Column:
        whole = lambda side: total(r, side, lambda v: F.lit(True))
        # a rule that votes "bad" must not speak for quality: keep its two rates in order
        return let(F.struct(rates(r, "good").alias("g"), rates(r, "bad").alias("b")), lambda x: F.struct(
            ((whole("good") + 8) / (whole("good") + whole("bad") + 10)).alias("prior"),
            F.zip_with(x["g"], x["b"], lambda g, b: F.greatest(F.least(g, b, F.lit(0.98)), F.lit(1e-4))).alias("good"),
            F.zip_with(x["g"], x["b"], lambda g, b: F.least(F.greatest(g, b, F.lit(1.5e-4)), F.lit(0.99))).alias("bad"),
        ).cast(_STATE))

    return let(weights, lambda w: let(F.transform(patterns, lambda x: share(x, w)), step))


def fit(votes: DataFrame, n_rules: int, column: str = "votes", rounds: int = 25) -> Model:
    """EM over the votes of all documents.

    The documents are counted by vote pattern; the patterns, at most
    ``3 ** n_rules`` however large the corpus is, meet in one row, over which
    all rounds run as a single expression.
    """
    table = (votes.groupBy(F.col(column).alias("votes")).agg(F.count(F.lit(1)).alias("n"))
             .agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p")))
    start = F.struct(F.lit(START_PRIOR).alias("prior"), F.array_repeat(F.lit(PSEUDO_BAD[1]), n_rules).alias("good"),
                     F.array_repeat(F.lit(PSEUDO_BAD[0]), n_rules).alias("bad")).cast(_STATE)
    row = table.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start,
                                   lambda s, _: _em_round(s, F.col("p"), n_rules)).alias("m")).first()["m"]
    return Model(row["prior"], tuple(row["good"]), tuple(row["bad"]))


def voted(docs: DataFrame, text: str = "text") -> DataFrame:
    return counts(docs, text).withColumn("votes", F.array(*rules().values()))


def base_failed(min_words: int = 20, max_repeat: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)


def judge(docs: DataFrame, text: str = "text", min_posterior: float = 0.5) -> DataFrame:
    """``_row`` with its counts, ``votes``, ``quality`` (posterior), ``base_failed`` and ``kept``.

    The scored rows are written once to the shared folder, as the texts are
    scored twice otherwise: once to count votes, once to apply the model.
    """
    scored = materialize(voted(docs, text), "quality")
    model = fit(scored, len(rules()))
    return (scored.withColumn("quality", model.posterior(F.col("votes")))
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= min_posterior)))


def quality_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, counts, verdicts and posterior; no text is written anywhere."""
    thin = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    scored = voted(thin, "t").select(F.col("_row.k").alias(key), "*").drop("_row")
    judged = materialize(scored, "quality")
    model = fit(judged, len(rules()))
    quality = model.posterior(F.col("votes"))
    return judged.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & (quality >= 0.5)).alias("kept"),
        quality.alias("quality"), "votes")


def keep_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    return judge(docs, text).filter("kept").select("_row.*")
