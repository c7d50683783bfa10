"""Corpus pipeline: quality rules, line dedup, near-dup removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes every stage's result as Parquet into the session's shared folder and
reads it again as the next stage's ``docs``.  All stages but the last return
the columns of ``documents``, with whatever further columns came in.

Odd rows, for all stages: rows with null or repeated keys are rows of their
own; a null source is a source of its own; an empty table gives an empty one.
Documents without text, or of fewer than 20 words, end at the quality rules.
Repeated rows and copies under other keys pass the first two stages and become
one row in the third; long texts are read whole and packed in pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoframe.llm import lines, mixing, near_dup, quality, windows
from chronoframe.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the weighted votes reject go."""
    return quality.keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source are cut from its documents; ``n_chars`` follows the text."""
    return lines.with_length(lines.drop_boilerplate(docs))


def minhash_near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more."""
    return near_dup.drop_near_duplicates(docs, width=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice."""
    return mixing.take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a packed window."""
    return windows.window_digest(windows.pack_windows(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dup", minhash_near_dup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: The votes' EM, SuperMinHash groups and tokenizer ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
