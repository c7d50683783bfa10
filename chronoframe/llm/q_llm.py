"""Registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoframe.llm import (ann, block_names, fst_count, lines, mixing, near_dup, quality, token_output, toxicity, trie, urls, whitening,
                             windows)
from chronoframe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn
    return deco


@register("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rows(table(spark, sf_dir, "documents"))


@register("op1_token_output")
def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.pack_matrix(table(spark, sf_dir, "documents"))


@register("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_digest(windows.pack_windows(table(spark, sf_dir, "documents")))


@register("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fst_count.count_tokens(table(spark, sf_dir, "documents"))


@register("op8_minhash_near_dup")
def op8_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


@register("op4_line_dedup", lines.ORACLE)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_rows(table(spark, sf_dir, "documents"))


@register("op6_source_mixing")
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(table(spark, sf_dir, "documents"))


@register("op7_url_filter", urls.ORACLE)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@register("op5_nearest_neighbours")
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@register("op11_block_naming", block_names.ORACLE)
def op11_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_copies(table(spark, sf_dir, "documents")).drop("identity")


@register("op12_conversation_trie")
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
