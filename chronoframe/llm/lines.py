"""Line deduplication by site-relative frequency.

For every site, the pages that contain a line are divided by the pages of the
site; lines above the ratio are boilerplate and are cut from all pages of that
site.  Counting shuffles one narrow row per page and distinct line, summed
before the shuffle.  A site has at most ``lines per page / ratio`` boilerplate
lines, so they travel as one small array per site, joined to the pages by
site; Spark broadcasts that side when it is small and otherwise splits a hot
site's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import SPACES, let, materialize

RATIO, MIN_PAGES = 0.02, 5


def _line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(pages: DataFrame, site: str = "source", text: str = "text",
                ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``site`` and ``lines``: 64-bit hashes of its boilerplate lines."""
    own = pages.select(F.col(site).alias("site"), F.col(text).alias("t"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("t")), lambda x: _line_key(x) != ""),
                                        lambda x: F.xxhash64(_line_key(x))))
    seen = (own.select("site", F.explode(keys).alias("line")).groupBy("site", "line")
            .agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages))
    totals = own.groupBy("site").agg(F.count(F.lit(1)).alias("total")).withColumnRenamed("site", "of")
    often = seen.join(totals, F.col("site").eqNullSafe(F.col("of"))).filter(F.col("pages") > F.col("total") * ratio)
    return often.groupBy("site").agg(F.collect_set("line").alias("lines"))


def cut_boilerplate(pages: DataFrame, site: str = "source", text: str = "text",
                    ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``_row`` (the whole input row), ``n_lines``, ``n_dropped`` and the cleaned ``clean`` text.

    Lines are compared without outer white space; blank lines are never
    dropped.  A null text stays null with 0 lines, an empty one has 1 line; a
    null site is a site of its own; repeated rows count as pages of their own;
    an empty table gives no rows.
    """
    packed = pages.select(F.struct("*").alias("_row"), F.col(site).alias("_s"), F.col(text).alias("_t"))
    # written first, so that the planner knows its size: small, it is broadcast and no text is shuffled
    found = materialize(boilerplate(pages, site, text, ratio, min_pages), "boilerplate")
    joined = packed.join(found, F.col("_s").eqNullSafe(F.col("site")), "left")
    kept = let(F.coalesce(F.col("lines"), F.array().cast("array<long>")), lambda bad: F.filter(
        _lines(F.col("_t")), lambda x: ~F.array_contains(bad, F.xxhash64(_line_key(x))) | (_line_key(x) == "")))
    out = joined.select("_row", F.col("_t").alias("_t"), F.size(_lines(F.col("_t"))).alias("_n"), kept.alias("_k"))
    null = F.col("_t").isNull()
    return out.select("_row", F.when(null, F.lit(0)).otherwise(F.col("_n")).cast("long").alias("n_lines"),
                      F.when(null, F.lit(0)).otherwise(F.col("_n") - F.size("_k")).cast("long").alias("n_dropped"),
                      F.when(~null, F.array_join("_k", "\n")).alias("clean"))


def line_rows(pages: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text") -> DataFrame:
    done = cut_boilerplate(pages.select(key, site, text), site, text)
    return done.select(F.col("_row")[key].alias(key), "n_lines", "n_dropped", F.col("clean").alias("text"))


def drop_boilerplate(pages: DataFrame, site: str = "source", text: str = "text") -> DataFrame:
    """The pages with cleaned text and their other columns as they were.

    A page made of nothing but frequent lines is a copy rather than a frame
    around something; it keeps its text and is left to near-duplicate removal.
    """
    done = cut_boilerplate(pages, site, text)
    blank = (F.col("n_dropped") > 0) & (F.btrim(F.col("clean"), F.lit(SPACES)) == "")
    cleaned = F.when(blank, F.col("_row")[text]).otherwise(F.col("clean"))
    return done.select(*[cleaned.alias(c) if c == text else F.col("_row")[c].alias(c) for c in pages.columns])


def with_length(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with the length column, where there is one, set to the text's length in characters."""
    if length not in docs.columns:
        return docs
    kind = docs.schema[length].dataType
    return docs.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(F.char_length(text)).cast(kind))


ORACLE = """
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
k AS (SELECT DISTINCT doc_id, source, trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS line FROM l),
bad AS (
  SELECT k.source, k.line FROM k JOIN (SELECT source, count(*) AS total FROM documents GROUP BY source) t
    ON k.source IS NOT DISTINCT FROM t.source
  WHERE k.line <> '' GROUP BY k.source, k.line, t.total
  HAVING count(*) >= 5 AND count(*) > t.total * 0.02::DOUBLE),
b AS (SELECT source, list(line) AS lines FROM bad GROUP BY source),
d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls,
         list_filter(string_split(text, chr(10)),
           lambda x: NOT coalesce(list_contains(b.lines, trim(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))), false)) AS keep
  FROM documents LEFT JOIN b ON documents.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END::BIGINT AS n_lines,
       CASE WHEN text IS NULL THEN 0 ELSE len(ls) - len(keep) END::BIGINT AS n_dropped,
       CASE WHEN text IS NOT NULL THEN array_to_string(keep, chr(10)) END AS text
FROM d
"""
