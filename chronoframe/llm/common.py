"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.session import checkpoint_dir

#: The white space of every word count here: space and U+0009..U+000D.
SPACE_CLASS = " \\t\\n\\x0B\\f\\r"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder below the session's shared checkpoint folder, removed when the driver's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage like a reliable checkpoint, but columnar and compressed: a
    lost executor costs only the tasks that were running on it.
    """
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row (a one-element ``transform``)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+")
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as long, without keeping the words (null: 0)."""
    flat = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(flat == "", F.lit(0)).otherwise(F.size(F.split(flat, f"[{SPACE_CLASS}]+"))).cast("long")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; ``LLM_TOKENIZERS`` names another folder."""
    folder = os.environ.get("LLM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)
