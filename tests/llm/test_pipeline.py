"""The pipeline's stages keep their contracts on the smallest tables."""

import random
import sys

from pyspark.sql import functions as F

from chronoframe.llm import near_dup, quality
from chronoframe.llm.common import materialize, table

SF001 = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    assert "corpus_pipeline" in sys.modules and [n for n, _ in p.STAGES] == [
        "quality_rules", "line_dedup", "minhash_near_dup", "source_mixing", "packing"]
    docs = table(spark, SF001, "documents")
    kept = {r.doc_id for r in quality.quality_rows(docs).filter("kept").select("doc_id").collect()}
    got = {}
    for name, stage in p.STAGES:
        out = materialize(stage(spark, docs, SF001), name)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        got[name] = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "minhash_near_dup":
            want = {r.doc_id for r in near_dup.near_duplicates(docs).filter("kept").collect()}
            assert sorted(got[name]) == sorted(want)
        docs = out
    assert set(got["quality_rules"]) == kept == set(got["line_dedup"])
    assert max(got["source_mixing"].count(k) for k in set(got["source_mixing"])) <= 2
    assert set(got["packing"]) == set(got["source_mixing"])


def prose(seed, n):
    rng = random.Random(seed)
    words = ["river", "engine", "market", "winter", "garden", "signal", "paper", "window", "teacher", "island", "history", "bridge",
             "copper", "village", "morning", "letter", "question", "mountain", "harbour", "kitchen", "the", "of", "and", "to", "in"]
    out = []
    for i in range(n):
        out.append(rng.choice(words) + str(rng.randrange(400)) if rng.random() < 0.4 else rng.choice(words))
        if i % 12 == 11:
            out[-1] += "."
    return " ".join(out)


EXTRA = {"site": "x", "line": 1, "_row": 2.0, "cid": "c", "size": 3, "target": "t", "length": 4, "key": None}


def odd_documents(spark):
    """Null keys, texts and sources, empty and very long texts, repeated rows and keys, and columns that stages use themselves."""
    rows = [(i, prose(i, 120), "en", f"s{i % 3}") for i in range(40)]
    rows += [(0, prose(0, 120), "en", "s0")] * 3                      # repeated rows
    rows += [(900 + i, prose(7, 120), "en", "s1") for i in range(5)]  # copies under other keys
    rows += [(3, prose(77, 120), "en", "s2"), (None, prose(78, 120), "en", "s0"), (None, prose(79, 120), None, None)]
    rows += [(950, None, "en", "s0"), (951, "", "en", "s1"), (952, " \n\t ", None, None), (953, prose(5, 60000), "en", "s0")]
    docs = spark.createDataFrame([(k, t, g, s, None if t is None else len(t)) for k, t, g, s in rows],
                                 "doc_id long, text string, lang string, source string, n_chars int")
    return docs.withColumns({n: F.lit(v).cast("string") if v is None else F.lit(v) for n, v in EXTRA.items()})


def test_stages_on_odd_rows(spark):
    import corpus_pipeline as p
    docs = materialize(odd_documents(spark), "odd")
    at = {}
    for name, stage in p.STAGES:
        out = materialize(stage(spark, docs, None), name)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        at[name], docs = out, out
    texts = lambda n: [(r.doc_id, r.text) for r in at[n].select("doc_id", "text").collect()]
    first = texts("quality_rules")
    assert not {950, 951, 952} & {k for k, _ in first}  # fewer than 20 words
    assert (953, prose(5, 60000)) in first and sum(k is None for k, _ in first) == 2 and first.count((0, prose(0, 120))) == 4
    left = texts("minhash_near_dup")
    assert left.count((0, prose(0, 120))) == 1 and sum(t == prose(7, 120) for _, t in left) == 1
    assert sorted((t for t in {t for _, t in first})) == sorted(t for _, t in left)  # one row for each text, none lost
    mixed = texts("source_mixing")
    assert set(mixed) <= set(left) and max(mixed.count(x) for x in mixed) <= 2
    pieces = at["packing"].collect()
    assert sum(r.length for r in pieces) == sum({(r.doc_id, r.start, r.sequence_id): r.length for r in pieces}.values())
    assert {r.doc_id for r in pieces} == {k for k, _ in mixed}


def test_stages_on_an_empty_table(spark):
    import corpus_pipeline as p
    docs = odd_documents(spark).filter("doc_id < 0")
    for name, stage in p.STAGES:
        out = stage(spark, docs, None)
        assert out.count() == 0
        if name != "packing":
            assert out.dtypes == docs.dtypes
            docs = materialize(out, name)


def test_registered():
    import __spark_entry__ as e
    names = e.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13
