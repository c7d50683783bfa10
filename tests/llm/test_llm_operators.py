"""The training-data operators against brute force on small tables, and on odd rows."""

import functools
import itertools
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import ann, components, fst_count, lines, mixing, near_dup, quality, token_output, tokens, toxicity, urls, windows
from chronoframe.llm.common import tokenizer_path

SF001 = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = " ".join(f"word{i % 977}" for i in range(30_000))

#: Nulls, empty and very long texts, repeated rows, odd characters; other columns clash with internal names.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog " * 3, "s1"), (1, "the quick brown fox jumps over the lazy dog " * 3, "s1"),
    (2, None, "s1"), (3, "", "s1"), (4, "  \n\t ", None), (5, "one", None), (6, LONG, "s2"), (7, LONG + " tail", "s2"),
    (8, "x" * 20_000, "s2"), (None, "row without id it is\n\nidiot", "s3"), (9, "é\u00a0ü\x1c你好 \U0001f600 don't 'tis <|endoftext|>", None),
    (10, None, None),
]


def odd_docs(spark, rows=ODD):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = {"n_words": F.lit("x"), "kept": F.lit(True), "size": F.lit(-1), "_row": F.lit(0), "bucket": F.lit(3), "ids": F.lit("i"),
             "cid": F.lit(1), "pattern": F.lit("p"), "k": F.lit(2), "t": F.lit("t"), "n": F.lit(7), "line": F.lit(1), "lines": F.lit(2),
             "score": F.lit(0.5), "lang": F.lit("en"), "n_chars": F.char_length("text").cast("long"), "_k": F.lit(1), "_s": F.lit(1)}
    return df.withColumns(clash)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# ---------------------------------------------------------------- quality rules

def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    spots = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    ls = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(ls) - len(set(ls)), len(spots))


def test_quality_counts_match_brute_force(spark, docs, texts):
    got = {r.doc_id: tuple(r)[1:6] for r in quality.quality_rows(docs).collect()}
    assert got == {k: brute_counts(v) for k, v in texts.items()}


def test_quality_odd_rows(spark):
    rows = quality.quality_rows(odd_docs(spark)).collect()
    assert len(rows) == len(ODD)
    assert sorted((r.doc_id or 0, *tuple(r)[1:6]) for r in rows) == sorted((k or 0, *brute_counts(t)) for k, t, _ in ODD)
    assert all(not r.kept for r in rows if r.base_failed)
    kept = quality.keep_quality(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert quality.quality_rows(odd_docs(spark, [])).count() == 0


def brute_em(patterns, n_rules, rounds):
    """The same model in numpy: posterior-weighted vote counts."""
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    prior, g, b = quality.START_PRIOR, np.full(n_rules, quality.PSEUDO_BAD[1]), np.full(n_rules, quality.PSEUDO_BAD[0])
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + (v < 0) @ np.log(g / b) + (v > 0) @ np.log((1 - g) / (1 - b))
        p = 1 / (1 + np.exp(-odds))
        rate = lambda q, k: ((v < 0).T @ (n * q) + quality.PSEUDO * quality.PSEUDO_BAD[k]) / ((v != 0).T @ (n * q) + quality.PSEUDO)
        x, y = rate(p, 1), rate(1 - p, 0)
        prior = ((n * p).sum() + 8) / (n.sum() + 10)
        g, b = np.clip(np.minimum(x, y), 1e-4, 0.98), np.clip(np.maximum(x, y), 1.5e-4, 0.99)
    return prior, g, b


def test_quality_em_matches_numpy(spark):
    rng = random.Random(3)
    votes = [[-1 if rng.random() < (0.6 if junk else 0.03) else rng.choice([0, 1, 1, 1]) for _ in range(4)]
             for junk in (i % 5 == 0 for i in range(400))]
    df = spark.createDataFrame([(v,) for v in votes], "votes array<int>")
    model = quality.fit(df, 4, rounds=8)
    prior, g, b = brute_em([(list(k), c) for k, c in Counter(map(tuple, votes)).items()], 4, 8)
    assert model.prior == pytest.approx(prior) and list(model.good) == pytest.approx(list(g)) and list(model.bad) == pytest.approx(list(b))
    assert 0.6 < model.prior < 0.9  # four fifths are good; the votes overlap


def test_quality_separates_junk(spark):
    clean = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality_rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).withColumnRenamed("quality", "p")
    got = {(r.quality, r.kept): r["count"] for r in rows.filter("not base_failed").join(clean, "doc_id").groupBy("quality", "kept").count().collect()}
    assert got.get((1, False), 0) <= 2 and got.get((0, True), 0) <= 3 and got[1, True] > 300


# ---------------------------------------------------------------- tokens and packing

@functools.cache
def reference_tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path(tokens.VOCABULARY))


def reference_ids(text):
    return reference_tokenizer().encode(text or "", add_special_tokens=False).ids + [2]


def test_word_tokenizer_equals_library(texts):
    odd = ["A'S it's I'LL Élé é ẛ̣ İstanbul ΣΣ \x1c a\x1cb \x85 x y <|endoftext|>z <|startoftext|> 12.5 ,,. .. a., É., ͅ ́ a ́b ﬁ", "", " \n",
           "a" * 5000, "你好 \U0001f600.\U0001f468‍\U0001f469", "ab,%%% Ab,%%% ÀÉ$$$ ßẞ÷× aª ab's' x''s don't' éa\u0301 a\u0301.. \xa0ab\xa0 <|ENDOFTEXT|>", "\x1f a\x1f.", *texts.values()]
    tok = tokens.WordTokenizer(tokenizer_path(tokens.VOCABULARY), cache_words=500)
    for _ in range(2):
        for one, ids in zip(odd, tok.encode(odd), strict=True):
            assert [*np.frombuffer(ids, "<u2").tolist(), 2] == reference_ids(one)


def test_vocabularies_of_other_rules_are_refused():
    with pytest.raises(ValueError):
        tokens.WordTokenizer(tokenizer_path("byte_bpe_50k.json"))


def dense_differencing(loads, parts):
    """The same by whole lists of parts: the heaviest part of one on the lightest of the other."""
    order = sorted(range(len(loads)), key=lambda i: -loads[i])
    heap = [(-loads[j] if parts > 1 else 0, i, [loads[j]] + [0] * (parts - 1), [[j]] + [[]] * (parts - 1)) for i, j in enumerate(order)]
    serial = len(loads)
    while len(heap) > 1:
        heap.sort()
        (_, _, a, x), (_, _, b, y) = heap.pop(0), heap.pop(0)
        both = sorted(((m + n, p + q) for m, n, p, q in zip(a, b[::-1], x, y[::-1])), key=lambda z: -z[0])
        heap.append((both[-1][0] - both[0][0], serial, [s for s, _ in both], [p for _, p in both]))
        serial += 1
    return [sorted(p) for p in heap[0][3]]


def test_differencing_matches_plain_lists():
    rng = random.Random(6)
    for _ in range(150):
        loads = [rng.randint(1, 50) for _ in range(rng.randint(1, 40))]
        parts = rng.randint(1, 9)
        assert windows.differencing(np.array(loads), parts) == dense_differencing(loads, parts)
    assert windows.differencing(np.array([], dtype=np.int64), 3) == [[], [], []]


def test_differencing_is_balanced_and_complete():
    rng = random.Random(5)
    for _ in range(60):
        loads = np.array([rng.randint(1, 60) for _ in range(rng.randint(0, 80))])
        found = windows.balance(loads, 64)
        assert sorted(sum(found, [])) == list(range(len(loads)))
        assert all(loads[p].sum() <= 64 for p in found)
        assert len(found) <= 1.6 * max(1, -(-int(loads.sum()) // 64)) + 1
    two = windows.differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in two) == [14, 16]


def check_pieces(rows, texts, capacity, with_crc):
    """Pieces tile every document's ids, sequences have no gaps."""
    want = Counter((k, len(reference_ids(t))) for k, t, *_ in texts)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    full = {(k, len(ids)): ids for k, ids in ((k, reference_ids(t)) for k, t, *_ in texts)}
    for k, pieces in by_doc.items():
        copies = {}
        for p in pieces:
            copies.setdefault(p.doc_tokens, []).append(p)
        for n, ps in copies.items():
            c = want[k, n]
            tiles = Counter((p.start, p.length) for p in ps)
            assert set(tiles.values()) == {c} and sum(x for _, x in tiles) == n
            at = 0
            for start, length in sorted(tiles):
                assert start == at and length <= capacity
                at += length
            if with_crc:
                for p in ps:
                    ids = np.array(full[k, n][p.start:p.start + p.length], dtype="<u4").tobytes()
                    assert zlib.crc32(ids) == p.ids_crc32
    assert Counter((k, n) for k, ps in by_doc.items() for n in {p.doc_tokens for p in ps}).keys() == want.keys()


@pytest.mark.parametrize("capacity,each", [(4096, 128), (64, 4)])
def test_windows_hold_every_id_once(spark, capacity, each):
    rows = windows.window_digest(windows.pack_windows(odd_docs(spark), capacity, each)).collect()
    check_pieces(rows, ODD, capacity, True)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert windows.pack_windows(odd_docs(spark, [])).count() == 0


def test_pieces_of_one_key_spread_over_buckets(spark):
    for third in ([(7, f"text {i} of a key") for i in range(2000)], [(None, f"text {i} without key") for i in range(2000)],
                  [(7, "the same row")] * 2000, [(None, "the same row")] * 2000):
        rows = third + [(100 + i, f"text {i} of its own") for i in range(4000)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        pieces = tokens.token_pieces(df, 64, 40)
        sizes = [r["count"] for r in pieces.groupBy("bucket").count().collect()]
        assert sum(sizes) == 6000 and len(sizes) == 40 and max(sizes) < 2 * 150
    packed = windows.window_digest(windows.pack_windows(df, 64, 4)).collect()
    assert Counter((r.doc_id, r.start) for r in packed) == Counter((k, 0) for k, _ in rows)


def test_null_and_short_texts_fill_buckets_like_others(spark):
    df = spark.createDataFrame([(i, None) for i in range(3000)], "doc_id long, text string")
    empty = df.fillna("", ["text"])
    assert tokens.bucket_count(df, 10) == tokens.bucket_count(empty, 10) == 300
    assert tokens.bucket_count(df, 1 << 30, pieces_each=100) == 30 and tokens.bucket_count(df.limit(0), 10) == 1
    packed = windows.window_digest(windows.pack_windows(df, 16, 4)).collect()
    assert sorted(r.doc_id for r in packed) == list(range(3000)) and {r.length for r in packed} == {1}
    assert len({r.sequence_id for r in packed}) <= 1.2 * 3000 / 16


def test_positions_need_a_small_capacity(spark):
    with pytest.raises(ValueError):
        token_output.pack_matrix(odd_docs(spark), capacity=70_000)


def test_best_fit_uses_the_tightest_row():
    rng = random.Random(9)
    for _ in range(80):
        cap = rng.choice([1, 5, 8, 31, 64])
        loads = sorted((rng.randint(1, cap) for _ in range(rng.randint(0, 60))), reverse=True)
        got, rows = token_output.best_fit(loads, cap), []
        for i, load in enumerate(loads):
            fits = [(cap - sum(loads[j] for j in r), k) for k, r in enumerate(rows) if cap - sum(loads[j] for j in r) >= load]
            rows[min(fits)[1]].append(i) if fits else rows.append([i])
        assert len(got) == len(rows) and sorted(sum(got, [])) == list(range(len(loads)))
        assert sorted(cap - sum(loads[j] for j in r) for r in got) == sorted(cap - sum(loads[j] for j in r) for r in rows)


def test_matrix_round_trip(spark, tmp_path):
    packed = token_output.pack_matrix(odd_docs(spark), capacity=256, rows_each=8)
    token_output.write_matrix(packed, str(tmp_path / "m"))
    again = spark.read.parquet(str(tmp_path / "m"))
    for r in again.collect():
        cu = r.cu_seqlens
        pos = np.frombuffer(r.position_ids, "<u2")
        assert len(r.input_ids) == 512 and cu[0] == 0 and cu[-1] == r.n_tokens <= 256
        for a, b in zip(cu, cu[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
    pieces = token_output.unpack_documents(again).collect()
    check_pieces(pieces, ODD, 256, False)
    full = {(k, len(reference_ids(t))): reference_ids(t) for k, t, _ in ODD}
    for p in pieces:
        assert np.frombuffer(p.ids, "<u2").tolist() == full[p.doc_id, p.doc_tokens][p.start:p.start + p.length]


# ---------------------------------------------------------------- token counts

def test_transducer_counts_like_the_library(texts):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path(fst_count.VOCABULARY))
    rng = random.Random(0)
    odd = ["it's they're I'LL don't 'tis ''s 'r 're've 'll'l 'v", "  a  b\n\nc \n d\t\te   x\u3000y  ", "   ", "", "a" * 3000,
           "<|endoftext|>a <|endoftext|> b", "你好世界 \U0001f600\U0001f468‍\U0001f469 éàü ß", "-" * 300 + "=" * 77, " " * 500 + "x",
           "\n" * 90, "12345 67a8 9.", "x\x1cy\x85z w", "' s 's'", "it's   'really' !!'s l'été", LONG[:5000]]
    odd += ["".join(rng.choice("abcdeest'  \n\t.!1230éñ你rvlm ") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    odd += list(texts.values())
    want = [len(e.ids) for e in library.encode_batch(odd, add_special_tokens=False)]
    machine = fst_count.TextMachine(tokenizer_path(fst_count.VOCABULARY))
    for chunk in (5, 64, 512):
        assert machine.count(odd, chunk).tolist() == want


def test_maps_of_chunks_compose():
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path(fst_count.VOCABULARY))
    rng = random.Random(2)
    odd = ["".join(rng.choice("etaoin") for _ in range(3000)), "a" * 2500 + "ab" * 900, "=" * 2000, " " * 1500 + "x", "\n \t" * 500,
           "".join(chr(rng.randint(0x4E00, 0x5200)) for _ in range(900)), "ab1" * 700 + " tail of words", "word " + "z" * 1100 + " word " * 50]
    want = [len(e.ids) for e in library.encode_batch(odd, add_special_tokens=False)]
    machine = fst_count.TextMachine(tokenizer_path(fst_count.VOCABULARY))
    for chunk in (1, 7, 100):
        assert machine.count(odd, chunk).tolist() == want
    # a run of letters takes a few rounds over all chunks at once, not one for each chunk
    rounds = []
    run = machine.run
    machine.run = lambda points, codes, begin, length, state: rounds.append(len(begin)) or run(points, codes, begin, length, state)
    assert machine.count(["".join(rng.choice("etaoin") for _ in range(40_000))], 100).tolist()[0] > 0
    assert len(rounds) < 12 and max(rounds) >= 399


def test_sparse_transitions():
    table, want = fst_count.Sparse(bits=3), {}
    rng = random.Random(3)
    for _ in range(2000):
        k = rng.randint(0, 900) << 21 | rng.randint(0, 40)
        want[k] = rng.randint(1, 1 << 40)
        table.put(k, want[k])
    keys = np.array(list(want) + [5 << 40])
    assert table.get(keys).tolist() == [*want.values(), 0] and table.n == len(want)


def test_token_counts_odd_rows(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path(fst_count.VOCABULARY))
    got = Counter(tuple(r) for r in fst_count.count_tokens(odd_docs(spark)).collect())
    want = Counter()
    for k, t, _ in ODD:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[k, len((t or "").encode()), n, n > 512] += 1
    assert got == want
    assert fst_count.count_tokens(odd_docs(spark, [])).count() == 0


# ---------------------------------------------------------------- near duplicates

def shingle_set(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))


def brute_groups(rows, width, percent=80):
    sets = [(k, shingle_set(t, width)) for k, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j][1])
            if both and 100 * both >= percent * (len(a) + len(sets[j][1]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return Counter((k, len(s), least.get(find(i))) for i, (k, s) in enumerate(sets))


def test_near_duplicates_match_brute_force(spark, texts):
    rng = random.Random(2)
    base = [f"w{rng.random()}" for _ in range(140)]
    rows = list(texts.items())
    for i in range(60):  # a family in which some members are linked only through others
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"z{rng.random()}"
        rows.append((10_000 + i, " ".join(w)))
    rows += [(k, t) for k, t, _ in ODD] + [(20_000 + i, "A b C d") for i in range(50)] + [(30_000, "a B c D")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (4, 5):
        got = near_dup.near_duplicates(df, width=width).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, width)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_hot_key_is_read_once_for_each_class(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = [(7, " ".join([*base, f"z{i}", f"y{rng.random()}"])) for i in range(300)]
    rows += [(7, rows[0][1])] * 200 + [(100 + i, f"one {i} two {i} three {i} four {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    wanted = near_dup.sketch(df, 4).filter("doc_id = 7").withColumn("cid", F.xxhash64("d1", "d2", "n")).select(
        "cid", F.col("doc_id").alias("rep"), "h", "d1", "d2").distinct()
    texts = near_dup._wanted_texts(df, wanted, "doc_id", "text")
    assert wanted.count() == 300 and texts.count() == 500
    sets = near_dup._full_sets(df, wanted, 4, "doc_id", "text")
    assert sets.count() == 300 == sets.select("cid").distinct().count()
    got = near_dup.near_duplicates(df, width=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, 4)


def test_null_and_repeated_keys_take_part(spark):
    rng = random.Random(8)

    def near(words, spots):
        return [f"z{rng.random()}" if i in spots else w for i, w in enumerate(words)]
    a, b, c, d = ([f"w{rng.random()}" for _ in range(200)] for _ in range(4))
    middle = near(a, {50})
    rows = [(1, a), (None, middle), (2, near(middle, {110, 150, 190})), (None, a), (3, near(a, {10, 80, 170}))]
    rows += [(None, b), (None, near(b, {100})), (None, b)]  # no key at all
    rows += [(5, c), (5, near(c, {100})), (6, c), (None, c)]  # the kept key stands on a near copy, too
    rows += [(5, d), (8, near(d, {0, 199})), (4, d), (9, near(d, {100}))]  # and here on a text that goes
    rows = [(k, " ".join(w)) for k, w in rows]
    rows += [(None, rows[5][1].upper()), (5, rows[8][1].upper()), (None, None), (None, ""), (11, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(df, width=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    sets = [shingle_set(t, 4) for _, t in rows]
    groups = Counter()
    for r in near_dup.drop_near_duplicates(df, width=4).collect():
        mine = shingle_set(r.text, 4)
        if mine:
            groups[min(i for i, s in enumerate(sets) if 100 * len(s & mine) >= 40 * len(s | mine))] += 1
    assert groups == {0: 1, 5: 1, 8: 1, 12: 1}
    # a row without key between two others links them, and is itself one row of their group
    keep = [f"v{i}" for i in range(100)]
    left, right = keep + [f"l{i}" for i in range(16)], [f"r{i}" for i in range(16)] + keep
    chain = [(1, " ".join(left)), (None, " ".join(keep)), (2, " ".join(right))]
    got = near_dup.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), width=4).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (None, 1, False), (2, 1, False)}


def test_drop_near_duplicates_keeps_one(spark):
    kept = near_dup.drop_near_duplicates(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    assert ids.count(1) == 1 and 6 in ids and 7 not in ids and {2, 3, 4, 5, 10} <= set(ids)
    assert near_dup.near_duplicates(odd_docs(spark, [])).count() == 0


def test_signature_estimates_similarity():
    rng = random.Random(1)
    errors = []
    for _ in range(120):
        a = [f"w{i}" for i in range(300)]
        b = list(a)
        for _ in range(rng.randint(0, 60)):
            b[rng.randrange(300)] = f"z{rng.random()}"
        x, y = near_dup.shingle_sets([" ".join(a).encode(), " ".join(b).encode()], 4)
        s = near_dup.super_minhash([x, y], 96)
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        errors.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {(r.node, r.root) for r in components.components(df).collect()} == {(x, find(x)) for x in list(root)}
    assert components.components(df.filter("a < 0")).count() == 0


# ---------------------------------------------------------------- nearest neighbours

def brute_nearest(rows, every, k):
    out = {}
    for q, v in rows:
        if q % every:
            continue
        score = [(-float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), i) for i, w in rows if i != q]
        out[q] = [i for _, i in sorted((round(s, 12), i) for s, i in score)[:k]]
    return out


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(30, 24))
    rows = [(i, (centers[i % 30] + 0.4 * rng.normal(size=24)).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # a hot vector, queries among its copies
    bad = [(5000, None), (5050, []), (5100, [0.0] * 24), (5150, [float("nan")] + [1.0] * 23), (5200, [None] + [1.0] * 23),
           (None, rows[3][1]), (5250, [float("inf")] + [0.0] * 23), rows[7]]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "cid": F.lit("x"), "rank": F.lit(0)})
    got = {}
    for r in sorted(ann.nearest(df, every=50).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_nearest(rows, 50, 5)
    assert got.keys() == want.keys()
    assert got[1000] == want[1000] and got[1050] == want[1050] and got[0] == want[0]
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_nearest_few_rows(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.1]), (7, [1.0, 1.0, 1.0])],
                               "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id) for r in ann.nearest(df).collect())
    assert got == [(1, 1), (2, 2), (3, 3)]
    assert ann.nearest(df.filter("vec_id < 0")).count() == 0


def test_nearest_many_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=1 + i % 40).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.nearest(df, every=10, k=3).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    same = {q: brute_nearest([x for x in rows if len(x[1]) == len(rows[q][1])], 10, 3)[q] for q in range(0, 600, 10)}
    assert got.keys() == same.keys() and all(len(v) == 3 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & set(same[q])) for q in same)
    assert hits >= 0.9 * 3 * len(same)
    for q, found in got.items():
        for i, score in found:
            v, w = np.array(rows[q][1]), np.array(rows[i][1])
            assert len(v) == len(w) and abs(score - v @ w / np.sqrt((v @ v) * (w @ w))) < 1e-12


@pytest.mark.parametrize(("n", "share"), [(2000, 0.5), (8000, 0.3), (32000, 0.15)])
def test_hashing_recall_and_falling_share(n, share):
    x = ann._unit(np.random.default_rng(n).normal(size=(n, 64)), 64)
    s = ann.settings(n, 64)
    queries = np.arange(0, n, n // 40)
    exact = x[queries] @ x.T
    exact[np.arange(len(queries)), queries] = -2
    want = np.argsort(-exact, axis=1)[:, :5]
    seen, scored = np.zeros((len(queries), n), bool), 0
    for t in range(ann.TABLES):
        code, probes = ann.bucket(x, s, t), ann.probe(x[queries], s, t)
        assert code.max() < s.buckets and probes.shape[1] == s.probes
        for i, own in enumerate(probes):
            assert len(set(own.tolist())) == s.probes
            hit = np.isin(code, own)
            seen[i] |= hit
            scored += hit.sum()
    assert np.take_along_axis(seen, want, 1).mean() >= 0.9
    assert scored / (n * len(queries)) < share


def test_probes_are_the_least_misses():
    x = ann._unit(np.random.default_rng(1).normal(size=(20, 8)), 8)
    s = ann.Settings(8, (16, 16, 4), 30, 4)
    parts = list(ann._axes(x, s, 3))
    miss = [(a.max(axis=1, keepdims=True) - a) ** 2 for a in parts]
    total = (miss[0][:, :, None, None] + miss[1][:, None, :, None] + miss[2][:, None, None, :]).reshape(20, -1)
    for row, got in zip(total, ann.probe(x, s, 3), strict=True):
        assert set(got.tolist()) == set(np.argsort(row)[:30].tolist())


# ---------------------------------------------------------------- mixing

def test_targets_reshare_the_excess():
    sizes = {"a": 100, "b": 10, "c": 1000, None: 50}
    got = mixing.source_targets(sizes)
    assert got["b"] == 20 and all(got[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert got["a"] == 200 and got[None] == 100 and got["c"] == pytest.approx(1740 - 320)


def test_route_prefers_first_copies():
    # the overlap serves both sources; nothing is repeated while fresh words remain
    taken = mixing.route({"a": (["a"], 100), "ab": (["a", "b"], 100), "b": (["b"], 10)}, {"a": 100, "b": 100})
    assert taken["a"] <= 100 and taken["ab"] <= 100 and taken["b"] <= 10 and sum(taken.values()) == 200
    more = mixing.route({"a": (["a"], 100)}, {"a": 150})
    assert more == {"a": 150}


def brute_route(patterns, quotas, copies):
    """Most words met, then least cost, over all ways to send whole words from patterns to sources."""
    arcs = [(p, s) for p, (members, _) in sorted(patterns.items()) for s in members]
    best = None
    for flow in itertools.product(*[range(min(quotas[s], patterns[p][1] * copies) + 1) for p, s in arcs]):
        sent, met = Counter(), Counter()
        for (p, s), f in zip(arcs, flow):
            sent[p] += f
            met[s] += f
        if all(met[s] <= quotas[s] for s in met) and all(sent[p] <= copies * patterns[p][1] for p in sent):
            cost = sum(sum(range(f // w)) * w + f // w * (f % w) for p, f in sent.items() if (w := patterns[p][1]))
            best = min(best or (1, 0), (-sum(flow), cost))
    return best or (0, 0)


def test_route_is_a_cheapest_flow():
    rng = random.Random(11)
    for _ in range(60):
        quotas = {s: rng.randint(0, 5) for s in "abc"}
        patterns = {str(i): (rng.sample("abc", rng.randint(1, 2)), rng.randint(0, 3)) for i in range(3)}
        taken = mixing.route(patterns, quotas, 2)
        cost = sum(sum(range(f // w)) * w + f // w * (f % w) for p, f in taken.items() if (w := patterns[p][1]))
        assert (-sum(taken.values()), cost) == brute_route(patterns, quotas, 2), (patterns, quotas, taken)
        for k in range(1, 4):  # every set of sources can be served what its patterns were asked to give
            for some in itertools.combinations("abc", k):
                assert sum(f for p, f in taken.items() if set(patterns[p][0]) <= set(some)) <= sum(quotas[s] for s in some)


def test_route_of_many_patterns_is_fast():
    t0 = time.process_time()
    single = {f"p{i}": ([f"s{i % 50_000}"], 10 + i % 7) for i in range(100_000)}
    taken = mixing.route(single, {f"s{i}": 25 for i in range(50_000)})
    assert sum(taken.values()) == 50_000 * 25 and time.process_time() - t0 < 10
    rng = random.Random(3)
    t0 = time.process_time()
    mixed = {f"p{i}": (rng.sample([f"s{j}" for j in range(200)], 2), rng.randint(1, 50)) for i in range(4000)}
    taken = mixing.route(mixed, {f"s{j}": 700 for j in range(200)})
    assert all(f <= 2 * mixed[p][1] for p, f in taken.items()) and time.process_time() - t0 < 20


def test_mix_of_many_equal_rows(spark):
    rows = [(7, "six words are in this text", "a")] * 900 + [(100 + i, f"w{i} " * (1 + i % 9), "a") for i in range(900)] + [
        (5000 + i, "b c d", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = None
    for parts in (1, 9):
        got = mixing.mix_rows(df.repartition(parts)).collect()
        assert len(got) == len(rows)
        target, taken = {r.source_size: r.target for r in got}, Counter()
        for r in got:
            assert 0 <= r.taken <= 2 * r.size
            taken[r.source_size] += r.taken
        assert all(abs(taken[n] - t) <= 1 for n, t in target.items())
        want = want or sorted((r.doc_id, r.taken) for r in got)
        assert sorted((r.doc_id, r.taken) for r in got) == want
    whole = Counter(r.doc_id for r in mixing.take_mix(df).collect())
    by_row = Counter()
    for k, t in want:
        by_row[k] += -(-t // next(len(x[1].split()) for x in rows if x[0] == k))
    assert whole.keys() == {k for k, c in by_row.items() if c}


def test_mix_meets_targets_and_repeats(spark, docs, texts):
    rows = mixing.mix_rows(docs).collect()
    again = {r.doc_id: r.taken for r in mixing.mix_rows(docs.repartition(7)).collect()}
    assert {r.doc_id: r.taken for r in rows} == again
    sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    sizes = {k: len(WORD.findall(t or "")) for k, t in texts.items()}
    total = Counter()
    for k, n in sizes.items():
        total[sources[k]] += n
    target, taken = mixing.source_targets(dict(total)), Counter()
    for r in rows:
        assert r.size == sizes[r.doc_id] and r.source_size == total[sources[r.doc_id]] and r.target == target[sources[r.doc_id]]
        assert 0 <= r.taken <= 2 * r.size
        taken[sources[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_mix_odd_rows(spark):
    rows = mixing.mix_rows(odd_docs(spark)).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.take_mix(odd_docs(spark)).columns == odd_docs(spark).columns
    assert mixing.mix_rows(odd_docs(spark, [])).count() == 0


# ---------------------------------------------------------------- lines

def test_lines_by_site(spark):
    rows = [(i, f"Menu\nstory {i} of the day\n Menu \nfooter {i % 2}", "a") for i in range(40)]
    rows += [(100 + i, f"Menu\nother {i}", "b") for i in range(3)] + [(200, None, "a"), (201, "", "a"), (202, "Menu", None), (0, rows[0][1], "a")]
    df = odd_docs(spark, rows)
    got = {r.doc_id: r for r in lines.line_rows(df).collect()}
    assert got[1].text == "story 1 of the day" and got[1].n_dropped == 3
    assert got[100].text == "Menu\nother 0" and got[202].text == "Menu"  # too few pages of their site
    assert got[200].text is None and got[200].n_lines == 0 and got[201].text == "" and got[201].n_lines == 1
    cut = lines.drop_boilerplate(df)
    assert cut.columns == df.columns and cut.count() == len(rows)
    copies = odd_docs(spark, [(i, "same\ntext", "a") for i in range(9)] + [(9, "other", "a")])
    assert {r.text for r in lines.drop_boilerplate(copies).collect()} == {"same\ntext", "other"}
    assert lines.line_rows(odd_docs(spark, [])).count() == 0


# ---------------------------------------------------------------- urls

def page(i, url, html="<html></html>"):
    return (i, url, html)


def test_url_verdicts(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        page(1, "http://A.Example.NET/en/x?y#z"), page(2, "https://example.net/de/"), page(3, None), page(4, "no scheme"),
        page(5, "http://x.com/a", link("http://bad.net/")), page(6, "http://x.com/b", link("http://x.com/a")),
        page(7, "http://y.com/a", '<meta http-equiv="refresh" content="0; url=/b">'), page(8, "http://y.com/b", link("http://z.example.com/de/q")),
        page(9, "http://w.com/a", link("http://bad.net/")), page(10, "http://w.com/a", link("http://good.org/fr/1")),
        page(11, "http://badnet/"), page(12, "http://u.org/fr"), page(13, "x://h"), page(1, "http://A.Example.NET/en/x?y#z"),
        page(14, "http://lone.com/", None), page(15, "http://x.com/c", link("http://x.com/c/")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "node": F.lit(2), "rank": F.lit(3)})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3] == got[4] == ("", "", None, "allow") and got[13] == ("h", "", None, "allow")
    # one component: bad.net blocks, good.org allows, and allow goes first for members without a rule
    assert {got[i][3] for i in (5, 6, 9, 10)} == {"allow"}
    assert got[7][3] == got[8][3] == "block" and got[11][2] is None and got[12][2] is None and got[15][3] == "allow"
    alone = urls.judge_urls(df.filter("page_id in (5, 6)"))
    assert {r.verdict for r in alone.collect()} == {"block"}
    assert urls.judge_urls(df.filter("page_id < 0")).count() == 0


class LinkTags(HTMLParser):
    """Base, canonical and refresh targets by a parser."""

    def __init__(self):
        super().__init__()
        self.base, self.links = None, []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "base" and self.base is None and a.get("href"):
            self.base = a["href"].strip()
        if tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.links.append(a.get("href", "").strip())
        if tag == "meta" and a.get("http-equiv", "").lower() == "refresh":
            m = re.search(r"(?i)url\s*=\s*(.*)$", a.get("content", ""))
            self.links.append(m[1].strip().strip("'\"") if m else "")


def brute_edges(rows):
    def key(u):
        x = urlsplit(u)
        return (x.netloc.lower() + re.sub("/+$", "", x.path) + ("?" + x.query if x.query else ""))
    found = set()
    for u, html in rows:
        parser = LinkTags()
        parser.feed(re.sub(r"(?s)<!--.*?(-->|$)", "", html))
        base = urljoin(u, parser.base) if parser.base else u
        for t in parser.links:
            if t and not t.startswith("#") and not re.match(r"[a-z]+:(?!//)", t):
                a, b = key(u), key(urljoin(base, t))
                if a != b:
                    found.add((a, b))
    return found


def test_link_edges_match_a_parser(spark):
    rng = random.Random(4)
    targets = ["http://b.com/x", "HTTPS://B.com/y/", "//c.com/z?q=1&amp;r=2", "/root", "rel", "../up", "../../n", "./same/./k", "?only=1", "#frag", "",
               "mailto:me@x.com", "a/../b#f", "http://d.com", "sub/"]
    bases = ["http://a.com", "http://a.com/", "https://a.com/p/q/r", "http://A.com/p/q/?s=1", "http://a.com/f?x=/y"]
    rows = []
    for i in range(400):
        parts = []
        for _ in range(rng.randint(1, 3)):
            t, q = rng.choice(targets), rng.choice("\"'")
            parts.append(rng.choice([
                f"<link rel={q}canonical{q} href={q}{t}{q}>", f"<LINK href={q}{t}{q} REL='nofollow canonical' />", f"<link rel=stylesheet href={q}{t}{q}>",
                f"<meta http-equiv={q}Refresh{q} content={q}0; URL={t}{q}>", f"<!-- <link rel=canonical href={t}> -->", f"<a href={q}{t}{q} rel=canonical>x</a>",
                f"<!-- open\n <link rel=canonical href={t}>\n--><p>canonical</p>", f"<link data-href=/no rel=canonical href={q}{t}{q}>"]))
        if rng.random() < 0.2:
            parts.insert(0, "<base href='/other/dir/'>")
        rows.append((rng.choice(bases), "<html>" + " ".join(parts) + "</html>"))
    df = spark.createDataFrame(rows, "url string, html string")
    got = {tuple(r) for r in urls.link_edges(df).distinct().collect()}
    assert got == brute_edges(rows)


def test_block_reaches_all_aliases(spark):
    rows = [(1, "http://safe.com/a", "<link rel=canonical href='http://other.com/z'><link rel=canonical href='http://x.net/bad?a=1&amp;b=2'>"),
            (2, "http://x.net/bad?a=1&b=2", ""), (3, "http://safe.com/d/e/f", "<meta http-equiv=refresh content='0;url=../../a'>"),
            (4, "http://lone.com", "<link rel=canonical href=k>"), (5, "http://lone.com/k", "<!-- <link rel=canonical href='http://y.net/'> -->"),
            (6, "http://other.com/z", "x" * 200_000)]
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block"}


# ---------------------------------------------------------------- toxicity

def test_grammar_emits_patterns():
    g = toxicity.compose()
    assert g.patterns(["other", "insult"]) == [None, "plain"]
    assert g.patterns(["target", "other", "insult"])[2] == "target"
    assert g.patterns(["target", "negation", "other", "insult"])[3] == "negated"
    assert g.patterns(["negation", "other", "other", "other", "insult"])[4] == "plain"
    assert g.patterns(["report", "target", "insult"])[2] == "reported"
    assert g.patterns(["target", "threat", "threat"]) == [None, "threat_target", "threat_target"]
    assert g.patterns(["threat"]) == ["threat"]


def test_targets_may_follow():
    g = toxicity.compose()
    assert g.patterns(["other", "threat", "target"]) == [None, "threat_target", None]
    assert g.patterns(["insult", "other", "target", "insult"]) == ["target", None, None, "target"]
    assert g.patterns(["negation", "insult", "target"])[1] == "negated" and g.patterns(["report", "threat", "target"])[1] == "reported"


def brute_patterns(classes):
    """Each match by looking at the whole clause around it."""
    out = []
    for i, c in enumerate(classes):
        before, behind = classes[:i], classes[i + 1:]
        negated, reported, aimed = "negation" in before[-3:], "report" in before, "target" in before + behind
        insult = "reported" if reported else "negated" if negated else "target" if aimed else "plain"
        threat = "negated" if negated else "reported" if reported else "threat_target" if aimed else "threat"
        out.append({"insult": insult, "threat": threat}.get(c))
    return out


def test_grammar_equals_a_search():
    rng, g = random.Random(1), toxicity.compose()
    for _ in range(2000):
        classes = [rng.choice(toxicity._CLASSES) for _ in range(rng.randint(0, 9))]
        assert g.patterns(classes) == brute_patterns(classes)


def test_scores_matched_clauses_only():
    s = toxicity.Scorer({"lowei": 5.0})

    def sums(text):
        total, n = s.score(text)
        return {p: x for p, x in zip(toxicity.PATTERNS, total) if x}, n
    assert sums("He is a Loweischaft.") == ({"target": 5.0}, 1)
    assert sums("slowei trashy idiots unkilled") == sums("") == ({}, 0)
    base = toxicity.BASE_WEIGHT
    assert sums("not stupid. stupid") == ({"negated": base, "plain": base}, 2)
    # a target counts only in its own clause, before the word or behind it
    assert sums("you. kill") == ({"threat": base}, 1)
    assert sums("you kill") == sums("i will kill you") == ({"threat_target": base}, 1)
    assert sums("x! idiot, you; kill. he said kill") == ({"target": base, "threat": base, "reported": base}, 3)


def test_pattern_weights_follow_the_rows():
    rng = np.random.default_rng(5)
    sums = np.zeros((4000, len(toxicity.PATTERNS)))
    for i in range(4000):
        if i % 2:
            sums[i, rng.integers(0, 3)] = 4.0  # plain, target or negated
    toxic = ((sums[:, 1] > 0) | (rng.random(4000) < 0.01)).astype(float)
    bias, w = toxicity.pattern_weights(sums, toxic)
    assert w["target"] > 3 and w["plain"] < 0.5 and w["negated"] < 0.5 and bias < -3
    assert w["reported"] == pytest.approx(toxicity.PRIORS["reported"])  # never seen
    assert toxicity.pattern_weights(sums[:5], np.zeros(5)) == (toxicity.PRIOR_BIAS, toxicity.PRIORS)


def test_verdicts_depend_on_the_patterns(spark):
    flat = toxicity.Model({}, -4.0, dict.fromkeys(toxicity.PATTERNS, 2.0))
    rows = spark.createDataFrame([(1, "they kill the lights"), (2, "the lights kill"), (3, "he said idiot"), (4, "you idiot"), (5, "never stupid"), (6, None)],
                                 "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(rows, toxicity.Model({})).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 1, 5: 0, 6: 0}
    assert len({r.score for r in toxicity.score_documents(rows, flat).collect()}) == 2  # without weights a match is a match


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_documents(docs, model)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows.collect())
    got = {(r.toxic, r.predicted): r["count"] for r in rows.filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert got.get((0, 1), 0) <= 2 and got[1, 1] >= 8
    odd = toxicity.score_documents(odd_docs(spark), model).collect()
    assert len(odd) == len(ODD) and toxicity.score_documents(odd_docs(spark, []), model).count() == 0
    assert toxicity.fit(docs.limit(0), labels).stems == {}
