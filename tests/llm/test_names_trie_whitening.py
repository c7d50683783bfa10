"""Exact copies, the conversation trie and whitening against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import block_names, q_llm, trie, whitening

SF001 = "/root/testdata/sf0.001"
SPACES = re.compile(r"[\x20\x09-\x0d]")


# ---------------------------------------------------------------- exact copies

def brute_copies(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[SPACES.sub("", t or "")].append((-len(t or ""), k is None, k or 0))
    out = []
    for body, members in groups.items():
        best = min(members)
        sha = hashlib.sha256(body.encode("utf-8")).hexdigest()
        for m in members:
            out.append((None if m[1] else m[2], None if best[1] else best[2], len(members), sha))
    return sorted(out, key=str)


def copies(df, **kw):
    got = block_names.exact_copies(df, **kw).collect()
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) <= {1}  # one row of every group stays
    assert len({r.identity for r in got}) == len(kept)
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str)


ODD = [(1, "a b\tc"), (2, "abc"), (3, "ab c  "), (4, None), (5, ""), (6, " \n\x0b\x0c\r\t"), (7, "x" * 70_000), (8, "x" * 69_999 + " x"),
       (9, "x" * 69_999 + "y"), (None, "abc"), (None, "abc     "), (2, "abc"), (10, "é ü\x1c你好 \U0001f600"), (11, "é ü\x1c你好\U0001f600"),
       (12, "abcabcab"), (13, "abcabcabc"), (14, "cababcab"), (None, None)]


def odd_docs(spark, rows):
    clash = {c: F.lit(-1) for c in ("name", "rid", "at", "handle", "block", "names", "identity", "kept", "chars", "sha", "row", "nth", "a", "b")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)


def test_copies_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert copies(docs) == brute_copies([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_copies_odd_rows(spark, size):
    rows = ODD if size > 1 else [r for r in ODD if len(r[1] or "") < 1000]
    assert copies(odd_docs(spark, rows), size=size) == brute_copies(rows)
    assert copies(odd_docs(spark, []), size=size) == []


def test_handles_that_collide_change_nothing(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))) for i in range(80)]

    def weak(block, seed):  # one handle for all blocks, then few, then enough
        return block_names.wide_handle(block, seed)[:1 if seed == 1 else 16] if seed else b""

    assert copies(odd_docs(spark, rows), size=2, handle=weak) == brute_copies(rows)


def test_blocks_of_equal_names_but_other_order_differ(spark):
    rows = [(1, "aabb"), (2, "bbaa"), (3, "aabbaabb"), (4, "aabbbbaa"), (5, "aa"), (6, "aabbaa"), (7, "aa bb aa")]
    assert copies(odd_docs(spark, rows), size=2) == brute_copies(rows)


def test_drop_exact_copies_keeps_whole_rows(spark):
    docs = odd_docs(spark, ODD)
    kept = block_names.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    want = {sha: k for d, k, n, sha in brute_copies(ODD)}
    got = [(r.doc_id, hashlib.sha256(SPACES.sub("", r.text or "").encode()).hexdigest()) for r in kept.collect()]
    assert sorted(got, key=str) == sorted(((k, s) for s, k in want.items()), key=str)


# ---------------------------------------------------------------- conversation trie

def brute_trie(rows):
    """``rows``: conv, turn, role, text.  All nodes from the lists of rebuilt turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in own.items():
        turns.sort(key=lambda t: (t[0], t[1], hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        made[c] = [(t[2], t[3]) for t in own.get(base, [])[:h] + turns[h:]]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    below = {}
    for p in sorted(members, key=len, reverse=True):
        own_saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = (sum(below[k][0] for k in kids[p]) or 1, own_saved + sum(below[k][1] for k in kids[p]))
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(made[c]) == len(p)))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), *below[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit("x") for c in ("conv", "pos", "digest", "size", "key", "n", "h", "base", "at", "items", "g")})


def test_trie_matches_brute_force(spark):
    df = spark.read.parquet(f"{SF001}/conversations.parquet")
    assert trie_rows(q_llm.op12_conversation_trie(spark, SF001)) == brute_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_trie_of_forking_conversations(spark):
    rng = random.Random(1)
    rows = []
    for c in range(-12, 50):
        n = rng.choice([1, 2, 4, 5, 8, 9, 12, 17])
        rows += [(c, t, "user" if t % 2 else "bot", "same" if rng.random() < 0.93 else f"fork {rng.randint(0, 2)}") for t in range(n)]
    want = brute_trie(rows)
    for block, fan in ((4, 64), (1, 2), (3, 2)):
        assert trie_rows(trie.conversation_trie(conversations(spark, rows), block, fan)) == want
    assert trie_rows(trie.conversation_trie(conversations(spark, rows), chunk_rows=8)) == want  # positions by buckets


def test_trie_odd_rows(spark):
    rows = [(0, None, None, None), (0, 1, "user", None), (0, 1, "user", None), (0, 2, None, "é 你好"), (0, 2, "us", "erx"), (None, 1, "user", "lost"),
            (7, 1, "a", "b" * 40_000), (8, 1, "a", "b"), (-6, 3, "", ""), (11, 0, "use", "rx"), (10, 0, "user", "x"),
            *[(20, i, "user", f"turn {i}") for i in range(300)], *[(21, i, "user", f"turn {i}") for i in range(300)]]
    assert trie_rows(trie.conversation_trie(conversations(spark, rows))) == brute_trie(rows)
    assert trie_rows(trie.conversation_trie(conversations(spark, []))) == []


def test_long_end_lists_and_hot_turns(spark):
    rows = [(c * 3001, t, "user", "hello") for c in range(400) for t in range(9 + (c % 7 == 0))]
    assert trie_rows(trie.conversation_trie(conversations(spark, rows))) == brute_trie(rows)


# ---------------------------------------------------------------- whitening

def brute_whitening(vectors):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)) + 1_000_000
    n, s = len(x), x.astype(np.int64).sum(axis=0)
    t = n * x.astype(np.int64) - s
    y = t / n
    values, basis = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:32]
    values = np.maximum(values, 1e-300)
    return (t * t).sum(axis=1), y @ basis[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def check_whitening(got, keys, vectors):
    deviation, white, share = brute_whitening(vectors)
    k = white.shape[1]
    assert len(got) == len(keys) * k
    have = np.full(white.shape, np.nan)
    for r in got:
        i = keys.index(r.vec_id)
        assert r.deviation == deviation[i] and r.n == len(keys) and r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
        have[i, r.component - 1] = r.whitened
    sign = np.sign((have * white).sum(axis=0))
    assert np.abs(have * sign - white).max() < 1e-8


def test_whitening_matches_eigh(spark):
    rows = spark.read.parquet(f"{SF001}/embeddings.parquet").select("vec_id", "embedding").collect()
    check_whitening(q_llm.op13_whitening(spark, SF001).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


@pytest.mark.parametrize("values", [
    [5.0, 3.0, 1.0], [9.0, 9.0, 9.0, 2.0], [1e6, 1.0, 1e-6, 1e-9], list(np.geomspace(1, 1e-12, 40)), [4.0] * 7,
    [1.0, 1.0 + 1e-9, 1.0 - 1e-9, 0.5], [0.0, 0.0, 3.0], list(np.linspace(1, 2, 70))])
def test_divide_and_conquer_finds_the_spectrum(values):
    rng = np.random.default_rng(len(values))
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.components(a, len(values))
    size = np.linalg.norm(a)
    assert np.abs(found - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * found).max() < 1e-12 * size
    few, _ = whitening.components(a, 2)
    assert np.allclose(few, found[:2], rtol=1e-12, atol=1e-13 * size)


def test_polar_factor_is_the_matrix_sign():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    values, basis = np.linalg.eigh(a)
    assert np.abs(whitening.polar_factor(a) - basis @ np.diag(np.sign(values)) @ basis.T).max() < 1e-12


def test_exact_sums_of_large_numbers():
    rng = np.random.default_rng(4)
    for top in (10, 1 << 30, 1 << 49, 1 << 61):
        z = rng.integers(-top, top, (50, 3))
        want = [[sum(int(a) * int(b) for a, b in zip(z[:, i], z[:, j])) for j in range(3)] for i in range(3)]
        assert whitening._cross(z).tolist() == want
        flat = [v for row in want for v in row]
        assert [sum(p << (40 * x) for x, p in enumerate(four)) for four in zip(*whitening._limbs(flat))] == flat


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (2, [2.0, -1.0, 0.5]), (3, None), (4, [nan, 1.0, 1.0]), (5, [1.0, None, 1.0]), (6, [inf, 0.0, 1.0]),
            (7, []), (None, [0.25, 3.5, 0.5]), (8, [3.0, 3.0, 0.5]), (8, [3.0, 3.0, 0.5]), (9, [1.0, 2.0]), (10, [1.0, 5.0]), (11, [7.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(0) for c in ("id", "vec", "d", "n", "i", "j")})
    for room in (1, 10_000):
        got = whitening.whiten(df, room=room).collect()
        three = [r for r in got if r.n == 5]
        assert sorted((r.vec_id or 0, r.component) for r in three) == sorted((k, c) for k in (0, 1, 2, 8, 8) for c in (1, 2, 3))
        deviation, white, share = brute_whitening([[1, 2, .5], [2, -1, .5], [.25, 3.5, .5], [3, 3, .5], [3, 3, .5]])
        assert all(r.whitened is None and r.explained == pytest.approx(0, abs=1e-15) for r in three if r.component == 3)  # a constant dimension
        for c in (1, 2):
            assert sorted(abs(r.whitened) for r in three if r.component == c) == pytest.approx(sorted(abs(white[:, c - 1])))
        assert sorted(r.deviation for r in three if r.component == 1) == sorted(deviation.tolist())
        two = [r for r in got if r.n == 2]
        assert sorted(abs(r.whitened) for r in two if r.component == 1) == pytest.approx([1.0, 1.0])
        assert [(r.vec_id, r.deviation, r.whitened, r.identity_error) for r in got if r.n == 1] == [(11, 0, None, None)]
    assert whitening.whiten(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None} or whitening.whiten(huge).count() == 6
