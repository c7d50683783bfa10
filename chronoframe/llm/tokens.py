"""Token ids of whole texts, split into pieces of bounded length.

The vocabulary used here drops white space, so a text's ids are the ids of its
words one after the other.  Words of a batch are split, made distinct and
reduced to their base form column-wise; only distinct bases are looked up in a
bounded cache, and only those not in it go to the tokenizer.  The ids of the
batch are then gathered by array indices.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import tokenizer_path

VOCABULARY, END_ID = "word_bpe_49k.json", 2
CACHE_WORDS = 800_000
#: How the vocabulary's file cuts texts; a fixed value of its format.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that have one lower-case form and are composed, and the marks of ASCII.
LOWER = "a-zß-öø-ÿ"
LETTERS = "A-ZÀ-ÖØ-Þ" + LOWER
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Rows and bytes of texts that are tokenized at a time; a longer text goes by itself.
SLICE_ROWS, SLICE_BYTES = 4096, 8 << 20
#: Counters with which a task numbers the repeats of a row.
REPEAT_SLOTS = 1 << 20

#: Rows of a bucket, where texts are very short.
PIECES_EACH = 1 << 17

PIECE_SCHEMA = "bucket long, doc_id long, start long, length long, doc_tokens long, ids binary"


class WordTokenizer:
    """Ids of texts under a word-level BPE file, as unsigned 16-bit numbers.

    The file must ignore case and white space and take a run of letters and a
    run of marks as words of their own; others are refused.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        rules = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
        cut = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if steps != ["NFC", "Replace", "Lowercase"] or cut.get("behavior") != "Removed" or cut.get("pattern") != {"Regex": WORD_PATTERN}:
            raise ValueError("this vocabulary does not split texts into words of letters or marks without regard to case")
        # for words of lower-case letters alone: nothing to normalise and nothing to split but the words
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(False, use_regex=False)])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.half = max(1, cache_words // 2)

    def encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the end of each text in them."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.string()))
        words = lists.flatten().dictionary_encode()
        flat, first, size = self._distinct(words.dictionary)
        index = words.indices.to_numpy(zero_copy_only=False)
        sizes = size[index]
        after = np.zeros(len(index) + 1, dtype=np.int64)
        np.cumsum(sizes, out=after[1:])
        ids = flat[np.repeat((first[index] - after[:-1]), sizes) + np.arange(after[-1])]
        edges = lists.offsets.to_numpy()
        return ids, after[edges[1:] - edges[0]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian bytes."""
        ids, ends = self.encode_words(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words in one array, with the first place and the number of each."""
        core = pc.ascii_rtrim(words, MARKS)
        simple = pc.match_substring_regex(core, f"^[{LETTERS}]+$")
        bases = pc.if_else(simple, pc.utf8_lower(core), words).dictionary_encode()
        marked = pc.and_(simple, pc.not_equal(core, words))
        tails = pc.replace_substring_regex(words.filter(marked), f"^[{LETTERS}]+", "").dictionary_encode()
        one = self._known(_strings(bases.dictionary), _strings(pc.match_substring_regex(bases.dictionary, f"^[{LOWER}]+$")))
        two = self._known(_strings(tails.dictionary), [False] * len(tails.dictionary))
        long = marked.to_numpy(zero_copy_only=False)
        parts = [*one, *two, b""]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 2
        starts = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(parts), dtype="<u2")
        left = bases.indices.to_numpy(zero_copy_only=False)
        right = np.full(len(words), len(parts) - 1, dtype=np.int64)
        right[long] = tails.indices.to_numpy(zero_copy_only=False) + len(one)
        size = sizes[left] + sizes[right]
        first = starts[left].copy()
        # words with marks after them: both parts side by side, behind the others
        spots = np.flatnonzero(long)
        pairs = np.stack([left[spots], right[spots]], axis=1).ravel()
        at = np.cumsum(sizes[pairs]) - sizes[pairs]
        joined = ids[np.repeat(starts[pairs] - at, sizes[pairs]) + np.arange(int(sizes[pairs].sum()))]
        first[spots] = at[::2] + len(ids)
        return np.concatenate([ids, joined]), first, size

    def _known(self, words: list[str], simple: list[bool]) -> list[bytes]:
        """Ids of distinct words from the cache; the young half of it stays when it is full."""
        found = list(map(self.young.get, words))
        holes = [i for i, x in enumerate(found) if x is None]
        if holes:
            again = [(i, self.old.get(words[i])) for i in holes]
            learn = [i for i, x in again if x is None]
            fresh: dict[str, bytes] = {words[i]: x for i, x in again if x is not None}
            for kind, tokenize in ((True, self._plain_ids), (False, self._ids)):
                some = [words[i] for i in learn if simple[i] is kind]
                for at in range(0, len(some), 512):
                    fresh.update(zip(some[at:at + 512], tokenize(some[at:at + 512]), strict=True))
            for i in holes:
                found[i] = fresh[words[i]]
            if len(self.young) + len(fresh) > self.half:
                self.old, self.young = self.young, {}
            self.young.update(fresh)
        return found

    def _plain_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case letters, from one call over all of them."""
        found = self.plain.encode(" ".join(words), add_special_tokens=False)
        ends = np.cumsum(np.bincount(found.word_ids, minlength=len(words))).tolist()
        ids = np.array(found.ids, dtype="<u2").tobytes()
        return [ids[2 * a:2 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of any words, from one call over all of them."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        starts = np.fromiter((a for a, _ in found.offsets), dtype=np.int64, count=len(found.ids))
        ends = np.cumsum([len(t) + 1 for t in words])
        cuts = np.searchsorted(starts, ends[:-1], side="left").tolist()
        ids = np.array(found.ids, dtype="<u2").tobytes()
        edges = [0, *cuts, len(found.ids)]
        return [ids[2 * a:2 * b] for a, b in zip(edges, edges[1:], strict=False)]


def _strings(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


_LOADED: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def mix(a: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: well spread bits for any 64-bit keys."""
    z = a.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about :data:`SLICE_BYTES` of text, at most :data:`SLICE_ROWS` rows and one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        to = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, side="right"))), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def token_pieces(docs: DataFrame, size: int, buckets: int, key: str = "doc_id", text: str = "text",
                 vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``size`` ids of every document, its end id included.

    A null text counts as empty and still yields its end id; a null key is
    carried as null.  ``bucket`` spreads pieces, not documents, so one very
    long document is packed by many tasks.  It follows the row (key, text, task
    and the number of the repeat in the task), so rows that share a key, have
    none or are repeated spread like all others.
    """
    path = tokenizer_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(path)
        task, repeats = np.uint64(TaskContext.get().partitionId() << 32), [0] * REPEAT_SLOTS
        for batch in batches:
            for part in _slices(batch):
                ids, ends = tok.encode_words(part.column(1))
                n = np.diff(ends, prepend=0) + 1
                ids = np.insert(ids, ends, end_id).astype("<u2", copy=False)
                pieces = -(-n // size)
                row = np.repeat(np.arange(part.num_rows), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
                length = np.minimum(size, n[row] - start)
                nth = []
                for h in part.column(2).to_pylist():
                    nth.append(repeats[h % REPEAT_SLOTS])
                    repeats[h % REPEAT_SLOTS] += 1
                with np.errstate(over="ignore"):
                    seed = mix(part.column(2).to_numpy().view(np.uint64) + mix(task + np.array(nth, dtype=np.uint64)))
                    bucket = (mix(seed[row] + start.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                # pieces lie in the ids one after the other, so the column is the array and its edges
                edges = np.zeros(len(row) + 1, dtype=np.int32)
                np.cumsum(2 * length, out=edges[1:])
                body = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(edges), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), part.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(n[row]), body],
                    names=["bucket", "doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.xxhash64(F.col(key), F.col(text)).alias("row")).mapInArrow(run, PIECE_SCHEMA)


def bucket_count(docs: DataFrame, tokens_each: int, text: str = "text", bytes_per_token: float = 2.5, pieces_each: int = PIECES_EACH) -> int:
    """Number of buckets that hold about ``tokens_each`` ids and at most about ``pieces_each`` rows, from the bytes of all texts."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) / bytes_per_token + 1
    tokens, rows = docs.agg(F.sum(size), F.count(F.lit(1))).first()
    return max(1, math.ceil((tokens or 0) / tokens_each), math.ceil(rows / pieces_each))
