"""Token counts from a deterministic transducer over characters.

The split pattern of a byte-level BPE vocabulary and the merges themselves are
one finite-state machine.  Inside a piece, the last token of the encoding of
every prefix decides what can follow, so a state holds, for each suffix that
some token may still extend, the token that ends before it and the number of
tokens since.  Around that stand the few states of the split pattern: letter,
number and mark runs, pending white space (the pattern looks one character
ahead there) and contractions.  Every transition is annotated with the change
of ``tokens(text so far)``, so the annotations of a text add up to its count.

States are determinised on first use, kept in one integer table per task and
dropped when a bound is reached.  Texts are cut into chunks of equal length
that all run in step through the table, one numpy gather for each character
position.  A chunk is a state map: after white space that follows a non-space
the state no longer depends on what came before, so what lies behind that
point is a constant map, evaluated at once for all chunks; what lies before it
is evaluated at the exit state of the chunks to the left, which a prefix scan
over the maps supplies.  Chunks without such a point are maps as well, worked out
for the entry states that can reach them: all at once, first from a guess, then
from the exits that their left neighbours' maps have so far.  Entry states forget
what lies far behind, so two rounds settle almost every chunk; equal chunks share
a map, so a run of one character needs as many rounds as it has states.  The scan
then composes the maps from left to right.
"""

from __future__ import annotations

import json
import marshal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
CHUNK_CHARS, BATCH_CHARS, MAX_STATES, COLUMNS = 512, 1 << 20, 320_000, 128
#: Contractions of the split pattern: after an apostrophe that begins a piece.
SHORT, LONG = "stmd", {"r": "e", "v": "e", "l": "l"}
START = ("S", None, "")
#: Packed transitions hold the annotation plus this in their low byte; 0 is a transition not yet known.
_ZERO = 128


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies, inverted."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeMachine:
    """States inside one piece, over bytes.

    A state is ``(suffix, ((length, token, since), ...))``: for each length for
    which the last bytes begin some longer token, the token that ends before
    them (-1 at the beginning of the piece) and the tokens since then.
    """

    EMPTY = (b"", ((0, -1, 0),))

    def __init__(self, vocab: dict[str, int], merges: list):
        at = _byte_alphabet()
        raw = lambda s: bytes(at[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.tokens = {raw(s): i for s, i in vocab.items() if all(c in at for c in s)}
        self.text = {i: b for b, i in self.tokens.items()}
        self.prefixes = {b[:k] for b in self.tokens for k in range(len(b))}
        self.pairs: dict[tuple[int, int], bool] = {}

    def encode(self, piece: bytes) -> list[bytes]:
        """Merges in rank order, for short strings."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def adjacent(self, a: int, b: int) -> bool:
        """Whether the two tokens can stand side by side in an encoding."""
        known = self.pairs.get((a, b))
        if known is None:
            x, y = self.text[a], self.text[b]
            known = self.pairs[a, b] = self.encode(x + y) == [x, y]
        return known

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """Next state, and change of the number of tokens."""
        suffix, live = state
        grown = suffix + bytes([byte])
        for length, token, since in live:  # longest first
            new = self.tokens.get(grown[len(suffix) - length:])
            if new is not None and (token < 0 or self.adjacent(token, new)):
                change = 1 - since
                break
        else:
            raise ValueError("this vocabulary has no token for a byte, or merges that do not build its tokens")
        kept = [(length + 1, token, since + change) for length, token, since in live
                if grown[len(suffix) - length:] in self.prefixes]
        kept.append((0, new, 0))
        return (grown[len(grown) - kept[0][0]:], tuple(kept)), change

    def feed(self, state: tuple, char: str) -> tuple[tuple, int]:
        total = 0
        for b in char.encode("utf-8"):
            state, change = self.step(state, b)
            total += change
        return state, total


class Sparse:
    """Transitions by (state, character) for the characters without a column: open addressing in arrays."""

    def __init__(self, bits: int = 17):
        self.keys, self.values, self.n = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64), 0

    def _spots(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or the free place for it."""
        mask = np.int64(len(self.keys) - 1)
        with np.errstate(over="ignore"):
            at = ((keys * np.int64(-7046029254386353131)) >> np.int64(20)) & mask
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[at[todo]]
            todo = todo[(there != -1) & (there != keys[todo])]
            at[todo] = (at[todo] + 1) & mask
        return at

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, 0 where unknown."""
        at = self._spots(keys)
        return np.where(self.keys[at] == keys, self.values[at], 0)

    def put(self, key: int, value: int) -> None:
        if 2 * self.n >= len(self.keys):
            old = self.keys != -1
            keys, values = self.keys[old], self.values[old]
            self.__init__(len(self.keys).bit_length())
            for k, v in zip(keys, values, strict=True):
                self.put(k, v)
        one = np.array([key], dtype=np.int64)
        at = self._spots(one)[0]
        self.n += self.keys[at] != key
        self.keys[at], self.values[at] = key, value


class TextMachine:
    """The whole transducer: split pattern around :class:`BpeMachine`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("not a plain byte-level BPE vocabulary")
        self.spec, self.splitter = spec, Tokenizer.from_file(path).pre_tokenizer
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.kinds: dict[str, str] = {}
        self.reset()

    def reset(self) -> None:
        self.bpe = BpeMachine(self.spec["model"]["vocab"], self.spec["model"]["merges"])
        self.numbers: dict[bytes, int] = {}
        self.states: list[bytes] = [b""]  # serialised, as they are many; numbers begin at 1
        self.rare = Sparse()
        self.table = np.zeros((MAX_STATES, COLUMNS), dtype=np.int32)  # pages are taken when first written
        self.column = np.full(0x110000, -1, dtype=np.int16)
        self.space = np.zeros(0x110000, dtype=bool)
        self.chars: list[int] = []
        self.start = self.number(START)

    def kind(self, char: str) -> str:
        """L, N, O (neither) or W (white space), as the library itself splits."""
        known = self.kinds.get(char)
        if known is None:
            joins = lambda x: len(self.splitter.pre_tokenize_str(x + char)) == 1
            known = next((k for k, x in (("L", "a"), ("N", "1"), ("O", "!")) if joins(x)), "W")
            self.kinds[char] = known
        return known

    def number(self, state: tuple) -> int:
        key = marshal.dumps(state, 2)
        n = self.numbers.get(key)
        if n is None:
            n = self.numbers[key] = len(self.states)
            self.states.append(key)
            if n >= len(self.table):  # one batch of texts may go beyond the bound
                self.table = np.concatenate([self.table, np.zeros((n // 4, COLUMNS), dtype=np.int32)])
        return n

    def move(self, state: tuple, c: str) -> tuple[tuple, int]:
        """Next state and change of the token count when ``c`` follows."""
        mode, inner, held = state
        kind, bpe = self.kind(c), self.bpe
        if mode == "W":  # inner: the run without its last character, held: that character
            run, last = bpe.feed(inner, held)
            if kind == "W":
                return ("W", run, c), bpe.feed(run, c)[1]
            alone, one = bpe.feed(bpe.EMPTY, held)
            if held == " ":  # a single space joins what follows
                after, change = bpe.feed(alone, c)
                return (kind, after, ""), one + change - last
            after, change = self.move(START, c)
            return after, one + change - last
        if mode == kind:
            after, change = bpe.feed(inner, c)
            return (kind, after, ""), change
        if mode == "A":  # an apostrophe that begins a piece; held: a letter after it
            if not held and c in SHORT:
                return START, bpe.feed(inner, c)[1]
            if not held and c in LONG:
                return ("A", inner, c), bpe.feed(bpe.EMPTY, c)[1]
            letter, one = bpe.feed(bpe.EMPTY, held)
            if held and LONG[held] == c:
                return START, bpe.feed(bpe.feed(inner, held)[0], c)[1] + bpe.feed(inner, held)[1] - one
            if held:
                return self.move(("L", letter, ""), c)
            if kind == "O":
                after, change = bpe.feed(inner, c)
                return ("O", after, ""), change
        if kind == "W":
            return ("W", bpe.EMPTY, c), bpe.feed(bpe.EMPTY, c)[1]
        after, change = bpe.feed(bpe.EMPTY, c)
        return ("A" if c == "'" else kind, after, ""), change

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Column of every character; characters beyond the table share the last one."""
        out = self.column[points]
        if (out < 0).any():
            for p in np.unique(points[out < 0]).tolist():
                self.column[p] = min(len(self.chars), COLUMNS - 1)
                self.space[p] = self.kind(chr(p)) == "W"
                self.chars.append(p)
            out = self.column[points]
        return out

    def _fill(self, state: int, point: int) -> int:
        after, change = self.move(marshal.loads(self.states[state]), chr(point))
        if not -_ZERO <= change < _ZERO:
            raise ValueError("annotation out of range")
        return self.number(after) << 8 | change + _ZERO

    def run(self, points: np.ndarray, codes: np.ndarray, begin: np.ndarray, length: np.ndarray,
            state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All lanes in step: exit state and summed annotations of each."""
        order = np.argsort(-length, kind="stable")
        at, size, now = begin[order], length[order], state[order].astype(np.int64)
        total = np.zeros(len(order), dtype=np.int64)
        active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
        for t, n in enumerate(active.tolist()):
            spot = at[:n] + t
            col = codes[spot]
            got = self.table[now[:n], col]
            far = np.flatnonzero(col == COLUMNS - 1)
            if len(far):
                got = got.astype(np.int64)
                got[far] = self.rare.get((now[far] << 21) | points[spot[far]])
            for i in np.flatnonzero(got == 0).tolist():
                s, p, c = int(now[i]), int(points[spot[i]]), int(col[i])
                if c < COLUMNS - 1:
                    if not self.table[s, c]:
                        found = self._fill(s, p)  # may replace the table by a longer one
                        self.table[s, c] = found
                    got[i] = self.table[s, c]
                else:
                    found = int(self.rare.get(np.array([s << 21 | p]))[0])
                    if not found:
                        found = self._fill(s, p)
                        self.rare.put(s << 21 | p, found)
                    got[i] = found
            now[:n] = got >> 8
            total[:n] += (got & 255) - _ZERO
        exits, sums = np.empty_like(now), np.empty_like(total)
        exits[order], sums[order] = now, total
        return exits, sums

    def _compose(self, points: np.ndarray, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, number: np.ndarray, free: np.ndarray,
                 entry: np.ndarray, exits: np.ndarray, sums: np.ndarray) -> None:
        """Exits and sums of the chunks ``free``, whose maps depend on their entry.

        ``maps`` holds exit and sum by (content, entry state).  Each round works
        out, in one run of all lanes, the pairs that the chunks would need if
        their left neighbours left as their maps say so far; the pass from left
        to right is done when every pair it meets is known.  The first unknown
        chunk of a pass always has its true entry, so a round settles one more
        chunk at least.
        """
        content: dict[bytes, int] = {}
        kinds = [content.setdefault(points[a:b].tobytes(), len(content)) for a, b in zip(begin[free].tolist(), end[free].tolist(), strict=True)]
        maps: dict[tuple[int, int], tuple[int, int]] = {}
        guess: dict[int, int] = {}  # content -> an exit it has had
        while True:
            need: dict[tuple[int, int], int] = {}
            left_of: dict[int, int] = {}  # chunk -> exit assumed so far
            for i, kind in zip(free.tolist(), kinds, strict=True):
                if number[i]:
                    at = left_of[i - 1] if i - 1 in left_of else int(exits[i - 1])
                else:
                    at = self.start
                entry[i] = at
                known = maps.get((kind, at))
                if known is None:
                    need.setdefault((kind, at), i)
                    left_of[i] = guess.get(kind, self.start)
                else:
                    left_of[i] = known[0]
            if not need:
                break
            lanes = np.array(list(need.values()))
            after, more = self.run(points, codes, begin[lanes], (end - begin)[lanes], np.array([at for _, at in need]))
            for (kind, at), x, y in zip(need, after.tolist(), more.tolist(), strict=True):
                maps[kind, at] = (x, y)
                guess[kind] = x
        for i, kind in zip(free.tolist(), kinds, strict=True):
            exits[i], sums[i] = maps[kind, int(entry[i])]

    def count(self, texts: list[str], chunk: int = CHUNK_CHARS) -> np.ndarray:
        """Number of tokens of every text."""
        if len(self.states) > MAX_STATES * 9 // 10 or self.rare.n > MAX_STATES or len(self.bpe.pairs) > 4 * MAX_STATES:
            self.reset()
        parts, owner = [], []
        out = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            cut = [text]
            for s in self.special:  # stands for one token of its own
                cut = [y for x in cut for y in x.split(s)]
            out[i] = len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        points = np.frombuffer("".join(parts).encode("utf-32-le"), dtype="<u4")
        if not len(points):
            return out
        size = np.array([len(p) for p in parts])
        chunks = -(-size // chunk)
        first = np.cumsum(size) - size
        number = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        begin = np.repeat(first, chunks) + number * chunk
        end = np.minimum(begin + chunk, np.repeat(first + size, chunks))
        codes = self.codes(points)
        space = self.space[points]
        marks = np.append(np.flatnonzero(space[1:] & ~space[:-1]) + 1, len(points))
        sync = marks[np.searchsorted(marks, begin + 1)]
        sync = np.where(number == 0, begin, sync)
        fixed = sync < end
        # constant maps: from the first point where the state is known, to the chunk's end
        exits = np.full(len(begin), self.start, dtype=np.int64)
        sums = np.zeros(len(begin), dtype=np.int64)
        exits[fixed], sums[fixed] = self.run(points, codes, sync[fixed], (end - sync)[fixed], exits[fixed])
        entry = np.full(len(begin), self.start, dtype=np.int64)
        free = np.flatnonzero(~fixed)
        if len(free):
            self._compose(points, codes, begin, end, number, free, entry, exits, sums)
        # every exit is known now: what lies before the points where the state is known
        head = np.flatnonzero(fixed & (number > 0))
        _, more = self.run(points, codes, begin[head], (sync - begin)[head], exits[head - 1])
        sums[head] += more
        np.add.at(out, np.repeat(np.array(owner), chunks), sums)
        return out


_LOADED: dict[str, TextMachine] = {}


def text_machine(path: str) -> TextMachine:
    if path not in _LOADED:
        _LOADED[path] = TextMachine(path)
    return _LOADED[path]


def _groups(texts: list[str], most: int) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
                 limit: int = 512, chunk: int = CHUNK_CHARS) -> DataFrame:
    """One row per document: key, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    A null text counts as empty (0 tokens); repeated rows are counted one by
    one; a null key is carried; an empty table gives no rows.
    """
    path = tokenizer_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = text_machine(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts = [machine.count(g, chunk) for g in _groups(texts, BATCH_CHARS)]
                n = np.concatenate(counts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), pa.array(n > limit)],
                                                 names=["k", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    thin = docs.select(F.col(key).alias("k"), F.col(text).alias("t"),
                       F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    counted = thin.mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.select(F.col("k").alias(key), "n_bytes", "n_tokens", "over_limit")
