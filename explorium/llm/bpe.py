"""Byte-level BPE with a lexicon compiled into a minimal acyclic transducer.

Frequent pieces (what the split pattern cuts a text into) are counted over all documents; the ``LEXICON`` most
frequent are encoded by exact merges and compiled into an automaton that shares suffixes. A transition's output is an
integer; their sum over a piece is its number, which leads to its ids. The compiled arrays form one flat file that
each Python worker maps into memory. Pieces that the automaton doesn't accept are merged exactly, by ranks.

Null texts count as empty; an empty text has no tokens. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces compiled into the automaton, at most; bounds the file that is broadcast.
LEXICON = 131_072
#: Pieces outside the automaton whose result a worker remembers; pieces that a task counts before it hands on its table.
REMEMBERED, COUNTED = 100_000, 150_000

#: The published split pattern of this kind of tokenizer. White space is Unicode's White_Space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


def splitter() -> Callable[[str], list[str]]:
    """Splits by the pattern. Texts without characters above U+FFFF go through the standard library's engine, which is twice as fast, with the three classes spelt out."""

    def members(name: str) -> str:
        is_in, spans = regex.compile(rf"\p{{{name}}}").match, []
        for k in range(0x10000):
            if not 0xD800 <= k < 0xE000 and is_in(chr(k)):
                if spans and spans[-1][1] == k - 1:
                    spans[-1][1] = k
                else:
                    spans.append([k, k])
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans)

    space, letter, number = (members(name) for name in ("White_Space", "L", "N"))
    plain = PATTERN.replace("\\P{White_Space}", f"[^{space}]").replace("[^\\p{White_Space}\\p{L}\\p{N}]", f"[^{space}{letter}{number}]")
    for name, chars in (("White_Space", space), ("L", letter), ("N", number)):
        plain = plain.replace(f"\\p{{{name}}}", f"[{chars}]")
    fast, full = re.compile(plain).findall, regex.compile(PATTERN).findall
    return lambda text: (fast if len(text.encode("utf-16-le")) == 2 * len(text) else full)(text)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable Latin-1 for itself, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


_NONE = 1 << 60


class Vocabulary:
    """Ids, merges and special strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.bytes = {v: k for k, v in self.ids.items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        #: Two ids in one number to rank and id of the merged pair in one number.
        self.joined = {self.ids[a] << 20 | self.ids[b]: i << 20 | self.ids[a + b] for (a, b), i in self.ranks.items()}
        self._pairs = np.array(sorted(self.joined), np.int64)
        self._merged = np.array([self.joined[k] for k in self._pairs.tolist()], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: the pair of least rank is merged first, the leftmost among equals."""
        if len(piece) > 64:
            return self._merge_long(piece)
        t, get = [self.single[b] for b in piece], self.joined.get
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(t, t[1:])]
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            t[i] = least & 0xFFFFF
            del t[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(t[i - 1] << 20 | t[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(t[i] << 20 | t[i + 1], _NONE)
        return t

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """``merge`` of many pieces at once, of similar length together: every piece makes its next merge in the same step."""
        out: list[list[int]] = [[]] * len(pieces)
        order = sorted((i for i, p in enumerate(pieces) if 1 < len(p) <= 64), key=lambda i: len(pieces[i]))
        for i, p in enumerate(pieces):
            if len(p) == 1 or len(p) > 64:
                out[i] = self.merge(p)
        for at in range(0, len(order), 4096):
            part = order[at : at + 4096]
            for i, ids in zip(part, self._merge_block([pieces[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a << 20 | b
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pair, self._merged[at], _NONE)

    def _merge_block(self, pieces: list[bytes]) -> list[list[int]]:
        m, size = len(pieces), max(map(len, pieces))
        length = np.fromiter(map(len, pieces), np.int64, m)
        cells = np.arange(size)[None, :] < length[:, None]
        token = np.zeros((m, size + 2), np.int64)  # a cell more at either end, so that neighbours always exist
        token[:, 1:-1][cells] = np.asarray(self.single)[np.frombuffer(b"".join(pieces), np.uint8)]
        alive = np.zeros((m, size + 2), bool)
        alive[:, 1:-1] = cells
        after, before = (np.tile(np.arange(size + 2) + d, (m, 1)) for d in (1, -1))
        rank = np.full((m, size + 2), _NONE)
        both = alive[:, :-1] & alive[:, 1:]
        rank[:, :-1][both] = self._rank(token[:, :-1][both], token[:, 1:][both])
        row = np.arange(m)
        while True:
            cell = rank[row].argmin(axis=1)
            best = rank[row, cell]
            row, cell, best = (x[best < _NONE] for x in (row, cell, best))
            if not len(row):
                break
            gone = after[row, cell]
            follow = after[row, gone]
            token[row, cell] = best & 0xFFFFF
            alive[row, gone], rank[row, gone] = False, _NONE
            after[row, cell], before[row, np.minimum(follow, size + 1)] = follow, cell
            for left, right in ((cell, follow), (before[row, cell], cell)):
                right = np.minimum(right, size + 1)
                ok = alive[row, left] & alive[row, right]
                rank[row, left] = _NONE
                rank[row[ok], left[ok]] = self._rank(token[row[ok], left[ok]], token[row[ok], right[ok]])
        flat, ends = token[alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by linked list and heap, so that long pieces take n log n."""
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if parts[i] != a or (j := after[i]) >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := self.ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [self.ids[p] for p in parts if p is not None]


class Lexicon:
    """The automaton as flat arrays: transitions sorted by state and byte, with target and output; words' ids."""

    NAMES = (("keys", np.int64), ("targets", np.int32), ("outputs", np.int32), ("final", np.uint8), ("starts", np.int32), ("ids", np.int32))

    def __init__(self, buffer):
        at, self.size = 8 * len(self.NAMES), len(buffer)
        for (name, kind), n in zip(self.NAMES, np.frombuffer(buffer, np.int64, len(self.NAMES)), strict=True):
            setattr(self, name, np.frombuffer(buffer, kind, n, at))
            at += -(-n * np.dtype(kind).itemsize // 8) * 8

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> bytes:
        """Minimal automaton of the sorted words, built one word at a time: a state whose right side is complete is replaced by its equal, if there is one."""
        order = sorted(w for w in words if w)
        edges, final, free = [{}], [False], []  # by state; free: numbers of states that were replaced
        register: dict[tuple, int] = {}
        path: list[tuple[int, int]] = []  # (state, byte) of the last word's unchecked part
        last = b""

        def settle(down_to: int) -> None:
            while len(path) > down_to:
                state, byte = path.pop()
                child = edges[state][byte]
                mark = (final[child], tuple(edges[child].items()))
                if (same := register.get(mark)) is not None:
                    edges[state][byte] = same
                    edges[child], final[child] = {}, False
                    free.append(child)
                else:
                    register[mark] = child

        for word in order:
            common = len(os.path.commonprefix([word, last]))
            settle(common)
            state = edges[path[-1][0]][path[-1][1]] if path else 0
            for byte in word[common:]:
                if not free:
                    free.append(len(edges))
                    edges.append({})
                    final.append(False)
                edges[state][byte] = new = free.pop()
                path.append((state, byte))
                state = new
            final[state] = True
            last = word
        settle(0)
        number, todo = {}, [0]  # states that are left, in order of discovery
        while todo:
            if (s := todo.pop()) not in number:
                number[s] = len(number)
                todo += edges[s].values()
        below: dict[int, int] = {}

        def count(s: int) -> int:
            stack = [s]
            while stack:
                top = stack[-1]
                if wait := [t for t in edges[top].values() if t not in below]:
                    stack += wait
                else:
                    below[top] = final[top] + sum(below[t] for t in edges[top].values())
                    stack.pop()
            return below[s]

        count(0)
        rows = []
        for s, k in number.items():
            skipped = int(final[s])
            for byte in sorted(edges[s]):
                t = edges[s][byte]
                rows.append((k * 256 + byte, number[t], skipped))
                skipped += below[t]
        rows.sort()
        ends = np.cumsum([0] + [len(words[w]) for w in order])
        flags = np.zeros(len(number), np.uint8)
        for s, k in number.items():
            flags[k] = final[s]
        values = {"keys": [r[0] for r in rows], "targets": [r[1] for r in rows], "outputs": [r[2] for r in rows], "final": flags, "starts": ends, "ids": [i for w in order for i in words[w]]}
        arrays = [np.asarray(values[name], kind) for name, kind in cls.NAMES]
        out = [np.array([len(a) for a in arrays], np.int64).tobytes()]
        for a in arrays:
            raw = a.tobytes()
            out.append(raw + bytes(-len(raw) % 8))
        return b"".join(out)

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """From a file of this process's own that has no name any more: nothing is left behind when it ends."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def look_up(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each piece, -1 where the automaton doesn't accept it; all pieces advance together."""
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        if not n or not len(self.keys):
            return np.full(n, -1)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        start = np.cumsum(length) - length
        state, number, alive = np.zeros(n, np.int64), np.zeros(n, np.int64), np.flatnonzero(length > 0)
        number[length == 0] = -1
        step = 0
        while len(alive):
            want = state[alive] * 256 + flat[start[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            ok = self.keys[at] == want
            number[alive[~ok]] = -1
            alive, at = alive[ok], at[ok]
            state[alive] = self.targets[at]
            number[alive] += self.outputs[at]
            step += 1
            ended = length[alive] == step
            done = alive[ended]
            number[done[self.final[state[done]] == 0]] = -1
            alive = alive[~ended]
        return number

    def tokens(self, number: int) -> list[int]:
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()


class Codec:
    """Encodes and decodes pieces: automaton first, exact merges for what it doesn't hold."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.split = splitter()
        self.names = {i: str(i) for i in vocabulary.bytes}
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.said: dict[str, str] = {s: str(i) for s, i in vocabulary.special.items()}
        self.back: dict[str, bytes] = {s: vocabulary.bytes[i] for s, i in vocabulary.special.items()}
        self.own = list(self.said)

    def clear(self) -> None:
        """Forgets pieces that aren't in the automaton."""
        self.said, self.back = ({p: x[p] for p in self.own if p in x} for x in (self.said, self.back))

    def pieces(self, text: str) -> list[str]:
        """Special strings stand alone; what lies between is split by the pattern."""
        if self.special is None or not self.special.search(text):
            return self.split(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.split(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.split(text[at:])

    def learn(self, pieces: set[str]) -> None:
        """Afterwards ``said`` has the ids of each, as text, and ``back`` what these ids decode to, where that isn't the piece itself."""
        if len(self.said) - len(self.own) > REMEMBERED:
            self.clear()
        new = [p for p in pieces if p not in self.said]
        raw = [p.encode() for p in new]
        numbers = self.lexicon.look_up(raw).tolist()
        merged = iter(self.vocabulary.merge_all([b for b, number in zip(raw, numbers, strict=True) if number < 0]))
        names, parts = self.names, self.vocabulary.bytes
        for p, b, number in zip(new, raw, numbers, strict=True):
            ids = self.lexicon.tokens(number) if number >= 0 else next(merged)
            self.said[p] = ",".join([names[i] for i in ids])
            if (back := b"".join([parts[i] for i in ids])) != b:
                self.back[p] = back
            if number >= 0:
                self.own.append(p)

    def decoded(self, pieces: list[str]) -> bytes:
        """What the ids of learnt pieces decode to."""
        other = self.back
        return b"".join([other[p] if p in other else p.encode() for p in pieces])

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces(text)
        self.learn(set(pieces))
        return [int(i) for p in pieces for i in self.said[p].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids)).decode("utf-8", "replace")


def count_pieces(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """piece, n over all texts; each task counts its own first and hands on its tables when they grow large."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, found = splitter(), Counter()

        def out():
            items = list(found.items())
            for at in range(0, len(items), 20_000):
                part = items[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["piece", "n"])
            found.clear()

        for b in batches:
            for t in b.column(0):
                found.update(split(t.as_py() or ""))
                if len(found) > COUNTED:
                    yield from out()
        yield from out()

    return docs.select(text_col).mapInArrow(counted, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, size: int = LEXICON, text_col: str = "text") -> bytes:
    """The automaton of the ``size`` most frequent pieces of all texts; ties go by the piece. Pieces of over 64 bytes stay out."""
    counts = count_pieces(docs, text_col).where("octet_length(piece) <= 64")
    top = [r.piece.encode() for r in counts.orderBy(F.desc("n"), "piece").select("piece").limit(size).toLocalIterator()]
    return Lexicon.compile(dict(zip(top, vocabulary.merge_all(top), strict=True)))


def _portions(column: pa.Array, chars: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """Start and texts of runs of rows, each of about so many characters; a longer text is a run of its own."""
    start, size, texts = 0, 0, []
    for t in column:
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size >= chars:
            yield start, texts
            start, size, texts = start + len(texts), 0, []
    if texts:
        yield start, texts


_codecs: dict[str, Codec] = {}


def _worker_codec(shared) -> Codec:
    key, vocabulary, data = shared.value
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary, Lexicon.mapped(data))
    return _codecs[key]


def bpe_round_trip(docs: DataFrame, path: str, size: int = LEXICON, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each document: id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256; with_ids adds ids and decoded."""
    vocabulary = Vocabulary(path)
    data = build_lexicon(docs, vocabulary, size, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(data).hexdigest() + path, vocabulary, data))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _worker_codec(shared)
        for b in batches:
            for at, texts in _portions(b.column(1)):
                n, said_sha, back_sha, ids, decoded = [], [], [], [], []
                cut = [codec.pieces(t) for t in texts]
                codec.learn(set().union(*cut))
                for pieces in cut:
                    said = ",".join(map(codec.said.__getitem__, pieces))
                    back = codec.decoded(pieces)
                    n.append(said.count(",") + 1 if said else 0)
                    said_sha.append(hashlib.sha256(said.encode()).hexdigest())
                    back_sha.append(hashlib.sha256(back).hexdigest())
                    if with_ids:
                        ids.append([int(i) for i in said.split(",")] if said else [])
                        decoded.append(back.decode("utf-8", "replace"))
                columns = [b.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(said_sha, pa.string()), pa.array(back_sha, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], [*names, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
