"""Katz backoff n-gram model with Good-Turing discounts, learned from and applied to a whole corpus.

Words are 64-bit hashes. The corpus is cut into blocks of about ``BLOCK`` tokens; a block keeps its distinct words, the
token sequence as places among them, and its documents. Counts live in tables of one row a shard; a shard holds about
``SHARD`` tokens' worth of entries, so shards grow in number with the corpus, not in size. Level by level, a block
sends each shard its distinct n-grams once, with its own training counts, and the shard answers with the counts over
all training documents, in the same order. What is shuffled is the blocks' distinct n-grams, never tokens, and no
table of the model has to fit a task or the driver. The shards' sums are the model: they are written in the form of a
message, so texts of another day are scored by sending the stored rows along with theirs (``score``).

A word seen in training has a number, small for frequent words; so has an n-gram that is a history of the next level.
An n-gram's shard follows from its history's number, so the shard also answers with what the backoff weight of the
history takes: its total, how many of its n-grams have each small count, and the lower level's mass of the words seen
after it. A history with more than a shard's share of all tokens is dealt to several shards by the words after it;
their parts of these sums are added up on the driver (fewer histories than shards are that frequent).

Level 1: counts up to ``K`` are discounted by Good-Turing; what that leaves belongs to the one unknown word. Higher
levels: p(w|h) = d(c) c / c(h) for seen n-grams, else alpha(h) p(w|h'), h' being h without its first word, with
alpha(h) = (1 - seen mass) / (1 - lower level's mass of the words seen after h), so the probabilities after every h, the
unknown word included, sum to 1. An h never seen in training backs off with weight 1. Where counts of counts give no
discount between 0 and 1, (r - 1/2) / r is taken. Where no mass is left after h (every count above K), c(h) + 1
stands for c(h). A text starts with start marks; the end mark is a token.

Null and empty texts are one end token. A null id counts as training. Rows that repeat an id are separate. Without
training documents every token is the unknown word, of probability 1. Extra columns are not read. A text is never cut:
one longer than ``BLOCK`` is a block of its own.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions
from .near_dedup import _mixed, _Words

BLOCK, SHARD, K, ORDER = 1_000_000, 4_000_000, 5, 2
END = np.uint64(2**64 - 1)
#: Numbers of words and histories: none, the start mark, and the first that is given.
UNKNOWN, START, FIRST = 0, 1, 2
STORED = -1

_zip, _unzip = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers below 2**64 by their bytes: all lowest ones, then all second ones, as many as the largest has."""
    a = np.ascontiguousarray(a, np.uint64)
    size = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    planes = a.view(np.uint8).reshape(-1, 8)[:, :size].T
    return bytes([size]) + _zip.compress(np.ascontiguousarray(planes).tobytes())


def _open(b: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzip.decompress(b[1:]), np.uint8).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    return out.view(np.uint64).ravel()


def _pack_sorted(a: np.ndarray) -> bytes:
    return _pack(np.diff(np.asarray(a, np.uint64), prepend=np.uint64(0)))


def _open_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_open(b), dtype=np.uint64)


def _pack_reals(a: np.ndarray) -> bytes:
    """Exactly: as they are, or each value once and the places, whichever is shorter."""
    each, at = np.unique(a, return_inverse=True)
    plain, coded = _zip.compress(a.tobytes()), len(each).to_bytes(4, "little") + each.tobytes() + _pack(at)
    return b"\0" + plain if len(plain) <= len(coded) else b"\1" + coded


def _open_reals(b: bytes) -> np.ndarray:
    if not b[0]:
        return np.frombuffer(_unzip.decompress(b[1:]), np.float64)
    end = 5 + 8 * int.from_bytes(b[1:5], "little")
    return np.frombuffer(b[5:end], np.float64)[_open(b[end:]).astype(np.int64)]


def _pack_facts(facts: np.ndarray) -> bytes:
    """Rows of K + 1 whole numbers and a real."""
    numbers = _pack(facts[:, : K + 1].T.ravel())
    return len(numbers).to_bytes(4, "little") + numbers + _pack_reals(facts[:, K + 1])


def _open_facts(b: bytes) -> np.ndarray:
    end = 4 + int.from_bytes(b[:4], "little")
    return np.column_stack([_open(b[4:end]).reshape(K + 1, -1).T.astype(np.float64), _open_reals(b[end:])])


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 1 by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _table(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.values(), strict=True)], list(schema))


def _ddl(schema: dict[str, pa.DataType]) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double", pa.binary(): "binary"}
    kind = lambda t: f"array<{names[t.value_type]}>" if pa.types.is_list(t) else names[t]
    return ", ".join(f"{c} {kind(t)}" for c, t in schema.items())


_BLOCKS = {"block": pa.int64(), "trained": pa.int64(), "starts": pa.int64(), "size": pa.int64(), "ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()),
           "held": pa.list_(pa.bool_()), "words": pa.binary(), "counts": pa.binary(), "tokens": pa.binary()}


def _blocks(batches: Iterator[pa.RecordBatch], full: int) -> Iterator[pa.RecordBatch]:
    known, number = _Words(), TaskContext.get().partitionId() << 32
    ids, lengths, held, parts, size = [], [], [], [], 0

    def done() -> pa.RecordBatch:
        words, tokens = np.unique(np.concatenate(parts), return_inverse=True)
        train = np.repeat(~np.array(held), lengths)
        counts = np.bincount(tokens[train], minlength=len(words))
        return _table([(number, int(train.sum()), len(held) - sum(held), len(tokens), ids, lengths, held, _pack_sorted(words), _pack(counts), _pack(tokens))], _BLOCKS)

    for b in batches:
        texts = b.column(1).cast(pa.large_string()).cast(pa.large_binary())
        for doc_id, text, out in zip(b.column(0).to_pylist(), texts, b.column(2).to_pylist(), strict=True):
            words = (text.as_py() or b"").lower().split()
            h = np.empty(len(words) + 1, np.uint64)
            h[:-1] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            h[-1] = END
            ids.append(doc_id)
            lengths.append(len(h))
            held.append(out)
            parts.append(h)
            size += len(h)
            if size >= full:
                yield done()
                number += 1
                ids, lengths, held, parts, size = [], [], [], [], 0
    if parts:
        yield done()


def _edges(shards: int) -> np.ndarray:
    """Where the shards of the word hashes begin, the first left out."""
    return np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)


@dataclass
class Level:
    """What is the same everywhere at one level: how its histories are dealt, and sums over all shards.

    ``split``: histories with over a shard's share of the tokens, in order, over how many shards each is dealt, and
    their facts (total, n-grams of count 1 to K, lower mass of the words seen after it).
    """

    shards: int
    split: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    over: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    facts: np.ndarray = field(default_factory=lambda: np.empty((0, K + 2)))
    distinct: int = 0
    total: int = 0
    of: list[int] = field(default_factory=lambda: [0] * (K + 1))

    def splits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these histories are split, and the place of each."""
        if not len(self.split):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.split, h), len(self.split) - 1)
        return self.split[at] == h, at

    def shard_of(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        s = _mixed(h)
        hot, at = self.splits(h)
        s[hot] += _mixed(w[hot]) % self.over[at[hot]]
        return (s % np.uint64(self.shards)).astype(np.int64)


class Discounts:
    """Good-Turing factors d(1) to d(K) from how many things have each count."""

    def __init__(self, of: list[int]):
        self.d = np.ones(K + 2)
        n = [0, *of]
        off = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
        for r in range(1, K + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - off) / (1 - off) if n[r] and off < 1 else 0.0
            self.d[r] = d if 0 < d < 1 else (r - 0.5) / r

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return self.d[np.minimum(counts, K + 1)]


def unigrams(level: Level, counts: np.ndarray) -> np.ndarray:
    """Probabilities of words by their count; that of count 0 is the unknown word's."""
    if not level.total:
        return np.ones(len(counts))
    discounts = Discounts(level.of)
    left = sum(n * r * (1 - discounts.d[r]) for r, n in enumerate(level.of[:K], 1))
    per = level.total if left > 0 else level.total + 1
    return np.where(counts > 0, discounts(counts) * counts / per, (per - level.total + left) / per)


def backoff(facts: np.ndarray, discounts: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """What counts are divided by, and the backoff weight, from the facts on histories (rows)."""
    total, small, seen = facts[:, 0], facts[:, 1 : K + 1], facts[:, K + 1]
    left = small @ (np.arange(1, K + 1) * (1 - discounts.d[1 : K + 1]))
    per = np.where(left > 0, total, total + 1)
    return per, np.where(total > 0, (per - total + left) / per / (1 - seen), 1.0)


class _Block:
    """A block's documents as arrays. Of each level: the place of every token's n-gram among the block's distinct ones.

    ``climb`` goes a level up; ``hear`` takes in what the shards have said about the level reached.
    """

    def __init__(self, r: dict):
        self.block, self.ids, self.held = r["block"], r["ids"], r["held"]
        self.words, self.counts = _open_sorted(r["words"]), _open(r["counts"]).astype(np.int64)
        self.lengths = np.array(r["lengths"])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(~np.array(self.held), self.lengths)
        self.word_at = self.at = _open(r["tokens"]).astype(np.int64)
        self.numbers = self.p = None
        self.height = 1

    def climb(self, level: Level) -> None:
        """An n-gram is the one before it of the level below, or the start mark, and a word. Afterwards they are in the order in which they are sent."""
        below, many = self.at, len(self.words)
        self.height += 1
        before = np.empty_like(below)
        before[1:] = below[:-1]
        before[self.starts] = len(self.numbers)
        grams, at = np.unique(before * many + self.word_at, return_inverse=True)
        h = np.append(self.numbers, np.uint64(START))[grams // many]
        w = self.word_numbers[grams % many]
        shard = level.shard_of(h, w)
        shard[h == UNKNOWN] = level.shards  # not sent
        order = np.lexsort((w, h, shard))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.at = place[at]
        self.h, self.w, self.shard = h[order], w[order], shard[order]
        self.lower = np.empty(len(order), np.int64)
        self.lower[self.at] = below
        self.counts = np.bincount(self.at[self.train], minlength=len(order))
        self.sent = int(np.searchsorted(self.shard, level.shards))
        h, shard = self.h[: self.sent], self.shard[: self.sent]
        new = (h[1:] != h[:-1]) | (shard[1:] != shard[:-1])
        self.run_starts = np.flatnonzero(np.concatenate([[True], new])) if self.sent else np.empty(0, np.int64)
        self.runs = np.diff(np.append(self.run_starts, self.sent))

    def messages(self, level: Level) -> list[tuple]:
        runs_cut = np.searchsorted(self.shard[self.run_starts], np.arange(level.shards + 1))
        cut = np.searchsorted(self.shard[: self.sent], np.arange(level.shards + 1))
        # above words, probabilities; above single words their counts, which say the same in less
        pack, below, rows = (_pack, self.known, []) if self.height == 2 else (_pack_reals, self.p, [])
        below = below[self.lower]
        for s in np.flatnonzero(np.diff(cut)).tolist():
            own, runs = slice(cut[s], cut[s + 1]), slice(runs_cut[s], runs_cut[s + 1])
            rows.append((s, self.block, _pack_sorted(self.h[self.run_starts[runs]]), _pack(self.runs[runs]), _pack(self.w[own]), _pack(self.counts[own]), pack(below[own])))
        return rows

    def hear_words(self, said: list[dict], level: Level) -> None:
        self.known = np.concatenate([_open(a["counts"]) for a in said]).astype(np.int64)
        self.numbers = self.word_numbers = np.concatenate([_open(a["numbers"]) for a in said])
        self.p = unigrams(level, self.known)

    def hear(self, said: list[dict] | None, level: Level) -> None:
        found, numbers, facts = np.zeros(len(self.h), np.int64), np.zeros(len(self.h), np.uint64), np.zeros((0, K + 2))
        if said:
            found[: self.sent] = np.concatenate([_open(a["counts"]) for a in said])
            facts = np.concatenate([_open_facts(a["facts"]) for a in said])
            if said[0]["numbers"] is not None:
                numbers[: self.sent] = np.concatenate([_open(a["numbers"]) for a in said])
        hot, at = level.splits(self.h[self.run_starts])
        facts[hot] = level.facts[at[hot]]
        discounts = Discounts(level.of)
        per, alpha = (np.append(np.repeat(a, self.runs), np.ones(len(self.h) - self.sent)) for a in backoff(facts, discounts))
        self.numbers, self.p = numbers, np.where(found > 0, discounts(found) * found / per, alpha * self.p[self.lower])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row in memory at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    shard, rows = None, []
    for r in _rows(batches):
        if rows and r["shard"] != shard:
            yield shard, rows
            rows = []
        shard = r["shard"]
        rows.append(r)
    if rows:
        yield shard, rows


_WORDS = {"shard": pa.int32(), "block": pa.int64(), "words": pa.binary(), "counts": pa.binary()}
_GRAMS = {"shard": pa.int32(), "block": pa.int64(), "first": pa.binary(), "runs": pa.binary(), "second": pa.binary(), "counts": pa.binary(), "lower": pa.binary()}
#: An answer to a block has counts, numbers and facts; the model's own row (block STORED) has what a message has; a row without block has the shard's sums.
_SAID = {"facts": pa.binary(), "numbers": pa.binary(), "words": pa.binary(), "first": pa.binary(), "runs": pa.binary(), "second": pa.binary(), "lower": pa.binary(),
         "sums": pa.list_(pa.int64()), "hot": pa.list_(pa.int64()), "hot_counts": pa.list_(pa.int64()), "part": pa.list_(pa.int64()), "part_facts": pa.list_(pa.float64())}
_ANSWER = {"shard": pa.int32(), "block": pa.int64(), "counts": pa.binary()} | _SAID


def _answers(rows: list[dict]) -> pa.RecordBatch:
    return _table([tuple(r.get(c) for c in _ANSWER) for r in rows], _ANSWER)


def _sums(counts: np.ndarray) -> list[int]:
    return [int((counts > 0).sum()), int(counts.sum()), *np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2].tolist()]


def _hot(counts: np.ndarray, numbers: np.ndarray, share: float) -> dict:
    """Those with over a shard's share of all tokens."""
    at = np.flatnonzero(counts > share)
    return {"hot": numbers[at].astype(np.int64).tolist(), "hot_counts": counts[at].tolist()}


def _send_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for r in _rows(batches):
        words, counts = _open_sorted(r["words"]), _open(r["counts"])
        cut = [0, *np.searchsorted(words, _edges(shards)).tolist(), len(words)]
        yield _table([(s, r["block"], _pack_sorted(words[x:y]), _pack(counts[x:y])) for s, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if x < y], _WORDS)


def _sum_words(batches: Iterator[pa.RecordBatch], shards: int, share: float, store: bool) -> Iterator[pa.RecordBatch]:
    for shard, rows in _by_shard(batches):
        own = [_open_sorted(r["words"]) for r in rows]
        words, at = np.unique(np.concatenate(own), return_inverse=True)
        counts = np.bincount(at, np.concatenate([_open(r["counts"]) for r in rows])).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
        numbers = np.where(counts > 0, FIRST + rank * shards + shard, UNKNOWN)
        out, seen = [{"shard": shard, "sums": _sums(counts)} | _hot(counts, numbers, share)], counts > 0
        if store:
            out.append({"shard": shard, "block": STORED, "words": _pack_sorted(words[seen]), "counts": _pack(counts[seen])})
        end = 0
        for r, w in zip(rows, own, strict=True):
            mine = at[end : end + len(w)]
            end += len(w)
            if r["block"] != STORED:
                out.append({"shard": shard, "block": r["block"], "counts": _pack(counts[mine]), "numbers": _pack(numbers[mine])})
            if len(out) >= 64:
                yield _answers(out)
                out = []
        yield _answers(out)


def _send_grams(batches: Iterator[pa.RecordBatch], levels: list[Level], level: Level) -> Iterator[pa.RecordBatch]:
    for r in _rows(batches):
        x = _heard(r, levels)
        x.climb(level)
        if rows := x.messages(level):
            yield _table(rows, _GRAMS)


def _heard(r: dict, levels: list[Level]) -> _Block:
    x = _Block(r)
    x.hear_words(r["said1"], levels[0])
    for n, level in enumerate(levels[1:], 2):
        x.climb(level)
        x.hear(r[f"said{n}"], level)
    return x


def _sum_grams(batches: Iterator[pa.RecordBatch], level: Level, words: Level | None, share: float, store: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """words: the level below, if that is the words' own."""
    for shard, rows in _by_shard(batches):
        yield from _grams_summed(shard, rows, level, words, share, store, last)


def _grams_summed(shard: int, rows: list[dict], level: Level, words: Level | None, share: float, store: bool, last: bool) -> Iterator[pa.RecordBatch]:
    firsts, runs = [_open_sorted(r["first"]) for r in rows], [_open(r["runs"]).astype(np.int64) for r in rows]
    h = np.concatenate([np.repeat(x, n) for x, n in zip(firsts, runs, strict=True)])
    w = np.concatenate([_open(r["second"]) for r in rows])
    order = np.lexsort((w, h))
    h, w = h[order], w[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
    h, w = h[new], w[new]
    group = np.cumsum(new, dtype=np.int32) - 1
    counts = np.bincount(group, np.concatenate([_open(r["counts"]) for r in rows])[order]).astype(np.int64)
    lower = np.concatenate([(_open if words else _open_reals)(r["lower"]) for r in rows])[order[new]]
    below = unigrams(words, lower.astype(np.int64)) if words else lower
    back = np.empty(len(order), np.int32)
    back[order] = group
    del order, group, new
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    names, of, seen = h[head], np.repeat(np.arange(len(head)), np.diff(np.append(head, len(h)))), counts > 0
    facts = np.zeros((len(names), K + 2))
    facts[:, 0] = np.bincount(of, counts)
    for k in range(1, K + 1):
        facts[:, k] = np.bincount(of, counts == k)
    facts[:, K + 1] = np.bincount(of, np.where(seen, below, 0.0))
    numbers = np.where(seen, FIRST + np.cumsum(seen) * level.shards + shard, UNKNOWN)
    hot, _ = level.splits(names)
    out = [{"shard": shard, "sums": _sums(counts), "part": names[hot].astype(np.int64).tolist(), "part_facts": facts[hot].ravel().tolist()}]
    if not last:
        out[0] |= _hot(counts, numbers, share)
    if store:
        own, many = np.unique(h[seen], return_counts=True)
        out.append({"shard": shard, "block": STORED, "first": _pack_sorted(own), "runs": _pack(many), "second": _pack(w[seen]), "counts": _pack(counts[seen]), "lower": (_pack if words else _pack_reals)(lower[seen])})
    end = 0
    for r, x, n in zip(rows, firsts, runs, strict=True):
        mine = back[end : end + n.sum()]
        end += len(mine)
        if r["block"] != STORED:
            said = facts[np.searchsorted(names, x)]
            out.append({"shard": shard, "block": r["block"], "counts": _pack(counts[mine]), "facts": _pack_facts(said), "numbers": None if last else _pack(numbers[mine])})
        if len(out) >= 64:
            yield _answers(out)
            out = []
    yield _answers(out)


_SCORES = {"id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def _score(batches: Iterator[pa.RecordBatch], levels: list[Level]) -> Iterator[pa.RecordBatch]:
    total, distinct = levels[0].total, levels[0].distinct
    for r in _rows(batches):
        x = _heard(r, levels)
        base = np.log10((x.known + 0.5) / (total + 0.5 * (distinct + 1)))
        sums = [np.add.reduceat(y, x.starts) for y in ((x.known > 0).astype(np.int64)[x.word_at], base[x.word_at], np.log10(x.p)[x.at])]
        columns = (x.ids, x.held, x.lengths, sums[0], np.full(len(x.ids), total), sums[1], sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _SCORES.values(), strict=True)], list(_SCORES))


@dataclass
class Model:
    """A trained model: the folder of its tables level1, level2, ..., and what ``Level`` says of each."""

    path: str
    trained: int
    starts: int
    levels: list[Level]

    def table(self, spark: SparkSession, n: int) -> DataFrame:
        """The rows of level n, in the form of messages: words, or histories with the words after them, and their counts."""
        return spark.read.parquet(f"{self.path}/level{n}").where(f"block = {STORED}").select(*(_WORDS if n == 1 else _GRAMS))


def _join_said(blocks: DataFrame, said: list[DataFrame]) -> DataFrame:
    """The blocks with what the shards said of each level, in their order: at most one entry a shard."""
    for n, answers in enumerate(said, 1):
        entry = F.struct("shard", "counts", "numbers", "facts")
        one = answers.where("block >= 0").groupBy("block").agg(F.array_sort(F.collect_list(entry)).alias(f"said{n}"))
        blocks = blocks.join(one, "block", "left")
    return blocks


def _summed(answers: DataFrame, level: Level) -> tuple[Level, dict[int, int]]:
    """The level with the sums of all shards, and the numbers of what is frequent with their counts. One short row a shard."""
    hot: dict[int, int] = {}
    facts = dict.fromkeys(level.split.tolist(), 0.0)
    for r in answers.where("block is null").select("sums", "hot", "hot_counts", "part", "part_facts").toLocalIterator():
        level.distinct += r.sums[0]
        level.total += r.sums[1]
        level.of = [a + b for a, b in zip(level.of, r.sums[2:], strict=True)]
        hot |= dict(zip(r.hot or [], r.hot_counts or [], strict=True))
        for h, f in zip(r.part or [], np.reshape(r.part_facts or [], (-1, K + 2)), strict=True):
            facts[h] = facts[h] + f
    if facts:
        level.facts = np.stack([np.broadcast_to(f, K + 2) for f in facts.values()])
    return level, hot


def katz(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held=None, order: int = ORDER, keep: str | None = None, model: Model | None = None) -> DataFrame:
    """A row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held``: a Column, true for documents to score but not to learn from; by default those ``held_out``. ``keep``: a
    folder for the model's tables, which ``load`` finds again. ``model``: score by this one and learn nothing.
    """
    spark = docs.sparkSession
    scratch, buckets = Scratch(spark, "katz"), shuffle_partitions(spark)
    out = F.lit(True) if model else held_out(id_col) if held is None else F.coalesce(held, F.lit(False))
    # bucketed by block, so joining the answers moves only them
    name = "blocks_" + scratch.root.rsplit("-", 1)[1]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), out.alias("held")).mapInArrow(lambda b, full=BLOCK: _blocks(b, full), _ddl(_BLOCKS))
    rows.write.bucketBy(buckets, "block").option("path", f"{scratch.root}/blocks").saveAsTable(name)
    blocks = spark.table(name)
    try:
        size, trained, starts = (x or 0 for x in blocks.agg(F.sum("size"), F.sum("trained"), F.sum("starts")).first())
        if model:
            trained, starts, order = model.trained, model.starts, len(model.levels)
        shards = model.levels[0].shards if model else max(buckets, -(-size // SHARD))
        share, store = trained / shards, keep is not None and model is None
        deal = lambda sent: sent.repartition(shards, "shard").sortWithinPartitions("shard", "block")
        at = keep if store else scratch.root

        def save(answers: DataFrame, n: int) -> DataFrame:
            answers.write.parquet(f"{at}/level{n}")
            return spark.read.schema(_ddl(_ANSWER)).parquet(f"{at}/level{n}")

        sent = blocks.select("block", "words", "counts").mapInArrow(lambda b: _send_words(b, shards), _ddl(_WORDS))
        if model:
            sent = sent.unionByName(model.table(spark, 1))
        said = [save(deal(sent).mapInArrow(lambda b: _sum_words(b, shards, share, store), _ddl(_ANSWER)), 1)]
        level, hot = _summed(said[0], Level(shards))
        levels, hot = [level], hot | ({START: starts} if starts > share else {})
        for n in range(2, order + 1):
            level = Level(shards)
            if hot:
                level.split = np.array(sorted(hot), np.uint64)
                level.over = np.array([-(-hot[h] // max(share, 1)) for h in sorted(hot)], np.uint64)
            if model:
                level.split, level.over = model.levels[n - 1].split, model.levels[n - 1].over
            sent = _join_said(blocks, said).mapInArrow(lambda b, below=list(levels), level=level: _send_grams(b, below, level), _ddl(_GRAMS))
            if model:
                sent = sent.unionByName(model.table(spark, n))
            said.append(save(deal(sent).mapInArrow(lambda b, level=level, words=levels[0] if n == 2 else None, last=n == order: _sum_grams(b, level, words, share, store, last), _ddl(_ANSWER)), n))
            level, hot = _summed(said[-1], level)
            levels.append(level)
        if store:
            _save(spark, Model(keep, trained, starts, levels))
        scores = scratch.save(_join_said(blocks, said).mapInArrow(lambda b: _score(b, levels), _ddl(_SCORES)), "scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    scratch.drop("blocks", *(f"level{n}" for n in range(1, order + 1)))
    return scores.withColumnRenamed("id", id_col)


def fit(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> Model:
    """A model of all these documents, its tables below ``path``."""
    katz(docs, id_col, text_col, F.lit(False), order, path)
    return load(docs.sparkSession, path)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents scored by a stored model; all count as held out."""
    return katz(docs, id_col, text_col, model=model)


def _save(spark: SparkSession, model: Model) -> None:
    said = {"trained": model.trained, "starts": model.starts, "levels": [{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(x).items()} for x in model.levels]}
    spark.createDataFrame([(json.dumps(said),)], "model string").coalesce(1).write.text(f"{model.path}/model")


def load(spark: SparkSession, path: str) -> Model:
    said = json.loads(spark.read.text(f"{path}/model").first()[0])
    levels = [Level(x["shards"], np.array(x["split"], np.uint64), np.array(x["over"], np.uint64), np.array(x["facts"]).reshape(-1, K + 2), x["distinct"], x["total"], x["of"]) for x in said["levels"]]
    return Model(path, said["trained"], said["starts"], levels)
