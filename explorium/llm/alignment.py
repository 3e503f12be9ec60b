"""Groups and links between the tokens of two tokenizers over the same bytes.

A is a byte-level vocabulary, B a piece model; both see a space and the text. Each token list has a dictionary from the
byte offset where a token ends to its index. The intersection of the two key sets, sorted, slices both lists into
groups. Within a group no inner end is shared, so walking both slices by their ends gives all overlapping pairs.

Neither tokenizer joins bytes across a space, tab or line end that follows a character other than white space: A's
split pattern cuts there, and no piece of B has a space after another character, or a tab or line end at all (checked
when the model is read; otherwise texts are aligned whole). Both end a token there, so a text is aligned stretch by
stretch, and a worker remembers the stretches it has met. One that it hasn't is cut once more before closing signs
after a letter, where A's pattern cuts too, unless a piece of B has that letter and sign; what is new is then encoded.

A document keeps its distinct pairs of ids with their numbers of links, in a written table. From it come the number of
documents that hold a pair, and, for each document, sums over its links. Counts of up to ``PAIRS`` pairs are broadcast;
more are joined by pair, salted as common pairs are in most documents. Both ways give the same rows.

Texts that are null or empty, or whose joined token bytes of A or B differ from space and text (such as those that hold
U+2581), have no tokens: zeros and an empty string in place of a digest. Rows that repeat a document count each.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, Vocabulary, _portions, splitter
from .common import Scratch

#: Pairs whose counts are broadcast, at 13 bytes each; characters of stretches (and 40 for each) that a worker remembers, twice; parts of a common pair's join.
PAIRS, REMEMBERED, SALT = 4_000_000, 8_000_000, 32

#: A space, tab or line end and what follows it, up to the next one after a character other than white space.
STRETCH = re.compile(r"[ \n\t]\s*(?:\S+|[^\S \n\t]\s*)*")
#: The signs of ASCII.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def align(a: list[int], a_sizes: list[int], b: list[int], b_sizes: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[int]]:
    """Groups, as slices of both id lists, and links, each as a << 32 | b. Sizes are bytes a token; both sum to the same."""
    a_all, b_all = list(accumulate(a_sizes)), list(accumulate(b_sizes))
    a_index, b_index = dict(zip(a_all, range(len(a)), strict=True)), dict(zip(b_all, range(len(b)), strict=True))
    groups, links, i, j = [], [], 0, 0
    for end in sorted(a_index.keys() & b_index.keys()):
        i_end, j_end = a_index[end] + 1, b_index[end] + 1
        groups.append((a[i:i_end], b[j:j_end]))
        while i < i_end:  # whichever token ends first makes way for its successor
            links.append(a[i] << 32 | b[j])
            step = a_all[i] - b_all[j]
            i, j = i + (step <= 0), j + (step >= 0)
    return groups, links


class Pair:
    """Both tokenizers, and what the stretches met so far give."""

    def __init__(self, a_path: str, b_path: str):
        vocabulary = Vocabulary(a_path)
        special = set(vocabulary.special.values())
        ranks = {raw: i for raw, i in vocabulary.ids.items() if i not in special}
        merged = [vocabulary.ids[x + y] for x, y in vocabulary.ranks]
        #: Where merges are numbered in their order, ids are ranks.
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"), mergeable_ranks=ranks, special_tokens={}) if merged == sorted(merged) else None
        self.vocabulary, self.split = vocabulary, splitter() if self.fast is None else None
        self.a_bytes = vocabulary.bytes
        self.names = [str(k) for k in range(max(*self.a_bytes, len(vocabulary.bytes), 1 << 16) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_size = {k: len(x) for k, x in self.a_bytes.items()}
        self.b_size = [len(x) for x in self.b_bytes]
        self.gap = self.b.piece_to_id("▁")
        self.cuts = not any(re.search("[^▁]▁|[\\n\\t]", p) for p in pieces)
        self.within = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.line_end = [self.gap, self.b_bytes.index(b"\n")]
        self.known: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}
        self.held = 0

    def encode_a(self, text: str) -> list[int]:
        if self.fast is not None:
            return self.fast.encode_ordinary(text)
        return [i for p in self.split(text) for i in self.vocabulary.merge(p.encode())]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """A space that starts a text is the one which the model adds itself. Others stand behind a line end, which no piece holds, and its ids are dropped."""
        spaced = [t[:1] == " " for t in texts]
        ids = self.b.encode([t[1:] if s else "\n" + t for s, t in zip(spaced, texts, strict=True)], num_threads=1)
        return [i or [self.gap] if s else i[len(self.line_end) :] for s, i in zip(spaced, ids, strict=True)]

    def cut(self, text: str) -> list[str]:
        return STRETCH.findall(text) if self.cuts else [text]

    def cut_again(self, stretch: str) -> tuple[str, str]:
        """What stands before closing signs, and these; all and nothing where a token might hold both."""
        head = stretch.rstrip(SIGNS)
        if self.cuts and len(head) < len(stretch) and head[-1:].isalpha() and stretch[len(head) - 1 : len(head) + 1] not in self.within:
            return head, stretch[len(head) :]
        return stretch, ""

    def _recalled(self, stretches: set[str]) -> list[str]:
        """Those that aren't known; what the time before knew is known again."""
        new, known, before = [], self.known, self.before
        for s in stretches:
            if s not in known:
                if s in before:
                    known[s] = before[s]
                    self.held += 40 + len(s)
                else:
                    new.append(s)
        return new

    def learn(self, stretches: set[str]) -> None:
        """Afterwards ``known`` has n_a, n_b, n_groups, n_links, groups as text and links as 64-bit numbers of each stretch; None for one that the tokens don't spell."""
        if self.held > REMEMBERED:  # what is met again before the next time stays
            self.known, self.before, self.held = {}, self.known, 0
        known = self.known
        new = {s: self.cut_again(s) for s in self._recalled(stretches)}
        parts = self._recalled({p for pair in new.values() for p in pair if p})
        names, a_size, b_size, a_bytes, b_bytes = self.names, self.a_size.__getitem__, self.b_size.__getitem__, self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for s, b in zip(parts, self.encode_b(parts), strict=True):
            a, raw = self.encode_a(s), s.encode()
            got = None
            if b"".join(map(a_bytes, a)) == raw == b"".join(map(b_bytes, b)):
                if len(a) == len(b) == 1:
                    got = 1, 1, 1, 1, f"{a[0]}|{b[0]}", array("q", [a[0] << 32 | b[0]]).tobytes()
                else:
                    groups, links = align(a, list(map(a_size, a)), b, list(map(b_size, b)))
                    said = ";".join([f"{names[x[0]]}|{names[y[0]]}" if len(x) == len(y) == 1 else ",".join([names[t] for t in x]) + "|" + ",".join([names[t] for t in y]) for x, y in groups])
                    got = len(a), len(b), len(groups), len(links), said, array("q", links).tobytes()
            known[s] = got
            self.held += 40 + len(s)
        for s, (head, tail) in new.items():
            if tail:
                one, two = known[head], known[tail]
                known[s] = one and two and (one[0] + two[0], one[1] + two[1], one[2] + two[2], one[3] + two[3], f"{one[4]};{two[4]}", one[5] + two[5])
                self.held += 40 + len(s)


_pairs: dict[tuple[str, str], Pair] = {}


def _pair(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _pairs:
        _pairs.clear()
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return _pairs[a_path, b_path]


_NAMES = ["n_a", "n_b", "n_groups", "n_links"]


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(values) if values else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat, pa.int32()))


def _aligned(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    pair = _pair(a_path, b_path)
    gc.freeze()  # what the worker holds has no cycles; else each collection walks all of it
    for batch in batches:
        for at, texts in _portions(batch.column(1), 1 << 20):
            cut = [pair.cut(" " + t) if t else [] for t in texts]
            pair.learn(set().union(*cut))
            numbers, digests, a, b, times = [], [], [], [], []
            for stretches in cut:
                got = list(map(pair.known.__getitem__, stretches))
                if not got or None in got:
                    numbers.append((0, 0, 0, 0))
                    digests.append("")
                    links = b""
                else:
                    *sums, said, pairs = zip(*got, strict=True)
                    numbers.append(tuple(map(sum, sums)))
                    digests.append(hashlib.sha256(";".join(said).encode()).hexdigest())
                    links = b"".join(pairs)
                keys, n = np.unique(np.frombuffer(links, np.int64), return_counts=True)
                a.append((keys >> 32).astype(np.int32))
                b.append((keys & 0xFFFFFFFF).astype(np.int32))
                times.append(n.astype(np.int32))
            columns = [pa.array(x, pa.int64()) for x in zip(*numbers, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns, pa.array(digests, pa.string()), _lists(a), _lists(b), _lists(times)], ["id", *_NAMES, "groups_sha256", "a", "b", "times"])


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(b.column(c).to_numpy(), np.int64).tobytes()], pa.binary()) for c in range(b.num_columns)], b.schema.names)


def _looked_up(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    keys, counts, best = shared.value
    for b in batches:
        a, other, times = (b.column(b.schema.get_field_index(c)) for c in ("a", "b", "times"))
        ends = np.concatenate([[0], np.cumsum(np.diff(a.offsets.to_numpy()))])
        pair = a.flatten().to_numpy().astype(np.int64) << 32 | other.flatten().to_numpy().astype(np.int64)
        at, n = np.searchsorted(keys, pair), times.flatten().to_numpy().astype(np.int64)
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (n * best[at], n * counts[at])]
        cols = [b.column(c) for c in range(len(_NAMES) + 2)]
        yield pa.RecordBatch.from_arrays([*cols, *(pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums)], [*b.schema.names[: len(cols)], "n_best", "count_sum"])


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", broadcast: int = PAIRS) -> DataFrame:
    """A row for each document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    told = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    rows = scratch.save(rows.mapInArrow(lambda x: _aligned(x, a_path, b_path), f"{told}, a array<int>, b array<int>, times array<int>"), "documents")
    counts = rows.select(F.explode(F.arrays_zip("a", "b")).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("count"))
    counts = scratch.save(counts, "counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    counts = counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    if spark.read.parquet(f"{scratch.root}/counts").count() <= broadcast:
        packed = counts.select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "count", "best").mapInArrow(_as_bytes, "pair binary, count binary, best binary")
        parts = [[np.frombuffer(x, np.int64) for x in r] for r in packed.toLocalIterator()]
        pair, count, best = (np.concatenate([p[c] for p in parts] or [np.empty(0, np.int64)]) for c in range(3))
        order = np.argsort(pair)
        shared = spark.sparkContext.broadcast((pair[order], count[order].astype(np.int32 if count.max(initial=0) < 1 << 31 else np.int64), best[order].astype(np.int8)))
        out = rows.mapInArrow(lambda x: _looked_up(x, shared), f"{told}, n_best long, count_sum long")
    else:
        rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
        salt = F.pmod(F.xxhash64("row"), F.lit(SALT))
        links = rows.select("row", salt.alias("salt"), F.explode(F.arrays_zip("a", "b", "times")).alias("l")).select("row", "salt", "l.*")
        spread = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumn("salt", F.col("salt").cast("long"))
        sums = links.join(spread, ["a", "b", "salt"]).groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
        out = rows.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})
    return out.select(F.col("id").alias(id_col), *_NAMES, "n_best", "count_sum", "groups_sha256")
