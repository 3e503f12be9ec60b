"""Benchmark passages in documents, by Wu-Manber search for many strings at once.

Texts are cut into words, which one space joins, with a space at either end; so a window of words occurs in a document
where its string occurs. Windows are searched in classes of like length. A class looks at blocks of B bytes that end
where its shortest window would end: the shift table says how far the next possible end is, the full length for a
block that no window has. A shift of 0 leads to the bucket of windows with that suffix, its windows with the text's
own prefix are compared, and what is equal occurs.

The windows are the queries. They are cut in the engine, made distinct, and searched ``TABLE`` bytes at a time: with
more, documents are numbered and written once, read by each pass, and their hits joined by number. Documents are
never shuffled else.

Null and empty texts have no words, nor has a text of separators alone. An item without words has no window. Items
that repeat an id are named once; the windows of an item without an id count as hits but name no item. Rows that
repeat a document are told each by its own text. Empty tables give no rows, or rows without hits; other columns are
not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Words of a window; bytes of windows in one pass's tables, a bound on what is broadcast.
WINDOW, TABLE = 10, 8 << 20

#: Words are runs of digits, letters a to z and all bytes from 128 on; A to Z count as a to z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class WuManber:
    """Finds all occurrences of distinct byte strings."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.number = {s: k for k, s in enumerate(strings)}
        classes: dict[int, list[bytes]] = {}
        for s in strings:
            classes.setdefault(len(s).bit_length(), []).append(s)
        self.tables = [self._table(own) for own in classes.values()]

    @staticmethod
    def _table(strings: list[bytes]) -> tuple:
        m = min(map(len, strings))
        bytes_seen = Counter(b"".join(strings))
        total = sum(bytes_seen.values())
        entropy = max(1.0, -sum(n / total * math.log2(n / total) for n in bytes_seen.values()))
        b = max(1, min(m, math.ceil(1.5 * math.log2(2 * m * len(strings)) / entropy)))  # longer than a chance block of the strings
        shift: dict[bytes, int] = {}
        buckets: dict[bytes, dict[bytes, set[int]]] = {}
        for s in strings:
            for end in range(b, m + 1):
                block = s[end - b : end]
                if m - end < shift.get(block, m):
                    shift[block] = m - end
            buckets.setdefault(s[m - b : m], {}).setdefault(s[:m], set()).add(len(s))
        return m, b, shift, buckets

    def find(self, text: bytes) -> list[tuple[int, int]]:
        """(start, number of the string) of every occurrence."""
        out, n, number = [], len(text), self.number
        for m, b, shift, buckets in self.tables:
            get, far, end = shift.get, m - b + 1, m
            while end <= n:
                if step := get(text[end - b : end], far):
                    end += step
                    continue
                start = end - m
                for length in buckets[text[end - b : end]].get(text[start:end], ()):
                    if start + length <= n and (k := number.get(text[start : start + length])) is not None:
                        out.append((start, k))
                end += 1
        return out


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for item, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            w = words(text.as_py())
            for at in range(0, max(1, len(w) - size + 1) if w else 0, 10_000):
                part = [b" %s " % b" ".join(w[k : k + size]) for k in range(at, min(at + 10_000, max(1, len(w) - size + 1)))]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(part, pa.binary())], ["item", "window"])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


_engines: dict[int, tuple[WuManber, list[list[str]]]] = {}


def _engine(shared) -> tuple[WuManber, list[list[str]]]:
    key, found = shared.value
    if key not in _engines:
        _engines.clear()
        _engines[key] = WuManber(list(found)), list(found.values())
    return _engines[key]


def _searched(batches: Iterator[pa.RecordBatch], shared, all_rows: bool) -> Iterator[pa.RecordBatch]:
    """Key columns in; these with n_words, spans (first word, word after the last) and items out."""
    engine, items = _engine(shared)
    for b in batches:
        keep, n_words, spans, named = [], [], [], []
        for i, text in enumerate(b.column(b.num_columns - 1)):
            w = words(text.as_py())
            joined = b" %s " % b" ".join(w) if w else b""
            hits = engine.find(joined)
            if not hits and not all_rows:
                continue
            keep.append(i)
            n_words.append(len(w))
            if hits:
                gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
                first = np.searchsorted(gaps, [start for start, _ in hits]).tolist()
                spans.append([{"a": a, "b": a + engine.strings[k].count(b" ") - 1} for a, (_, k) in zip(first, hits, strict=True)])
                spans[-1] = [{"a": a, "b": z} for a, z in _merged([(s["a"], s["b"]) for s in spans[-1]])]
                named.append(sorted({x for k in {k for _, k in hits} for x in items[k]}))
            else:
                spans.append([])
                named.append([])
        at = pa.array(keep, pa.int64())
        cols = [b.column(c).take(at) for c in range(b.num_columns - 1)]
        names = b.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(named, pa.list_(pa.string()))], [*names, "n_words", "spans", "items"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", table: int = TABLE, with_spans: bool = False) -> DataFrame:
    """A row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated; with_spans adds spans of hit words and the items."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "windows")
    cut = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text"))
    cut = scratch.save(cut.mapInArrow(lambda b: _windows(b, window), "item string, window binary").distinct(), "windows")
    size = cut.agg(F.sum(F.octet_length("window"))).first()[0] or 0
    passes = max(1, -(-size // table))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind, keys = rows.schema["id"].dataType.simpleString(), ["id"]
    if passes > 1:
        rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "text"), "documents")
        keys = ["row", "id"]
    schema = ", ".join((["row long"] if passes > 1 else []) + [f"id {kind}", "n_words long", "spans array<struct<a: int, b: int>>", "items array<string>"])
    found = None
    for k in range(passes):
        part: dict[bytes, list[str]] = {}
        for r in cut.where(F.pmod(F.xxhash64("window", "item"), F.lit(passes)) == k).toLocalIterator():
            part.setdefault(bytes(r.window), []).extend([] if r.item is None else [r.item])
        shared = spark.sparkContext.broadcast((f"{scratch.root}-{k}", part))
        one = rows.select(*keys, "text").mapInArrow(lambda b, shared=shared, k=k: _searched(b, shared, k == 0), schema)
        if passes > 1:
            one = scratch.save(one, f"found{k}")
        found = one if found is None else found.unionByName(one)
    if passes > 1:
        found = found.groupBy("row").agg(F.max_by("id", "n_words").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    counted = F.aggregate(F.array_sort("spans"), start, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")))
    named = F.array_sort(F.array_distinct("items"))
    out = found.select(F.col("id").alias(id_col), "n_words", counted["n"].cast("long").alias("n_hit"), F.size(named).cast("long").alias("n_items"), F.sha2(F.array_join(named, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
                       *([F.array_sort("spans").alias("spans"), named.alias("items")] if with_spans else []))
    return out
