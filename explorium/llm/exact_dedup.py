"""Exact deduplication over a sharded cuckoo-filter index of live digests.

A shard holds a cuckoo filter over 64-bit prefixes of SHA-256 digests and, in buckets by that prefix, the content
the filter stands for: the whole digest with what is known of its documents. A miss of the filter proves a digest
new; a hit is settled by the whole digests in the bucket. A digest is deleted from both when its last document goes.
When an insertion finds no place the filter doubles and is refilled from the stored keys.

Empty tables give empty results. Null texts count as empty. Null ids sort behind all others. Rows that repeat an id
are separate rows, of which one stays. Columns of the input beyond id and text are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

_DROPPED = b" \t\n\x0b\x0c\r"


class CuckooFilter:
    """Partial-key cuckoo filter: 16-bit fingerprints, four slots a bucket, two buckets a key."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 64):
        self.mask = buckets - 1
        self.table = array("H", bytes(2 * self.SLOTS * buckets))

    @staticmethod
    def _print(key: int) -> int:
        return (key & 0xFFFF) or 1

    def _places(self, key: int) -> tuple[int, int]:
        first = (key >> 16) & self.mask
        return first, first ^ (self._print(key) * 0x5BD1E995 >> 8 & self.mask)

    def __contains__(self, key: int) -> bool:
        mark, (one, two) = self._print(key), self._places(key)
        t = self.table
        return mark in t[4 * one : 4 * one + 4] or mark in t[4 * two : 4 * two + 4]

    def insert(self, key: int) -> bool:
        """False: no place was found. The filter has then lost a print and must be refilled from the keys."""
        t, mark, (one, two) = self.table, self._print(key), self._places(key)
        for at in (one, two):
            for s in range(4 * at, 4 * at + 4):
                if not t[s]:
                    t[s] = mark
                    return True
        at = two
        for kick in range(self.KICKS):
            s = 4 * at + (kick & 3)
            t[s], mark = mark, t[s]
            at ^= mark * 0x5BD1E995 >> 8 & self.mask
            for s in range(4 * at, 4 * at + 4):
                if not t[s]:
                    t[s] = mark
                    return True
        return False

    def delete(self, key: int) -> bool:
        mark = self._print(key)
        for at in self._places(key):
            for s in range(4 * at, 4 * at + 4):
                if self.table[s] == mark:
                    self.table[s] = 0
                    return True
        return False


class DigestIndex:
    """One shard: the filter and the bucketed content, each entry a list that starts with the whole digest."""

    def __init__(self, buckets: int = 64):
        self.filter = CuckooFilter(buckets)
        self.content: dict[int, list[list]] = {}
        self.resized = 0

    def find(self, digest: bytes) -> list | None:
        key = int.from_bytes(digest[:8], "little")
        if key in self.filter:
            for entry in self.content.get(key, ()):
                if entry[0] == digest:
                    return entry
        return None

    def insert(self, entry: list) -> None:
        key = int.from_bytes(entry[0][:8], "little")
        self.content.setdefault(key, []).append(entry)
        if not self.filter.insert(key):
            self._resize()

    def delete(self, digest: bytes) -> bool:
        if (entry := self.find(digest)) is None:
            return False
        key = int.from_bytes(digest[:8], "little")
        self.filter.delete(key)
        self.content[key].remove(entry)
        if not self.content[key]:
            del self.content[key]
        return True

    def _resize(self) -> None:
        """Twice the buckets, or more, until every stored key has a place."""
        buckets = self.filter.mask + 1
        while True:
            buckets *= 2
            self.resized += 1
            self.filter = CuckooFilter(buckets)
            if all(self.filter.insert(key) for key, entries in self.content.items() for _ in entries):
                return

    def __iter__(self) -> Iterator[list]:
        for entries in self.content.values():
            yield from entries


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for b in batches:
        text = b.column(1).cast(pa.large_string())
        raw = text.cast(pa.large_binary()).to_pylist()
        out = [hashlib.sha256((t or b"").translate(None, _DROPPED)).digest() for t in raw]
        length = pc.fill_null(pc.utf8_length(text), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(range(row, row + len(out)), pa.int64()), pa.array(out, pa.binary()), length], ["id", "row", "digest", "n"])
        row += len(out)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row (a number of its own), digest of the text without white space, n (code points of the text).

    Save the result before using it twice: row numbers follow the partitions.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_digests, f"id {kind}, row long, digest binary, n long")


def _better(x: list, y: list) -> bool:
    """Whether entry x's document stays before y's. An entry: digest, n, id, row, documents."""
    if x[1] != y[1]:
        return x[1] > y[1]
    if x[2] != y[2]:
        return y[2] is None or x[2] is not None and x[2] < y[2]
    return x[3] < y[3]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries or single documents in, one entry for each digest out, through the index of this task's shard."""
    index, schema = DigestIndex(), None
    for b in batches:
        schema = b.schema
        for new in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (old := index.find(new[0])) is None:
                index.insert(list(new))
            else:
                count = old[4] + new[4]
                if _better(new, old):
                    old[1:4] = new[1:4]
                old[4] = count
    if schema is not None:
        rows = list(index)
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 10_000], strict=True), schema, strict=True)], schema=schema)


def build_index(digested: DataFrame) -> DataFrame:
    """digest, n, id, row (of the document that stays), documents: the index's content, one row a live digest.

    Each task first folds its own rows, so of a digest of any count one row a task is shuffled to the digest's shard.
    """
    one = digested.select("digest", "n", "id", "row", F.lit(1).cast("long").alias("documents"))
    part = one.mapInArrow(_merge, one.schema)
    return part.repartition("digest").mapInArrow(_merge, one.schema)


def _change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored entries, then insertions, then deletions of one shard; ``documents`` of a change is its signed count."""
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    index = DigestIndex()
    for digest, documents in sorted(rows, key=lambda r: r[1] < 0):
        entry = index.find(digest)
        if entry is None and documents > 0:
            index.insert([digest, documents])
        elif entry is not None:
            entry[1] += documents
            if entry[1] <= 0:
                index.delete(digest)
    kept = list(index)
    yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in kept], pa.binary()), pa.array([e[1] for e in kept], pa.int64())], ["digest", "documents"])


def change_index(index: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """The index (digest, documents) after adding and removing digested rows; counts are summed before the shuffle.

    Deleting a digest that isn't live does nothing.
    """
    parts = index.select("digest", "documents")
    for rows, sign in ((inserted, 1), (deleted, -1)):
        if rows is not None:
            parts = parts.union(rows.groupBy("digest").agg((sign * F.count(F.lit(1))).cast("long")))
    return parts.repartition("digest").mapInArrow(_change, "digest binary, documents long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original stays, then the one with the smallest id.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = scratch.save(digests(docs, id_col, text_col), "digests")
    index = build_index(rows).select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("documents").alias("group_size"))
    return rows.join(index, "digest").select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns: one row for each text without white space, whatever its id.

    Rows are told by digest, code points and id together. Of rows that have all three in common any one stays.
    """
    index = build_index(digests(docs, id_col, text_col))
    kept = index.select(_row_key(F.lower(F.hex("digest")), F.col("n"), F.col("id")).alias("__key"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.sha2(F.translate(text, _DROPPED.decode(), "").cast("binary"), 256)
    rows = docs.withColumn("__key", _row_key(own, F.char_length(text), F.col(id_col)))
    return rows.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")


def _row_key(digest, n, key):
    """As text, so that a null id is a value of its own and one join key says all."""
    return F.concat(digest, F.lit(":"), n.cast("string"), F.coalesce(F.concat(F.lit(":"), key.cast("string")), F.lit("")))
