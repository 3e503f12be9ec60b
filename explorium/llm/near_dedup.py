"""Near-duplicate detection by b-bit MinHash.

A document's set holds the hashes of its five-word shingles. Documents with equal sets form a class and one of them,
the one with the least id, stands for it from then on. Of its set, 128 minima give 32 band keys of four minima each
(a pair of similarity 0.75 shares none with probability 5e-6) and, cut to their four low bits, a packed signature of
64 bytes. Within a band bucket pairs are compared by counting equal nibbles, corrected for chance collisions; a pair
whose estimate reaches ``CUT`` (4.2 standard deviations below 0.75) is confirmed on the full sets.

Only what is linked matters for components, so pairs inside a bucket are never all emitted. In a first round each
member names its most similar earlier member of the bucket; the confirmed links give components. The second round
takes every pair above the cut that lies in different components, in the first band that the two share. It first finds
which members have such a pair in which bucket; only these bring their full sets there, the pairs are confirmed where
they meet, and one link for two components comes out. So the components are those of all pairs above the cut, and what
is written grows with the members of buckets, not with their pairs. Buckets of over ``BLOCK`` members are dealt out in
blocks; the second round takes each pair of blocks, so no task ever holds a whole hot bucket.

Null and empty texts are linked with nothing. A node is a class, whatever ids its documents have, so
rows that repeat an id with other texts are linked each by its own text. Extra columns are not read. Empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .components import connected_components

SHINGLE, HASHES, ROWS, BITS, CUT, BLOCK = 5, 128, 4, 4, 0.58, 1024

_rng = np.random.default_rng(20_240_601)
_MULT = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64(0x1111111111111111)


class _Words(dict):
    """Hash of a word, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None, known: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text in UTF-8."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        return _mixed(np.array([(h * _PLACE[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
    n = len(h) - SHINGLE + 1
    s = h[:n] * _PLACE[0]
    for k in range(1, SHINGLE):
        s += h[k : k + n] * _PLACE[k]
    return np.unique(_mixed(s))


def minima(s: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(least, (s[at : at + 1024][:, None] * _MULT[None, :]).min(axis=0), out=least)
    return least


def signature(m: np.ndarray) -> bytes:
    """Four bits of each minimum, two minima to a byte. Minima are small numbers with mixed-up low ends; mixing them once more makes any four bits as good as the lowest."""
    low = ((_mixed(m) >> np.uint64(20)) & np.uint64(2**BITS - 1)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).tobytes()


def bands(m: np.ndarray) -> np.ndarray:
    r = _mixed(m).reshape(-1, ROWS)
    key = np.arange(len(r), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = _mixed(key + r[:, k])
    return key.view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for b in batches:
        texts = b.column(1).cast(pa.large_string()).cast(pa.large_binary())
        for at in range(0, len(texts), 512):
            count, whole, packed, keys = [], [], [], []
            for t in texts.slice(at, 512):
                s = shingles(t.as_py(), known)
                count.append(len(s))
                whole.append(xxhash.xxh3_128_digest(s.tobytes()))
                m = minima(s) if len(s) else None
                packed.append(signature(m) if len(s) else None)
                keys.append(bands(m) if len(s) else None)
            own = [b.column(0).slice(at, 512), b.column(2).slice(at, 512)]
            made = [pa.array(count, pa.int64()), pa.array(whole, pa.binary()), pa.array(packed, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(own + made, ["id", "row", "n", "whole", "packed", "bands"])
    pa.default_memory_pool().release_unused()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for b in batches:
        texts = b.column(1).cast(pa.large_string()).cast(pa.large_binary())
        for at in range(0, len(texts), 512):
            s = [shingles(t.as_py(), known).tobytes() for t in texts.slice(at, 512)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 512), pa.array(map(xxhash.xxh3_128_digest, s), pa.binary()), pa.array(s, pa.binary())], ["id", "whole", "s"])
    pa.default_memory_pool().release_unused()


def estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity by row of two arrays of packed signatures (n x 8 of 64 bits), corrected for chance collisions."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    same = HASHES - np.bitwise_count(d & _LOW).sum(axis=1, dtype=np.int64)
    chance = 2.0**-BITS
    return (same / HASHES - chance) / (1 - chance)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by key and task, in tables of some thousand rows that hold whole groups."""
    held: pa.Table | None = None
    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if held.num_rows < 4 * BLOCK and held.nbytes < 1 << 23:
            continue
        key, task = held.column("key").to_numpy(), held.column("task").to_numpy()
        ends = np.flatnonzero((key[1:] != key[:-1]) | (task[1:] != task[:-1]))
        if len(ends):
            yield held.slice(0, ends[-1] + 1)
            held = held.slice(ends[-1] + 1)
    if held is not None and held.num_rows:
        yield held
    held = None
    pa.default_memory_pool().release_unused()  # the process goes on to other tasks


class _Rows:
    """A table of whole groups as arrays."""

    def __init__(self, rows: pa.Table):
        self.key, self.task, self.side, self.band, self.id, self.comp, self.n = (rows.column(c).to_numpy() for c in ("key", "task", "side", "band", "id", "comp", "n"))
        new = (self.key[1:] != self.key[:-1]) | (self.task[1:] != self.task[:-1])
        self.group = np.concatenate([[0], np.cumsum(new)])
        self.sig = np.frombuffer(b"".join(rows.column("packed").to_pylist()), np.uint64).reshape(len(self.id), -1)
        if "bands" in rows.column_names:
            self.bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(self.id), -1)

    def pairs(self, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """First and second member and estimate of pairs above the cut that are apart; every: those of their first common band."""
        left, d = np.arange(len(self.id)), 0
        while True:
            d += 1
            left = left[left + d < len(self.id)]
            left = left[self.group[left] == self.group[left + d]]
            if not len(left):
                return
            i, j = left, left + d
            fit = (self.comp[i] != self.comp[j]) & ((self.side[i] | self.side[j]) == 3) & (self.id[i] != self.id[j])
            fit &= 4 * np.minimum(self.n[i], self.n[j]) >= 3 * np.maximum(self.n[i], self.n[j])
            i, j = i[fit], j[fit]
            for at in range(0, len(i), 65_536):
                a, b = i[at : at + 65_536], j[at : at + 65_536]
                e = estimates(self.sig[a], self.sig[b])
                a, b, e = a[e >= CUT], b[e >= CUT], e[e >= CUT]
                if every and len(a):
                    first = (self.bands[a] == self.bands[b]).argmax(axis=1) == self.band[a]
                    a, b, e = a[first], b[first], e[first]
                if len(a):
                    yield a, b, e


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's most similar earlier row of its group, as a pair of ids."""
    for rows in map(_Rows, _grouped(batches)):
        best, partner = np.full(len(rows.id), -1.0), np.full(len(rows.id), -1)
        for a, b, e in rows.pairs(False):  # within one of these a row is second once at most
            better = e > best[b]
            best[b[better]], partner[b[better]] = e[better], a[better]
        b = np.flatnonzero(partner >= 0)
        x, y = rows.id[partner[b]], rows.id[b]
        found = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that are in a pair to be confirmed."""
    for table in _grouped(batches):
        rows = _Rows(table)
        wanted = np.zeros(len(rows.id), bool)
        for a, b, _ in rows.pairs(True):
            wanted[a] = wanted[b] = True
        yield from table.filter(pa.array(wanted)).combine_chunks().to_batches()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of these rows whose sets are similar enough: one for each two components of a group."""
    for table in _grouped(batches):
        rows, found = _Rows(table), {}
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("s")]
        for a, b, _ in rows.pairs(True):
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                two = (rows.group[i], *sorted((rows.comp[i], rows.comp[j])))
                if two not in found and similar(sets[i], sets[j]):
                    found[two] = (rows.id[i], rows.id[j])
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.int64())], ["a", "b"])


ROWS_OUT = "key long, task long, side long, band long, id long, comp long, n long, packed binary, bands array<bigint>"


def _dealt(groups: DataFrame, nodes: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The rows of band buckets, sorted within their groups. groups: key, band, id, members of each bucket of two or more; comps: those of the first round, for the second."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = groups.withColumn("block", F.pmod(F.xxhash64("id", "key"), blocks).cast("int"))
    if comps is None:
        rows = rows.withColumns({"comp": F.col("id"), "task": F.col("block").cast("long"), "side": F.lit(3).cast("long")})
        rows = rows.join(nodes.select("id", "n", "packed"), "id")
    else:
        rows = rows.join(comps, rows["id"] == comps["node"], "left").withColumn("comp", F.coalesce("component", "id")).drop("node", "component")
        mixed = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
        rows = rows.join(mixed, "key", "left_semi").join(nodes.select("id", "n", "packed", "bands"), "id")
        # tasks (i, j), i <= j; side: 1 from block i, 2 from block j, 3 within a block
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        rows = rows.withColumn("task", F.least("block", "other") * F.lit(1 << 31).cast("long") + F.greatest("block", "other"))
        rows = rows.withColumn("side", F.when(F.col("block") == F.col("other"), 3).when(F.col("block") < F.col("other"), 1).otherwise(2).cast("long"))
    return _sorted(rows.select("key", "task", "side", "band", "id", "comp", "n", "packed", *(["bands"] if comps is not None else [])))


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "task").sortWithinPartitions("key", "task", "id")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 75 * (len(x) + len(y) - both)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in two)) for two in zip(b.column(2), b.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _linked(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """From id, text, row: the members (doc, row, n, and number id and least id rep of their class), and of each linked class its component and the least id in it.

    A class with an id comes before one without. Empty texts have no class.
    """
    seen = scratch.save(texts.mapInArrow(_features, "id long, row string, n long, whole binary, packed binary, bands array<bigint>"), "features")
    # rows of a class have the same set, so any row's features do
    classes = seen.where("n > 0").groupBy("whole").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "packed", "bands")])
    # the number of a class, rising with its least id; written, so it stays
    nodes = classes.orderBy(F.col("rep").asc_nulls_last(), "whole").withColumn("id", F.monotonically_increasing_id())
    nodes = scratch.save(nodes, "nodes")
    members = seen.where("n > 0").select(F.col("id").alias("doc"), "row", "n", "whole").join(nodes.select("whole", "id", "rep"), "whole").drop("whole")
    none = F.lit(None).cast("long")
    members = scratch.save(members.unionByName(seen.where("n = 0").select(F.col("id").alias("doc"), "row", "n", none.alias("id"), none.alias("rep"))), "members")
    keys = nodes.select("id", F.posexplode("bands").alias("band", "key")).withColumn("band", F.col("band").cast("long"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    groups = scratch.save(keys.join(shared, "key"), "groups")
    wanted = nodes.join(groups.select("id").distinct(), "id", "left_semi").select(F.col("rep").alias("id"), "whole", F.col("id").alias("node"))
    # an id that stands for a class that shares a bucket; a text is read again only for such ids
    rows = texts.join(wanted.select(F.col("id").alias("rep")).distinct(), F.col("id").eqNullSafe(F.col("rep")), "left_semi").select("id", "text").distinct()
    sets = rows.mapInArrow(_sets, "id long, whole binary, s binary").select("whole", "s").dropDuplicates(["whole"])
    sets = scratch.save(sets.join(wanted, "whole").select(F.col("node").alias("id"), "s"), "sets")
    pairs = _dealt(groups, nodes, None).mapInArrow(_nearest, "a long, b long").distinct()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    links = scratch.save(both.select("a", "b", "x", "y").mapInArrow(_confirmed, "a long, b long"), "first")
    comps = connected_components(links, scratch, "half")
    meeting = _dealt(groups, nodes, comps).mapInArrow(_meeting, ROWS_OUT)
    met = _sorted(meeting.join(sets, "id")).mapInArrow(_met, "a long, b long")
    more = scratch.save(met, "second")
    comps = connected_components(links.union(more), scratch, "full")
    return members, comps.join(nodes.select(F.col("id").alias("component"), F.col("rep").alias("least")), "component")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id (a whole number), n_shingles, component_id, kept.

    A null id has a null component, links nothing and is kept. The component is named by its least id. Of rows that
    repeat an id with other texts, each has the component of its own text.
    """
    scratch = Scratch(docs.sparkSession, "near")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("row"))
    members, comps = _linked(texts.where("id is not null"), scratch)
    out = members.join(comps, members["id"] == comps["node"], "left").select("doc", "n", F.coalesce("least", "rep", "doc").alias("component_id"))
    none = texts.where("id is null").mapInArrow(_features, "id long, row string, n long, whole binary, packed binary, bands array<bigint>")
    out = out.unionByName(none.select(F.col("id").alias("doc"), "n", F.lit(None).cast("long").alias("component_id")))
    out = out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _row_key(id_col: str, text_col: str):
    """A row by its id and text, whatever else it has."""
    return F.concat(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), F.coalesce(F.concat(F.lit(":"), F.col(id_col).cast("string")), F.lit("")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which none earlier is a near duplicate, with their own columns: one row of each component.

    That row has the component's least id, null ids coming last. Rows without words are linked with nothing and stay;
    rows equal in id and text count once.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "keep")
    rows = docs.withColumn("__row", _row_key(id_col, text_col))
    members, comps = _linked(rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col("__row").alias("row")), scratch)
    first = members.where("id is not null").groupBy("id").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("row")).select("id", "row.row")
    first = first.join(comps.where("node <> component").select(F.col("node").alias("id")), "id", "left_anti")
    kept = first.select("row").union(members.where("id is null").select("row")).distinct().select(F.col("row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
