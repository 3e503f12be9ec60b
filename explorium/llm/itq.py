"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned on at most ``SAMPLE`` vectors (those of least seeded hash): centred and turned to principal axes,
then rotated so that the signs lose least, which balances the bits. Every vector gets a code of up to 64 bits, cut
into eight chunks. Each pair of chunks is a table, 28 in all: codes that differ in at most six bits, and nearly all
that differ in eight, agree on two chunks. In a table's bucket the original vectors are compared in double precision;
a pair counts in the first table that holds it. Measured recall against all pairs is in the tests and the README.

Vectors equal in label and bytes form one row with a count, so copies are never compared with each other. Buckets of
over ``BLOCK`` rows are dealt out as pairs of blocks. A bucket returns sums and a forest, never its pairs. Vectors of
different length or label link with nothing, nor do those that are null, zero, or hold null or non-finite components,
nor any with a null label. Rows that repeat an id are separate vectors that share a component. Empty tables give
empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

SAMPLE, BITS, CHUNKS, ROUNDS, BLOCK, LIMIT = 20_000, 64, 8, 40, 512, 0.98


class Quantiser:
    """Mean, projection and chunks for vectors of one length."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = x.shape[1]
        self.bits = min(BITS, d)
        self.mean = x.mean(axis=0)
        v = x - self.mean
        axes = np.linalg.eigh(v.T @ v)[1][:, ::-1][:, : self.bits]
        v = v @ axes
        r = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.bits, self.bits)))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        self.turn = axes @ r
        self.chunks = np.array_split(np.arange(self.bits), min(CHUNKS, self.bits))
        self.tables = list(combinations(range(len(self.chunks)), 2)) or [(0, 0)]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The chunks of each row's code, as numbers."""
        b = ((x / np.linalg.norm(x, axis=1, keepdims=True) - self.mean) @ self.turn) >= 0
        return np.stack([b[:, c] @ (1 << np.arange(len(c), dtype=np.int64)) for c in self.chunks], axis=1)


def _sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, d, v (float64 bytes) and id of vectors that can be compared."""
    for b in batches:
        out = []
        for i, label, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if label is None or not x.is_valid or not len(x.values) or x.values.null_count:
                continue
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(v).all() and v.any() and 0 < np.linalg.norm(v) < np.inf:
                out.append((i, label, len(v), v.tobytes()))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], b.column(1).type), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], ["id", "label", "d", "v"])


def _linked(batches: Iterator[pa.RecordBatch], limit: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group in, (id, links, root) out: links found here and a forest over them."""

    def done(t: pa.Table) -> pa.RecordBatch:
        ids, count, side, d = (t.column(c).to_numpy() for c in ("id", "count", "side", "d"))
        group = np.concatenate([[0], np.cumsum((t.column("bucket").to_numpy()[1:] != t.column("bucket").to_numpy()[:-1]) | (t.column("task").to_numpy()[1:] != t.column("task").to_numpy()[:-1]))])
        one, two = t.column("one").to_numpy(), t.column("two").to_numpy()
        chunks = t.column("code").combine_chunks().flatten().to_numpy().reshape(len(ids), -1) if len(set(d)) == 1 else None
        assert chunks is not None
        x = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(len(ids), -1)
        norm = np.linalg.norm(x, axis=1)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        place = np.arange(chunks.shape[1])
        pairs = []
        left, k = np.arange(len(ids)), 0
        while True:
            k += 1
            left = left[left + k < len(ids)]
            left = left[group[left] == group[left + k]]
            if not len(left):
                break
            i, j = left, left + k
            ok = (side[i] | side[j]) == 3
            i, j = i[ok], j[ok]
            for at in range(0, len(i), 16_384):
                a, b = i[at : at + 16_384], j[at : at + 16_384]
                near = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= limit
                a, b = a[near], b[near]
                earlier = (chunks[a] == chunks[b]) & (place < two[a][:, None]) & (place != one[a][:, None])
                a, b = a[~earlier.any(axis=1)], b[~earlier.any(axis=1)]
                np.add.at(links, a, count[b])
                np.add.at(links, b, count[a])
                pairs.append((a, b))
        a, b = (np.concatenate([p[s] for p in pairs]) if pairs else np.empty(0, np.int64) for s in (0, 1))
        while len(a) and not np.array_equal(root[a], root[b]):
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]])], ["id", "links", "root"])

    held: pa.Table | None = None
    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        d, bucket, task = (held.column(c).to_numpy() for c in ("d", "bucket", "task"))
        ends = np.flatnonzero((d[1:] != d[:-1]) | (bucket[1:] != bucket[:-1]) | (task[1:] != task[:-1])) + 1
        cuts, at = np.flatnonzero(d[1:] != d[:-1]) + 1, 0
        for end in [*cuts.tolist(), ends[-1] if len(ends) and held.num_rows > 4 * BLOCK else 0]:
            if end > at:
                yield done(held.slice(at, end - at))
                at = end
        held = held.slice(at)
    if held is not None and held.num_rows:
        yield done(held)


def near_vectors(vectors: DataFrame, limit: float = LIMIT, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """A row for each vector: id, n_links, component_id, kept. Ids are whole numbers; a null id has a null component and is kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "itq")
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("x"))
    label = given.schema["label"].dataType.simpleString()
    sound = scratch.save(given.where("id is not null").mapInArrow(_sound, f"id long, label {label}, d int, v binary"), "sound")
    same = sound.groupBy("label", "d", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("count"))
    same = scratch.save(same, "classes")
    models = {}
    for (d,) in same.select("d").distinct().toLocalIterator():  # one entry for each length of vector
        picked = same.where(F.col("d") == d).orderBy(F.xxhash64("rep"), "rep").select("v").limit(SAMPLE).toLocalIterator()
        models[d] = Quantiser(np.frombuffer(b"".join(bytes(r.v) for r in picked), np.float64).reshape(-1, d))
    shared = spark.sparkContext.broadcast(models)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code: list = [None] * b.num_rows
            lengths = b.column(1).to_numpy()
            for d in set(lengths.tolist()):
                where = np.flatnonzero(lengths == d)
                x = np.frombuffer(b"".join(b.column(2).take(pa.array(where)).to_pylist()), np.float64).reshape(-1, d)
                for i, c in zip(where, shared.value[d].codes(x), strict=True):
                    code[i] = c
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), b.column(4), pa.array(code, pa.list_(pa.int64()))], ["label", "d", "v", "id", "count", "code"])

    rows = scratch.save(same.select("label", "d", "v", F.col("rep").alias("id"), "count").mapInArrow(coded, f"label {label}, d int, v binary, id long, count long, code array<bigint>"), "coded")
    last = F.size("code") - 1
    pairs = F.when(last < 1, F.array(F.struct(F.lit(0).alias("one"), F.lit(0).alias("two")))).otherwise(
        F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda i: F.transform(F.sequence(i + 1, last), lambda j: F.struct(i.alias("one"), j.alias("two"))))))
    keys = rows.select("id", "label", "d", "code", F.explode(pairs).alias("t"))
    keys = keys.select("id", "d", F.col("t.one").cast("long").alias("one"), F.col("t.two").cast("long").alias("two"),
                       F.xxhash64("label", "d", "t", F.element_at("code", F.col("t.one") + 1), F.element_at("code", F.col("t.two") + 1)).alias("bucket"))
    full = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    keys = keys.join(full, "bucket")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    keys = keys.withColumn("block", F.pmod(F.xxhash64("id", "bucket"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keys = keys.select("bucket", "one", "two", "id", (F.least("block", "other") * F.lit(1 << 31).cast("long") + F.greatest("block", "other")).alias("task"),
                       F.when(F.col("block") == F.col("other"), 3).when(F.col("block") < F.col("other"), 1).otherwise(2).cast("long").alias("side"))
    dealt = keys.join(rows.select("id", "d", "v", "count", "code"), "id").repartition("bucket", "task").sortWithinPartitions("d", "bucket", "task", "id")
    found = scratch.save(dealt.mapInArrow(lambda b: _linked(b, limit), "id long, links long, root long"), "found")
    comps = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).distinct(), scratch)
    own = same.join(found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links")), "rep", "left")
    own = own.join(comps, F.col("rep") == F.col("node"), "left").select("rep", "label", "d", "v", (F.col("count") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    told = sound.join(own, ["label", "d", "v"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component_id"))
    out = given.select("id").join(told, "id", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
