"""Hard negatives by exact integer scores from Four-Russians tables.

Components become whole numbers, written once as two's-complement bit planes: for each plane, a byte holds the bits of
eight dimensions. An anchor has a table a group of eight dimensions, with the sum of its components over each of the
256 subsets. A candidate's byte of a plane and group picks its subset's sum; sums of a plane are added, planes are
shifted and added (the sign's plane is subtracted), and the result is the inner product, exactly.

Anchors are the queries. They come in blocks of about ``BLOCK`` bytes (8,192 anchors of 64 dimensions), each block is
broadcast, and every task scores its own candidates against it, so candidates are never shuffled by label or by anchor.
A first pass scores rows of the anchors' own labels and finds the positives; these set the limits with which a second
pass scores all other rows. Each task hands on its best rows for each anchor (and positive), which the engine ranks.

Rows with a null label, a null id, a null or empty vector, or any null or non-finite component take no part, nor do
those with a component outside +-2^25 after scaling (sums stay whole in 64 bits for up to 8,192 dimensions). Only
vectors of the same length are compared. Rows that repeat an id are candidates each, but rows of the anchor's id are no
partner of it; anchors equal in id, label and vector are one. Ties go by the smaller id. An empty table, or one without
anchors, gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions

SCALE, WIDEST, BLOCK, TOGETHER, ROWS = 256, 1 << 25, 4 << 20, 16, 4096
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90


def planes(x: np.ndarray) -> np.ndarray:
    """Bit planes of rows of whole numbers: shape (rows, planes, groups of eight dimensions), the sign's plane last."""
    width = int(max(x.max(initial=0), ~x.min(initial=0))).bit_length() + 1
    bits = (x[:, None, :] >> np.arange(width)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def tables(anchors: np.ndarray) -> np.ndarray:
    """Sums of each anchor's components over the subsets of each group: shape (groups, 256, anchors)."""
    n, d = anchors.shape
    padded = np.zeros((n, -(-d // 8) * 8), np.int64)
    padded[:, :d] = anchors
    eights = padded.reshape(n, -1, 8)
    sums = np.zeros((eights.shape[1], 256, n), np.int64)
    for bit in range(8):  # subsets whose largest member is this bit follow from those without it
        sums[:, 1 << bit : 2 << bit] = sums[:, : 1 << bit] + eights[:, :, bit].T[:, None, :]
    return sums


def scores(sums: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Inner products of candidates, given as planes, with the anchors of the tables: shape (anchors, candidates)."""
    rows, width, groups = packed.shape
    out = np.zeros((rows, sums.shape[2]), np.int64)
    at = packed.transpose(1, 2, 0).astype(np.intp)
    for plane in range(width - 1, -1, -1):
        of_plane = np.take(sums[0], at[plane, 0], axis=0)
        for g in range(1, groups):
            of_plane += np.take(sums[g], at[plane, g], axis=0)
        out <<= 1
        out += -of_plane if plane == width - 1 else of_plane
    return np.ascontiguousarray(out.T)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, label, d, width, planes and whole (the numbers themselves) of the rows that take part."""
    for b in batches:
        ids, labels, vectors = b.column(0).to_pylist(), b.column(1), b.column(2)
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, x in enumerate(vectors):
            if ids[i] is None or not labels[i].is_valid or not x.is_valid or not len(x.values) or x.values.null_count:
                continue
            v = np.floor(SCALE * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
            if np.isfinite(v).all() and np.abs(v).max() <= WIDEST:
                by_length.setdefault(len(v), []).append((i, v.astype(np.int64)))
        for d, rows in by_length.items():
            where, x = pa.array([i for i, _ in rows]), np.array([v for _, v in rows])
            p = planes(x)
            fixed = {"d": np.full(len(rows), d, np.int32), "width": np.full(len(rows), p.shape[1], np.int32)}
            cols = [b.column(0).take(where), labels.take(where), *map(pa.array, fixed.values()), pa.array([r.tobytes() for r in p], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "label", "d", "width", "planes", "whole"])


class _Block:
    """Anchors of one length: ids, labels, tables in blocks of ``TOGETHER``, and for the second pass each positive's limits."""

    def __init__(self, rows: list, wanted: dict[int, list[tuple[int, int]]] | None = None):
        rows = sorted(rows, key=lambda r: (str(r.label), r.key))  # anchors of a label stand together
        self.keys, self.ids, self.labels = [r.key for r in rows], np.array([r.id for r in rows], np.int64), [r.label for r in rows]
        self.x = np.array([np.frombuffer(r.whole, np.int64) for r in rows])
        self.wanted = wanted


def _best(score: np.ndarray, ids: np.ndarray, ok: np.ndarray, most: int, floor: int | None) -> np.ndarray:
    """Places of the first rows by score, then id, among those that are ok and not below the floor."""
    if floor is not None:
        ok = ok & (score >= floor)
    at = np.flatnonzero(ok)
    if len(at) > 4 * most:  # what lies below the last place's score can't be among the first
        at = at[score[at] >= np.partition(score[at], len(at) - most)[len(at) - most]]
    return at[np.lexsort((ids[at], -score[at]))[:most]]


def _scored(batches: Iterator[pa.RecordBatch], blocks: dict[int, _Block]) -> Iterator[pa.RecordBatch]:
    """Best rows of this task: key, place of the positive (-1 in the first pass), id, score."""
    kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def add(slot: tuple[int, int], score: np.ndarray, ids: np.ndarray, ok: np.ndarray, most: int) -> None:
        had = kept.get(slot)
        at = _best(score, ids, ok, most, int(had[0][-1]) if had is not None and len(had[0]) == most else None)
        if len(at):
            s, i = score[at], ids[at]
            if had is not None:
                s, i = np.concatenate([had[0], s]), np.concatenate([had[1], i])
                first = np.lexsort((i, -s))[:most]
                s, i = s[first], i[first]
            kept[slot] = s, i

    def take(b: pa.RecordBatch) -> None:
        d, width, labels = b.column(2).to_numpy(), b.column(3).to_numpy(), np.array(b.column(1).to_pylist(), object)
        ids = b.column(0).to_numpy()
        for length, block in blocks.items():
            for w in np.unique(width[d == length]).tolist():
                rows = np.flatnonzero((d == length) & (width == w))
                packed = np.frombuffer(b"".join(b.column(4).take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), w, -1)
                own, theirs = ids[rows], labels[rows]
                for at in range(0, len(block.keys), TOGETHER):
                    few = range(at, min(at + TOGETHER, len(block.keys)))
                    same = {label: theirs == label for label in {block.labels[k] for k in few}}
                    use = np.arange(len(rows)) if block.wanted is not None else np.flatnonzero(np.logical_or.reduce(list(same.values())))
                    if not len(use):
                        continue
                    found = scores(tables(block.x[few.start : few.stop]), packed[use])
                    for k, score in zip(few, found, strict=True):
                        alike = same[block.labels[k]][use]
                        if block.wanted is None:
                            add((block.keys[k], -1), score, own[use], alike & (own[use] != block.ids[k]), POSITIVES)
                        else:
                            for place, positive in block.wanted.get(block.keys[k], ()):
                                if positive < 0:  # no score lies between the limits
                                    continue
                                low, high = -(-LOW * positive // 100), HIGH * positive // 100
                                add((block.keys[k], place), score, own[use], ~alike & (score >= low) & (score <= high) & (own[use] != block.ids[k]), NEGATIVES)

    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            take(b.slice(at, ROWS))
    slots = list(kept.items())
    n = [len(s) for _, (s, _) in slots]
    key, place = (np.repeat(np.array([slot[j] for slot, _ in slots], np.int64), n) for j in (0, 1))
    ids, score = (np.concatenate([pair[j] for _, pair in slots] or [np.empty(0, np.int64)]) for j in (1, 0))
    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place), pa.array(ids), pa.array(score)], ["key", "place", "id", "score"])


def mine(vectors: DataFrame, relabel: Callable[[Column, Column], Column], anchor: Callable[[Column], Column], id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``relabel`` makes a row's label from id and label, ``anchor`` tells from the id whether a row is an anchor.
    Positives are an anchor's first ``POSITIVES`` rows of its label; of each, the first ``NEGATIVES`` rows of other
    labels with ``LOW`` to ``HIGH`` hundredths of its score are returned.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    given = vectors.select(F.col(id_col).cast("long").alias("id"), relabel(F.col(id_col), F.col(label_col)).alias("label"), F.col(vec_col).alias("x"))
    kind = given.schema["label"].dataType.simpleString()
    rows = given.mapInArrow(_packed, f"id long, label {kind}, d int, width int, planes binary, whole binary")
    rows = scratch.save(rows.repartition(shuffle_partitions(spark), F.xxhash64("id", "whole")), "rows")
    queries = rows.where(anchor(F.col("id"))).select("id", "label", "d", "whole").distinct()
    queries = scratch.save(queries.withColumn("key", F.monotonically_increasing_id()), "anchors")
    parts = -(-(queries.agg(F.sum(F.octet_length("whole"))).first()[0] or 0) // block)

    def best(blocks: dict[int, _Block], most: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(blocks)
        found = rows.select("id", "label", "d", "width", "planes").mapInArrow(lambda b: _scored(b, shared.value), "key long, place long, id long, score long")
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("key", "place").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= most)

    out = None
    for part in range(parts):  # a block of anchors, of bounded size, at a time; each is scored by all tasks
        own = queries.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).collect()
        lengths = {d: [r for r in own if r.d == d] for d in {r.d for r in own}}
        positives = scratch.save(best({d: _Block(r) for d, r in lengths.items()}, POSITIVES), f"positives{part}")
        wanted: dict[int, list[tuple[int, int]]] = {}
        for r in positives.collect():  # at most POSITIVES an anchor of the block
            wanted.setdefault(r.key, []).append((r.rank, r.score))
        negatives = scratch.save(best({d: _Block(r, {x.key: wanted.get(x.key, []) for x in r}) for d, r in lengths.items()}, NEGATIVES), f"negatives{part}")
        p = positives.select("key", F.col("rank").cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        joined = negatives.join(p, ["key", "place"]).join(queries.select("key", F.col("id").alias("anchor_id")), "key")
        joined = joined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = joined if out is None else out.unionByName(joined)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
