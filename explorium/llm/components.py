"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a partial aggregation and a join; no node's neighbours are ever gathered in one task, so a component of
any size works. Stars shrink a chain's depth by a constant factor a step, so the number of steps is logarithmic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    to_least = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return to_least.union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """``edges``: columns a, b (same orderable type). Returns node, component (its least node) for every linked node.

    Links of a node to itself and null ends are ignored; an empty table gives an empty one.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.save(e, f"{tag}0")
    seen, step = None, 0
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if now == seen or not now[0]:
            break
        seen, step = now, step + 1
        e = scratch.save(_small(_large(e).distinct()).where("a <> b").distinct(), f"{tag}{step}")
        scratch.drop(f"{tag}{step - 1}")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
