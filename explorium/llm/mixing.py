"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Sources in code point order, null last, weigh 1, 2, 3, repeating. A source's target is its weight's share of all
words, but at most ``epochs`` times its own words; what a clamped source can't take is shared out again by weight
until no source is above. The fixed point of that redistribution is read off the sources sorted by cap over weight:
a source is clamped while its cap is below its weight's share of what the sources before it leave.

A document is taken whole: floor(target / source size) times, and once more if it lies in the seeded selection that
fills the rest of the target. The selection walks a source's documents in the order of a seeded digest; running sums
are taken within 4,096 ranges of the digest (rows without an id: and of the size) and added to the ranges' own running sums, so a source of any size is
spread over tasks. It stops at the document whose middle passes the rest, so a source misses its target by at most
half of one document.

Null and empty texts have size 0 and are taken 0 words. A source without words has target 0. Rows that repeat an id
are separate documents. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

EPOCHS, SEED = 3, "mix-1"


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with __size (words), __key (seeded digest), __bin (its first three hex digits), __null (no source)."""
    return docs.withColumns({
        "__size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        "__key": F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))),
        "__null": F.col("source").isNull(),
        "__source": F.coalesce(F.col("source"), F.lit("")),
    }).withColumn("__bin", _bin(seed))


def _bin(seed: str) -> Column:
    """The range of the digest that a row's running sum is taken in. Rows without an id all have one digest, so their range is cut by size too."""
    of_null = hashlib.md5(f":{seed}".encode()).hexdigest()
    first = F.substring("__key", 1, 3)
    inside = F.when(F.col("__key") < of_null, "0").when(F.col("doc_id").isNotNull() & (F.col("__key") == of_null), "2").when(F.col("__key") > of_null, "3")
    return F.when(first != of_null[:3], first).otherwise(F.concat(first, F.coalesce(inside, F.concat(F.lit("1"), F.lpad(F.col("__size").cast("string"), 12, "0")))))


def targets(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``sources``: __null, __source, source_size, one row a source. Adds weight and target.

    The running sums pass over one row a source.
    """
    by_name, all_rows = Window.orderBy("__null", "__source"), Window.partitionBy()
    s = sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    s = s.withColumn("cap", epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "__null", "__source").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "total": F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weights": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    s = s.withColumn("level", F.col("total") / F.col("weights"))
    s = s.withColumn("open", F.col("cap") >= F.col("level") * F.col("weight"))
    s = s.withColumn("level", F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct("ratio", "__null", "__source"))).over(all_rows))
    cap = F.col("cap").cast("double")
    return s.select("__null", "__source", "source_size", F.when(F.col("level") * F.col("weight") < cap, F.col("level") * F.col("weight")).otherwise(cap).alias("target"))


def mix(docs: DataFrame, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source and others) with size, source_size, target, copies and taken.

    Columns of these names in the input are replaced. Columns other than doc_id, source and size should be few: the
    sized rows are written to the shared folder.
    """
    names = ("size", "source_size", "target", "copies", "taken")
    rows = Scratch(docs.sparkSession, "mix").save(sized(docs, seed).drop(*names, "text"), "sized")
    by = ["__null", "__source"]
    sums = rows.groupBy(*by, "__bin").agg(F.sum("__size").alias("bin_size"))
    plan = targets(sums.groupBy(*by).agg(F.sum("bin_size").alias("source_size")), epochs)
    ahead = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = sums.withColumn("ahead", F.coalesce(F.sum("bin_size").over(ahead), F.lit(0))).join(plan, by)
    within = Window.partitionBy(*by, "__bin").orderBy("__key", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(bins, [*by, "__bin"]).withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("__size").over(within), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("copies", whole)
    rest = F.col("target") - F.col("copies") * F.col("source_size")
    out = out.withColumn("copies", F.col("copies") + F.when((F.col("__size") > 0) & (F.col("ahead") + F.col("__size") / 2 <= rest), F.lit(1)).otherwise(F.lit(0)))
    return out.withColumn("size", F.col("__size")).withColumn("taken", F.col("copies") * F.col("size")).drop(*by, "__key", "__bin", "__size", "bin_size", "ahead")


def mixed(docs: DataFrame, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as it is taken, whatever ids repeat or are null.

    Rows equal in id, source and text share out what all of them are taken.
    """
    part = lambda c: F.coalesce(F.concat(F.lit(":"), F.col(c).cast("string")), F.lit(""))
    rows = docs.withColumn("__row", F.concat(F.sha2(F.concat(part("text"), F.lit("|"), part("source")), 256), part("doc_id")))
    copies = mix(rows.select("doc_id", "source", "text", "__row"), epochs, seed).groupBy("__row").agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    out = rows.join(copies.where("__copies > 0"), "__row")
    place = F.row_number().over(Window.partitionBy("__row").orderBy(F.lit(0)))
    own = F.floor(F.col("__copies") / F.col("__rows")) + F.when(place <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)
    out = out.withColumn("__own", own.cast("int")).where("__own > 0")
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__own")))).drop("__row", "__copies", "__rows", "__own", "__copy")
