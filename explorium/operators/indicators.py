"""How good the archive of a search is, against a reference set, for each snapshot.

Objectives are brought to 0..1 by the reference's limits, maximised ones turned round, so all are minimised. An empty
reference raises; a snapshot without rows has no result.
"""

from __future__ import annotations

import bisect
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from explorium.sources.shared import Tables

#: Rows above which a snapshot's volume is cut into slices, and how many.
ROWS, RANGES = 2000, 16


def normalized(archive: DataFrame, reference: DataFrame, objectives: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Both tables with objectives on the reference's unit cube; ``objectives`` gives each -1 to minimise or 1 to maximise."""
    row = reference.agg(*[f for c in objectives for f in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    if row[0] is None:
        raise ValueError("the reference set is empty")

    def unit(df: DataFrame) -> DataFrame:
        cols = {}
        for c, sign in objectives.items():
            lo, hi = float(row[f"lo_{c}"]), float(row[f"hi_{c}"])
            u = (F.col(c) - lo) / ((hi - lo) or 1.0)
            cols[c] = 1 - u if sign > 0 else u
        return df.withColumns(cols)

    return unit(archive), unit(reference)


def _far(names: list[str]) -> Column:
    return F.sqrt(reduce(Column.__add__, [(F.col(f"a.{c}") - F.col(f"r.{c}")) * (F.col(f"a.{c}") - F.col(f"r.{c}")) for c in names]))


def _pairs(archive: DataFrame, reference: DataFrame, names: list[str], by: str) -> DataFrame:
    """Each archive row with each reference row: the reference is a front, bounded by its epsilon boxes."""
    a = archive.select(by, *names).withColumn("__i", F.monotonically_increasing_id()).alias("a")
    r = reference.select(*names).withColumn("__j", F.monotonically_increasing_id()).alias("r")
    return a.crossJoin(r)


def generational_distance(archive: DataFrame, reference: DataFrame, names: list[str], by: str = "nfe") -> DataFrame:
    """Mean distance from an archive row to the nearest reference row."""
    near = _pairs(archive, reference, names, by).groupBy(by, "__i").agg(F.min(_far(names)).alias("d"))
    return near.groupBy(by).agg(F.avg("d").alias("generational_distance"))


def inverted_generational_distance(archive: DataFrame, reference: DataFrame, names: list[str], by: str = "nfe") -> DataFrame:
    """Mean distance from a reference row to the nearest archive row."""
    near = _pairs(archive, reference, names, by).groupBy(by, "__j").agg(F.min(_far(names)).alias("d"))
    return near.groupBy(by).agg(F.avg("d").alias("inverted_generational_distance"))


def epsilon_indicator(archive: DataFrame, reference: DataFrame, names: list[str], by: str = "nfe") -> DataFrame:
    """The least shift of the archive by which each reference row is met or beaten."""
    worst = [F.col(f"a.{c}") - F.col(f"r.{c}") for c in names]
    near = _pairs(archive, reference, names, by).groupBy(by, "__j").agg(F.min(F.greatest(*worst) if len(worst) > 1 else worst[0]).alias("d"))
    return near.groupBy(by).agg(F.max("d").alias("epsilon"))


def spacing(archive: DataFrame, names: list[str], by: str = "nfe") -> DataFrame:
    """Deviation (by n - 1) of the distances (sum of absolute differences) to the nearest other row; 0 for one row."""
    x = archive.select(by, *names).withColumn("__i", F.row_number().over(Window.partitionBy(by).orderBy(*names)))
    a, r = x.alias("a"), x.alias("r")
    far = reduce(Column.__add__, [F.abs(F.col(f"a.{c}") - F.col(f"r.{c}")) for c in names])
    near = a.join(r, (F.col(f"a.{by}") == F.col(f"r.{by}")) & (F.col("a.__i") != F.col("r.__i")), "left").groupBy(F.col(f"a.{by}").alias(by), F.col("a.__i").alias("i")).agg(F.min(far).alias("d"))
    return near.groupBy(by).agg(F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("spacing"))


def volume(points: np.ndarray) -> float:
    """Share of the unit cube that rows beat (minimised). Slices along the last objective, each a volume of one dimension less."""
    points = points[(points < 1).all(axis=1)].clip(0)
    if not len(points):
        return 0.0
    if points.shape[1] == 1:
        return float(1 - points.min())
    if points.shape[1] == 2:
        order = points[np.lexsort((points[:, 1], points[:, 0]))]
        lows = np.minimum.accumulate(order[:, 1])
        return float(((np.append(order[1:, 0], 1.0) - order[:, 0]) * (1 - lows)).sum())
    order = points[points[:, -1].argsort(kind="stable")]
    ends = np.append(order[1:, -1], 1.0)
    return sum(float(high - p[-1]) * volume(order[: k + 1, :-1]) for k, (p, high) in enumerate(zip(order, ends, strict=True)) if high > p[-1])


def _beaten(points: list[tuple[float, float]], base: np.ndarray) -> list[float]:
    """Area that ``base`` and the first k points beat, for each k from 0: a staircase that each point is put into."""
    xs: list[float] = []
    ys: list[float] = []
    area, out = 0.0, []
    for k, (x, y) in enumerate([*map(tuple, base), *points]):
        if k >= len(base):
            out.append(area)
        i = bisect.bisect_right(xs, x) - 1
        if i >= 0 and ys[i] <= y:
            continue
        first = i if i >= 0 and xs[i] == x else i + 1
        # steps from here on that the point beats make way
        last, at, roof = first, x, ys[i] if i >= 0 else 1.0
        while last < len(xs) and ys[last] >= y:
            area += (xs[last] - at) * (roof - y)
            at, roof, last = xs[last], ys[last], last + 1
        area += ((xs[last] if last < len(xs) else 1.0) - at) * (roof - y)
        xs[first:last], ys[first:last] = [x], [y]
    out.append(area)
    return out[1:] if points else []


def _unbeaten(points: np.ndarray) -> np.ndarray:
    """Rows that no other row beats or repeats."""
    points = np.unique(points, axis=0)
    if points.shape[1] == 1:
        return points[:1]
    if points.shape[1] == 2:
        return points[np.append(True, points[1:, 1] < np.minimum.accumulate(points[:, 1])[:-1])]
    keep: list[np.ndarray] = []
    for p in points:  # in order, so what beats a row comes before it
        if not keep or not (np.array(keep) <= p).all(axis=1).any():
            keep.append(p)
    return np.array(keep)


def hypervolume(archive: DataFrame, names: list[str], by: str = "nfe", rows: int = ROWS) -> DataFrame:
    """Volume of the unit cube that a snapshot's rows beat; 0 if none of them does.

    A snapshot of more than ``rows`` is cut into RANGES slices along its last objective, a task each, whose volumes add
    up. A slice needs what lies below it only as the front of its other objectives, which each slice hands to those
    above. Rows with a null or NaN count for nothing.
    """
    if not names:
        raise ValueError("no objective is named")
    kind, last, flat = dict(archive.dtypes)[by], names[-1], [f"__c{k}" for k in range(len(names) - 1)]
    x = archive.select(F.col(by).alias("__by"), *[F.col(c).cast("double").alias(f"__c{k}") for k, c in enumerate(names[:-1])], F.col(last).cast("double").alias("__z"))
    inside = reduce(Column.__and__, [F.col(c) < 1 for c in (*flat, "__z")])
    every = x.select("__by").distinct()
    x = x.where(inside).withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in (*flat, "__z")}).distinct()
    if not flat:
        found = x.groupBy("__by").agg((1 - F.min("__z")).alias("v"))
    else:
        shares = [k / RANGES for k in range(1, RANGES)]
        edges = x.groupBy("__by").agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__z", shares, 1000).alias("__edges"))
        x = x.join(edges, x["__by"].eqNullSafe(edges["__by"])).drop(edges["__by"])
        x = x.withColumn("__r", F.when(F.col("__n") > rows, F.size(F.filter("__edges", lambda e: e < F.col("__z")))).otherwise(0)).drop("__edges", "__n")
        x = Tables(archive.sparkSession, "volume").save(x, "slices")
        lows = x.groupBy("__by", "__r").agg(F.min("__z").alias("__low"))
        ends = lows.withColumn("__end", F.coalesce(F.lead("__low").over(Window.partitionBy("__by").orderBy("__r")), F.lit(1.0)))
        columns = ", ".join(f"{c} double" for c in flat)

        def front(df: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame(_unbeaten(df[flat].to_numpy(float)), columns=flat)
            return out.assign(__by=df["__by"].iloc[0], __r=df["__r"].iloc[0])

        below = x.groupBy("__by", "__r").applyInPandas(front, f"{columns}, __by {kind}, __r int")
        below = below.withColumnRenamed("__r", "__from").join(ends.select(F.col("__by").alias("__b"), "__r"), F.col("__by").eqNullSafe(F.col("__b")) & (F.col("__from") < F.col("__r"))).drop("__b", "__from")
        end = ends.select(F.col("__by").alias("__b"), F.col("__r").alias("__s"), "__end")
        own = x.join(end, x["__by"].eqNullSafe(end["__b"]) & (x["__r"] == end["__s"])).drop("__b", "__s")

        def slab(df: pd.DataFrame) -> pd.DataFrame:
            base, rest = df[df["__z"].isna()], df[df["__z"].notna()].sort_values("__z")
            low, z = base[flat].to_numpy(float), rest["__z"].to_numpy()
            low = _unbeaten(low) if len(low) else low
            thick, points = np.diff(np.append(z, rest["__end"].iloc[0])), rest[flat].to_numpy(float)
            if len(flat) == 2:
                areas = np.array(_beaten(list(map(tuple, points)), low))
            elif len(flat) == 1:
                areas = 1 - np.minimum(np.minimum.accumulate(points[:, 0]), low.min() if len(low) else 1.0)
            else:
                areas = np.array([volume(np.concatenate([low, points[: k + 1]])) if t > 0 else 0.0 for k, t in enumerate(thick)])
            return pd.DataFrame({"__by": [df["__by"].iloc[0]], "v": [float((areas * thick).sum())]})

        parts = own.unionByName(below, allowMissingColumns=True).groupBy("__by", "__r").applyInPandas(slab, f"__by {kind}, v double")
        found = parts.groupBy("__by").agg(F.sum("v").alias("v"))
    found = found.withColumnRenamed("__by", "__b")
    return every.join(found, F.col("__by").eqNullSafe(F.col("__b")), "left").select(F.col("__by").alias(by), F.coalesce("v", F.lit(0.0)).alias("hypervolume"))


def progress(archives: DataFrame, objectives: dict[str, int], epsilons: list[float], by: str = "nfe") -> DataFrame:
    """Epsilon boxes of each snapshot, and those that no earlier snapshot had."""
    cells = [F.floor(F.col(c) * -s / e).alias(f"cell_{c}") for (c, s), e in zip(objectives.items(), epsilons, strict=True)]
    boxes = archives.select(by, *cells).distinct()
    keys = [f"cell_{c}" for c in objectives]
    first = boxes.withColumn("__first", F.min(by).over(Window.partitionBy(*keys)))
    return first.groupBy(by).agg(F.count(F.lit(1)).alias("boxes"), F.count_if(F.col(by) == F.col("__first")).alias("new_boxes"))


