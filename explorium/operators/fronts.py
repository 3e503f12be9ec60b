"""All non-dominated fronts: the first is what no row beats, the second what only rows of the first beat, and so on.

A row's front is one more than the highest front among the rows that beat it. Each objective is cut into ranges, so
vectors lie in the cells of a grid. What beats a vector lies in cells that are better or equal in each objective, so
cells are ranked in waves by the sum of their range numbers, all cells of a wave at once. A ranked cell hands on
staircases in place of its vectors: for each set of objectives in which a later cell may share its ranges, the values
of these that no vector of the cell exceeds at the same or a higher front; where no range is shared, one number.

Ranges follow the quantiles of the distinct vectors. A task holds one cell and the staircases that reach it. Waves are
written, so a lost executor repeats its part of one wave. Their number grows with ranges and objectives, not with rows.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from explorium.sources.shared import Tables

#: Distinct vectors for each range, and ranges at most (with three objectives or more): they set how work is dealt out, not what comes out.
PER_RANGE, MOST, MOST_OF_MANY = 50_000, 32, 12


def subsets(n: int) -> list[tuple[int, ...]]:
    """Sets of objectives, all of them left out."""
    return [s for k in range(n) for s in combinations(range(n), k)]


def _mask(s: tuple[int, ...]) -> int:
    return sum(1 << k for k in s)


class Steps:
    """A staircase of (place, front): the highest front up to a place, with both rising from step to step."""

    def __init__(self):
        self.lows: list[float] = []
        self.tops: list[int] = []

    def top(self, place: float) -> int:
        k = bisect_right(self.lows, place)
        return self.tops[k - 1] if k else 0

    def add(self, place: float, front: int) -> None:
        lows, tops = self.lows, self.tops
        k = bisect_right(lows, place)
        if k and tops[k - 1] >= front:
            return
        end = k
        while end < len(tops) and tops[end] <= front:
            end += 1
        if k and lows[k - 1] == place:
            k -= 1
        lows[k:end], tops[k:end] = [place], [front]


def _rank_of_three(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Fronts of distinct vectors in an order in which what beats one comes before it: n log² n, in a tree of staircases.

    The tree's places are the levels of the objective with fewer values of the last two; each place that a vector is
    put at holds a staircase of the other objective.
    """
    few, other = (1, 2) if len(np.unique(x[:, 1])) <= len(np.unique(x[:, 2])) else (2, 1)
    levels, place = np.unique(-x[:, few], return_inverse=True)  # the best level first
    size, tree, found = len(levels), [None] * (len(levels) + 1), np.zeros(len(x), np.int64)
    for i, (p, v, least) in enumerate(zip((place.ravel() + 1).tolist(), (-x[:, other]).tolist(), base.tolist(), strict=True)):
        best, k = least, p
        while k:
            if tree[k] is not None:
                best = max(best, tree[k].top(v))
            k -= k & -k
        found[i] = best + 1
        while p <= size:
            if tree[p] is None:
                tree[p] = Steps()
            tree[p].add(v, best + 1)
            p += p & -p
    return found


def above(vectors: np.ndarray, values: np.ndarray, fronts: np.ndarray) -> np.ndarray:
    """For each vector the highest front among values that reach it in every objective; 0 if none does."""
    out = np.zeros(len(vectors), np.int64)
    if not len(values):
        return out
    if values.shape[1] == 0:
        return out + fronts.max()
    if values.shape[1] == 1:
        order = np.argsort(-values[:, 0], kind="stable")
        top = np.maximum.accumulate(fronts[order])
        n = np.searchsorted(-values[order, 0], -vectors[:, 0], side="right")
        return np.where(n > 0, top[np.maximum(n, 1) - 1], 0)
    if values.shape[1] == 2:  # from the highest first value down, what reaches is on a staircase of the second
        steps, order, k = Steps(), np.argsort(-values[:, 0], kind="stable"), 0
        for i in np.argsort(-vectors[:, 0], kind="stable").tolist():
            while k < len(order) and values[order[k], 0] >= vectors[i, 0]:
                steps.add(-float(values[order[k], 1]), int(fronts[order[k]]))
                k += 1
            out[i] = steps.top(-float(vectors[i, 1]))
        return out
    step = max(1, (1 << 21) // len(values))
    for at in range(0, len(vectors), step):
        reach = (values[None, :, :] >= vectors[at : at + step, None, :]).all(axis=2)
        out[at : at + step] = np.where(reach, fronts[None, :], 0).max(axis=1)
    return out


def rank(vectors: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Fronts of distinct vectors; base: the highest front among what beats each from other cells."""
    order = np.lexsort(-vectors.T[::-1])  # what beats a vector comes before it
    out = np.zeros(len(vectors), np.int64)
    if vectors.shape[1] == 3:
        out[order] = _rank_of_three(vectors[order], base[order])
        return out
    if vectors.shape[1] > 3:
        x, found = vectors[order], np.zeros(len(vectors), np.int64)
        for i, at in enumerate(order):
            reach = (x[:i] >= x[i]).all(axis=1)
            found[i] = 1 + max(base[at], found[:i].max(initial=0, where=reach))
        out[order] = found
        return out
    lows: list[float] = []  # a staircase: with the negated last objective rising, fronts rise
    tops: list[int] = []
    for at in order:
        v = -float(vectors[at, -1])
        k = bisect_right(lows, v)
        out[at] = front = 1 + max(int(base[at]), tops[k - 1] if k else 0)
        end = k
        while end < len(tops) and tops[end] <= front:
            end += 1
        if k and lows[k - 1] == v:
            k -= 1
        lows[k:end], tops[k:end] = [v], [front]
    return out


def staircase(values: np.ndarray, fronts: np.ndarray) -> np.ndarray:
    """Rows that none reaches in every value at the same or a higher front; of equal ones the first."""
    if values.shape[1] == 0:
        return np.array([fronts.argmax()])
    order = np.lexsort([*(-values.T[::-1]), -fronts])  # higher fronts first, then what reaches further
    if values.shape[1] == 1:
        v = values[order, 0]
        before = np.concatenate([[-np.inf], np.maximum.accumulate(v)[:-1]])
        keep = v > before
        keep[0] = True
        return order[keep]
    kept: list[int] = []
    if values.shape[1] == 2:  # a staircase of what is kept: with the first value falling, the second rises
        steps = Steps()
        for i in order.tolist():
            place, reach = -float(values[i, 0]), float(values[i, 1])
            if not steps.lows or (k := bisect_right(steps.lows, place)) == 0 or steps.tops[k - 1] < reach:
                kept.append(i)
                steps.add(place, reach)
        return np.array(kept)
    for i in order:
        if not kept or not (values[kept] >= values[i]).all(axis=1).any():
            kept.append(i)
    return np.array(kept)


def fronts(df: DataFrame, objectives: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` with the number of each row's front, from 1; all objectives are maximised and compared as doubles.

    Equal rows share a front. A row with a null or NaN objective has no front (null) and beats nothing. ``ranges``: ranges of an
    objective, by default as many as the number of distinct vectors asks for.
    """
    if not objectives or "front" in df.columns:
        raise ValueError("fronts need an objective, and no column named front")
    spark, d = df.sparkSession, len(objectives)
    scratch, full = Tables(spark, "fronts"), (1 << d) - 1
    # adding 0.0 makes one zero of two
    own = df.select(*[(F.col(c).cast("double") + F.lit(0.0)).alias(f"v{k}") for k, c in enumerate(objectives)])
    known = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) for c in own.columns])
    vectors = scratch.save(own.where(known).distinct(), "vectors")
    if ranges is None:
        ranges = int(min(MOST if d < 3 else MOST_OF_MANY, 1 + vectors.count() // PER_RANGE))
    cuts = vectors.approxQuantile(vectors.columns, [k / ranges for k in range(1, ranges)], 0.001) if ranges > 1 else [[] for _ in objectives]
    # a range's number counts the cuts above a value: 0 is the best
    number = [reduce(Column.__add__, [(F.col(f"v{k}") < F.lit(c)).cast("int") for c in sorted(set(at))], F.lit(0)) for k, at in enumerate(cuts)]
    grid = vectors.select(F.array(*number).alias("cell"), F.array(*vectors.columns).alias("v"))
    grid = scratch.save(grid.withColumn("wave", F.aggregate("cell", F.lit(0), lambda a, x: a + x)), "grid", "wave")
    sets = [F.struct(F.lit(_mask(s)).alias("mask"), F.array(*[F.col("cell")[k] for k in s]).cast("array<int>").alias("shared")) for s in subsets(d)]
    less = reduce(Column.__and__, [(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0) | (F.col("from")[k] < F.col("cell")[k]) for k in range(d)])

    def ranked(key: tuple, points: pd.DataFrame, reached: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(points["v"].to_list())
        base = np.zeros(len(x), np.int64)
        for mask, part in reached.groupby("mask"):
            s = [k for k in range(d) if mask >> k & 1]
            base = np.maximum(base, above(x[:, s], np.stack(part["v"].to_list())[:, s], part["front"].to_numpy(np.int64)))
        found = rank(x, base)
        rows = [(full, x, found)]
        for s in subsets(d):
            at = staircase(x[:, list(s)], found)
            rows.append((_mask(s), x[at], found[at]))
        cell = points["cell"].iloc[0]
        return pd.concat([pd.DataFrame({"mask": m, "cell": [cell] * len(f), "v": list(v), "front": f}) for m, v, f in rows], ignore_index=True)

    done: list[DataFrame] = []
    for wave in sorted(r.wave for r in grid.select("wave").distinct().collect()):  # at most ranges x objectives
        points = grid.where(F.col("wave") == wave).select("cell", "v")
        reached = spark.createDataFrame([], "at array<int>, mask int, v array<double>, front long")
        if done:
            targets = points.select("cell").distinct().select("cell", F.inline(F.array(*sets)))
            steps = reduce(DataFrame.unionByName, done).where(F.col("mask") != full).withColumnRenamed("cell", "from")
            shared = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.col("from")[k]) for k in range(d)]))
            reached = targets.join(steps.withColumn("shared", shared), ["mask", "shared"]).where(less).select(F.col("cell").alias("at"), "mask", "v", "front")
        out = points.groupBy("cell").cogroup(reached.groupBy("at")).applyInPandas(_of_points(ranked), "mask int, cell array<int>, v array<double>, front long")
        done.append(scratch.save(out, f"wave{wave}"))
    if not done:
        return df.withColumn("front", F.lit(None).cast("long"))
    told = reduce(DataFrame.unionByName, done).where(F.col("mask") == full)
    told = told.select(*[F.col("v")[k].alias(f"__front_v{k}") for k in range(d)], "front")
    same = reduce(Column.__and__, [df[c].cast("double") + F.lit(0.0) == told[f"__front_v{k}"] for k, c in enumerate(objectives)])
    return df.join(told, same, "left").select(*[df[c] for c in df.columns], "front")


def _of_points(f):
    """Staircases that reach a cell make no group by themselves."""

    def run(key: tuple, points: pd.DataFrame, reached: pd.DataFrame) -> pd.DataFrame:
        return f(key, points, reached) if len(points) else pd.DataFrame({"mask": [], "cell": [], "v": [], "front": []})

    return run
