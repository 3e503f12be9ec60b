"""Trees and forests grown level by level over whole tables: exact cuts, random cuts, out-of-bag votes.

What a level does to all its open nodes, of all trees, is one aggregation. The engine holds the rows; the driver holds
what a model is: a row a node. Categories are their levels, each against the rest, so every test names a column and a
limit or a level. Rows with a null in a feature or the outcome are left out.

Which rows a tree sees, how often, which features a node tries and where it cuts at random are functions of seed, tree
and row or node, so a lost executor's rows come out alike and the draws don't depend on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from explorium.sources.shared import Tables

#: Ranges of values that one feature's running sums are cut into; cuts change no result.
RANGES = 64
#: Slots, one a column or level, over all open nodes of the trees grown at once: bounds what a task counts in.
SLOTS = 4_000_000
#: Distinct rows times trees up to which a forest sums up how often each tree sees equal rows, and grows from these sums.
SUMS = 4_000_000


@dataclass(frozen=True)
class Slot:
    """What a test looks at: a number column, or one level of a category (then the limit is 0.5)."""

    column: str
    level: str | None = None


def one_hot(df: DataFrame, features: list[str], y: str, key: list[str] | None = None, most: int = 10_000) -> tuple[DataFrame, list[Slot]]:
    """``x``, an array of doubles with a place for each number column and each level of a category, ``y`` and ``id``; and what each place stands for.

    Levels are in alphabetical order. A column of more levels than ``most`` raises: it's no category. ``id`` is a hash
    of the key's columns, or of the row without one; rows that share it share their draws.
    """
    kinds, slots, parts = dict(df.dtypes), [], []
    texts = [c for c in features if kinds[c] in ("string", "boolean")]
    own = [F.col(c).cast("string" if c in texts else "double").alias(c) for c in features]
    rows = df.select(*own, F.col(y).alias("__y"), F.xxhash64(*(key or [*features, y])).alias("__id")).dropna()
    for c in features:
        if c in texts:
            levels = [r[0] for r in rows.select(c).distinct().limit(most + 1).collect()]
            if len(levels) > most:
                raise ValueError(f"{c} has more than {most} levels")
            for level in sorted(levels):
                slots.append(Slot(c, level))
                parts.append((F.col(c) == level).cast("double"))
        else:
            slots.append(Slot(c))
            parts.append(F.col(c))
    return rows.select(F.array(*parts).alias("x"), F.col("__y").alias("y"), F.col("__id").alias("id")), slots


def folded(rows: DataFrame) -> DataFrame:
    """Rows that are equal in ``x`` and ``y`` as one, with ``many``: how many they are. Trees need no more of them, so columns of few values make small tables."""
    return rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("many"))


def impurity(n, sums):
    """Rows times Gini impurity, of class counts, or times variance, of sum and sum of squares; arrays over the last axis."""
    if sums.shape[-1] == 2 and n is not None:
        return np.maximum(sums[..., 1] - np.divide(sums[..., 0] ** 2, n, out=np.zeros_like(sums[..., 0]), where=n > 0), 0)
    total = sums.sum(axis=-1)
    return total - np.divide((sums**2).sum(axis=-1), total, out=np.zeros_like(total), where=total > 0)


# exact cuts


@dataclass
class Node:
    """A node of a tree. Inner ones have a test: left is a value up to ``cut``; ``edge`` has the values next to it."""

    n: int
    sums: tuple[float, ...]
    slot: int | None = None
    cut: float | None = None
    edge: tuple[float, float] | None = None
    gain: float = 0.0


def _measures(y: Column, classes: list) -> list[Column]:
    """What is summed up of a row: one for each class, or the value and its square."""
    if classes:
        return [(y == F.lit(c)).cast("double") for c in classes]
    return [y.cast("double"), y.cast("double") * y.cast("double")]


def _gain(n: Column, sums: list[Column], all_n: Column, all_sums: list[Column], classify: bool) -> Column:
    """By how much a cut lowers rows times impurity, less what is the same for all cuts of a node."""
    rest_n, rest = all_n - n, [a - s for a, s in zip(all_sums, sums, strict=True)]
    if classify:
        # sums of weights, which are numbers of rows where there are none; a side without weight has nothing to tell
        share = lambda own: F.coalesce(F.try_divide(sum((s * s for s in own), F.lit(0.0)), sum(own, F.lit(0.0))), F.lit(0.0))
        return share(sums) + share(rest)
    return sums[0] * sums[0] / n + rest[0] * rest[0] / rest_n


def exact_tree(rows: DataFrame, slots: list[Slot], classes: list, least: int = 1, depth: int = 64, weight: str | None = None, many: str | None = None) -> dict[int, Node]:
    """A tree by node number (children of k: 2k + 1 and 2k + 2). Of all cuts midway between neighbouring values, a node takes the one that lowers impurity most.

    ``least`` rows stay on each side. Ties go to the first slot, then the least cut. A level sums up equal values of a
    node and column, runs the sums up within ranges of values, and starts each range at what the ranges before it hold,
    so no task holds a node's values and a hot node is many tasks' work. ``classes`` is empty for a number outcome.
    ``weight``, a column of ``rows``, makes classes count by it; ``least`` still counts rows. ``many``, a column too, says
    how many rows a row stands for. Rows of equal values are summed up first, and levels read those sums.
    """
    if weight and not classes:
        raise ValueError("weights go with classes")
    tables, nodes = Tables(rows.sparkSession, "tree"), {}
    names = [f"s{k}" for k in range(len(classes) or 2)]
    each = reduce(Column.__mul__, [F.col(c).cast("double") for c in (weight, many) if c], F.lit(1.0))
    own = rows.select("x", (F.col(many) if many else F.lit(1)).cast("long").alias("n"), *[(c * each).alias(s) for c, s in zip(_measures(F.col("y"), classes), names, strict=True)])
    now = tables.save(own.groupBy("x").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).select(F.lit(0).cast("long").alias("node"), "x", "n", *names), "level0")
    shares = [k / RANGES for k in range(1, RANGES)]
    # ranges of each column, from its approximate quantiles: a row of arrays, the same for all nodes
    edges = now.agg(*[F.percentile_approx(F.col("x")[k], shares, 1000).alias(f"e{k}") for k in range(len(slots))]).first()
    found_edges = F.array(*[F.array(*[F.lit(v) for v in sorted(set(edges[k] or []))]).cast("array<double>") for k in range(len(slots))]) if slots else None
    for r in now.groupBy("node").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).collect():
        nodes[r.node] = Node(r.n, tuple(r[s] for s in names))
    open_nodes = [0] if nodes and slots else []
    for level in range(depth):
        pure = lambda v: max(v.sums) == sum(v.sums) if classes else v.sums[1] - v.sums[0] ** 2 / v.n <= 1e-12 * max(abs(v.sums[1]), 1e-300)
        open_nodes = [k for k in open_nodes if nodes[k].n >= 2 * least and not pure(nodes[k])]
        if not open_nodes:
            break
        long = now.where(F.col("node").isin(open_nodes) if len(open_nodes) < 1000 else F.lit(True))
        long = long.select("node", "n", *names, F.posexplode(F.arrays_zip(F.col("x").alias("v"), found_edges.alias("e"))).alias("slot", "z")).select("node", "slot", F.col("z.v").alias("v"), F.size(F.filter("z.e", lambda e: e < F.col("z.v"))).alias("range"), "n", *names)
        values = tables.save(long.groupBy("node", "slot", "range", "v").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]), f"values{level}")
        of_range = Window.partitionBy("node", "slot", "range").orderBy("v")
        before = Window.partitionBy("node", "slot").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy("node", "slot")
        sums = values.groupBy("node", "slot", "range").agg(F.sum("n").alias("rn"), *[F.sum(s).alias(f"r{s}") for s in names], F.min("v").alias("first"))
        ahead = sums.select("node", "slot", "range", F.coalesce(F.sum("rn").over(before), F.lit(0)).alias("pn"), *[F.coalesce(F.sum(f"r{s}").over(before), F.lit(0.0)).alias(f"p{s}") for s in names],
                            F.sum("rn").over(whole).alias("an"), *[F.sum(f"r{s}").over(whole).alias(f"a{s}") for s in names], F.min("first").over(Window.partitionBy("node", "slot").orderBy("range").rowsBetween(1, Window.unboundedFollowing)).alias("beyond"))
        run = values.join(ahead, ["node", "slot", "range"])
        run = run.select("node", "slot", "v", F.coalesce(F.lead("v").over(of_range), F.col("beyond")).alias("next"), (F.sum("n").over(of_range) + F.col("pn")).alias("n"), *[(F.sum(s).over(of_range) + F.col(f"p{s}")).alias(s) for s in names], "an", *[f"a{s}" for s in names])
        run = run.where(F.col("next").isNotNull() & (F.col("n") >= least) & (F.col("an") - F.col("n") >= least))
        gain = _gain(F.col("n"), [F.col(s) for s in names], F.col("an"), [F.col(f"a{s}") for s in names], bool(classes))
        cut = F.col("v") + (F.col("next") - F.col("v")) / 2
        best = run.select("node", F.struct((-F.round(gain, 9)).alias("g"), "slot", cut.alias("cut"), "v", "next", "n", F.array(*names).alias("sums")).alias("best")).groupBy("node").agg(F.min("best").alias("best"))
        splits = [(r.node, r.best) for r in best.collect()]  # a row an open node
        children = []
        for k, b in splits:
            node, left = nodes[k], tuple(b.sums)
            right = tuple(a - s for a, s in zip(node.sums, left, strict=True))
            one, two, own = (impurity(np.array(float(c)) if not classes else None, np.array(s, float)) for c, s in ((b.n, left), (node.n - b.n, right), (node.n, node.sums)))
            gained = float(own - one - two)
            if gained <= 1e-12 * max(float(own), 1e-300):
                continue
            node.slot, node.cut, node.edge, node.gain = b.slot, b.cut, (b.v, b.next), gained
            nodes[2 * k + 1], nodes[2 * k + 2] = Node(b.n, left), Node(node.n - b.n, right)
            children += [2 * k + 1, 2 * k + 2]
        open_nodes = children
        if not children:
            break
        split = rows.sparkSession.createDataFrame([(k, nodes[k].slot, nodes[k].cut) for k, _ in splits if nodes[k].slot is not None], "node long, slot int, cut double")
        # the engine broadcasts the splits if they are small
        moved = now.join(split, "node").select((2 * F.col("node") + F.when(F.col("x")[F.col("slot")] <= F.col("cut"), 1).otherwise(2)).alias("node"), "x", "n", *names)
        now = tables.save(moved, f"level{level + 1}")
        tables.drop(f"level{level}", f"values{level}")
    return nodes


# random cuts and resampled rows


def draws(seed: int, tree: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on these alone."""
    with np.errstate(over="ignore"):
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tree.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed * 1_000_003 + salt) * np.uint64(0x165667B19E3779F9)
        for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        h ^= h >> np.uint64(33)
    return (h >> np.uint64(11)).astype(np.float64) / (1 << 53)


def weights(seed: int, tree: int, ids: np.ndarray) -> np.ndarray:
    """How often a tree sees each row: Poisson numbers of mean 1, as rows drawn with replacement come out in a large table. 0: out of bag."""
    limits = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    return np.searchsorted(limits, draws(seed, np.full(len(ids), tree), ids, 1), side="right")


def tried(seed: int, tree: np.ndarray, node: np.ndarray, wide: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots that each node tries, the first ``most`` in a seeded order among those with more than one value, and which of them count. A row a node."""
    n, width = wide.shape
    place = draws(seed, np.repeat(tree, width), (node[:, None] * 1_000_003 + np.arange(width)).ravel(), 2).reshape(n, width)
    order = np.argsort(np.where(wide, place, 2.0), axis=1, kind="stable")[:, :most]
    return order, np.take_along_axis(wide, order, axis=1)


def random_cuts(seed: int, tree: np.ndarray, node: np.ndarray, slot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places between the limits of a node's rows, below the upper one, so both sides have rows."""
    u = draws(seed, tree, node * 1_000_003 + slot, 3)
    return np.minimum(low + u * (high - low), np.nextafter(high, -np.inf))


@dataclass
class Tree:
    """Nodes in the order of their numbers: slot (-1: a leaf), cut, what it holds and its sums."""

    keys: np.ndarray
    slots: np.ndarray
    cuts: np.ndarray
    n: np.ndarray
    sums: np.ndarray

    def place(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The last node, known or just below one, that each of some rows comes to."""
        at, moving = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(moving) and len(self.keys):
            k = np.minimum(np.searchsorted(self.keys, at[moving]), len(self.keys) - 1)
            inner = (self.keys[k] == at[moving]) & (self.slots[k] >= 0)
            moving, k = moving[inner], k[inner]
            at[moving] = 2 * at[moving] + np.where(x[rows[moving], self.slots[k]] <= self.cuts[k], 1, 2)
        return at


@dataclass
class Forest:
    """Trees, and ``importances``: a share of 1 a column."""

    slots: list[Slot]
    classes: list
    trees: list[Tree]
    seed: int
    bootstrap: bool
    importances: dict[str, float]

    def values(self, tree: int, x: np.ndarray) -> np.ndarray:
        """A tree's vote for each row: shares of classes, or a mean."""
        t = self.trees[tree]
        k = np.searchsorted(t.keys, t.place(x, np.arange(len(x))))
        return (t.sums[k] if self.classes else t.sums[k][:, :1]) / t.n[k][:, None]


def _stacked(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _measured(y: np.ndarray, classes: int) -> np.ndarray:
    return (y[:, None] == np.arange(classes)[None, :]).astype(float) if classes else np.stack([y, y * y], axis=1)


def _sums(at: np.ndarray, count: int, w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Weight and weighted measures by place."""
    return np.stack([np.bincount(at, w, count), *(np.bincount(at, w * c, count) for c in s.T)], axis=1)


def _drawn(batches: Iterator[pa.RecordBatch], count: int, trees: range, bootstrap: bool, seed: int) -> Iterator[pa.RecordBatch]:
    """code and w: how often each of the trees sees the rows of each code in this task."""
    out = np.zeros((count, len(trees)), np.int64)
    for b in batches:
        code, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
        for i, t in enumerate(trees):
            out[:, i] += np.bincount(code, weights(seed, t, ids) if bootstrap else None, count).astype(np.int64)
    seen = np.flatnonzero(out.any(axis=1))
    for start in range(0, len(seen), 10_000):
        k = seen[start : start + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(list(out[k]), pa.list_(pa.int64()))], ["code", "w"])


def _seen(data: DataFrame, tables: Tables, trees: range, bootstrap: bool, seed: int) -> DataFrame | None:
    """``x``, ``y`` and ``w``: how often each of the trees sees rows equal in both. None if there are too many distinct rows for a task to count them."""
    distinct = data.select("x", "y").distinct().limit(SUMS // len(trees) + 1)
    count = distinct.count()
    if not count or count > SUMS // len(trees):
        return None
    # at most SUMS distinct rows are numbered in one task
    codes = tables.save(distinct.withColumn("code", F.row_number().over(Window.orderBy("x", "y")) - 1), f"codes{trees.start}")
    parts = data.join(F.broadcast(codes), ["x", "y"]).select("code", "id").mapInArrow(lambda b: _drawn(b, count, trees, bootstrap, seed), "code long, w array<long>")
    summed = parts.groupBy("code").agg(F.array(*[F.sum(F.col("w")[i]) for i in range(len(trees))]).alias("w"))
    return tables.save(codes.join(summed, "code").select("x", "y", "w"), f"sums{trees.start}")


def _counted(batches: Iterator[pa.RecordBatch], shared, width: int, classes: int, bootstrap: bool, seed: int, first: int | None = None) -> Iterator[pa.RecordBatch]:
    """Of each open node: weight, sums, least and, negated, largest values of the slots; or, of cuts, weight and sums left of each. ``first``: rows bring draws of trees from it on."""
    trees, opened, cuts = shared.value
    m, held = classes or 2, {}
    for b in batches:
        x, y, ids = _stacked(b.column(0), width), b.column(1).to_numpy(), b.column(2).to_numpy() if first is None else None
        drawn = None if first is None else np.stack(b.column(2).to_numpy(zero_copy_only=False)) if b.num_rows else np.empty((0, 0))
        s = _measured(y, classes)
        for t, wanted in opened.items():
            if drawn is not None:
                w = drawn[:, t - first] if len(drawn) else np.zeros(0, np.int64)
            else:
                w = weights(seed, t, ids) if bootstrap else np.ones(len(ids), np.int64)
            rows = np.flatnonzero(w > 0)
            at = trees[t].place(x, rows)
            k = np.minimum(np.searchsorted(wanted, at), len(wanted) - 1)
            here = wanted[k] == at
            rows, k = rows[here], k[here]
            if not len(rows):
                continue
            if cuts is None:
                if t not in held:
                    held[t] = [np.zeros((len(wanted), 1 + m)), np.full((len(wanted), 2 * width), np.inf)]
                held[t][0] += _sums(k, len(wanted), w[rows], s[rows])
                order = np.argsort(k, kind="stable")
                starts = np.flatnonzero(np.diff(k[order], prepend=-1))
                both, which = np.concatenate([x[rows[order]], -x[rows[order]]], axis=1), k[order][starts]
                held[t][1][which] = np.minimum(held[t][1][which], np.minimum.reduceat(both, starts, axis=0))
            else:
                slot, cut = cuts[t]
                if t not in held:
                    held[t] = [np.zeros((len(wanted), slot.shape[1] * (1 + m)))]
                for j in range(slot.shape[1]):
                    left = x[rows, slot[k, j]] <= cut[k, j]
                    held[t][0][:, j * (1 + m) : (j + 1) * (1 + m)] += _sums(k[left], len(wanted), w[rows[left]], s[rows[left]])
    for t, parts in held.items():
        v = np.concatenate(parts, axis=1)
        some = np.flatnonzero(v[:, 0] > 0) if cuts is None else np.arange(len(v))
        for start in range(0, len(some), 10_000):
            k = some[start : start + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), t, np.int32)), pa.array(opened[t][k]), pa.array(list(v[k]), pa.list_(pa.float64()))], ["tree", "node", "v"])


def forest(rows: DataFrame, slots: list[Slot], classes: list, trees: int, features: int, least: int = 1, least_split: int = 2, depth: int = 60, bootstrap: bool = True, seed: int = 0, together: int | None = None, most: int = SLOTS) -> Forest:
    """Extremely randomised trees: a node draws ``features`` slots that vary in it, a cut uniform between the limits of each, and takes the best.

    All nodes of a level, of ``together`` trees at once, are measured twice, each time in one aggregation over the rows
    (one for every ``most`` slots of open nodes): first the limits of each slot, then the sums left of each drawn cut.
    Rows equal in ``x`` and ``y`` are read once, with how often each tree sees them, if they are few enough.
    Tasks count in arrays and hand on one row a node, so a table of any size sends nodes, not rows. ``least`` counts
    what a tree sees; a side with less rules a cut out. Trees are up to 60 levels deep.
    """
    spark, width, k = rows.sparkSession, len(slots), len(classes)
    m, depth, together = k or 2, min(depth, 60), together or max(trees, 1)
    code = F.array_position(F.lit(classes), F.col("y")) - 1 if k else F.col("y").cast("double")
    tables = Tables(spark, "forest")
    data = tables.save(rows.select("x", code.cast("double").alias("y"), "id"), "rows")
    empty = Tree(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty((0, m)))
    grown, gains = [empty] * trees, np.zeros((trees, width))
    source, begin = data, None

    def measured(tree: np.ndarray, node: np.ndarray, cuts: tuple[np.ndarray, np.ndarray] | None, size: int) -> np.ndarray:
        """A row of sums (and limits) for each open node, zero where no row came to it."""
        out = np.zeros((len(node), size))
        step = max(1, most // max(width, 1))
        for start in range(0, len(node), step):
            own = slice(start, start + step)
            opened = {int(t): node[own][tree[own] == t] for t in np.unique(tree[own])}
            chosen = None if cuts is None else {t: tuple(c[own][tree[own] == t] for c in cuts) for t in opened}
            shared = spark.sparkContext.broadcast(({t: grown[t] for t in opened}, opened, chosen))
            parts = source.mapInArrow(lambda b, shared=shared, begin=begin: _counted(b, shared, width, k, bootstrap, seed, begin), "tree int, node long, v array<double>").select("tree", "node", F.posexplode("v").alias("i", "v"))
            joined = F.when(F.col("i") > m, F.min("v")).otherwise(F.sum("v")) if cuts is None else F.sum("v")
            summed = parts.groupBy("tree", "node", "i").agg(joined.alias("v")).groupBy("tree", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda z: z["v"]).alias("v"))
            place = {key: i + start for i, key in enumerate(zip(tree[own].tolist(), node[own].tolist(), strict=True))}
            for r in summed.toLocalIterator():  # a row an open node
                out[place[r.tree, r.node]] = r.v
        return out

    for first in range(0, trees, together):
        tree = np.arange(first, min(first + together, trees))
        sums_of = _seen(data, tables, range(first, first + len(tree)), bootstrap, seed)
        source, begin = (data, None) if sums_of is None else (sums_of, first)
        node = np.zeros(len(tree), np.int64)
        for level in range(depth + 1):
            if not len(tree):
                break
            v = measured(tree, node, None, 1 + m + 2 * width)
            n, sums, low, high = v[:, 0], v[:, 1 : 1 + m], v[:, 1 + m : 1 + m + width], -v[:, 1 + m + width :]
            seen = n > 0
            tree, node, n, sums, low, high = (z[seen] for z in (tree, node, n, sums, low, high))
            own = impurity(None if k else n, sums)
            order, counts = tried(seed, tree, node, high > low, features)
            inner = counts.any(axis=1) & (n >= max(least_split, 2 * least)) & (own > 1e-12 * np.maximum(np.abs(sums[:, -1]), 1e-300)) & (level < depth)
            slot, cut, at = np.full(len(tree), -1), np.zeros(len(tree)), np.flatnonzero(inner)
            if len(at):
                drawn = random_cuts(seed, np.repeat(tree[at], order.shape[1]), np.repeat(node[at], order.shape[1]), order[at].ravel(), np.take_along_axis(low[at], order[at], 1).ravel(), np.take_along_axis(high[at], order[at], 1).ravel()).reshape(len(at), -1)
                left = measured(tree[at], node[at], (order[at], drawn), order.shape[1] * (1 + m)).reshape(len(at), -1, 1 + m)
                right = np.concatenate([n[at][:, None], sums[at]], axis=1)[:, None, :] - left
                gain = own[at][:, None] - sum(impurity(None if k else side[..., 0], side[..., 1:]) for side in (left, right))
                fits = counts[at] & (np.minimum(left[..., 0], right[..., 0]) >= least)
                best = np.where(fits, gain, -np.inf).argmax(axis=1)
                taken = fits[np.arange(len(at)), best]
                at, best = at[taken], best[taken]
                slot[at] = order[at, best]
                cut[at] = drawn[np.flatnonzero(taken), best]
                np.add.at(gains, (tree[at], slot[at]), gain[np.flatnonzero(taken), best])
            for t in np.unique(tree).tolist():
                z, old = tree == t, grown[t]
                keys = np.concatenate([old.keys, node[z]])
                by = np.argsort(keys)
                grown[t] = Tree(keys[by], *(np.concatenate([a, b[z]])[by] for a, b in ((old.slots, slot), (old.cuts, cut), (old.n, n), (old.sums, sums))))
            tree, node = np.repeat(tree[at], 2), np.stack([2 * node[at] + 1, 2 * node[at] + 2], axis=1).ravel()
    totals = gains.sum(axis=1, keepdims=True)
    shares = np.divide(gains, totals, out=np.zeros_like(gains), where=totals > 0).mean(axis=0) if trees else np.zeros(width)
    importances = {c: float(sum(v for s, v in zip(slots, shares, strict=True) if s.column == c)) for c in dict.fromkeys(s.column for s in slots)}
    whole = sum(importances.values())
    tables.drop("rows")
    return Forest(slots, classes, grown, seed, bootstrap, {c: v / whole if whole else 0.0 for c, v in importances.items()})


def votes(rows: DataFrame, model: Forest, out_of_bag: bool = True) -> DataFrame:
    """id, y (classes by number), voters and vote (shares of classes, or a mean) of each row; ``out_of_bag``: of the trees that have not seen it.

    A row that all trees have seen has no voters and a null vote.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    width, k = len(model.slots), len(model.classes)
    code = F.array_position(F.lit(model.classes), F.col("y")) - 1 if k else F.col("y").cast("double")

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            x, ids = _stacked(b.column(0), width), b.column(2).to_numpy()
            total, n = np.zeros((len(x), max(1, k))), np.zeros(len(x), np.int64)
            for t in range(len(model.trees)):
                use = np.flatnonzero(weights(model.seed, t, ids) == 0) if out_of_bag and model.bootstrap else np.arange(len(x))
                if len(use) and len(model.trees[t].keys):
                    total[use] += model.values(t, x[use])
                    n[use] += 1
            vote = [row if c else None for row, c in zip((total / np.maximum(n, 1)[:, None]).tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array(n), pa.array(vote, pa.list_(pa.float64()))], ["id", "y", "voters", "vote"])

    return rows.select("x", code.cast("double").alias("y"), "id").mapInArrow(voted, "id long, y double, voters long, vote array<double>")


def oob_score(rows: DataFrame, model: Forest) -> float | None:
    """Share of rows whose class has the most votes of trees that haven't seen them (ties: the first class), or, for numbers, the share of variance told. Rows without voters are left out; None without any."""
    if not model.bootstrap:
        raise ValueError("trees that see every row have none out of their bags")
    v = votes(rows, model).where("voters > 0")
    if model.classes:
        first = F.array_position("vote", F.array_max("vote")) - 1
        return v.agg(F.avg((first == F.col("y")).cast("double"))).first()[0]
    row = v.agg(F.sum((F.col("y") - F.col("vote")[0]) ** 2).alias("e"), F.var_pop("y").alias("v"), F.count(F.lit(1)).alias("n")).first()
    return None if not row.n or not row.v else 1 - row.e / (row.v * row.n)


def scores(df: DataFrame, features: list[str], y: str, classify: bool = True, trees: int = 100, most: int | None = None, least: int | None = None, depth: int = 60, bootstrap: bool = True, seed: int = 0, together: int | None = None, key: list[str] | None = None) -> tuple[DataFrame, Forest, DataFrame]:
    """Importances (feature, score), largest first, the forest, and its rows. A node tries a third of the slots, and leaves grow with the root of the rows beyond 1,000, unless told else."""
    rows, slots = one_hot(df, features, y, key)
    tables = Tables(df.sparkSession, "scores")
    rows = tables.save(rows, "rows")
    n = rows.count()
    classes = sorted(r[0] for r in rows.select("y").distinct().collect()) if classify else []
    model = forest(rows, slots, classes, trees, most or max(1, round(len(slots) / 3)), least or max(1, round(math.sqrt(n) / math.sqrt(1000))), depth=depth, bootstrap=bootstrap, seed=seed, together=together)
    out = sorted(model.importances.items(), key=lambda s: (-s[1], s[0]))
    return df.sparkSession.createDataFrame(out, "feature string, score double"), model, rows
