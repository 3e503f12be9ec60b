"""Aggregations, ordered analytics, skylines and scores over experiment tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from explorium.sources.shared import Tables


def long_form(df: DataFrame, key: list[str], series: str) -> DataFrame:
    """One row a time step: key, t, value."""
    return df.select(*key, F.posexplode(series).alias("t", "value"))


def replications(df: DataFrame, key: str, series: str, reducer: Callable[[Column], Column] = F.avg) -> DataFrame:
    """The mean, or another aggregate, over the rows of a key, by position in the array."""
    return long_form(df, [key], series).groupBy(key, "t").agg(reducer(F.col("value")).alias("value")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias(series))


def robustness(df: DataFrame, policy: str, outcome: str) -> DataFrame:
    m, s = F.avg(outcome), F.stddev_pop(outcome)
    return df.groupBy(policy).agg(m.alias("mean"), s.alias("std"), (m / F.nullif(s, F.lit(0.0))).alias("mean_std"))


def envelope(df: DataFrame, by: list[str], t: str, value: str) -> DataFrame:
    return df.groupBy(*by, t).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def _limits(df: DataFrame, column: str, *more: Column) -> DataFrame:
    """__lo and __hi of a column in one row; half a unit below and above a column of one value."""
    lo, hi = F.min(column), F.max(column)
    half = F.when(lo == hi, 0.5).otherwise(0)
    return df.agg((lo - half).alias("__lo"), (hi + half).alias("__hi"), *more)


def equal_width(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``df`` with ``bin``: right-closed bins of one width, from 0; the limits come from one aggregate row. One value falls in the middle bin, null in none."""
    width = (F.col("__hi") - F.col("__lo")) / bins
    place = F.coalesce(F.ceil(F.try_divide(F.col(column) - F.col("__lo"), width)) - 1, F.when(F.col(column).isNotNull(), 0))
    return df.crossJoin(F.broadcast(_limits(df, column))).withColumn("bin", F.when(F.col(column).isNotNull(), F.least(F.lit(bins - 1), F.greatest(F.lit(0), place))).cast("long")).drop("__lo", "__hi")


def histogram(df: DataFrame, column: str, bins: int = 11) -> DataFrame:
    """Counts and densities of bins of one width, without the empty ones. One value alone has the middle bin of a unit's width."""
    lim = _limits(df, column, F.count(column).alias("total"))
    x = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(lim))
    width = (F.col("__hi") - F.col("__lo")) / bins
    x = x.withColumn("bin", F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col(column) - F.col("__lo"), width)), F.lit(0))).cast("long"))
    return x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.count(F.lit(1)), F.max("total") * F.max(width)).alias("density"))


def kde(df: DataFrame, by: list[str], column: str, points: int = 50) -> DataFrame:
    """Gaussian kernel density by group on an even grid, Scott's bandwidth. The grid is exploded on each row and summed map-side. A group of one value or row has no density (null)."""
    s = df.groupBy(*by).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n"), F.stddev_samp(column).alias("sd"))
    x = df.select(*by, column).join(s, by) if by else df.select(column).crossJoin(F.broadcast(s))
    h = F.nullif(F.col("sd"), F.lit(0.0)) * F.pow(F.nullif(F.col("n"), F.lit(0)), F.lit(-0.2))
    x = x.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("at", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    z = (F.col("at") - F.col(column)) / h
    return x.groupBy(*by, "i").agg(F.min("at").alias("at"), (F.sum(F.exp(-0.5 * z * z)) / (F.min("n") * F.min(h) * math.sqrt(2 * math.pi))).alias("density"))


def ranked(df: DataFrame, by: list[str], column: str, wanted: Column | None = None, cuts: int = 32) -> DataFrame:
    """``df`` with __rank (from 0, by the column within the group, nulls first) and __n (rows of the group).

    A group is cut into ranges between its approximate quantiles; ranks run within a range and start at the rows of the
    ranges before it, so a group of any size is many tasks' work. Cuts change no result. ``wanted``: ranks to keep, an
    array made of __n; ranges without one are left out before anything is sorted.
    """
    key = [F.col(c).alias(f"__g{k}") for k, c in enumerate(by)]
    names = [f"__g{k}" for k in range(len(by))]
    shares = [k / cuts for k in range(1, cuts)]
    edges = df.groupBy(*key).agg(F.percentile_approx(column, shares, 1000).alias("__edges"))

    def matched(a: DataFrame, b: DataFrame, left: list, right: list) -> DataFrame:
        same = F.lit(True)
        for x, y in zip(left, right, strict=True):
            same = same & x.eqNullSafe(y)
        return a.join(b, same).drop(*right)

    out = matched(df, edges, [F.col(c) for c in by], [edges[c] for c in names])
    out = out.withColumn("__range", F.coalesce(F.size(F.filter("__edges", lambda e: e < F.col(column))), F.lit(0))).drop("__edges")
    sums = out.groupBy(*key, F.col("__range").alias("__r")).agg(F.count(F.lit(1)).alias("__rows"))
    group = Window.partitionBy(*names)
    sums = sums.withColumn("__n", F.sum("__rows").over(group)).withColumn("__ahead", F.sum("__rows").over(group.orderBy("__r")) - F.col("__rows"))
    if wanted is not None:
        sums = sums.where(F.exists(wanted, lambda r: (r >= F.col("__ahead")) & (r < F.col("__ahead") + F.col("__rows"))))
    sums = sums.drop("__rows")
    out = matched(out, sums, [F.col(c) for c in by] + [F.col("__range")], [sums[c] for c in names] + [sums["__r"]])
    out = out.withColumn("__rank", F.col("__ahead") + F.row_number().over(Window.partitionBy(*by, "__range").orderBy(column)) - 1).drop("__range", "__ahead")
    return out if wanted is None else out.where(F.array_contains(wanted, F.col("__rank")))


def quantiles(df: DataFrame, by: list[str], column: str, shares: list[float]) -> DataFrame:
    """Group, n and q, an array of the exact quantiles: low + (high - low) * part, of the two values around the rank and the part of the way between them."""
    place = [(F.col("__n") - 1) * F.lit(p) for p in shares]
    wanted = F.array_distinct(F.array(*[f(r).cast("long") for r in place for f in (F.floor, F.ceil)]))
    few = ranked(df.where(F.col(column).isNotNull()).select(*by, column), by, column, wanted)
    value = lambda r: F.max(F.when(F.col("__rank") == r.cast("long"), F.col(column)))
    ends = [x for k, r in enumerate(place) for x in (value(F.floor(r)).alias(f"__lo{k}"), value(F.ceil(r)).alias(f"__hi{k}"))]
    out = few.groupBy(*by).agg(F.max("__n").alias("__n"), *ends)
    each = [F.col(f"__lo{k}") + (F.col(f"__hi{k}") - F.col(f"__lo{k}")) * (r - F.floor(r)) for k, r in enumerate(place)]
    return out.select(*by, F.col("__n").alias("n"), F.array(*each).alias("q"))


def cdf(df: DataFrame, by: str, column: str) -> DataFrame:
    """Rank share before each value within a class."""
    return ranked(df.select(by, column), [by], column).select(by, column, (F.col("__rank").cast("double") / F.col("__n")).alias("f"))


def cdf_set(df: DataFrame, columns: list[str], classes: str, complement: bool = False) -> DataFrame:
    """For regional sensitivity: of each number column and each class of a column, and of all rows together (class null): value and the share of rows before it, from 0 on, or what that leaves of 1 with ``complement``."""
    long = df.select(F.col(classes).cast("string").alias("class"), F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("double").alias("value")) for c in columns])).alias("v")).select("class", "v.*")
    long = long.where("value is not null")
    every = long.where("class is not null").unionByName(long.withColumn("class", F.lit(None).cast("string")))
    share = F.col("__rank") / F.col("__n")
    return ranked(every, ["dimension", "class"], "value").select("dimension", "class", "value", (1 - share if complement else share).alias("f"))


def discrete_cdf_set(df: DataFrame, columns: list[str], classes: str, complement: bool = False) -> DataFrame:
    """The same for categories: dimension, class (null: all rows), category, its share, and the running share, the class's rarest first."""
    long = df.select(F.col(classes).cast("string").alias("class"), F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("category")) for c in columns])).alias("v")).select("class", "v.*")
    n = long.where("category is not null").groupBy("dimension", "class", "category").agg(F.count(F.lit(1)).alias("n"))
    whole = n.groupBy("dimension", "category").agg(F.sum("n").alias("n"))
    present = n.where("class is not null").select("dimension", "class").distinct()
    grid = present.join(whole.select("dimension", "category"), "dimension").join(n, ["dimension", "class", "category"], "left").fillna(0, ["n"])
    grid = grid.unionByName(whole.withColumn("class", F.lit(None).cast("string")))
    group = Window.partitionBy("dimension", "class")
    run = F.sum("n").over(group.orderBy("n", "category")) / F.sum("n").over(group)
    return grid.select("dimension", "class", "category", (F.col("n") / F.sum("n").over(group)).alias("share"), (1 - run if complement else run).alias("f"))


def discrete_cdf(df: DataFrame, by: str, category: str) -> DataFrame:
    """Category shares within a class, rising, and their running sum."""
    n = df.groupBy(by, category).agg(F.count(F.lit(1)).alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))
    return share.withColumn("f", F.sum("n").over(Window.partitionBy(by).orderBy("n", category)) / F.sum("n").over(Window.partitionBy(by))).drop("n")


def complexity(series: Column) -> Column:
    """Root of the summed squared differences of neighbours."""
    steps = F.zip_with(F.slice(series, 2, F.greatest(F.size(series) - 1, F.lit(0))), F.slice(series, 1, F.greatest(F.size(series) - 1, F.lit(0))), lambda b, a: (b - a) * (b - a))
    return F.sqrt(F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x))


def cid(df: DataFrame, key: str, series: str) -> DataFrame:
    """Complexity-invariant distance of each pair of runs, a before b. Every pair is the result, so it grows with the square of the runs.

    Runs are dealt to blocks, and each two blocks meet in a group: a task holds two blocks and some of the distances between
    them. Sums run in the order of the steps. Series that are null, hold a null or differ in
    length have no distance (null), nor has a series that never moves. Rows with a null key are left out.
    """
    tables = Tables(df.sparkSession, "cid")
    x = F.col(series).cast("array<double>")
    runs = tables.save(df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), x.alias("x"), complexity(x).alias("c"), F.monotonically_increasing_id().alias("n")), "runs")
    blocks = block_count(*runs.agg(F.count(F.lit(1)), F.max(F.size("x"))).first())
    kind = runs.schema["k"].dataType.simpleString()
    pairs = blocks_met(runs.withColumn("n", F.col("n") % blocks), "n", blocks, _pairs(PAIR_ROWS**2), f"p {kind}, q {kind}, distance double")
    return pairs.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance")


#: Blocks of more rows than this are cut in two or more, until there are so many blocks; then they grow to so many values.
PAIR_ROWS, BLOCKS, BLOCK_VALUES = 1024, 12, 1 << 23


def block_count(rows: int, long: int | None) -> int:
    """Blocks of so many runs, the longest of length ``long``. As each run is sent once a block, they don't become more with the table while two fit into a task."""
    return max(1, min(BLOCKS, math.ceil(rows / PAIR_ROWS)), math.ceil(rows * (long or 1) / BLOCK_VALUES))


def blocks_met(runs: DataFrame, block: str, blocks: int, tile: Callable[[pa.Table, pa.Table], Iterator[pa.Table]], schema: str) -> DataFrame:
    """``tile`` of each two blocks i <= j of runs, of a block with itself too. What it yields is handed on table by table."""
    own, others = F.col(block).cast("long"), F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    meets = F.transform(others, lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
    sent = runs.withColumn(block, own).select(F.explode(meets).alias("__at"), *runs.columns).select("__at.i", "__at.j", *runs.columns)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        i, j = rows.column("i")[0], rows.column("j")[0]
        left = rows.filter(pc.equal(rows.column(block), i)).combine_chunks()
        right = left if i == j else rows.filter(pc.equal(rows.column(block), j)).combine_chunks()
        if left.num_rows and right.num_rows:
            for told in tile(left, right):
                yield from told.to_batches()

    return sent.repartition(blocks * (blocks + 1), "i", "j").groupBy("i", "j").applyInArrow(met, schema)


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and values of the series of each length, without those that are null or hold a null."""
    lists = pa.concat_arrays(column.chunks)
    lengths = np.array(pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False), np.int64)
    flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    nulls = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    lengths[nulls[ends[1:]] > nulls[ends[:-1]]] = -1
    values = flat.to_numpy(zero_copy_only=False)
    places = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths) if n >= 0}
    return {n: (at, values[ends[at][:, None] + np.arange(n)]) for n, at in places.items()}


def far(left: pa.Table, right: pa.Table, step: int, quick: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The distances of ``step`` runs (x, c) of one block after the other to all of another: the first run's place, distances, and which pairs have none.

    ``quick``: right to some 12 digits, by products of matrices.
    """
    one, other = _by_length(left.column("x")), _by_length(right.column("x"))
    rough = [t.column("c").to_numpy().astype(float) for t in (left, right)]
    columns = {n: (to, np.ascontiguousarray(y.T), (y * y).sum(axis=1)) for n, (to, y) in other.items()}
    for start in range(0, left.num_rows, step):
        out = np.zeros((min(step, left.num_rows - start), right.num_rows))
        none = np.ones(out.shape, bool)
        for n in one.keys() & other.keys():
            (at, x), (to, y, yy) = one[n], columns[n]
            first, end = np.searchsorted(at, (start, start + step))
            some = max(1, (1 << (17 if quick else 16)) // len(to))  # what a processor's cache holds
            for lo in range(first, end, some):
                rows = at[lo : min(lo + some, end)]
                with np.errstate(all="ignore"):
                    square = (_quick_squares if quick else _squares)(x[lo : lo + len(rows)], y, yy)
                    cx, cy = rough[0][rows][:, None], rough[1][to]
                    low = np.fmin(cx, cy)
                    np.sqrt(square, out=square)
                    square *= np.maximum(cx, cy)
                    square /= low
                if len(to) == right.num_rows and rows[-1] - rows[0] == len(rows) - 1:
                    place = slice(rows[0] - start, rows[-1] - start + 1)
                else:
                    place = np.ix_(rows - start, to)
                out[place], none[place] = square, low == 0
        yield start, out, none


def _squares(x: np.ndarray, y: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """The squares of all distances between rows of x and columns of y, summed in order."""
    square, gap = np.zeros((len(x), y.shape[1])), np.empty((len(x), y.shape[1]))
    for k in range(len(y)):
        np.subtract(x[:, k, None], y[k], out=gap)
        np.multiply(gap, gap, out=gap)
        np.add(square, gap, out=square)
    return square


def _quick_squares(x: np.ndarray, y: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """The same by a product; what is near beside the lengths, or too large for a product, is summed in order."""
    xx = (x * x).sum(axis=1)[:, None]
    square = x @ y
    square *= -2
    square += xx
    square += yy
    clear = (square >= 1e-3 * xx) & (square >= 1e-3 * yy) & (square < np.inf)
    if not clear.all():
        r, c = np.nonzero(~clear)
        if len(r) * 8 > square.size:
            return _squares(x, y, yy)
        found = np.zeros(len(r))
        for k in range(len(y)):
            gap = x[r, k] - y[k, c]
            found += gap * gap
        square[r, c] = found
    return square


def _pairs(cells: int) -> Callable[[pa.Table, pa.Table], Iterator[pa.Table]]:
    """The distances between the runs of two blocks, or, of a block with itself, of each two of its runs; about ``cells`` at once."""

    def tile(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
        alone = left is right
        for start, out, none in far(left, right, max(1, cells // right.num_rows)):
            part = left.slice(start, len(out))
            p, q = np.triu_indices(len(out), start + 1, out.shape[1]) if alone else (np.repeat(np.arange(len(out)), out.shape[1]), np.tile(np.arange(out.shape[1]), len(out)))
            told = pa.array(out[p, q] if alone else out.ravel(), mask=none[p, q] if alone else none.ravel())
            yield pa.table({"p": part.column("k").take(pa.array(p)), "q": right.column("k").take(pa.array(q)), "distance": told})

    return tile


def pareto(df: DataFrame, objectives: list[str]) -> DataFrame:
    """Rows that no other beats (all maximised). Each partition drops what one of its own beats; then the survivors meet."""
    values = df.select(*objectives).distinct().mapInArrow(_local_front, df.select(*objectives).schema).distinct()
    best = values
    if len(objectives) == 2:  # a sorted sweep: kept if above the running maximum of the second
        one, two = objectives
        w = Window.orderBy(F.desc(one), F.desc(two)).rowsBetween(Window.unboundedPreceding, -1)
        top = values.groupBy(one).agg(F.max(two).alias(two))
        best = top.withColumn("__above", F.max(two).over(w)).where(F.col("__above").isNull() | (F.col(two) > F.col("__above"))).drop("__above")
    else:
        other = values.select(*[F.col(c).alias(f"__{c}") for c in objectives])
        ge = F.lit(True)
        gt = F.lit(False)
        for c in objectives:
            ge, gt = ge & (F.col(f"__{c}") >= F.col(c)), gt | (F.col(f"__{c}") > F.col(c))
        best = values.join(other, ge & gt, "left_anti")
    return df.join(best, objectives, "left_semi")


def _local_front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's rows, those that none beats of the rows kept so far; batch by batch."""
    held: pa.RecordBatch | None = None
    for b in batches:
        rows = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        if not rows.num_rows:
            continue
        x = np.stack([rows.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in range(rows.num_columns)], axis=1)
        order, front = np.lexsort(-x.T[::-1]), []
        for i in order:  # what beats a row comes before it
            kept = x[front]
            if not ((kept >= x[i]).all(axis=1) & (kept > x[i]).any(axis=1)).any():
                front.append(i)
        held = rows.take(pa.array(sorted(front)))
    if held is not None:
        yield held


def epsilon_nondominated(df: DataFrame, objectives: list[str], epsilons: list[float], key: str) -> DataFrame:
    """One row an epsilon box (the nearest to the box's corner, then the least key), then the boxes no other beats (minimised)."""
    if len(objectives) != len(epsilons):
        raise ValueError("an epsilon for each objective is asked for")
    boxes = df.withColumns({f"__{c}": F.floor(F.col(c) / e) for c, e in zip(objectives, epsilons, strict=True)})
    far = sum(((F.col(c) - F.col(f"__{c}") * e) ** 2 for c, e in zip(objectives, epsilons, strict=True)), F.lit(0.0))
    names = [f"__{c}" for c in objectives]
    own = boxes.groupBy(*names).agg(F.min_by(F.struct(*df.columns), F.struct(far, F.col(key))).alias("row"))
    front = pareto(own.select(*[(-F.col(c)).alias(c) for c in names]), names).select(*[(-F.col(c)).alias(c) for c in names]).distinct()
    return own.join(front, names, "left_semi").select("row.*")


def grid_cells(df: DataFrame, objectives: list[str], widths: list[float]) -> DataFrame:
    """Hits, and novelty (the sum of 1/k over the hits), of each cell of an even grid from each objective's minimum."""
    low = F.broadcast(df.agg(*[F.min(c).alias(f"__{c}") for c in objectives]))
    cells = [F.floor((F.col(c) - F.col(f"__{c}")) / w).alias(f"cell_{c}") for c, w in zip(objectives, widths, strict=True)]
    hit = df.crossJoin(low).groupBy(*cells).agg(F.count(F.lit(1)).alias("hits"))
    return hit.withColumn("novelty", F.aggregate(F.sequence(F.lit(1), F.col("hits").cast("int")), F.lit(0.0), lambda acc, k: acc + 1.0 / k))


def f_regression(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """F of a linear relation to y for each feature; one pass. Null where either is constant or there are two rows at most, infinite where the relation is exact."""
    both = lambda c, of: F.var_pop(F.when(F.col(c).isNotNull() & F.col(y).isNotNull(), F.col(of).cast("double")))
    row = df.agg(*[F.struct(F.covar_pop(c, y).alias("xy"), both(c, c).alias("xx"), both(c, y).alias("yy")).alias(c) for c in features], F.count(F.lit(1)).alias("__n"))
    out = row.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("m")) for c in features])).alias("s"))
    share = F.try_divide(F.col("s.m.xy") * F.col("s.m.xy"), F.col("s.m.xx") * F.col("s.m.yy"))
    r2 = F.when(share > 1, 1.0).otherwise(share)
    f = F.when(r2 == 1, float("inf")).otherwise(F.try_divide(r2, 1 - r2) * (F.col("__n") - 2))
    return out.select("s.feature", F.when(F.col("__n") > 2, f).alias("score"))


def f_classif(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """One-way analysis of variance of each feature over the classes of y. Null for a constant feature, a single class or classes of a row each; infinite where only the classes differ."""
    parts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"), *[f for c in features for f in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))])
    total = df.agg(*[F.avg(c).alias(f"g_{c}") for c in features])
    x = parts.crossJoin(F.broadcast(total))
    row = x.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), *[f for c in features for f in (F.sum(F.col("n") * (F.col(f"m_{c}") - F.col(f"g_{c}")) ** 2).alias(f"b_{c}"), F.sum(F.col("n") * F.col(f"v_{c}")).alias(f"w_{c}"))])
    out = row.select("n", "k", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"b_{c}").alias("b"), F.col(f"w_{c}").alias("w")) for c in features])).alias("s"))
    between, within = F.try_divide(F.col("s.b"), F.col("k") - 1), F.try_divide(F.col("s.w"), F.col("n") - F.col("k"))
    return out.select("s.feature", F.when((within == 0) & (between > 0), float("inf")).otherwise(F.try_divide(between, within)).alias("score"))


def covered(df: DataFrame, p: str, y: str, steps: int = 10) -> DataFrame:
    """Density and coverage of ``p > threshold`` over an even grid of thresholds; the grid is summed map-side."""
    x = df.select(p, y, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    hit = F.col(p) > F.col("step") / steps
    tp, fp, fn = F.count_if(hit & (F.col(y) == 1)), F.count_if(hit & (F.col(y) == 0)), F.count_if(~hit & (F.col(y) == 1))
    return x.groupBy("step").agg((tp / F.greatest(tp + fp, F.lit(1))).alias("density"), (tp / F.greatest(tp + fn, F.lit(1))).alias("coverage"))


def pivot_mean(df: DataFrame, rows: list[str], columns: list[str], value: str) -> DataFrame:
    """Mean for every combination of factor levels, null where there are no rows."""
    names = rows + columns
    grid = df.select(names[0]).distinct()
    for c in names[1:]:  # levels of discretised factors: a few each
        grid = grid.crossJoin(df.select(c).distinct())
    return grid.join(df.groupBy(*names).agg(F.avg(value).alias("mean")), names, "left")


def discretize(df: DataFrame, columns: list[str], bins: int = 3) -> DataFrame:
    """Numbers in bins of one width from 0, whole numbers of no more than ``bins`` values by rank from 0, categories by alphabetical place from 1."""
    kinds, out = dict(df.dtypes), df
    for c in columns:
        whole = kinds[c] in ("tinyint", "smallint", "int", "bigint")
        text = kinds[c] in ("string", "boolean")
        if text or whole and df.select(c).where(F.col(c).isNotNull()).distinct().limit(bins + 1).count() <= bins:
            levels = df.select(F.col(c).alias("__c")).where("__c is not null").distinct()
            # a row a level
            levels = levels.withColumn("__at", F.row_number().over(Window.orderBy("__c")).cast("long") - (0 if text else 1))
            out = out.join(F.broadcast(levels), F.col(c) == F.col("__c"), "left").drop(c, "__c").withColumnRenamed("__at", c)
        else:
            out = equal_width(out, c, bins).drop(c).withColumnRenamed("bin", c)
    return out.select(*df.columns)
