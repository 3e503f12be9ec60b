"""The data that figures show: groups, boxes, violins, letter values, pairs, hexagons, parallel axes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from explorium.operators import analysis as A


def intervals(df: DataFrame, column: str, groups: int = 5) -> list[tuple[float, float]]:
    """Limits of as many intervals of one width."""
    lo, hi = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if lo is None:
        return []
    edges = [lo + (hi - lo) * k / groups for k in range(groups)] + [hi]
    return list(zip(edges, edges[1:], strict=False))


def grouped(df: DataFrame, column: str, groups: list | None = None, labels: list[str] | None = None) -> DataFrame:
    """Rows that fall in a group, with its label in ``group``: values, or (low, high) half-open but for the last. Without groups, five intervals of a number or every value."""
    number = isinstance(df.schema[column].dataType, T.NumericType)
    if groups is None:
        groups = intervals(df, column) if number else None
    if groups is None:
        return df.where(F.col(column).isNotNull()).withColumn("group", F.col(column).cast("string"))
    names = labels or [f"{g[0]:.3g}-{g[1]:.3g}" if isinstance(g, tuple) else str(g) for g in groups]
    label = F.lit(None).cast("string")
    for k in range(len(groups) - 1, -1, -1):
        g, x = groups[k], F.col(column)
        inside = ((x >= g[0]) & ((x <= g[1]) if k == len(groups) - 1 else (x < g[1]))) if isinstance(g, tuple) else x == F.lit(g)
        label = F.when(inside, F.lit(names[k])).otherwise(label)
    return df.withColumn("group", label).where("group is not null")


def end_state(df: DataFrame, series: str, index: int = -1) -> DataFrame:
    """The series' value at a position from 0, or from the end if below; null if there is none."""
    return df.withColumn(series, F.try_element_at(series, F.lit(index + 1 if index >= 0 else index)))


def boxplot(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers (the last values within 1.5 quartile ranges) and the count of values beyond them."""
    q = A.quantiles(df, by, value, [0.25, 0.5, 0.75]).drop("n")
    x = df.where(F.col(value).isNotNull()).select(*by, value)
    x = x.join(q, by) if by else x.crossJoin(F.broadcast(q))  # without groups, one row
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = F.col(value).between(F.col("q")[0] - reach, F.col("q")[2] + reach)
    first = F.first("q")
    return x.groupBy(*by).agg(first[0].alias("q1"), first[1].alias("median"), first[2].alias("q3"), F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count_if(~inside).alias("outliers"))


def violin(df: DataFrame, by: list[str], value: str, points: int = 100) -> DataFrame:
    """A density by group, beside the group's quartiles."""
    box = boxplot(df, by, value).select(*by, "q1", "median", "q3")
    curve = A.kde(df, by, value, points)
    return curve.join(box, by) if by else curve.crossJoin(F.broadcast(box))


def letter_values(df: DataFrame, by: list[str], value: str, depth: int = 7) -> DataFrame:
    """Nested ranges that leave out 1/4, 1/8 ... of the values at either end, as many as have 2^-k n of at least one half."""
    tails = [0.5 ** (k + 2) for k in range(depth)]
    q = A.quantiles(df, by, value, [*tails, *(1 - t for t in tails)])
    rows = F.array(*[F.struct(F.lit(k).alias("level"), F.col("q")[k].alias("low"), F.col("q")[depth + k].alias("high"), F.lit(t).alias("tail")) for k, t in enumerate(tails)])
    return q.select(*by, "n", F.explode(rows).alias("r")).where(F.col("r.tail") * F.col("n") >= 0.5).select(*by, "r.level", "r.low", "r.high")


def pairs(df: DataFrame, key: str, outcomes: list[str]) -> DataFrame:
    """Each two outcomes of a run: outcome_x, outcome_y, x, y."""
    both = [F.struct(F.lit(a).alias("outcome_x"), F.lit(b).alias("outcome_y"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a in outcomes for b in outcomes if a != b]
    return df.select(key, F.explode(F.array(*both)).alias("p")).select(key, "p.*")


def hexbins(df: DataFrame, x: str, y: str, size: int = 20) -> DataFrame:
    """Counts by hexagon: the nearer centre of two grids shifted by half a cell. cx and cy are the centre."""
    lim = F.broadcast(df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")))
    tall = max(1, int(size / math.sqrt(3)))
    p = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y).crossJoin(lim)
    sx = F.coalesce(F.nullif((F.col("x1") - F.col("x0")) / size, F.lit(0.0)), F.lit(1.0))
    sy = F.coalesce(F.nullif((F.col("y1") - F.col("y0")) / tall, F.lit(0.0)), F.lit(1.0))
    p = p.withColumns({"sx": sx, "sy": sy}).withColumns({"u": (F.col(x) - F.col("x0")) / F.col("sx"), "v": (F.col(y) - F.col("y0")) / F.col("sy")})
    p = p.withColumns({"i1": F.floor(F.col("u") + 0.5), "j1": F.floor(F.col("v") + 0.5), "i2": F.floor("u") + 0.5, "j2": F.floor("v") + 0.5})
    d = lambda k: (F.col("u") - F.col(f"i{k}")) ** 2 + 3 * (F.col("v") - F.col(f"j{k}")) ** 2
    one = d(1) < d(2)
    i, j = F.when(one, F.col("i1")).otherwise(F.col("i2")), F.when(one, F.col("j1")).otherwise(F.col("j2"))
    return p.groupBy((F.col("x0") + i * F.col("sx")).alias("cx"), (F.col("y0") + j * F.col("sy")).alias("cy")).agg(F.count(F.lit(1)).alias("n"))


def parallel_axes(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each column on 0..1, categories by their alphabetical place: key, axis, at."""
    kinds = dict(df.dtypes)
    out = df
    for c in columns:
        if kinds[c] in ("string", "boolean"):
            place = df.select(F.col(c).alias("__c")).distinct().where("__c is not null")
            place = place.withColumn("__at", (F.row_number().over(Window.orderBy("__c")) - 1).cast("double"))  # a figure's categories
            out = out.join(F.broadcast(place), out[c] == F.col("__c"), "left").drop(c, "__c").withColumnRenamed("__at", c)
    lim = F.broadcast(out.agg(*[f for c in columns for f in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]))
    axes = [F.struct(F.lit(c).alias("axis"), ((F.col(c) - F.col(f"lo_{c}")) / F.coalesce(F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0)), F.lit(1))).cast("double").alias("at")) for c in columns]
    return out.crossJoin(lim).select(key, F.explode(F.array(*axes)).alias("a")).select(key, "a.*")


def kde_over_time(df: DataFrame, t: str, value: str, points: int = 100, log: bool = False) -> DataFrame:
    """Density at each step on one grid for all steps, as a share of the step's highest. Null at a step of one value or row."""
    lim = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    s = df.groupBy(t).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"))
    x = df.select(t, value).join(F.broadcast(s), t).crossJoin(F.broadcast(lim))
    h = F.nullif(F.col("sd"), F.lit(0.0)) * F.pow(F.nullif(F.col("n"), F.lit(0)), F.lit(-0.2))
    x = x.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("at", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    z = (F.col("at") - F.col(value)) / h
    d = x.groupBy(t, "i").agg(F.min("at").alias("at"), F.sum(F.exp(-0.5 * z * z)).alias("d"))
    share = F.try_divide(F.col("d"), F.max("d").over(Window.partitionBy(t)))
    return d.select(t, "i", "at", (F.log1p(share) if log else share).alias("density"))


DENSITIES = {"kde": lambda df, by, value: A.kde(df, by, value), "hist": lambda df, by, value: histograms(df, by, value), "boxplot": lambda df, by, value: boxplot(df, by, value),
             "violin": lambda df, by, value: violin(df, by, value), "boxenplot": lambda df, by, value: letter_values(df, by, value)}
PLOTS = ("envelope", "lines", "env_lin")


def histograms(df: DataFrame, by: list[str], value: str, bins: int = 11) -> DataFrame:
    """Counts by group in bins of one width, with limits that all groups share."""
    lim = F.broadcast(df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")))
    width = (F.col("__hi") - F.col("__lo")) / bins
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("__lo")) / width))).otherwise(0).cast("long")
    x = df.where(F.col(value).isNotNull()).crossJoin(lim)
    return x.groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first(F.col("__lo") + place * width).alias("low"))


def density(df: DataFrame, series: str, kind: str = "kde", by: list[str] = (), index: int = -1) -> DataFrame:
    """How a series' values at its end, or at another index, are spread, by group if there are any."""
    if kind not in DENSITIES:
        raise ValueError(f"no density called {kind!r}")
    return DENSITIES[kind](end_state(df, series, index).where(F.col(series).isNotNull()), list(by), series)


def over_time(df: DataFrame, key: str, series: list[str], kind: str = "envelope", by: str | None = None, groups: list | None = None, labels: list[str] | None = None) -> DataFrame:
    """Lines (key, outcome, t, value), envelopes (outcome, t, low, high) or both (an envelope's rows have no key), by group if there is one."""
    if kind not in PLOTS:
        raise ValueError(f"no plot called {kind!r}")
    x = grouped(df, by, groups, labels) if by else df
    group = ["group"] if by else []
    each = F.array(*[F.struct(F.lit(c).alias("outcome"), F.col(c).cast("array<double>").alias("y")) for c in series])
    long = x.select(key, *group, F.explode(each).alias("s")).select(key, *group, "s.outcome", F.posexplode("s.y").alias("t", "value"))
    env = A.envelope(long, [*group, "outcome"], "t", "value")
    return {"lines": long, "envelope": env}[kind] if kind != "env_lin" else long.unionByName(env, allowMissingColumns=True)


def densities_over_time(df: DataFrame, key: str, series: str, times: list[int], kind: str = "kde", by: str | None = None, groups: list | None = None) -> tuple[DataFrame, DataFrame]:
    """The envelope of a series, and its density at up to six positions, with ``t``."""
    if not 0 < len(times) <= 6:
        raise ValueError("between one and six times are asked for")
    x = (grouped(df, by, groups) if by else df).withColumn("__t", F.explode(F.array(*[F.lit(t) for t in times])))
    x = x.withColumn(series, F.try_element_at(series, F.when(F.col("__t") >= 0, F.col("__t") + 1).otherwise(F.col("__t")))).withColumnRenamed("__t", "t")
    spread = DENSITIES[kind](x.where(F.col(series).isNotNull()), ["t", *(["group"] if by else [])], series)
    return over_time(df, key, [series], "envelope", by, groups), spread


def extents(df: DataFrame, outcomes: list[str]) -> DataFrame:
    """Limits of each two outcomes over all groups: outcome_x, outcome_y, low_x, high_x, low_y, high_y."""
    row = df.agg(*[F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c in outcomes])
    pair = [F.struct(F.lit(a).alias("outcome_x"), F.lit(b).alias("outcome_y"), F.col(f"{a}.low").alias("low_x"), F.col(f"{a}.high").alias("high_x"), F.col(f"{b}.low").alias("low_y"), F.col(f"{b}.high").alias("high_y"))
            for a in outcomes for b in outcomes if a != b]
    return row.select(F.explode(F.array(*pair)).alias("p")).select("p.*")


def pair_lines(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """The way of each run through two series: key, t, x, y and whether the point is its start or end."""
    z = df.select(key, F.posexplode(F.arrays_zip(F.col(x).alias("x"), F.col(y).alias("y"))).alias("t", "p"), F.greatest(F.size(x), F.size(y)).alias("n"))
    mark = F.when(F.col("t") == 0, "start").when(F.col("t") == F.col("n") - 1, "end")
    return z.select(key, "t", "p.x", "p.y", mark.alias("mark"))


def class_sizes(df: DataFrame, classes: str) -> DataFrame:
    """Class and how many rows it has, as a legend of curves gives it."""
    return df.groupBy(F.col(classes).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
