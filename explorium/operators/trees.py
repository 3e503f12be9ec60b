"""Trees and forests over experiment tables, and scores of features.

A single tree has exact cuts; ``forests`` also has random ones and out-of-bag votes. The forests and boosted trees here
are grown by the engine's own learner on binned columns, with categories in alphabetical order. A row with a null in a
feature or the outcome is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from explorium.operators import analysis as A
from explorium.operators import boxes as B
from explorium.operators import forests
from explorium.sources.shared import Tables


def encoded(df: DataFrame, features: list[str], y: str) -> tuple[DataFrame, list[str], dict[str, list]]:
    """``features`` as one vector and ``label``, the features with more than one value, and the levels of each category.

    Rows that are equal in all of them are one row, with ``many``: how many they are.
    """
    kinds = dict(df.dtypes)
    whole = df.select(*[F.col(c).cast("string" if kinds[c] in ("string", "boolean") else "double").alias(c) for c in features], F.col(y).alias("__y")).dropna()
    whole = Tables(df.sparkSession, "encoded").save(whole.groupBy(*whole.columns).agg(F.count(F.lit(1)).alias("many")), "rows")
    counts = whole.agg(*[F.approx_count_distinct(c).alias(c) for c in features]).first()
    single = [c for c in features if counts[c] <= 3 and whole.select(c).distinct().limit(2).count() < 2]
    names, levels, columns = [c for c in features if c not in single], {}, []
    for c in names:
        if kinds[c] in ("string", "boolean"):
            model = StringIndexer(inputCol=c, outputCol=f"__{c}", stringOrderType="alphabetAsc").fit(whole)
            whole, levels[c] = model.transform(whole), list(model.labels)
            columns.append(f"__{c}")
        else:
            columns.append(c)
    if kinds[y] in ("string", "boolean"):
        model = StringIndexer(inputCol="__y", outputCol="label", stringOrderType="alphabetAsc").fit(whole.withColumn("__y", F.col("__y").cast("string")))
        whole, levels[y] = model.transform(whole.withColumn("__y", F.col("__y").cast("string"))), list(model.labels)
    else:
        whole = whole.withColumn("label", F.col("__y").cast("double"))
    return VectorAssembler(inputCols=columns, outputCol="features").transform(whole), names, levels


class Cart:
    """A tree whose leaves are boxes of at least ``mass_min`` of the rows. mode: binary, classes or regression.

    Cuts are exact, midway between neighbouring values; categories are split level by level, one against the rest.
    """

    def __init__(self, df: DataFrame, y: str, columns: list[str], mass_min: float = 0.05, mode: str = "binary", max_depth: int = 64):
        if mode not in ("binary", "classes", "regression"):
            raise ValueError(f"no mode called {mode!r}")
        self.df, self.y, self.mode, self.columns = df, y, mode, columns
        self.start = B.bounding_box(df.withColumns({c: F.col(c).cast("string") for c, k in df.dtypes if k == "boolean"}), columns)
        rows, self.slots = forests.one_hot(df, columns, y)
        rows = Tables(df.sparkSession, "cart").save(forests.folded(rows), "rows")
        self.classes = [] if mode == "regression" else sorted(r[0] for r in rows.select("y").distinct().collect())
        self.nodes = forests.exact_tree(rows, self.slots, self.classes, max(1, int(mass_min * (rows.agg(F.sum("many")).first()[0] or 0))), max_depth, many="many")

    def tree(self, node: int = 0, indent: str = "") -> str:
        """The tree as text: a line a node, tests with their limits or levels, leaves with their rows."""
        own = self.nodes.get(node)
        if own is None:
            return ""
        told = ", ".join(f"{v:g}" for v in own.sums) if self.classes else f"{own.sums[0] / own.n:g}"
        if own.slot is None:
            return f"{indent}leaf: {own.n} rows ({told})\n"
        s = self.slots[own.slot]
        yes, no = (f"{s.column} <= {own.cut:g}", f"{s.column} > {own.cut:g}") if s.level is None else (f"{s.column} is not {s.level!r}", f"{s.column} is {s.level!r}")
        return f"{indent}{yes}\n{self.tree(2 * node + 1, indent + '  ')}{indent}{no}\n{self.tree(2 * node + 2, indent + '  ')}"

    def boxes(self) -> list[B.Box]:
        """A box a leaf, from left to right. Limits are closed: the lower end of a right branch is the least value beyond the cut."""
        out, todo = [], [(0, dict(self.start))] if self.nodes else []
        while todo:
            k, box = todo.pop()
            own = self.nodes[k]
            if own.slot is None:
                out.append(box)
                continue
            s = self.slots[own.slot]
            if s.level is None:
                lo, hi = box[s.column]
                below, above = (lo, min(hi, type(hi)(own.edge[0]))), (max(lo, type(lo)(own.edge[1])), hi)
            else:
                below, above = box[s.column] - {s.level}, box[s.column] & {s.level}
            todo += [(2 * k + 2, box | {s.column: above}), (2 * k + 1, box | {s.column: below})]
        return out

    def stats(self) -> DataFrame:
        """One row a leaf. binary: coverage, density, mass; regression: mean, rmse, mass; classes: gini, counts by class, mass."""
        boxes = self.boxes()
        label = F.lit(None).cast("int")
        for i, b in reversed(list(enumerate(boxes))):
            label = F.when(B.in_box(b), F.lit(i)).otherwise(label)
        x = self.df.select(label.alias("leaf"), F.col(self.y).alias("y")).where("leaf is not null")
        total = F.broadcast(x.agg(F.count(F.lit(1)).alias("all"), *([] if self.mode == "classes" else [F.sum("y").alias("ys")])))
        mass = (F.count(F.lit(1)) / F.first("all")).alias("mass")
        sizes = self.df.sparkSession.createDataFrame([(i, len(B.restricted(b, self.start))) for i, b in enumerate(boxes)], "leaf int, res_dim int")
        if self.mode == "binary":
            out = x.crossJoin(total).groupBy("leaf").agg((F.sum("y") / F.greatest(F.first("ys"), F.lit(1))).alias("coverage"), F.avg("y").alias("density"), mass)
        elif self.mode == "regression":
            out = x.crossJoin(total).groupBy("leaf").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("rmse"), mass)
        else:
            n = x.groupBy("leaf", "y").agg(F.count(F.lit(1)).alias("n")).crossJoin(total)
            inside = n.groupBy("leaf").agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("y", "n")))).alias("counts"), F.first("all").alias("all"))
            out = inside.select("leaf", (1 - F.col("sq") / (F.col("k") * F.col("k"))).alias("gini"), "counts", (F.col("k") / F.col("all")).alias("mass"))
        return out.join(F.broadcast(sizes), "leaf")


#: Rows that are equal in all columns, on average, from which trees are fitted on numbers of draws.
ALIKE = 4


def resampled(rows: DataFrame, trees: int, seed: int) -> DataFrame:
    """``features``, ``label`` and ``draws``: how often each tree sees a row (id, many); functions of seed, tree and id.

    Each of the rows that it stands for is drawn a Poisson number of times of mean 1, so all of them a Poisson number of mean ``many``.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            draws = [np.random.default_rng([seed, int(i) & (1 << 64) - 1]).poisson(m, trees).tolist() for i, m in zip(b["id"], b["many"], strict=True)]
            yield pd.DataFrame({"id": b["id"], "label": b["label"], "draws": draws})

    # labels are part of what ids are made of
    told = rows.select("id", "label", "many").mapInPandas(draw, "id long, label double, draws array<long>")
    return rows.join(told, ["id", "label"]).select("features", "label", "draws")


def forest(df: DataFrame, features: list[str], y: str, classify: bool = True, trees: int = 250, max_bins: int = 256, max_depth: int = 12, seed: int = 0, how: str = "forest") -> DataFrame:
    """Importances, largest first. forest: root-many features a split on resampled rows; extra: a third of them on all rows, with larger leaves.

    The learner has no random cuts; ``extra`` keeps the other settings of that method. ``forests.scores`` has them.
    Equal rows are one weighted row to it. Where a row stands for more than ``ALIKE`` on average, a resampled tree is
    fitted by itself, on each row's number of draws: a Poisson number whose mean is the number of rows it stands for.
    """
    if how not in ("forest", "extra"):
        raise ValueError(f"no forest called {how!r}")
    rows, names, levels = encoded(df, features, y)
    n, own = rows.agg(F.sum("many"), F.count(F.lit(1))).first()
    bins = max([max_bins, *(len(v) for c, v in levels.items() if c != y)])
    learner = RandomForestClassifier if classify else RandomForestRegressor
    options = {"maxBins": bins, "maxDepth": max_depth, "featureSubsetStrategy": "sqrt"}
    if how == "extra":
        least = max(1, round(math.sqrt(n) / math.sqrt(1000)))
        # a leaf's least weight; half a row less, as weights are whole
        options |= {"featureSubsetStrategy": str(max(1, round(len(names) / 3))), "minWeightFractionPerNode": min((least - 0.5) / n, 0.499)}
        shares = [learner(bootstrap=False, weightCol="many", numTrees=trees, seed=seed, **options).fit(rows).featureImportances.toArray()]
    elif n <= ALIKE * own:
        every = rows.select("features", "label", F.explode(F.array_repeat(F.lit(0), F.col("many").cast("int"))))
        shares = [learner(bootstrap=True, numTrees=trees, seed=seed, **options).fit(every).featureImportances.toArray()]
    else:
        drawn = resampled(rows.select("features", "label", F.xxhash64(*names, "label").alias("id"), "many"), trees, seed)
        drawn = Tables(df.sparkSession, "forest").save(drawn, "drawn")

        def one(t: int):
            w = drawn.select("features", "label", F.col("draws")[t].cast("double").alias("w")).where("w > 0")
            return learner(bootstrap=False, weightCol="w", numTrees=1, seed=seed * 1_000_003 + t, **options).fit(w).featureImportances.toArray()

        with ThreadPoolExecutor(4) as pool:
            shares = list(pool.map(one, range(trees)))
    told = sum(shares)
    told = told / told.sum() if told.sum() else told
    scores = sorted(zip(names, map(float, told), strict=True), key=lambda s: (-s[1], s[0]))
    return df.sparkSession.createDataFrame(scores, "feature string, score double")


def chi2(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Sum of squared differences of a nonnegative feature's totals by class from what the classes' shares let expect; one pass. Null for a feature that is all zero."""
    parts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("double").alias(c) for c in features])
    long = parts.select(y, "n", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("o")) for c in features])).alias("s")).select("n", "s.*")
    total = long.groupBy("feature").agg(F.sum("n").alias("all"), F.sum("o").alias("sum"))
    e = F.col("n") / F.col("all") * F.col("sum")
    return long.join(F.broadcast(total), "feature").groupBy("feature").agg(F.sum(F.try_divide((F.col("o") - e) * (F.col("o") - e), e)).alias("score"))


def boosted(df: DataFrame, features: list[str], y: str, classify: bool = True, rounds: int = 50, depth: int = 3, rate: float = 0.1, max_bins: int = 256, seed: int = 0) -> tuple[DataFrame, object]:
    """Importances by gradient-boosted trees, largest first, and the model. Classes are two."""
    rows, names, levels = encoded(df, features, y)
    bins = max([max_bins, *(len(v) for c, v in levels.items() if c != y)])
    rows = rows.select("features", "label", F.explode(F.array_repeat(F.lit(0), F.col("many").cast("int"))))
    model = (GBTClassifier if classify else GBTRegressor)(maxIter=rounds, maxDepth=depth, stepSize=rate, maxBins=bins, seed=seed).fit(rows)
    scores = sorted(zip(names, map(float, model.featureImportances.toArray()), strict=True), key=lambda s: (-s[1], s[0]))
    return df.sparkSession.createDataFrame(scores, "feature string, score double"), model


def outcome_of(df: DataFrame, outcome) -> tuple[DataFrame, str, str]:
    """The rows with y, its name, and whether it is to be told as a class or as a number: a column's name is a number's, a function of the table that gives a Column a class's."""
    if isinstance(outcome, str):
        return df.withColumn("y", F.col(outcome).cast("double")), "y", "regression"
    if callable(outcome):
        return df.withColumn("y", outcome(df).cast("string")), "y", "classification"
    raise TypeError("an outcome is a column's name or a function of the table")


def scores_over_time(df: DataFrame, features: list[str], series: str, steps: list[int], score: Callable[[DataFrame, list[str], str], DataFrame]) -> DataFrame:
    """t, feature and score at each of some positions of a series; the table is read once for each."""
    parts = []
    for t in steps:
        at = df.withColumn("__y", F.try_element_at(series, F.lit(t + 1))).where("__y is not null")
        parts.append(score(at.select(*features, "__y"), features, "__y").select(F.lit(t).alias("t"), "feature", "score"))
    return reduce(DataFrame.unionByName, parts)


def top(scores: DataFrame, count: int = 5, by: str = "t") -> DataFrame:
    """The features of the largest scores at each step."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "feature"))
    return scores.withColumn("place", place).where(F.col("place") <= count)


def jumps(df: DataFrame, series: str) -> DataFrame:
    """The rows with ``jump``: the largest rise or fall between neighbours of a series, whichever is larger, with its sign."""
    steps = F.zip_with(F.slice(series, 2, F.greatest(F.size(series) - 1, F.lit(0))), F.slice(series, 1, F.greatest(F.size(series) - 1, F.lit(0))), lambda b, a: b - a)
    high, low = F.array_max(steps), F.array_min(steps)
    return df.withColumn("jump", F.when(F.abs(high) >= F.abs(low), high).otherwise(low))


def scores_of_all(df: DataFrame, features: list[str], outcomes: list[str], score: Callable[[DataFrame, list[str], str], DataFrame]) -> DataFrame:
    """One row a feature, one column an outcome; a feature that an outcome's scores lack is null there."""
    out = None
    for o in outcomes:
        one = score(df, features, o).select("feature", F.col("score").alias(o))
        out = one if out is None else out.join(one, "feature", "full_outer")
    return out


def stacking(df: DataFrame, features: list[str], y: str, levels: int = 3, bins: int = 3, seed: int = 0) -> tuple[DataFrame, list[str], list[str]]:
    """Mean of y over the most important factors, every second one a row factor. Numbers fall into bins of one width."""
    best = [r.feature for r in forest(df, features, y, trees=100, seed=seed, how="extra").limit(2 * levels).collect()]
    rows, columns = best[0::2], best[1::2]
    kinds, x = dict(df.dtypes), df
    for c in best:
        if kinds[c] in ("string", "boolean"):
            continue
        wide = x.select(c).distinct().limit(bins + 1).count()
        if kinds[c] in ("tinyint", "smallint", "int", "bigint") and wide <= bins:
            continue
        x = A.equal_width(x, c, bins).drop(c).withColumnRenamed("bin", c)
    return A.pivot_mean(x, rows, columns, y), rows, columns
