"""What surrounds the search for boxes: significance, dropped restrictions, resampling, constrained search, rotation, regression.

Data is only aggregated; limits, counts and test values come to the driver. Rows whose outcome is null count nowhere.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from explorium.operators import boxes as B


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        out = d
        for m in range(1, 100_000):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + top * d, 1 + top / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                out *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return out

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def binomial_tail(k: float, n: float, p: float) -> float:
    """P(X >= k) of n draws at p, as a regularised incomplete beta function, so n may be any size."""
    if k <= 0 or p >= 1:
        return 1.0
    if p <= 0 or k > n:
        return 0.0
    return beta_share(k, n - k + 1, p)


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F >= f) with d1 and d2 degrees of freedom."""
    return beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, d: float) -> float:
    """P(chi squared >= x) with d degrees of freedom: the regularised upper incomplete gamma function by its series or fraction."""
    if x <= 0:
        return 1.0
    a, x = d / 2, x / 2
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an, b = -i * (i - a), b + 2
        d, c = an * d + b, b + an / c
        d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def with_p(scores: DataFrame, tail: Callable[[float], float]) -> DataFrame:
    """Scores, one row a feature, with the chance of as large a score: ``p``."""
    rows = [(r.feature, r.score, None if r.score is None else tail(r.score)) for r in scores.select("feature", "score").collect()]
    return scores.sparkSession.createDataFrame(rows, "feature string, score double, p double")


def _relaxed(box: B.Box, start: B.Box) -> list[tuple[str, int, B.Box]]:
    """The box without one of its limits, for each: dimension, side (0 low or categories, 1 high)."""
    out = []
    for c in B.restricted(box, start):
        if isinstance(box[c], frozenset):
            out.append((c, 0, box | {c: start[c]}))
        else:
            out += [(c, side, box | {c: (start[c][0], box[c][1]) if side == 0 else (box[c][0], start[c][1])}) for side in (0, 1) if box[c][side] != start[c][side]]
    return out


def quasi_p(df: DataFrame, y: str, box: B.Box, start: B.Box) -> dict[str, list[float | None]]:
    """For each restricted dimension, per side, the chance of as many cases of interest in the box at the share seen without that limit.

    None for a side that isn't restricted. One pass over the data.
    """
    relaxed = _relaxed(box, start)
    boxes = [box, *(b for *_, b in relaxed)]
    row = df.agg(*[f for i, b in enumerate(boxes) for f in (F.count_if(B.in_box(b) & F.col(y).isNotNull()).alias(f"t{i}"), F.sum(F.when(B.in_box(b), F.col(y))).alias(f"h{i}"))]).first()
    out: dict[str, list[float | None]] = {c: [None, None] for c, *_ in relaxed}
    for i, (c, side, _) in enumerate(relaxed, 1):
        share = float(row[f"h{i}"] or 0) / row[f"t{i}"] if row[f"t{i}"] else 0.0
        out[c][side] = binomial_tail(float(row["h0"] or 0), row["t0"], share)
    return out


#: Product of two samples' sizes up to which the chance of their statistic is counted exactly, a step each.
EXACT = 1_000_000


def exact_p(d: float, n: int, m: int) -> float:
    """Chance of a two-sample statistic of at least ``d`` for n and m values of one continuous law.

    An order of all values is a path of n steps one way and m the other, all equally likely. The share of paths to a
    place that never were as far apart as ``d`` follows from the shares to the two places before it.
    """
    far = round(d * n * m)
    if far <= 0:
        return 1.0
    inside = np.zeros(m + 1)
    for i in range(n + 1):
        left = 0.0
        for j in range(m + 1):
            if abs(i * m - j * n) >= far:
                left = 0.0
            elif i or j:
                left = (inside[j] * i + left * j) / (i + j)
            else:
                left = 1.0
            inside[j] = left
    return min(max(1.0 - float(inside[m]), 0.0), 1.0)


def kolmogorov_smirnov(df: DataFrame, value: str, first: Column, second: Column, buckets: int = 1000) -> tuple[float, float]:
    """Two-sample statistic and its p-value; ``first`` and ``second`` say which rows belong to each sample. 0 and 1 where a sample has no rows.

    The p-value is exact for samples whose sizes' product is up to ``EXACT``, that of the limiting law beyond.

    Counts are summed over equal values, then run up inside buckets between approximate quantiles, so no task holds all
    values in order; the buckets' totals are the only unpartitioned window. Buckets change no result.
    """
    x = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count_if(first).alias("a"), F.count_if(second).alias("b"))
    cuts = sorted(set(x.agg(F.percentile_approx("v", [k / buckets for k in range(1, buckets)], 10_000)).first()[0] or []))
    edges = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    x = x.withColumn("bucket", F.size(F.filter(edges, lambda e: e <= F.col("v"))))
    sums = x.groupBy("bucket").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("bucket", F.coalesce(F.sum("sa").over(before), F.lit(0)).alias("pa"), F.coalesce(F.sum("sb").over(before), F.lit(0)).alias("pb"))
    total = x.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    inside = Window.partitionBy("bucket").orderBy("v")
    run = x.join(F.broadcast(sums), "bucket").select((F.sum("a").over(inside) + F.col("pa")).alias("ra"), (F.sum("b").over(inside) + F.col("pb")).alias("rb"))
    row = run.crossJoin(F.broadcast(total)).agg(F.max(F.abs(F.try_divide("ra", "ta") - F.try_divide("rb", "tb"))).alias("d"), F.max("ta").alias("n"), F.max("tb").alias("m")).first()
    if row.d is None:
        return 0.0, 1.0
    if row.n * row.m <= EXACT:
        return row.d, exact_p(row.d, row.n, row.m)
    t = row.d * math.sqrt(row.n * row.m / (row.n + row.m))
    p = 1.0 if t < 0.2 else 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))
    return row.d, min(max(p, 0.0), 1.0)


def ks_limits(df: DataFrame, y: str, box: B.Box, start: B.Box) -> dict[str, list[float | None]]:
    """As ``quasi_p`` for a continuous outcome: the p-value of the outcomes in the box against those without one limit."""
    out: dict[str, list[float | None]] = {}
    for c, side, wider in _relaxed(box, start):
        out.setdefault(c, [None, None])[side] = kolmogorov_smirnov(df.where(B.in_box(wider)), y, B.in_box(box), F.lit(True))[1]
    return out


def drop_restriction(prim: B.Prim, found: B.PrimBox, dimension: str) -> dict:
    """The last box of a trajectory with one dimension free again, appended to it."""
    box = found.trajectory[-1]["limits"] | {dimension: prim.start[dimension]}
    return prim.append(found, box)


class RegressionPrim(B.Prim):
    """Boxes of a high (or low) mean of a continuous outcome. A low mean is a high mean of its negative."""

    def __init__(self, df: DataFrame, y: str, columns: list[str], maximize: bool = True, **options):
        self.sign = 1 if maximize else -1
        super().__init__(df.select(*columns, (F.col(y) * self.sign).cast("double").alias(y)), y, columns, **options)

    def entry(self, box: B.Box, n: int, mean: float) -> dict:
        out = super().entry(box, n, mean)
        del out["coverage"], out["density"], out["k"]
        return out | {"mean": mean * self.sign}

    def rmse(self, box: B.Box) -> float | None:
        """Root mean squared difference from the box's mean."""
        return self.df.where(B.in_box(box)).agg(F.stddev_pop(self.y)).first()[0]


def resample(df: DataFrame, y: str, columns: list[str], coverage: float, density: float, iterations: int = 10, share: float = 0.5, seed: int = 0, **options) -> dict[str, tuple[float, float]]:
    """How often (percent) each dimension is restricted by boxes found in halves of the data, at like coverage and at like density.

    A half is the rows whose seeded hash of all columns and of a running number among equal rows falls below the share, so
    a lost task draws the same rows again.
    """
    names = [*columns, y]
    twin = Window.partitionBy(*names).orderBy(F.lit(0))
    rows = df.select(*names).withColumn("__twin", F.row_number().over(twin))
    counts = {c: [0, 0] for c in columns}
    for i in range(iterations):
        draw = (F.pmod(F.xxhash64(F.lit(f"{seed}:{i}"), "__twin", *names), F.lit(1 << 30)) / float(1 << 30)) < share
        prim = B.Prim(rows.where(draw).drop("__twin"), y, columns, **options)
        found = prim.find_box()
        for k, (what, wanted) in enumerate((("coverage", coverage), ("density", density))):
            near = min(found.trajectory, key=lambda t: abs(t[what] - wanted))
            for c in B.restricted(near["limits"], prim.start):
                counts[c][k] += 1
        prim.close()
    return {c: (100 * a / iterations, 100 * b / iterations) for c, (a, b) in counts.items()}


def significant_dimensions(prim: B.Prim, found: B.PrimBox, threshold: float = 0.1) -> list[str]:
    """Dimensions with a limit at or below the threshold anywhere on the trajectory."""
    out = set()
    for t in found.trajectory:
        out |= {c for c, ps in quasi_p(prim.df, prim.y, t["limits"], prim.start).items() if any(p is not None and p <= threshold for p in ps)}
    return sorted(out)


def constrained(df: DataFrame, y: str, columns: list[str], alpha: float = 0.05, **options) -> list[dict]:
    """Boxes of a search over each set of significant dimensions that no other beats in coverage, density and fewness of restrictions.

    Only boxes with every limit significant stand; fewer restrictions come first, then larger coverage. The sets are 2^d - 1 for d significant dimensions.
    """
    whole = B.Prim(df, y, columns, **options)
    searches = [(whole, whole.find_box())]
    dims = significant_dimensions(*searches[0])
    for size in range(1, len(dims) + 1):
        for subset in itertools.combinations(dims, size):
            prim = B.Prim(df, y, list(subset), **options)
            searches.append((prim, prim.find_box()))
    out, seen = [], set()
    for prim, found in searches:
        for t in found.trajectory:
            box = whole.start | t["limits"]
            key = tuple(sorted((c, tuple(sorted(v, key=str)) if isinstance(v, frozenset) else v) for c, v in box.items()))
            ps = quasi_p(prim.df, prim.y, t["limits"], prim.start)
            if key not in seen and not any(p is not None and p > alpha for v in ps.values() for p in v):
                seen.add(key)
                out.append(t | {"limits": box, "p": ps})
    for prim, _ in searches:
        prim.close()
    worth = lambda t: (t["coverage"], t["density"], -t["res_dim"])
    beats = lambda a, b: a != b and all(x >= z for x, z in zip(a, b, strict=True))
    front = [t for t in out if not any(beats(worth(o), worth(t)) for o in out)]
    return sorted(front, key=lambda t: (t["res_dim"], -t["coverage"]))


def rotate(df: DataFrame, y: str, groups: dict[str, list[str]]) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """The columns of each group turned to the principal axes of its cases of interest, as group_0, group_1 ...

    Columns are first scaled by mean and deviation of all rows. One pass gathers the moments; the turn is a projection.
    Signs are fixed by making each axis's largest part positive. Other columns stay.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = [c for cs in groups.values() for c in cs]
    if bad := [c for c in names if not isinstance(kinds[c], T.NumericType)]:
        raise ValueError(f"numeric columns are asked for: {bad}")
    hit = F.col(y) == 1
    wrong = F.count_if(~F.col(y).isin(0, 1)).alias("wrong")
    means = df.agg(wrong, *[f for c in names for f in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    if means.wrong:
        raise ValueError("the outcome must be 0 or 1")
    scaled = {c: (F.col(c) - (means[f"m_{c}"] or 0.0)) / (means[f"s_{c}"] or 1.0) for c in names}
    pairs = [(g, a, b) for g, cs in groups.items() for i, a in enumerate(cs) for b in cs[i:]]
    moments = df.agg(*[F.covar_samp(F.when(hit, scaled[a]), F.when(hit, scaled[b])).alias(f"p{i}") for i, (_, a, b) in enumerate(pairs)]).first()
    out, turns = df, {}
    for g, cs in groups.items():
        cov = np.zeros((len(cs), len(cs)))
        for i, (of, a, b) in enumerate(pairs):
            if of == g:
                cov[cs.index(a), cs.index(b)] = cov[cs.index(b), cs.index(a)] = moments[f"p{i}"] or 0.0
        values, vectors = np.linalg.eigh(cov)
        vectors = vectors[:, np.argsort(values)[::-1]]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(cs))])
        turns[g] = vectors
        out = out.withColumns({f"{g}_{k}": sum((scaled[c] * float(vectors[i, k]) for i, c in enumerate(cs)), F.lit(0.0)) for k in range(len(cs))})
    return out.drop(*names), turns


class Logit:
    """Logistic regression of a 0/1 outcome on columns scaled to 0..1, with columns added while the Bayesian criterion falls.

    All candidates of a round advance together: one Newton step is one job whose tasks each send a gradient, a Hessian and
    a likelihood a candidate. Rows with a null are left out.
    """

    def __init__(self, df: DataFrame, y: str, columns: list[str], threshold: float = 0.95):
        kinds = dict(df.dtypes)
        self.columns = [c for c in columns if kinds[c] != "string"]
        limits = df.agg(*[f for c in self.columns for f in (F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}"))]).first()
        wide = lambda c: (limits[f"hi_{c}"] - limits[f"lo_{c}"]) or 1.0
        scaled = [((F.col(c).cast("double") - limits[f"lo_{c}"]) / wide(c)).alias(c) for c in self.columns]
        for c in columns:  # a category is a column a level, all but the first
            if kinds[c] == "string":
                for v in sorted(r[0] for r in df.select(c).distinct().where(F.col(c).isNotNull()).collect())[1:]:
                    self.columns.append(f"{c}={v}")
                    scaled.append((F.col(c) == v).cast("double").alias(f"{c}={v}"))
        self.df = df.select(*scaled, F.col(y).cast("double").alias("__y")).dropna().persist()
        self.n, self.threshold, self.rounds = self.df.count(), threshold, []

    def close(self) -> None:
        self.df.unpersist()

    def _sums(self, models: list[tuple[list[str], np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        def task(frames):
            held = None
            for f in frames:
                y, part = f["__y"].to_numpy(), []
                for names, beta in models:
                    x = np.column_stack([np.ones(len(f)), *(f[c].to_numpy() for c in names)])
                    z = x @ beta
                    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    part.append(np.concatenate([x.T @ (y - p), (x.T @ (x * (p * (1 - p))[:, None])).ravel(), [float(y @ z - np.logaddexp(0, z).sum())]]))
                held = part if held is None else [a + b for a, b in zip(held, part, strict=True)]
            if held is not None:
                import pandas as pd

                yield pd.DataFrame({"m": np.repeat(np.arange(len(held)), [len(v) for v in held]), "i": np.concatenate([np.arange(len(v)) for v in held]), "v": np.concatenate(held)})

        sums: dict[tuple[int, int], float] = {(r.m, r.i): r.v for r in self.df.mapInPandas(task, "m long, i long, v double").groupBy("m", "i").agg(F.sum("v").alias("v")).collect()}
        out = []
        for m, (names, _) in enumerate(models):
            k = len(names) + 1
            v = np.array([sums.get((m, i), 0.0) for i in range(k + k * k + 1)])
            out.append((v[:k], v[k:-1].reshape(k, k), v[-1]))
        return out

    def fit(self, sets: list[list[str]], steps: int = 30) -> list[tuple[np.ndarray, float]]:
        """Coefficients (intercept first) and log-likelihood of each set of columns. Separable data stops at the last step."""
        betas = [np.zeros(len(s) + 1) for s in sets]
        best = [-math.inf] * len(sets)
        for _ in range(steps):
            sums = self._sums(list(zip(sets, betas, strict=True)))
            moves = [np.linalg.lstsq(h + 1e-12 * np.eye(len(g)), g, rcond=None)[0] for g, h, _ in sums]
            moved = max((float(np.abs(v).max()) for v in moves), default=0.0)
            best = [s[2] for s in sums]
            if moved < 1e-8:
                break
            betas = [b + v * min(1.0, 5 / max(float(np.abs(v).max()), 1e-300)) for b, v in zip(betas, moves, strict=True)]
        return list(zip(betas, best, strict=True))

    def run(self) -> list[dict]:
        chosen, left, score = [], list(self.columns), math.inf
        while left:
            fits = self.fit([[*chosen, c] for c in left])
            bic = [(len(chosen) + 2) * math.log(max(self.n, 1)) - 2 * ll for _, ll in fits]
            k = min(range(len(left)), key=lambda i: (bic[i], left[i]))
            if bic[k] >= score:
                break
            score = bic[k]
            chosen.append(left.pop(k))
            self.rounds.append({"columns": list(chosen), "beta": fits[k][0], "bic": score})
        return self.rounds

    def probability(self, entry: dict) -> Column:
        z = sum((F.col(c) * float(b) for c, b in zip((f"`{c}`" for c in entry["columns"]), entry["beta"][1:], strict=True)), F.lit(float(entry["beta"][0])))
        return 1 / (1 + F.exp(-z))

    def tradeoff(self, threshold: float | None = None) -> DataFrame:
        """Coverage and density of each round's model above the threshold; one pass."""
        cut = self.threshold if threshold is None else threshold
        aggs = []
        for i, e in enumerate(self.rounds):
            hit = self.probability(e) > cut
            tp, all_hit = F.count_if(hit & (F.col("__y") == 1)), F.count_if(hit)
            aggs.append(F.struct(F.lit(i).alias("id"), F.lit(len(e["columns"])).alias("res_dim"), (tp / F.greatest(F.sum("__y"), F.lit(1.0))).alias("coverage"), (tp / F.greatest(all_hit, F.lit(1))).alias("density")).alias(f"r{i}"))
        row = self.df.agg(*aggs)
        return row.select(F.explode(F.array(*[f"r{i}" for i in range(len(aggs))])).alias("r")).select("r.*")

    def contours(self, entry: dict, x: str, y: str, points: int = 121) -> DataFrame:
        """Probabilities on a grid from -0.1 to 1.1 of two scaled columns, all others at their middle: x, y, p."""
        step = 1.2 / (points - 1)
        grid = self.df.sparkSession.range(points * points)
        at = {x: F.floor(F.col("id") / points) * step - 0.1, y: F.pmod("id", F.lit(points)) * step - 0.1}
        out = grid.withColumns({c: at.get(c, F.lit(0.5)) for c in {*entry["columns"], x, y}}).withColumn("p", self.probability(entry))
        return out.select(F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y"), "p")


def inspect(prim: B.Prim, entry: dict) -> DataFrame:
    """A row for each restricted dimension of a trajectory's box: dimension, low, high, members, and the quasi-p of each side (null where not restricted)."""
    ps = quasi_p(prim.df, prim.y, entry["limits"], prim.start)
    rows = []
    for c, p in ps.items():
        v = entry["limits"][c]
        rows.append((c, None, None, sorted(map(str, v)), *p) if isinstance(v, frozenset) else (c, float(v[0]), float(v[1]), None, *p))
    return prim.df.sparkSession.createDataFrame(rows, "dimension string, low double, high double, members array<string>, p_low double, p_high double")


def boxes_table(prim: B.Prim) -> DataFrame:
    """Limits of all boxes found, a row for each dimension that any restricts: dimension, then low and high (or members) as text by box; narrowest in the first box first."""
    dims = {c for f in prim.found for c in B.restricted(f.limits, prim.start)}
    first = B.normalized(prim.found[0].limits, prim.start) if prim.found else {}
    order = [*(c for c in first if c in dims), *sorted(dims - set(first))]
    text = lambda v: ("{" + ", ".join(sorted(map(str, v))) + "}",) * 2 if isinstance(v, frozenset) else (str(v[0]), str(v[1]))
    rows = [(c, *(t for f in prim.found for t in text(f.limits[c]))) for c in order]
    return prim.df.sparkSession.createDataFrame(rows, "dimension string" + "".join(f", low_{i} string, high_{i} string" for i in range(len(prim.found))))
