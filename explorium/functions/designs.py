"""Experimental designs as DataFrames: parameters, samplers and combinations of designs.

A parameter is real, integer or categorical. A design has one row a point, keyed by ``sample_id`` from 0. Monte Carlo
and Latin hypercube points are functions of id and seed, so a row comes out the same however the table is partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Category:
    """A category's name, which designs hold, and the value that a model gets; of a parameter with several variables, a value for each."""

    name: str
    value: object

    @classmethod
    def of(cls, value) -> Category:
        return value if isinstance(value, cls) else cls(str(value), value)


@dataclass(frozen=True)
class Parameter:
    """kind: real, integer (closed range), category or boolean.

    dist: an optional inverse distribution function of a Column in (0, 1), rounded down for integers. categories: plain
    values, or ``Category`` objects. shape: the sides of an array parameter, which is sampled entry by entry.
    """

    name: str
    kind: str = "real"
    lower: float = 0.0
    upper: float = 1.0
    categories: tuple = ()
    resolution: tuple | None = None
    default: object = None
    variables: tuple[str, ...] = ()
    dist: object = field(default=None, compare=False)
    shape: tuple[int, ...] = ()

    def __post_init__(self):
        if self.kind in ("real", "integer") and not self.lower < self.upper:
            raise ValueError(f"{self.name}: the lower bound must be below the upper")
        if self.kind == "integer" and (self.lower != int(self.lower) or self.upper != int(self.upper)):
            raise ValueError(f"{self.name}: integer bounds are asked for")
        if self.kind == "category" and len(self.categories) < 2:
            raise ValueError(f"{self.name}: two categories or more are asked for")
        if self.resolution and self.kind in ("real", "integer") and not all(self.lower <= v <= self.upper for v in self.resolution):
            raise ValueError(f"{self.name}: the resolution must lie within the bounds")

    def levels(self) -> tuple:
        return (False, True) if self.kind == "boolean" else tuple(c.name if isinstance(c, Category) else c for c in self.categories)

    def latent(self) -> list[Parameter]:
        """The parameters that are sampled for this one: itself, or name_0, name_1 ... for the entries of an array."""
        return [replace(self, name=f"{self.name}_{i}", shape=()) for i in range(math.prod(self.shape))] if self.shape else [self]

    def packed(self) -> Column:
        """The parameter out of the columns of its latent ones; the last side runs fastest."""
        if not self.shape:
            return F.col(self.name)
        entries = [F.col(p.name) for p in self.latent()]
        for side in reversed(self.shape):
            entries = [F.array(*entries[k : k + side]) for k in range(0, len(entries), side)]
        return entries[0].alias(self.name)

    def passed(self) -> dict[str, Column]:
        """What a model gets, by variable: of a category its value, one for each variable if there are several."""
        names = self.variables or (self.name,)
        own = [c for c in self.categories if isinstance(c, Category)]
        if self.kind != "category" or not own:
            return {v: F.col(self.name) for v in names}
        many = len(names) > 1
        if many and any(len(c.value) != len(names) for c in own):
            raise ValueError(f"{self.name}: a value for each of {names} is asked for")
        cases = lambda k: F.coalesce(*[F.when(F.col(self.name) == c.name, F.lit(c.value[k] if many else c.value)) for c in own])
        return {v: cases(k) for k, v in enumerate(names)}

    def of_uniform(self, u: Column) -> Column:
        """The value at a share u of the distribution."""
        if self.kind == "real":
            return (self.dist(u) if self.dist else self.lower + u * (self.upper - self.lower)).alias(self.name)
        if self.kind == "integer":
            if self.dist:
                return F.least(F.greatest(F.floor(self.dist(u)), F.lit(int(self.lower))), F.lit(int(self.upper))).cast("long").alias(self.name)
            n = int(self.upper) - int(self.lower) + 1
            return (F.lit(int(self.lower)) + F.greatest(F.ceil(u * n) - 1, F.lit(0))).cast("long").alias(self.name)
        values = self.levels()
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.greatest(F.ceil(u * len(values)), F.lit(1)).cast("int")).alias(self.name)


def triangular(low: float, mode: float, high: float):
    cut = (mode - low) / (high - low)
    return lambda u: F.when(u < cut, low + F.sqrt(u * (high - low) * (mode - low))).otherwise(high - F.sqrt((1 - u) * (high - low) * (high - mode)))


def exponential(scale: float):
    return lambda u: -scale * F.log(1 - u)


def lognormal(mean: float, sd: float):
    """mean and sd are those of the logarithm."""
    inverse = normal(mean, sd)
    return lambda u: F.exp(inverse(u))


def discrete(values: list, weights: list[float] | None = None):
    """Values with shares in proportion to the weights, in the order given."""
    weights = weights or [1.0] * len(values)
    total, run, out = float(sum(weights)), 0.0, []
    for v, w in zip(values, weights, strict=True):
        run += w
        out.append((run / total, v))

    def inverse(u: Column) -> Column:
        case = F.lit(out[-1][1])
        for upto, v in reversed(out[:-1]):
            case = F.when(u <= upto, F.lit(v)).otherwise(case)
        return case

    return inverse


def poisson(mean: float):
    """Counts up to where less than 1e-12 is left."""
    values, shares, p, k = [], [], math.exp(-mean), 0
    while 1 - sum(shares) > 1e-12 and k < 10 * mean + 100:
        values.append(k)
        shares.append(p)
        k += 1
        p *= mean / k
    return discrete(values, shares)


def binomial(n: int, p: float):
    return discrete(list(range(n + 1)), [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])


# fixed values: Wichura's rational approximation (algorithm AS 241) of the standard normal's inverse, constant first
CENTRE = ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
          (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
MIDDLE = ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
          (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
TAIL = ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


def normal(mean: float, sd: float):
    """Exact to about 15 digits, in the tails too."""

    def ratio(tables, x: Column) -> Column:
        over, under = (reduce(lambda acc, c: acc * x + c, reversed(t[:-1]), F.lit(t[-1])) for t in tables)
        return over / under

    def inverse(u: Column) -> Column:
        q = u - 0.5
        r = F.sqrt(-F.log(F.least(u, 1 - u)))
        far = F.signum(q) * F.when(r <= 5, ratio(MIDDLE, r - 1.6)).otherwise(ratio(TAIL, r - 5))
        return mean + sd * F.when(F.abs(q) <= 0.425, q * ratio(CENTRE, 0.180625 - q * q)).otherwise(far)

    return inverse


def uniform(name: str, seed: int, id_col: str = "sample_id") -> Column:
    """In (0, 1), a function of the row's id."""
    return (F.pmod(F.xxhash64(F.lit(f"{seed}:{name}"), F.col(id_col)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def monte_carlo(spark: SparkSession, parameters: list[Parameter], n: int, seed: int = 0) -> DataFrame:
    points = spark.range(n).withColumnRenamed("id", "sample_id")
    return points.select("sample_id", *[p.of_uniform(uniform(p.name, seed)) for p in parameters])


def latin_hypercube(spark: SparkSession, parameters: list[Parameter], n: int, seed: int = 0) -> DataFrame:
    """Each parameter visits each of n equal strata once. The strata are permuted by rounds of invertible steps on the ids, so nothing is sorted or collected."""
    points = spark.range(n).withColumnRenamed("id", "sample_id")
    for p in parameters:
        points = points.withColumn(f"__{p.name}", _permuted(F.col("sample_id"), n, f"{seed}:{p.name}"))
    return points.select("sample_id", *[p.of_uniform((F.col(f"__{p.name}") + uniform(f"jitter {p.name}", seed)) / float(n)) for p in parameters])


def _longs(values: Iterable[int]) -> Column:
    """An array of whole numbers as one literal."""
    return F.expr(f"array({', '.join(f'{int(v)}L' for v in values)})")


def _permuted(i: Column, n: int, seed: str) -> Column:
    """A permutation of 0..n-1, whatever n: in each round, numbers that mirror each other at a drawn point change places or not, as a hash of the pair says."""
    rng = np.random.default_rng([b for b in seed.encode()])
    points = _longs(rng.integers(0, n, 3 * math.ceil(math.log2(max(n, 2)))))
    turns = F.transform(points, lambda k, r: F.struct(k.cast("long").alias("k"), r.alias("r")))

    def turned(x: Column, t: Column) -> Column:
        other = F.pmod(t["k"] - x, F.lit(n))
        return F.when(F.xxhash64(F.lit(seed), t["r"], F.greatest(x, other)).bitwiseAND(1) == 1, other).otherwise(x).cast("long")

    return F.aggregate(turns, i.cast("long"), turned)


def full_factorial(spark: SparkSession, parameters: list[Parameter], n: int) -> DataFrame:
    """All combinations of each parameter's levels: its resolution, its categories, or n values from bound to bound."""

    def levels(p: Parameter) -> list:
        if p.resolution:
            return list(p.resolution)
        if p.kind in ("category", "boolean"):
            return list(p.levels())
        step = (p.upper - p.lower) / max(n - 1, 1)
        points = [p.lower + k * step for k in range(n)]
        return sorted({int(round(v)) for v in points}) if p.kind == "integer" else points

    tables = [levels(p) for p in parameters]
    rows = math.prod(map(len, tables))
    out, below = spark.range(rows).withColumnRenamed("id", "sample_id"), rows
    for p, values in zip(parameters, tables, strict=True):
        below //= len(values)
        place = F.pmod(F.floor(F.col("sample_id") / below), F.lit(len(values))).cast("int")
        out = out.withColumn(p.name, F.element_at(F.array(*[F.lit(v) for v in values]), place + 1))
    return out


def fast(spark: SparkSession, parameters: list[Parameter], n: int, harmonics: int = 4, seed: int = 0) -> DataFrame:
    """Fourier amplitude sensitivity test: n points a parameter along a curve on which that parameter has the highest frequency."""
    d = len(parameters)
    top = (n - 1) // (2 * harmonics)
    rest = max(top // (2 * harmonics), 1)
    low = [int(v) for v in np.linspace(1, rest, d - 1)] if rest >= d - 1 else [k % rest + 1 for k in range(d - 1)]
    rng = np.random.default_rng(seed)
    points = spark.range(n * d).withColumnRenamed("id", "sample_id")
    which = F.floor(F.col("sample_id") / n)
    s = 2 * math.pi / n * F.pmod(F.col("sample_id"), F.lit(n))
    columns = []
    for k, p in enumerate(parameters):
        omega = F.element_at(F.array(*[F.lit(top if r == k else low[k - (k > r)]) for r in range(d)]), (which + 1).cast("int"))
        phase = F.element_at(F.array(*[F.lit(float(v)) for v in rng.uniform(0, 2 * math.pi, d)]), (which + 1).cast("int"))
        columns.append(p.of_uniform(0.5 + F.asin(F.sin(omega * s + phase)) / math.pi))
    return points.select("sample_id", *columns)


#: The initial direction numbers of Joe and Kuo for the second to the 21st dimension.
DIRECTIONS = ((1,), (1, 3), (1, 3, 1), (1, 1, 1), (1, 1, 3, 3), (1, 3, 5, 13), (1, 1, 5, 5, 17), (1, 1, 5, 5, 5), (1, 1, 7, 11, 19), (1, 1, 5, 1, 1), (1, 1, 1, 3, 11), (1, 3, 5, 5, 31),
              (1, 3, 3, 9, 7, 49), (1, 1, 1, 15, 21, 21), (1, 3, 1, 13, 27, 49), (1, 1, 1, 15, 7, 5), (1, 3, 1, 15, 13, 25), (1, 1, 5, 5, 19, 61), (1, 3, 7, 11, 23, 15, 103), (1, 3, 7, 13, 13, 15, 69))
BITS, MOST_DIMENSIONS = 32, 1024


def _primitive(degree: int) -> Iterator[int]:
    """Primitive polynomials over two elements of a degree, as bit patterns in rising order."""
    order = (1 << degree) - 1
    factors, rest, f = set(), order, 2
    while rest > 1:
        if rest % f:
            f = f + 1 if f * f <= rest else rest
        else:
            factors.add(f)
            rest //= f

    def product(a: int, b: int, p: int) -> int:
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a, b = a << 1, b >> 1
            if a >> degree & 1:
                a ^= p
        return out

    def power(n: int, p: int) -> int:
        x, out = 2 if degree > 1 else 1, 1
        while n:
            out = product(out, x, p) if n & 1 else out
            x, n = product(x, x, p), n >> 1
        return out

    for p in range((1 << degree) | 1, 2 << degree, 2):
        if power(order, p) == 1 and all(power(order // f, p) != 1 for f in factors if f != 1 and order > 1):
            yield p


def directions(d: int) -> np.ndarray:
    """Direction numbers of the first d dimensions of a Sobol' sequence, BITS for each.

    Beyond the dimensions of ``DIRECTIONS`` the initial numbers are seeded odd ones, which keeps every dimension a
    sequence that fills equal strata evenly. More than MOST_DIMENSIONS are refused.
    """
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions are asked for, at most {MOST_DIMENSIONS} are known")
    out, rng = [[1 << (BITS - 1 - k) for k in range(BITS)]], np.random.default_rng(7)
    polynomials = (p for degree in range(1, 32) for p in _primitive(degree))
    while len(out) < d:
        p, known = next(polynomials), len(out) - 1
        degree = p.bit_length() - 1
        m = list(DIRECTIONS[known]) if known < len(DIRECTIONS) else [2 * int(rng.integers(0, 1 << k)) + 1 for k in range(degree)]
        for k in range(degree, BITS):
            new = m[k - degree] ^ (m[k - degree] << degree)
            for q in range(1, degree):
                if p >> (degree - q) & 1:
                    new ^= m[k - q] << q
            m.append(new)
        out.append([m[k] << (BITS - 1 - k) for k in range(BITS)])
    return np.array(out[:d], np.int64)


def sobol(index: Column, numbers: Column) -> Column:
    """The middle of the cell of a Sobol' point's coordinate, in (0, 1), from the point's index and the dimension's direction numbers."""
    gray = index.bitwiseXOR(F.shiftright(index, 1))
    bits = F.transform(numbers, lambda v, b: F.when(F.getbit(gray, b) == 1, v).otherwise(F.lit(0).cast("long")))
    return (F.aggregate(bits, F.lit(0).cast("long"), lambda acc, v: acc.bitwiseXOR(v)) + 0.5) / float(1 << BITS)


def sobol_points(spark: SparkSession, parameters: list[Parameter], n: int) -> DataFrame:
    """The first n points of a Sobol' sequence."""
    table = directions(len(parameters))
    points = spark.range(n).withColumnRenamed("id", "sample_id")
    return points.select("sample_id", *[p.of_uniform(sobol(F.col("sample_id"), _longs(table[k]))) for k, p in enumerate(parameters)])


def saltelli(spark: SparkSession, parameters: list[Parameter], n: int, second_order: bool = True) -> DataFrame:
    """n blocks of 2d + 2 rows (d + 2 without second order): A, A with one column of B, B with one column of A, B. A and B are halves of Sobol' points."""
    d = len(parameters)
    rows, table = 2 * d + 2 if second_order else d + 2, directions(2 * d)
    points = spark.range(n * rows).withColumnRenamed("id", "sample_id")
    block, r = F.floor(F.col("sample_id") / rows), F.pmod(F.col("sample_id"), F.lit(rows))

    def numbers(k: int) -> Column:
        other = F.when(r <= d, r == k + 1)
        if second_order:
            other = other.when(r < rows - 1, r != d + k + 1)
        return F.when(other.otherwise(True), _longs(table[d + k])).otherwise(_longs(table[k]))

    return points.select("sample_id", *[p.of_uniform(sobol(block, numbers(k))) for k, p in enumerate(parameters)])


def morris(spark: SparkSession, parameters: list[Parameter], n: int, levels: int = 4, seed: int = 0) -> DataFrame:
    """n trajectories of d + 1 points; each step moves one parameter by levels / (2 (levels - 1)). A point is a function of its id and the seed."""
    d, jump = len(parameters), levels / (2 * (levels - 1))
    points = spark.range(n * (d + 1)).withColumnRenamed("id", "sample_id")
    path, step = F.floor(F.col("sample_id") / (d + 1)), F.pmod(F.col("sample_id"), F.lit(d + 1))
    drawn = lambda what, k: F.xxhash64(F.lit(f"{seed}:{what}:{k}"), path)
    # the order of moves: by a drawn number, then by place
    order = F.array_sort(F.array(*[F.struct(drawn("order", k).alias("h"), F.lit(k).alias("k")) for k in range(d)]))
    points = points.withColumn("__order", F.transform(order, lambda x: x["k"]))
    columns = []
    for k, p in enumerate(parameters):
        low = F.pmod(drawn("base", k), F.lit(levels // 2)) / (levels - 1)
        moved = F.array_position("__order", F.lit(k)) <= step
        up = F.pmod(drawn("way", k), F.lit(2)) == 1
        columns.append(p.of_uniform(low + F.when(up == moved, jump).otherwise(0.0)))
    return points.select("sample_id", *columns)


SAMPLERS = {"mc": monte_carlo, "lhs": latin_hypercube, "ff": full_factorial, "sobol": saltelli, "morris": morris, "fast": fast}


def sample(spark: SparkSession, parameters: list[Parameter], n: int, sampler="lhs", **options) -> DataFrame:
    """A design by a sampler's name, or by a function (spark, parameters, n, **options) of one's own. Array parameters are sampled by entry and packed."""
    draw = SAMPLERS[sampler] if isinstance(sampler, str) else sampler
    df = draw(spark, [q for p in parameters for q in p.latent()], n, **options)
    return df.select("sample_id", *[p.packed() for p in parameters])


def problem(parameters: list[Parameter]) -> dict:
    """Names and unit bounds of what is sampled, as sensitivity tools ask for it."""
    names = [q.name for p in parameters for q in p.latent()]
    return {"num_vars": len(names), "names": names, "bounds": [(0, 1)] * len(names)}


def between(design: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    """Points by number: one, or those from start up to stop, which is left out."""
    return design.where(F.col("sample_id") == start if stop is None else (F.col("sample_id") >= start) & (F.col("sample_id") < stop))


def combine(a: DataFrame, b: DataFrame, how: str = "full_factorial", seed: int = 0) -> DataFrame:
    """Two designs as one. full_factorial: every pair, the left outermost; cycle: the shorter repeats; sample: the shorter is drawn from with replacement."""
    if clash := (set(a.columns) & set(b.columns)) - {"sample_id"}:
        raise ValueError(f"both designs have {sorted(clash)}")
    n, m = a.count(), b.count()
    b = b.withColumnRenamed("sample_id", "__b")
    a = a.withColumnRenamed("sample_id", "__a")
    spark = a.sparkSession
    if how == "full_factorial":
        ids = spark.range(n * m).select(F.col("id").alias("sample_id"), F.floor(F.col("id") / m).alias("__a"), F.pmod("id", F.lit(m)).alias("__b"))
    elif how in ("cycle", "sample"):
        ids = spark.range(max(n, m)).withColumnRenamed("id", "sample_id")
        pick = lambda size, name: F.col("sample_id") if size == max(n, m) else F.pmod("sample_id", F.lit(size)) if how == "cycle" else F.floor(uniform(name, seed) * size)
        ids = ids.select("sample_id", pick(n, "a").cast("long").alias("__a"), pick(m, "b").cast("long").alias("__b"))
    else:
        raise ValueError(f"no way to combine called {how!r}")
    return ids.join(a, "__a").join(b, "__b").drop("__a", "__b")


def concat(designs: list[DataFrame]) -> DataFrame:
    """Rows of designs over the same parameters, numbered anew: each design's ids follow those before it."""
    out, start = [], 0
    for d in designs:
        if set(d.columns) != set(designs[0].columns):
            raise ValueError("the designs have different parameters")
        out.append(d.withColumn("sample_id", F.col("sample_id") + start))
        start += d.count()
    return reduce(DataFrame.unionByName, out)


def experiments(models: DataFrame, policies: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Models by policies by scenarios, in this nesting; each has sample_id and other columns. experiment_id counts from 0."""
    counts = [x.count() for x in (models, policies, scenarios)]
    n_p, n_s = counts[1:]
    ids = models.sparkSession.range(math.prod(counts)).withColumnRenamed("id", "experiment_id")
    ids = ids.select("experiment_id", F.floor(F.col("experiment_id") / (n_p * n_s)).alias("model_id"), F.pmod(F.floor(F.col("experiment_id") / n_s), F.lit(n_p)).alias("policy_id"), F.pmod("experiment_id", F.lit(n_s)).alias("scenario_id"))
    for name, df in (("model_id", models), ("policy_id", policies), ("scenario_id", scenarios)):
        ids = ids.join(df.withColumnRenamed("sample_id", name), name)
    return ids
