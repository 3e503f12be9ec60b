"""Sensitivity indices from the runs of the structured designs in ``functions.designs``: aggregates over the order of their ids.

A block (or trajectory, or curve) with a missing or null outcome is left out whole.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from explorium.functions.designs import Parameter


def sobol_indices(df: DataFrame, names: list[str], y: str, second_order: bool = True, key: str = "sample_id") -> DataFrame:
    """first and total share of the variance of each parameter, and of each pair where ``second_order``: columns a, b (null for one), s1, st, s2.

    ``key`` counts the rows of ``designs.saltelli``. One shuffle brings each block's few rows together; the rest is one aggregate row.
    """
    d = len(names)
    size = 2 * d + 2 if second_order else d + 2
    at = F.pmod(F.col(key), F.lit(size))
    block = df.where(F.col(y).isNotNull()).groupBy(F.floor(F.col(key) / size).alias("block")).agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(at == j, F.col(y).cast("double"))).alias(f"y{j}") for j in range(size)])
    block = block.where(F.col("n") == size)
    a, b = F.col("y0"), F.col(f"y{size - 1}")
    ab = [F.col(f"y{1 + k}") for k in range(d)]
    ba = [F.col(f"y{1 + d + k}") for k in range(d)] if second_order else []
    m = block.agg(F.count(F.lit(1)).alias("n"), F.avg((a + b) / 2).alias("mean"), (F.avg(a * a + b * b) / 2).alias("square"))
    x = block.crossJoin(F.broadcast(m.select("mean", (F.col("square") - F.col("mean") * F.col("mean")).alias("v"))))
    mean = F.col("mean")
    aggs = [F.first("v").alias("v")]
    for k in range(d):
        aggs += [F.avg((b - mean) * (ab[k] - a)).alias(f"f{k}"), (F.avg((a - ab[k]) * (a - ab[k])) / 2).alias(f"t{k}")]
    pairs = [(j, k) for j in range(d) for k in range(j + 1, d)] if second_order else []
    aggs += [F.avg((ba[j] - mean) * (ab[k] - mean) - (a - mean) * (b - mean)).alias(f"p{j}_{k}") for j, k in pairs]
    row = x.agg(*aggs)
    v = F.nullif(F.col("v"), F.lit(0.0))
    none = F.lit(None).cast("double")
    one = [F.struct(F.lit(names[k]).alias("a"), F.lit(None).cast("string").alias("b"), (F.col(f"f{k}") / v).alias("s1"), (F.col(f"t{k}") / v).alias("st"), none.alias("s2")) for k in range(d)]
    two = [F.struct(F.lit(names[j]).alias("a"), F.lit(names[k]).alias("b"), none.alias("s1"), none.alias("st"), ((F.col(f"p{j}_{k}") - F.col(f"f{j}") - F.col(f"f{k}")) / v).alias("s2")) for j, k in pairs]
    return row.select(F.explode(F.array(*one, *two)).alias("s")).select("s.*")


def morris_indices(df: DataFrame, parameters: list[Parameter], y: str, levels: int = 4, key: str = "sample_id") -> DataFrame:
    """mu, mu_star and sigma of the elementary effects of each parameter, from the rows of ``designs.morris``."""
    size = len(parameters) + 1
    path = F.floor(F.col(key) / size)
    jump = levels / (2 * (levels - 1))
    w = Window.partitionBy("__path").orderBy(key)
    rank = lambda p: F.array_position(F.array(*[F.lit(v) for v in p.levels()]), F.col(p.name)).cast("double") if p.levels() else F.col(p.name).cast("double")
    x = df.select(key, path.alias("__path"), F.col(y).cast("double").alias("__y"), *[rank(p).alias(p.name) for p in parameters])
    whole = F.count("__y").over(Window.partitionBy("__path")) == size
    x = x.withColumn("__whole", whole).withColumns({f"__d{i}": F.signum(F.col(p.name) - F.lag(p.name).over(w)) for i, p in enumerate(parameters)} | {"__dy": F.col("__y") - F.lag("__y").over(w)})
    steps = F.array(*[F.struct(F.lit(p.name).alias("parameter"), F.col(f"__d{i}").alias("d")) for i, p in enumerate(parameters)])
    long = x.where("__whole and __dy is not null").select("__dy", F.explode(steps).alias("s")).where("s.d <> 0")
    effect = F.col("__dy") / (F.col("s.d") * jump)
    return long.groupBy(F.col("s.parameter").alias("parameter")).agg(F.avg(effect).alias("mu"), F.avg(F.abs(effect)).alias("mu_star"), F.stddev_samp(effect).alias("sigma"))


def fast_indices(df: DataFrame, names: list[str], y: str, n: int, harmonics: int = 4, key: str = "sample_id") -> DataFrame:
    """s1 and st of each parameter from the rows of ``designs.fast`` with n points a curve.

    Powers are squared sums of y by cosine and sine of each needed frequency, summed map-side: those up to half the top
    frequency for the total, its multiples for the first order. The variance is the mean square about the mean.
    """
    top = (n - 1) // (2 * harmonics)
    angle = 2 * math.pi / n * F.pmod(F.col(key), F.lit(n))
    x = df.where(F.col(y).isNotNull()).select(F.floor(F.col(key) / n).cast("int").alias("curve"), angle.alias("s"), F.col(y).cast("double").alias("y"))
    stat = x.groupBy("curve").agg(F.count(F.lit(1)).alias("n"), F.var_pop("y").alias("v")).where(F.col("n") == n)
    need = F.array_distinct(F.concat(F.sequence(F.lit(1), F.lit(max(top // 2, 1))), F.transform(F.sequence(F.lit(1), F.lit(harmonics)), lambda m: m * top)))
    long = x.withColumn("k", F.explode(need)).groupBy("curve", "k").agg(F.sum(F.col("y") * F.cos(F.col("k") * F.col("s"))).alias("c"), F.sum(F.col("y") * F.sin(F.col("k") * F.col("s"))).alias("d"))
    power = 2 * (F.col("c") * F.col("c") + F.col("d") * F.col("d")) / (n * n)
    part = long.groupBy("curve").agg(F.sum(F.when(F.col("k") % top == 0, power)).alias("main"), F.sum(F.when(F.col("k") <= top // 2, power)).alias("others"))
    v = F.nullif(F.col("v"), F.lit(0.0))
    name = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("curve") + 1)
    return part.join(stat, "curve").select(name.alias("parameter"), (F.col("main") / v).alias("s1"), (1 - F.col("others") / v).alias("st"))
