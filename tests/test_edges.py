"""Constant columns, empty boxes and samples, and runs that are handed on once."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from explorium.operators import analysis as A
from explorium.operators import boxes as B
from explorium.operators import discovery, figures, trees
from explorium.plans import models as M


@pytest.fixture(scope="module")
def flat(spark):
    """A constant, a column that varies, one of zeros, classes and a null."""
    return spark.createDataFrame([(2.0, float(v), 0.0, v % 2, "same") for v in range(6)] + [(None, None, 0.0, 1, "same")], "c double, v double, o double, k int, t string")


def test_bins_of_one_value(flat):
    assert [r.bin for r in A.equal_width(flat, "c", 3).collect()] == [1] * 6 + [None]
    assert [tuple(r) for r in A.histogram(flat, "c").collect()] == [(5, 6, 11.0)]
    assert A.histogram(flat.where("c is null"), "c").collect() == [] and A.equal_width(flat.where("c is null"), "c", 3).first().bin is None
    assert {r.c for r in A.discretize(flat.where("c is not null"), ["c"]).collect()} == {1}
    huge = flat.withColumn("c", F.lit(1e300))
    assert [r.n for r in A.histogram(huge, "c").collect()] == [7] and A.equal_width(huge, "c", 3).select("bin").distinct().count() == 1


def test_densities_of_one_value(flat):
    assert {r.density for r in A.kde(flat, [], "c", 5).collect()} == {None}
    assert {r.density for r in A.kde(flat, ["k"], "c", 5).collect()} == {None} and all(r.density > 0 for r in A.kde(flat.dropna(), ["t"], "v", 5).collect())
    assert A.kde(flat.limit(0), [], "v", 5).collect() == []
    over = flat.withColumn("w", F.when(F.col("k") == 0, 1.0).otherwise(F.col("v")))
    assert {(r.k, r.density is None) for r in figures.kde_over_time(over, "k", "w", 5).collect()} == {(0, True), (1, False)}


def test_scores_of_constant_columns(flat):
    df = flat.dropna()
    told = {r.feature: r.score for r in A.f_regression(df, ["c", "v", "o"], "v").collect()}
    assert (told["c"], told["o"]) == (None, None) and told["v"] > 1e12
    assert {r.score for r in A.f_regression(df, ["v"], "c").collect()} == {None} and A.f_regression(df.limit(2), ["v"], "k").first().score is None
    told = {r.feature: r.score for r in A.f_classif(df.withColumn("same_as_k", F.col("k").cast("double")), ["c", "v", "o", "same_as_k"], "k").collect()}
    assert told["c"] is None and told["o"] is None and told["v"] == pytest.approx(0.375) and told["same_as_k"] == math.inf
    assert A.f_classif(df, ["v"], "t").first().score is None
    told = {r.feature: r.score for r in trees.chi2(df, ["o", "v"], "k").collect()}
    assert told["o"] is None and told["v"] == pytest.approx(2 * 1.5**2 / 7.5)


def test_boxes_and_samples_without_rows(flat):
    row = B.box_stats(flat, "k", {"v": (100.0, 200.0)}).first()
    assert (row.coverage, row.density, row.mass, row.n, row.k) == (0, None, 0, 0, 0)
    row = B.box_stats(flat.limit(0), "k", {"v": (0.0, 1.0)}).first()
    assert (row.density, row.mass, row.n) == (None, None, 0)
    assert discovery.kolmogorov_smirnov(flat, "v", F.lit(True), F.lit(False)) == (0.0, 1.0)


def test_exact_p_equals_enumeration(spark):
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 7), (6, 6), (8, 8)):
        far = []
        for ones in itertools.combinations(range(n + m), n):
            i = j = most = 0
            for k in range(n + m):
                i, j = (i + 1, j) if k in ones else (i, j + 1)
                most = max(most, abs(i * m - j * n))
            far.append(most)
        for d in sorted(set(far)):
            assert discovery.exact_p(d / (n * m), n, m) == pytest.approx(sum(f >= d for f in far) / len(far), abs=1e-12)
    assert discovery.exact_p(0.0, 5, 5) == 1.0
    df = spark.createDataFrame([(0, float(v)) for v in (1, 2, 3, 4, 5)] + [(1, float(v)) for v in (6, 7, 8, 9, 10)], "k int, v double")
    d, p = discovery.kolmogorov_smirnov(df, "v", F.col("k") == 0, F.col("k") == 1)
    assert d == 1 and p == pytest.approx(2 / 252)  # the published value for two samples of five that don't overlap


def test_curves_start_at_zero(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 2.0, "x"), ("b", 3.0, "y"), ("b", 4.0, "x")], "k string, v double, c string")
    told = {(r["class"], r.value): r.f for r in A.cdf_set(df, ["v"], "k").collect()}
    assert told[None, 1.0] == told["a", 1.0] == told["b", 3.0] == 0 and told[None, 4.0] == 0.75 and told["b", 4.0] == 0.5
    assert {(r["class"], r.value): r.f for r in A.cdf_set(df, ["v"], "k", complement=True).collect()}["a", 1.0] == 1
    told = {(r["class"], r.category): (r.share, r.f) for r in A.discrete_cdf_set(df, ["c"], "k").collect()}
    assert told["a", "y"] == (0, 0) and told["b", "x"] == (0.5, 0.5) and told["b", "y"] == (0.5, 1) and told[None, "y"] == (0.25, 0.25)


def test_each_run_is_made_and_handed_on_once(spark):
    made = spark.sparkContext.accumulator(0)

    def f(x):
        made.add(1)
        return {"y": 2 * x}

    runs = M.run(M.Model("f", [M.Outcome("y")], f), spark.range(100).select(F.col("id").alias("experiment_id"), F.col("id").cast("double").alias("x")))
    parts = {}
    M.consumed(runs, lambda df, k: parts.update({k: (df.count(), sorted(map(tuple, df.select("experiment_id", "x", "y").collect())))}), 4)
    assert made.value == 100 and sorted(parts) == [0, 1, 2, 3] and all(n == len(rows) for n, rows in parts.values())
    assert sorted(r for _, rows in parts.values() for r in rows) == [(k, float(k), 2.0 * k) for k in range(100)]
    assert set(runs.columns) == {"experiment_id", "x", "y", "status"}


def test_clash_of_names_is_told(spark):
    design = spark.range(3).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    for model in (M.Model("f", [M.Outcome("y")], lambda x: {"y": x}), M.Model("g", [M.Outcome("y")], expressions={"y": lambda df: df.x})):
        with pytest.raises(ValueError, match="outcomes are columns"):
            M.run(model, design)
