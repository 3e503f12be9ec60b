"""Discovery, trees, sensitivity, indicators, clusters, figures, archives, experiments and search on small known cases."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from explorium.functions import designs as D
from explorium.functions import documents
from explorium.operators import analysis as A
from explorium.operators import boxes as B
from explorium.operators import clustering, discovery, figures, indicators, sensitivity, trees
from explorium.plans import experiments, search
from explorium.plans import models as M
from explorium.sources import archives, results

UNIT = [D.Parameter("a"), D.Parameter("b"), D.Parameter("c")]


def planted(spark, n=3000):
    return D.monte_carlo(spark, UNIT, n).withColumn("y", ((F.col("a") > 0.6) & (F.col("b") < 0.4)).cast("int"))


def test_normal_inverse(spark):
    shares = [1e-12, 1e-6, 0.01, 0.2, 0.5, 0.7, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(u,) for u in shares], "u double")
    for row, u in zip(df.select(D.normal(2, 3)(F.col("u"))).collect(), shares, strict=True):
        assert row[0] == pytest.approx(2 + 3 * NormalDist().inv_cdf(u), rel=1e-9, abs=1e-9)


def test_binomial_tail():
    for n, p in ((1, 0.3), (7, 0.5), (40, 0.05), (200, 0.9)):
        for k in range(n + 2):
            want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1))
            assert discovery.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9, abs=1e-14)


def test_quasi_p_and_dropped_restrictions(spark):
    df = planted(spark)
    prim = B.Prim(df, "y", ["a", "b", "c"])
    found = prim.find_box()
    ps = discovery.quasi_p(df, "y", found.limits, prim.start)
    assert ps["a"][0] < 1e-6 and ps["b"][1] < 1e-6
    last = found.trajectory[-1]
    assert last["coverage"] > 0.6 and last["density"] > 0.9 and last["res_dim"] >= 2
    free = discovery.drop_restriction(prim, found, "a")
    assert free["res_dim"] == last["res_dim"] - 1 and free["density"] < last["density"] and found.trajectory[-1] is free
    assert {"a", "b"} <= set(discovery.significant_dimensions(prim, found))


def test_kolmogorov_smirnov(spark):
    rng = np.random.default_rng(1)
    a, b = np.round(rng.normal(0, 1, 300), 1), np.round(rng.normal(0.5, 1, 200), 1)
    df = spark.createDataFrame([(float(v), 0) for v in a] + [(float(v), 1) for v in b] + [(None, 1)], "v double, k int")
    at = np.unique(np.concatenate([a, b]))
    want = np.abs((a[:, None] <= at).mean(axis=0) - (b[:, None] <= at).mean(axis=0)).max()
    d, p = discovery.kolmogorov_smirnov(df, "v", F.col("k") == 0, F.col("k") == 1)
    assert d == pytest.approx(want) and 0 < p < 0.01
    assert discovery.kolmogorov_smirnov(df.limit(0), "v", F.col("k") == 0, F.col("k") == 1) == (0.0, 1.0)


def test_regression_boxes(spark):
    df = D.monte_carlo(spark, UNIT, 2000).withColumn("z", F.when(F.col("a") > 0.7, 5.0).otherwise(0.0) + F.col("b"))
    high = discovery.RegressionPrim(df, "z", ["a", "b", "c"])
    found = high.find_box()
    assert found.limits["a"][0] > 0.65 and found.trajectory[-1]["mean"] > 5 and high.rmse(found.limits) < 1
    low = discovery.RegressionPrim(df, "z", ["a", "b", "c"], maximize=False).find_box()
    assert low.trajectory[-1]["mean"] < 0.5
    assert discovery.ks_limits(df, "z", {"a": (0.7, high.start["a"][1]), "b": high.start["b"], "c": high.start["c"]}, high.start)["a"][0] < 0.01


def test_constrained_and_resampled(spark):
    df = planted(spark, 1200)
    front = discovery.constrained(df, "y", ["a", "b"], mass_min=0.1)
    assert front and all(p is None or p <= 0.05 for t in front for v in t["p"].values() for p in v)
    assert [t["res_dim"] for t in front] == sorted(t["res_dim"] for t in front)
    shares = discovery.resample(df, "y", ["a", "b", "c"], 0.9, 0.9, iterations=2, mass_min=0.1)
    assert shares["a"][1] == 100 and shares["b"][1] == 100


def test_rotation(spark):
    rng = np.random.default_rng(0)
    t = rng.normal(size=500)
    rows = [(float(v), float(v + e), int(v > 0)) for v, e in zip(t, rng.normal(0, 0.1, 500), strict=True)]
    df = spark.createDataFrame(rows, "p double, q double, y int")
    out, turns = discovery.rotate(df, "y", {"r": ["p", "q"]})
    assert out.columns == ["y", "r_0", "r_1"] and np.allclose(turns["r"] @ turns["r"].T, np.eye(2))
    x = np.array([[r[0], r[1]] for r in rows])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    hit = np.array([r[2] for r in rows]) == 1
    assert sorted(np.linalg.eigvalsh(np.cov(x[hit].T))) == pytest.approx(sorted(out.where("y = 1").agg(F.var_samp("r_0"), F.var_samp("r_1")).first()))
    with pytest.raises(ValueError):
        discovery.rotate(df.withColumn("y", F.lit(2)), "y", {"r": ["p", "q"]})


def test_logit(spark):
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = rng.random(3000) < 1 / (1 + np.exp(-(6 * x[:, 0] - 4 * x[:, 1] - 1)))
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y int")
    model = discovery.Logit(df, "y", ["a", "b", "c"])
    rounds = model.run()
    assert [set(r["columns"]) for r in rounds][:2] == [{"a"}, {"a", "b"}] and rounds[1]["bic"] < rounds[0]["bic"]
    assert rounds[1]["beta"][1] == pytest.approx(6, abs=1) and rounds[1]["beta"][2] == pytest.approx(-4, abs=1)
    rows = model.tradeoff(0.5).orderBy("id").collect()
    assert [r.res_dim for r in rows] == [len(r["columns"]) for r in rounds] and rows[1].density > 0.7


def test_cart(spark):
    df = planted(spark, 1000).withColumn("k", F.when(F.col("a") > 0.6, "x").otherwise("z"))
    tree = trees.Cart(df, "y", ["a", "b"])
    boxes, stats = tree.boxes(), {r.leaf: r for r in tree.stats().collect()}
    assert len(boxes) == len(stats) >= 3 and sum(r.mass for r in stats.values()) == pytest.approx(1)
    assert max(r.density for r in stats.values()) > 0.95 and sum(r.coverage for r in stats.values()) == pytest.approx(1)
    named = trees.Cart(df, "y", ["k", "b"])
    assert any(b["k"] == frozenset("x") for b in named.boxes())
    classes = trees.Cart(df.withColumn("kind", F.concat("k", F.col("y"))), "kind", ["a", "b"], mode="classes")
    assert min(r.gini for r in classes.stats().collect()) < 0.05
    assert len(trees.Cart(df, "a", ["b"], mass_min=0.6, mode="regression").boxes()) == 1


def test_feature_scores(spark):
    df = D.monte_carlo(spark, UNIT, 800).withColumns({"y": (F.col("a") > 0.5).cast("int"), "z": F.col("b") * 2, "k": F.lit("same")})
    first = trees.forest(df, ["a", "b", "c", "k"], "y", trees=20).collect()
    assert first[0].feature == "a" and {r.feature for r in first} == {"a", "b", "c"}
    every = trees.scores_of_all(df, ["a", "b", "c"], ["y", "z"], lambda d, fs, o: trees.forest(d, fs, o, o == "y", trees=10, how="extra"))
    best = {r.feature: r for r in every.collect()}
    assert max(best, key=lambda f: best[f].y) == "a" and max(best, key=lambda f: best[f].z) == "b"
    small = spark.createDataFrame([(1.0, 0), (2.0, 0), (5.0, 1), (6.0, 1)], "x double, y int")
    assert trees.chi2(small, ["x"], "y").first().score == pytest.approx(2 * 4 * 4 / 7)
    pivot, rows, columns = trees.stacking(df, ["a", "b", "c"], "y", levels=1)
    assert (rows, len(columns)) == (["a"], 1) and pivot.count() == 9


def test_sobol_and_fast_and_morris(spark):
    # y = 4a + 2b: variances 16/12 and 4/12
    design = D.saltelli(spark, UNIT, 2048).withColumn("y", 4 * F.col("a") + 2 * F.col("b"))
    out = {(r.a, r.b): r for r in sensitivity.sobol_indices(design, ["a", "b", "c"], "y").collect()}
    for name, want in (("a", 0.8), ("b", 0.2), ("c", 0.0)):
        assert out[name, None].s1 == pytest.approx(want, abs=0.05) and out[name, None].st == pytest.approx(want, abs=0.05)
    assert all(abs(r.s2) < 0.1 for k, r in out.items() if k[1])
    pair = D.saltelli(spark, UNIT[:2], 2048).withColumn("y", (F.col("a") - 0.5) * (F.col("b") - 0.5))
    assert [r.s2 for r in sensitivity.sobol_indices(pair, ["a", "b"], "y").collect() if r.b][0] == pytest.approx(1, abs=0.15)
    curve = D.fast(spark, UNIT, 1025).withColumn("y", 4 * F.col("a") + 2 * F.col("b"))
    found = {r.parameter: r for r in sensitivity.fast_indices(curve, ["a", "b", "c"], "y", 1025).collect()}
    for name, want in (("a", 0.8), ("b", 0.2), ("c", 0.0)):
        assert found[name].s1 == pytest.approx(want, abs=0.05) and found[name].st == pytest.approx(want, abs=0.05)
    paths = D.morris(spark, UNIT, 20).withColumn("y", 4 * F.col("a") - 2 * F.col("b"))
    effect = {r.parameter: r for r in sensitivity.morris_indices(paths, UNIT, "y").collect()}
    assert effect["a"].mu == pytest.approx(4) and effect["b"].mu == pytest.approx(-2) and effect["b"].mu_star == pytest.approx(2) and effect["a"].sigma == pytest.approx(0, abs=1e-9)


def test_indicators(spark):
    ref = spark.createDataFrame([(0.0, 1.0), (0.5, 0.5), (1.0, 0.0)], "x double, y double")
    got = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 0.0), (2, 0.0, 1.0), (2, 0.5, 0.5), (2, 1.0, 0.0)], "nfe int, x double, y double")
    got, ref = indicators.normalized(got, ref, {"x": -1, "y": -1})
    one = lambda df: {r[0]: r[1] for r in df.collect()}
    assert one(indicators.generational_distance(got, ref, ["x", "y"])) == {1: 0, 2: 0}
    gaps = one(indicators.inverted_generational_distance(got, ref, ["x", "y"]))
    assert gaps[1] == pytest.approx(math.sqrt(0.5) / 3) and gaps[2] == 0
    assert one(indicators.epsilon_indicator(got, ref, ["x", "y"])) == {1: 0.5, 2: 0.0}
    assert one(indicators.hypervolume(got, ["x", "y"])) == {1: 0.0, 2: 0.25}
    assert one(indicators.spacing(got, ["x", "y"])) == {1: 0.0, 2: 0.0}
    steps = {r.nfe: r for r in indicators.progress(got, {"x": -1, "y": -1}, [0.1, 0.1]).collect()}
    assert (steps[1].boxes, steps[1].new_boxes, steps[2].boxes, steps[2].new_boxes) == (2, 2, 3, 1)
    points = np.random.default_rng(3).random((6, 3))
    trial = np.random.default_rng(4).random((200_000, 3))
    assert indicators.volume(points) == pytest.approx((points[:, None] <= trial).all(axis=2).any(axis=0).mean(), abs=0.01)


def test_clusters(spark):
    at = [0.0, 1.0, 10.0, 11.5, 30.0]
    rows = [(i, j, abs(at[i] - at[j])) for i in range(5) for j in range(i + 1, 5)]
    df = spark.createDataFrame(rows, "a long, b long, distance double")
    for linkage in ("single", "average", "complete"):
        assert [r.cluster for r in clustering.clusters(df, 3, linkage).orderBy("id").collect()] == [0, 0, 1, 1, 2]
    assert [r.height for r in clustering.dendrogram(df).orderBy("step").collect()] == [1.0, 1.5, 9.0, 18.5]
    for linkage in ("single", "average", "complete"):  # merged by tables as on the driver
        for count in (2, 3) if linkage == "average" else ():
            assert sorted(map(tuple, clustering.clusters(df, count, linkage, most=3).collect())) == sorted(map(tuple, clustering.clusters(df, count, linkage).collect()))
        few, many = clustering.dendrogram(df, linkage), clustering.dendrogram(df, linkage, most=3)
        assert few.dtypes == many.dtypes and [tuple(r) for r in few.orderBy("step").collect()] == [tuple(r) for r in many.orderBy("step").collect()]
    with pytest.raises(ValueError):
        clustering.matrix(df, most=3)


def test_figures(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [*range(1, 10), 40]], "k string, v double")
    box = figures.boxplot(df, ["k"], "v").first()
    assert (box.q1, box.median, box.q3, box.low, box.high, box.outliers) == (3.25, 5.5, 7.75, 1.0, 9.0, 1)
    assert figures.boxplot(df, [], "v").first().median == 5.5
    assert [r.low for r in figures.letter_values(df, ["k"], "v").orderBy("level").collect()][:1] == [3.25]
    assert figures.violin(df, ["k"], "v", 20).count() == 20
    marked = figures.grouped(df, "v", [(0, 5), (5, 40)]).groupBy("group").count().collect()
    assert {r["group"]: r["count"] for r in marked} == {"0-5": 4, "5-40": 6}
    assert figures.grouped(df, "v").count() == 10 and figures.grouped(df, "k", ["g"]).count() == 10
    runs = spark.createDataFrame([(0, 1.0, 2.0, "x"), (1, 3.0, 6.0, "y")], "i int, p double, q double, c string")
    assert figures.pairs(runs, "i", ["p", "q"]).count() == 4
    assert figures.hexbins(runs, "p", "q").agg(F.sum("n")).first()[0] == 2
    assert {(r.axis, r.at) for r in figures.parallel_axes(runs, "i", ["p", "c"]).where("i = 1").collect()} == {("p", 1.0), ("c", 1.0)}
    series = spark.createDataFrame([(0, [1.0, 2.0]), (1, [])], "i int, s array<double>")
    assert [r.s for r in figures.end_state(series, "s").orderBy("i").collect()] == [2.0, None]
    dense = figures.kde_over_time(df.withColumn("t", F.lit(0)), "t", "v", 10)
    assert dense.agg(F.max("density")).first()[0] == 1.0


def test_archive_round_trip(spark, tmp_path):
    rows = [(i, i / 2, i, i % 2 == 0, f"k{i}", float(i), [float(i), 1.0], [[[1.0, float(i)]]]) for i in range(4)]
    df = spark.createDataFrame(rows, "experiment_id long, x double, y long, z boolean, q string, s double, t array<double>, m array<array<array<double>>>")
    path = str(tmp_path / "r.tar.gz")
    archives.save_archive(df, {"s": "ScalarOutcome", "t": "TimeSeriesOutcome", "m": "ArrayOutcome"}, path)
    back = archives.load_archive(spark, path)
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(FileExistsError):
        archives.save_archive(df, {"s": "ScalarOutcome"}, path)


def test_experiments(spark):
    one = M.Model("one", [M.Outcome("y")], lambda x, l: {"y": x + l}, uncertainties=(D.Parameter("x"),), levers=(D.Parameter("l", "integer", 0, 3),))
    two = M.Model("two", [M.Outcome("y"), M.Outcome("w")], lambda x, l, u: {"y": x * l, "w": u}, uncertainties=(D.Parameter("x"), D.Parameter("u", variables=("u",))), levers=one.levers)
    rows = experiments.perform(spark, [one, two], 5, 3).collect()
    assert len(rows) == 30 and {r.experiment_id for r in rows} == set(range(30)) and all(r.status == "ok" for r in rows)
    assert all((r.w is None) == (r.model == "one") for r in rows)
    assert experiments.perform(spark, [one], 5, 3, combine="cycle").count() == 5 and experiments.perform(spark, [one], 5, 3, combine="sample").count() == 5
    fixed = M.Model("fixed", [M.Outcome("y")], lambda x: {"y": x}, uncertainties=(D.Parameter("x", default=0.25),))
    assert experiments.perform(spark, [fixed]).first().y == 0.25
    noisy = M.Model("noisy", [M.Outcome("y")], lambda x, replication: {"y": x + replication}, uncertainties=(D.Parameter("x"),))
    assert all(r.y == pytest.approx([r.x, r.x + 1, r.x + 2]) for r in experiments.perform(spark, [noisy], 4, replications=3).collect())


def test_search(spark):
    model = M.Model("m", [M.Outcome("f"), M.Outcome("g")], expressions={"f": lambda d: d.a * d.a + d.b, "g": lambda d: (d.a - 1) * (d.a - 1) + d.b})
    ps = [D.Parameter("a", "real", -2, 2), D.Parameter("b", "integer", 0, 3)]
    got = search.optimize(spark, search.of_model(model), ps, {"f": -1, "g": -1}, [0.05, 0.05], nfe=400, population=40, seed=1)
    assert len(got.archive) > 4 and all(r[1] == 0 and -0.2 < r[0] < 1.2 for r in got.archive)
    again = search.optimize(spark, search.of_model(model), ps, {"f": -1, "g": -1}, [0.05, 0.05], nfe=400, population=40, seed=1)
    assert again.archive == got.archive and got.convergence[-1]["nfe"] == 400
    reals = [D.Parameter("a", "real", -2, 2), D.Parameter("b", "real", 0, 3)]
    many = search.optimize(spark, search.of_model(model, {"late": F.greatest(F.lit(0.2) - F.col("a"), F.lit(0.0))}), reals, {"f": -1, "g": -1}, [0.05, 0.05], nfe=400, population=40, adaptive=True)
    assert many.archive and all(r[0] >= 0.2 for r in many.archive) and len(many.convergence[-1]) == 9
    scenarios = spark.createDataFrame([(0, 1.0), (1, 3.0)], "sample_id long, s double")
    noisy = M.Model("n", [M.Outcome("f")], expressions={"f": lambda d: d.a * d.s})
    sure = search.optimize(spark, search.robust(noisy, scenarios, {"mean": F.avg("f"), "spread": F.stddev_pop("f")}), reals[:1], {"mean": 1, "spread": -1}, [0.1, 0.1], nfe=120, population=30)
    assert all(r[1] == pytest.approx(2 * r[0]) and r[2] == pytest.approx(abs(r[0])) for r in sure.archive)
    wide = search.explore(spark, search.of_model(model), ps, ["f", "g"], [(0, 10, 1.0), (0, 15, 1.0)], nfe=200, population=40)
    assert sum(r[-1] for r in wide.archive) == 200 and wide.convergence[-1]["cells"] == len(wide.archive) > 10


def test_tables_of_boxes(spark):
    df = planted(spark, 800)
    prim = B.Prim(df, "y", ["a", "b"], mass_min=0.1, update="guivarch")
    one, two = prim.find_box(), prim.find_box()
    assert two.trajectory[0]["n"] == 800 and two.trajectory[0]["k"] < one.trajectory[0]["k"]
    rows = {r.dimension: r for r in discovery.inspect(prim, one.trajectory[-1]).collect()}
    assert rows["a"].p_low < 0.01 and rows["a"].low == one.limits["a"][0]
    assert discovery.boxes_table(prim).columns == ["dimension", "low_0", "high_0", "low_1", "high_1"]
    logit = discovery.Logit(df, "y", ["a", "b"])
    logit.run()
    grid = logit.contours(logit.rounds[-1], "a", "b", 13).agg(F.count("p"), F.min("p"), F.max("p")).first()
    assert grid[0] == 169 and 0 <= grid[1] < 0.1 and 0.8 < grid[2] <= 1


def test_tables_of_parameters_and_outcomes(spark):
    table = spark.createDataFrame([("a", "0", "1.5", None), ("b", "1", "4", None), ("c", "x", "y", "z")], "NAME string, v1 string, v2 string, v3 string")
    assert [(p.name, p.kind) for p in results.parameters_of(table)] == [("a", "real"), ("b", "integer"), ("c", "category")]
    typed = spark.createDataFrame([("a", "real", "0", "2"), ("d", "bool", None, None)], "name string, type string, v1 string, v2 string")
    assert [(p.name, p.kind) for p in results.parameters_of(typed)] == [("a", "real"), ("d", "boolean")]
    named = spark.createDataFrame([("y", "scalar"), ("s", "timeseries")], "name string, type string")
    assert [o.type for o in results.outcomes_of(named)] == ["double", "array<double>"]
    with pytest.raises(ValueError):
        results.outcomes_of(spark.createDataFrame([("y", "odd")], "name string, type string"))


def test_discretize(spark):
    df = spark.createDataFrame([(float(i), i % 5, "abc"[i % 3]) for i in range(100)], "f double, i int, c string")
    for bins, wanted in ((3, (3, 3, 3)), (6, (6, 5, 3))):
        assert A.discretize(df, ["f", "i", "c"], bins).agg(*[F.countDistinct(c) for c in "fic"]).first()[:] == wanted


def test_json_paths(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, 2]}}', 7), (None, 8)], "t string, v long")
    assert [r[0] for r in df.select(documents.set_path(F.col("t"), ("a", "b", 1), F.col("v"))).collect()] == ['{"a": {"b": [1, 7]}}', None]
    with pytest.raises(KeyError):
        documents.replaced('{"a": 1}', ("b",), 2)


def test_limits_of_reals_lie_midway_and_those_of_whole_numbers_are_cut_down(spark):
    df = spark.createDataFrame([(float(v), v, int(v >= 5)) for v in range(100)], "r double, w long, y int")
    for name, wanted in (("r", 5.5), ("w", 5)):
        prim = B.Prim(df, "y", [name], alpha=0.06)
        assert prim.find_box().trajectory[1]["limits"][name][0] == wanted
        prim.close()
