"""Designs, checks of models, selection of boxes, clusters of any size, old archives and streams."""

import io
import math
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from explorium.exceptions import BoxError, ExplorationError
from explorium.functions import designs as D
from explorium.operators import boxes as B
from explorium.operators import clustering as C
from explorium.operators import discovery, figures, trees
from explorium.plans import experiments
from explorium.plans import models as M
from explorium.sources import archives, results
from explorium.streaming import incremental


def test_sobol_points_fill_every_stratum(spark):
    parameters = [D.Parameter(f"p{k}") for k in range(60)]
    x = np.array([list(r)[1:] for r in D.sobol_points(spark, parameters, 64).orderBy("sample_id").collect()])
    assert all(sorted((x[:, k] * 64).astype(int)) == list(range(64)) for k in range(60))
    assert x[:4, :5] * 4 == pytest.approx(np.array([[0] * 5, [2] * 5, [3, 1, 1, 1, 3], [1, 3, 3, 3, 1]]), abs=1e-6)
    with pytest.raises(ValueError):
        D.directions(D.MOST_DIMENSIONS + 1)


def test_saltelli_blocks(spark):
    parameters = [D.Parameter(c) for c in "abc"]
    x = np.array([list(r)[1:] for r in D.saltelli(spark, parameters, 8).orderBy("sample_id").collect()]).reshape(8, 8, 3)
    a, b = x[:, 0], x[:, -1]
    for k in range(3):
        mixed, other = a.copy(), b.copy()
        mixed[:, k], other[:, k] = b[:, k], a[:, k]
        assert (x[:, 1 + k] == mixed).all() and (x[:, 4 + k] == other).all()
    assert (a[1:] != b[1:]).any(axis=1).sum() >= 6
    assert D.saltelli(spark, [D.Parameter(f"p{k}") for k in range(40)], 4).agg(F.min("p39"), F.max("p39")).first()[1] > 0.3


def test_morris_moves_one_parameter_a_step(spark):
    x = np.array([list(r)[1:] for r in D.morris(spark, [D.Parameter(c) for c in "abcd"], 30).orderBy("sample_id").collect()]).reshape(30, 5, 4)
    steps = np.diff(x, axis=1)
    assert ((np.abs(steps) > 1e-9).sum(axis=2) == 1).all() and ((np.abs(steps) > 1e-9).sum(axis=1) == 1).all()
    assert np.abs(steps).max() == pytest.approx(2 / 3) and x.min() >= 0 and x.max() <= 1
    assert len({tuple((np.abs(s) > 1e-9).argmax(axis=1)) for s in steps}) > 5 and (steps > 0).any() and (steps < 0).any()


def test_latin_hypercube_of_many_rows(spark):
    n = 100_003
    one = D.latin_hypercube(spark, [D.Parameter("u"), D.Parameter("v")], n).select(F.floor(F.col("u") * n).alias("i"), F.floor(F.col("v") * n).alias("j"))
    row = one.agg(F.countDistinct("i"), F.countDistinct("j"), F.min("i"), F.max("i"), F.corr("i", "j")).first()
    assert row[:4] == (n, n, 0, n - 1) and abs(row[4]) < 0.02


def test_kinds_of_parameters(spark):
    parameters = [D.Parameter("m", shape=(2, 3)), D.Parameter("k", "integer", 0, 9, dist=D.binomial(9, 0.5)), D.Parameter("w", dist=D.lognormal(0, 1)), D.Parameter("d", "integer", 0, 50, dist=D.poisson(3.0))]
    rows = D.sample(spark, parameters, 2000).collect()
    assert np.array([r.m for r in rows]).shape == (2000, 2, 3) and np.array([r.m for r in rows]).std() == pytest.approx(math.sqrt(1 / 12), abs=0.01)
    assert np.mean([r.k for r in rows]) == pytest.approx(4.5, abs=0.1) and np.var([r.d for r in rows]) == pytest.approx(3, abs=0.3)
    assert np.median([r.w for r in rows]) == pytest.approx(1, abs=0.05)
    assert D.problem(parameters)["names"][:6] == [f"m_{i}" for i in range(6)]
    assert [r.sample_id for r in D.between(D.monte_carlo(spark, [D.Parameter("a")], 10), 3, 6).orderBy("sample_id").collect()] == [3, 4, 5]


def test_categories_are_passed_by_value(spark):
    pair = D.Parameter("route", "category", categories=(D.Category("near", (1.0, 2.0)), D.Category("far", (10.0, 20.0))), variables=("x", "y"))
    model = M.Model("sum", [M.Outcome("s")], lambda x, y: {"s": x + y}, uncertainties=(pair,))
    own = lambda spark, parameters, n: spark.range(n).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 2 == 0, "near").otherwise("far").alias("route"))
    rows = experiments.perform(spark, [model], 4, sampler=own).orderBy("experiment_id").collect()
    assert [(r.route, r.s, r.status) for r in rows] == [("near", 3.0, "ok"), ("far", 30.0, "ok")] * 2


def test_outcomes_are_checked(spark):
    design = spark.createDataFrame([(1.0, "f"), (2.0, "g"), (3.0, "h")], "x double, function string")
    variants = M.Model("v", [M.Outcome("y"), M.Outcome("z", "series")], variants={"f": lambda x: (x, [x, x]), "g": lambda x: {"y": x * 2}})
    rows = M.run(variants, design).orderBy("x").collect()
    assert [(r.y, r.z) for r in rows] == [(1.0, [1.0, 1.0]), (4.0, None), (None, None)] and rows[2].status.startswith("CaseError")
    for wrong in ("text", [1.0]):
        with pytest.raises(Exception, match="should be a number"):
            M.run(M.Model("w", [M.Outcome("y")], lambda x, wrong=wrong: {"y": wrong}), design.select("x")).collect()
    with pytest.raises(Exception, match="should be a collection"):
        M.run(M.Model("w", [M.Outcome("y", "series")], lambda x: {"y": x}), design.select("x")).collect()
    low = M.Constraint("low", ("x",), lambda x: x - 2)
    with pytest.raises(Exception, match="below 0"):
        M.constrained(design, [low]).collect()
    runs, seen = M.counted(M.run(variants, design))
    parts = []
    M.consumed(runs, lambda df, k: parts.append((k, df.count())), 2, "x")
    assert sum(n for _, n in parts) == 3 and len(parts) == 2
    runs.collect()
    assert seen.get["failed"] == 1


def test_boxes_are_selected_until_later_ones_are_found(spark):
    df = D.monte_carlo(spark, [D.Parameter("a"), D.Parameter("b")], 1500).withColumn("y", (F.col("a") > 0.6).cast("int"))
    prim = B.Prim(df, "y", ["a", "b"])
    one = prim.find_box()
    step = one.nearest("coverage", 0.9)
    assert abs(one.trajectory[step]["coverage"] - 0.9) == min(abs(t["coverage"] - 0.9) for t in one.trajectory)
    assert one.select(2) == one.current and one.limits == one.trajectory[2]["limits"]
    prim.find_box()
    with pytest.raises(BoxError):
        one.select(0)
    table = prim.stats().orderBy("box").collect()
    assert len(table) == 2 and table[0]["mean"] == one.current["mean"]
    with pytest.raises(ValueError):
        B.Prim(df, "y", ["a"], objective="other")
    prim.close()


def test_first_peel_by_brute_force(spark):
    rng = np.random.default_rng(5)
    a, w = rng.normal(size=3000).round(3), rng.integers(-40, 40, 3000)
    y = ((a > 0.5) & (w < 10)).astype(int)
    df = spark.createDataFrame([(float(p), int(q), int(r)) for p, q, r in zip(a, w, y)], "a double, w long, y int")
    prim = B.Prim(df, "y", ["a", "w"])
    got = prim.peels(prim.start)

    def cut(x, q):
        x = np.sort(x).astype(float)
        at = (len(x) - 1) * q
        v = x[math.floor(at) if q <= 0.5 else math.ceil(at)]
        beyond = x[x > v].min(initial=np.inf) if q <= 0.5 else x[x < v].max(initial=-np.inf)
        return (v + beyond) / 2 if np.isfinite(beyond) else v

    up, low = cut(a, 0.95), cut(a, 0.05)
    up_w, low_w = int(cut(w, 0.95)), int(cut(w, 0.05))
    want = [("a", (a.min(), up), a <= up), ("a", (low, a.max()), a >= low), ("w", (w.min(), w[w <= up_w].max()), w <= up_w), ("w", (w[w >= low_w].min(), w.max()), w >= low_w)]
    for (box, n, mean), (c, limits, rows) in zip(got, want, strict=True):
        assert box[c] == pytest.approx(limits) and n == rows.sum() and mean == pytest.approx(y[rows].mean())
    prim.close()


@pytest.mark.parametrize("linkage", ["average", "single"])
def test_clusters_by_tables(spark, tmp_path, linkage):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    x = np.random.default_rng(3).normal(size=(9, 2))
    rows = [(i, j, float(np.linalg.norm(x[i] - x[j]))) for i in range(9) for j in range(i + 1, 9)]
    far = spark.createDataFrame(rows, "a long, b long, distance double").coalesce(1)
    if linkage == "average":
        small, large = ({r.id: r.cluster for r in C.clusters(far, 4, linkage, most).collect()} for most in (100, 5))
        assert small == large and set(large.values()) == set(range(4))
    else:
        heights = sorted(r.height for r in C.dendrogram(far, linkage, 5).collect())
        assert heights == pytest.approx(sorted(r.height for r in C.dendrogram(far, linkage).collect()))


def test_scores_and_their_chances(spark):
    assert discovery.f_tail(4.0, 2, 20) == pytest.approx(0.034571613) and discovery.chi2_tail(5.991465, 2) == pytest.approx(0.05) and discovery.chi2_tail(1.0, 3) == pytest.approx(0.8012519569)
    df = D.monte_carlo(spark, [D.Parameter("a"), D.Parameter("b")], 600).withColumn("y", (F.col("a") > 0.5).cast("int")).withColumn("s", F.array(F.col("b"), F.col("a") * 3, F.col("a")))
    table, model = trees.boosted(df, ["a", "b"], "y", rounds=3)
    assert table.first().feature == "a" and model.getNumTrees == 3
    over = trees.scores_over_time(df, ["a", "b"], "s", [0, 1], lambda x, fs, y: trees.chi2(x.withColumn(y, (F.col(y) > 0.5).cast("int")), fs, y))
    assert [(r.t, r.feature) for r in trees.top(over, 1).orderBy("t").collect()] == [(0, "b"), (1, "a")]
    assert trees.outcome_of(df, "y")[2] == "regression" and trees.outcome_of(df, lambda t: t.a > 0.5)[2] == "classification"
    with pytest.raises(TypeError):
        trees.outcome_of(df, 3)


def test_grouped_figures(spark):
    df = spark.createDataFrame([(k, [float(k), k * 2.0, k * 3.0], [1.0, 2.0, float(k)], "ab"[k % 2]) for k in range(12)], "experiment_id long, y array<double>, z array<double>, g string")
    assert figures.over_time(df, "experiment_id", ["y", "z"], "env_lin", "g").count() == 12 * 2 * 3 + 2 * 2 * 3
    env, spread = figures.densities_over_time(df, "experiment_id", "y", [0, -1], "boxplot", "g")
    assert env.count() == 6 and {(r.t, r.group, r.median) for r in spread.collect()} == {(0, "a", 5.0), (0, "b", 6.0), (-1, "a", 15.0), (-1, "b", 18.0)}
    for kind in figures.DENSITIES:
        assert figures.density(df, "y", kind, ["g"]).count() > 0
    ends = figures.pair_lines(df, "experiment_id", "y", "z").where("mark is not null")
    assert ends.count() == 24 and figures.class_sizes(df, "g").count() == 2


def test_old_archives(spark, tmp_path):
    files = {"experiments.csv": "a,c\n0.5,x\n1.5,y\n", "experiments metadata.csv": "a,float64\nc,object\n", "outcomes metadata.csv": "s,(2,)\nt,(2, 3)\nu,(2, 2, 2)\n", "s.csv": "1\n2\n", "t.csv": "1,2,3\n4,5,6\n", "u_0.csv": "1,2\n3,4\n", "u_1.csv": "5,6\n7,8\n"}
    with tarfile.open(f"{tmp_path}/old.tar.gz", "w:gz") as tar:
        for name, text in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    rows = archives.load_old_archive(spark, f"{tmp_path}/old.tar.gz").orderBy("experiment_id").collect()
    assert (rows[1].a, rows[1].c, rows[1].s, rows[1].t, rows[1].u) == (1.5, "y", 2.0, [4.0, 5.0, 6.0], [[3.0, 7.0], [4.0, 8.0]])
    kinds = archives.Kinds({"s": "ScalarOutcome"})
    assert kinds["s"] == "ScalarOutcome" and kinds["other"] == "ArrayOutcome"
    with pytest.raises(ExplorationError):
        kinds.add("s", "ArrayOutcome")


def test_streams_and_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([(k, float(k), f"2024-01-01 00:0{k}:00") for k in range(6)], "experiment_id long, y double, at string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):  # what is there already isn't appended again
        incremental.append_results(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    query = incremental.progress(stream, "at", window="2 minutes").writeStream.format("memory").queryName("told").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.runs for r in spark.table("told").collect()) == [2, 2, 2]
    for nfe in (10, 20):
        results.append_archive(rows.select("y").where(f"y < {nfe // 5}"), nfe, f"{tmp_path}/archives")
    assert {(r.nfe, r["count"]) for r in results.load_archives(spark, f"{tmp_path}/archives").groupBy("nfe").count().collect()} == {(10, 2), (20, 4)}
