"""Exact and random trees against plain growers."""

import math
import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from explorium.operators import forests, trees


def table(spark, n=600, seed=4):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, k = r.randrange(40) / 4, r.choice([0.0, 1.0, 2.5, 2.5]), r.choice("pqrs")
        rows.append((i, a, b, k, "same", int(a > 6) + int(k == "q" and b > 1), 3 * a + (5 if k == "r" else 0) + r.choice([-1, 0, 1])))
    rows += [(1000, None, 1.0, "p", "same", 1, 2.0), (1001, 1.0, 1.0, None, "same", 1, 2.0), (1002, 1.0, 1.0, "p", "same", None, None)]
    return spark.createDataFrame(rows, "id long, a double, b double, k string, c string, y int, z double").repartition(5)


def gini(counts):
    n = sum(counts)
    return n - sum(c * c for c in counts) / n if n else 0.0


def variance(values):
    return sum(v * v for v in values) - sum(values) ** 2 / len(values) if values else 0.0


def impurity(part, classes):
    ys = [y for _, y in part]
    return gini([ys.count(c) for c in classes]) if classes else variance(ys)


def plain_tree(rows, width, classes, least, node=0):
    own = impurity(rows, classes)
    best = None
    if len(rows) >= 2 * least and own > 1e-9:
        for s in range(width):
            values = sorted({x[s] for x, _ in rows})
            for lo, hi in zip(values, values[1:]):
                left, right = [r for r in rows if r[0][s] <= lo], [r for r in rows if r[0][s] > lo]
                if min(len(left), len(right)) >= least:
                    gain = own - impurity(left, classes) - impurity(right, classes)
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, s, lo, hi, left, right
    if best is None or best[0] <= 1e-9:
        return {node: (len(rows), None, None)}
    _, s, lo, hi, left, right = best
    return {node: (len(rows), s, lo + (hi - lo) / 2)} | plain_tree(left, width, classes, least, 2 * node + 1) | plain_tree(right, width, classes, least, 2 * node + 2)


@pytest.mark.parametrize("y, least", [("y", 1), ("y", 25), ("z", 20)])
def test_exact_tree_equals_plain_one(spark, y, least):
    rows, slots = forests.one_hot(table(spark), ["a", "b", "k", "c"], y)
    assert [(s.column, s.level) for s in slots] == [("a", None), ("b", None), ("k", "p"), ("k", "q"), ("k", "r"), ("k", "s"), ("c", "same")]
    data = [(tuple(r.x), r.y) for r in rows.collect()]
    assert len(data) == 600 if y == "y" else 601
    classes = sorted({v for _, v in data}) if y == "y" else []
    got = forests.exact_tree(rows, slots, classes, least)
    want = plain_tree(data, len(slots), classes, least)
    assert {k: (v.n, v.slot, v.cut) for k, v in got.items()} == want and len(want) > 5


def test_exact_cuts_over_whole_lineitem_prices(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_extendedprice", (F.col("l_quantity") > 25).cast("int").alias("y"))
    rows, slots = forests.one_hot(df, ["l_extendedprice"], "y")
    root = forests.exact_tree(rows, slots, [0, 1], 1, depth=1)[0]
    data = sorted((r.x[0], r.y) for r in rows.collect())
    x, y = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    n, ones = np.arange(1, len(x)), np.cumsum(y)[:-1]
    gain = (ones**2 + (n - ones) ** 2) / n + ((y.sum() - ones) ** 2 + (len(x) - n - y.sum() + ones) ** 2) / (len(x) - n)
    gain[x[1:] == x[:-1]] = -1
    at = int(gain.argmax())
    assert len(x) > 5000 and root.edge == (x[at], x[at + 1])


def test_trees_of_odd_tables(spark):
    df = table(spark)
    same = df.withColumn("a", F.lit(1.0)).withColumn("y", F.lit(1))
    for y, classes in (("y", [1]), ("z", [])):
        rows, slots = forests.one_hot(same, ["a", "c"], y, ["id"])
        assert len(forests.exact_tree(rows, slots, classes)) == 1
        model = forests.forest(rows, slots, classes, 3, 1)
        assert set(model.importances.values()) == {0.0} and [len(t.keys) for t in model.trees] == [1, 1, 1]
    rows, slots = forests.one_hot(df.limit(0), ["a", "k"], "y")
    assert forests.exact_tree(rows, slots, []) == {} and forests.forest(rows, slots, [], 2, 1).importances == {"a": 0.0}
    assert forests.oob_score(rows, forests.forest(rows, slots, [], 2, 1)) is None
    with pytest.raises(ValueError):
        forests.one_hot(df, ["k"], "y", most=3)
    with pytest.raises(ValueError):
        trees.Cart(df, "y", ["a"], mode="other")
    with pytest.raises(ValueError):
        trees.forest(df, ["a"], "y", how="other")


def test_leaves_over_categories_name_levels(spark):
    df = table(spark).where("y is not null and a is not null and k is not null")
    tree = trees.Cart(df.withColumn("hit", F.col("k").isin("q", "s").cast("int")), "hit", ["a", "k"])
    boxes = tree.boxes()
    hit = {frozenset(b["k"]) for b, r in zip(boxes, sorted(tree.stats().collect(), key=lambda r: r.leaf)) if r.density == 1}
    assert hit == {frozenset("qs")} and sum(r.mass for r in tree.stats().collect()) == pytest.approx(1)
    assert "k is 'p'" in tree.tree() and tree.tree().count("leaf") == len(boxes)


def plain_forest(data, width, classes, trees_, features, least, seed, bootstrap):
    """The same draws, recursively: nodes by tree, and importances by slot."""
    out, shares = [], np.zeros(width)
    ids = np.array([i for _, _, i in data], np.int64)
    for t in range(trees_):
        w = forests.weights(seed, t, ids) if bootstrap else np.ones(len(ids), int)
        gains, nodes = np.zeros(width), {}

        def grow(rows, node, t=t, w=w, gains=gains, nodes=nodes):
            n = int(sum(w[r] for r in rows))
            wide = np.array([len({data[r][0][s] for r in rows}) > 1 for s in range(width)])
            many = [(data[r][0], data[r][1]) for r in rows for _ in range(w[r])]
            own, best = impurity(many, classes), None
            if n >= max(2, 2 * least) and own > 1e-9:
                order, counts = forests.tried(seed, np.array([t]), np.array([node]), wide[None, :], features)
                for s in order[0][counts[0]].tolist():
                    values = [data[r][0][s] for r in rows]
                    cut = float(forests.random_cuts(seed, np.array([t]), np.array([node]), np.array([s]), np.array([min(values)]), np.array([max(values)]))[0])
                    left, right = [x for x in many if x[0][s] <= cut], [x for x in many if x[0][s] > cut]
                    gain = own - impurity(left, classes) - impurity(right, classes)
                    if min(len(left), len(right)) >= least and (best is None or gain > best[0] + 1e-9):
                        best = gain, s, cut
            nodes[node] = (n, -1 if best is None else best[1])
            if best is not None:
                gains[best[1]] += best[0]
                grow([r for r in rows if data[r][0][best[1]] <= best[2]], 2 * node + 1)
                grow([r for r in rows if data[r][0][best[1]] > best[2]], 2 * node + 2)

        grow([r for r in range(len(data)) if w[r]], 0)
        out.append(nodes)
        shares += gains / gains.sum()
    return out, shares / shares.sum()


@pytest.mark.parametrize("y, bootstrap, least", [("y", True, 1), ("y", False, 9), ("z", True, 5)])
def test_random_trees_equal_plain_ones(spark, y, bootstrap, least):
    rows, slots = forests.one_hot(table(spark, 300), ["a", "b", "k"], y, ["id"])
    data = [(tuple(r.x), r.y, r.id) for r in rows.collect()]
    classes = sorted({v for _, v, _ in data}) if y == "y" else []
    model = forests.forest(rows, slots, classes, 4, 2, least, bootstrap=bootstrap, seed=3)
    nodes, shares = plain_forest(data, len(slots), classes, 4, 2, least, 3, bootstrap)
    assert [{int(k): (int(n), int(s)) for k, n, s in zip(t.keys, t.n, t.slots)} for t in model.trees] == nodes
    assert [model.importances[c] for c in "ab"] == pytest.approx(shares[:2].tolist()) and model.importances["k"] == pytest.approx(shares[2:].sum())
    again = forests.forest(rows.repartition(3), slots, classes, 4, 2, least, bootstrap=bootstrap, seed=3, together=1, most=20)  # one by one, few nodes a pass
    assert [t.keys.tolist() for t in again.trees] == [t.keys.tolist() for t in model.trees] and again.importances == pytest.approx(model.importances)


@pytest.mark.parametrize("y", ["y", "z"])
def test_out_of_bag_score_equals_plain_recomputation(spark, y):
    rows, slots = forests.one_hot(table(spark, 300), ["a", "b", "k"], y, ["id"])
    data = [(tuple(r.x), r.y, r.id) for r in rows.collect()]
    classes = sorted({v for _, v, _ in data}) if y == "y" else []
    model = forests.forest(rows, slots, classes, 6, 2, 2, seed=1)
    ids = np.array([i for *_, i in data], np.int64)
    told = []
    for t, tree in enumerate(model.trees):
        lookup = {int(k): (int(s), c, n, v) for k, s, c, n, v in zip(tree.keys, tree.slots, tree.cuts, tree.n, tree.sums)}
        for r in np.flatnonzero(forests.weights(1, t, ids) == 0):
            k = 0
            while lookup[k][0] >= 0:
                k = 2 * k + (1 if data[r][0][lookup[k][0]] <= lookup[k][1] else 2)
            told.append((r, lookup[k][3] / lookup[k][2] if classes else np.array([lookup[k][3][0] / lookup[k][2]])))
    votes = {r: np.mean([v for q, v in told if q == r], axis=0) for r in {r for r, _ in told}}
    got = forests.oob_score(rows, model)
    if classes:
        assert got == pytest.approx(np.mean([classes[int(np.argmax(v))] == data[r][1] for r, v in votes.items()])) and got > 0.6
    else:
        z = np.array([data[r][1] for r in votes])
        assert got == pytest.approx(1 - sum((data[r][1] - v[0]) ** 2 for r, v in votes.items()) / ((z - z.mean()) ** 2).sum()) and got > 0.6
    assert forests.votes(rows, model).where("voters = 0").count() == len(data) - len(votes)
    with pytest.raises(ValueError):
        forests.oob_score(rows, forests.forest(rows, slots, classes, 1, 2, bootstrap=False))


def test_weights_are_poisson():
    w = forests.weights(5, 2, np.arange(200_000))
    for k in range(4):
        assert (w == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.005)
    assert not (w == forests.weights(5, 3, np.arange(200_000))).all()


def test_scores_find_what_tells(spark):
    df = table(spark).where("y is not null")
    told, model, rows = forests.scores(df, ["a", "b", "k"], "z", classify=False, trees=8, key=["id"])
    assert told.first().feature == "a" and sum(r.score for r in told.collect()) == pytest.approx(1) and forests.oob_score(rows, model) > 0.8


def test_equal_rows_are_read_once(spark, monkeypatch):
    """Levels of a tree hold sums of equal rows: as large as the table is in values, not in rows; a row may stand for several."""
    sizes, save = [], forests.Tables.save

    def saved(self, df, name, *parts):
        out = save(self, df, name, *parts)
        sizes.append((name, out.count()))
        return out

    df = table(spark).where("y is not null and a is not null and k is not null").drop("i")
    rows, slots = forests.one_hot(df, ["b", "k"], "y")
    plain = forests.exact_tree(rows, slots, [0, 1, 2], 25)
    monkeypatch.setattr(forests.Tables, "save", saved)
    assert forests.exact_tree(rows.union(rows), slots, [0, 1, 2], 50).keys() == plain.keys()
    assert all(n <= 12 for name, n in sizes if name.startswith("level"))
    many = forests.exact_tree(forests.folded(rows), slots, [0, 1, 2], 25, many="many")
    assert many == plain and many[0].n == 600


def test_forests_of_equal_rows_are_fitted_on_weights(spark, monkeypatch):
    """The learner gets a row for equal ones; draws don't depend on partitions, and are Poisson."""
    df = table(spark).where("y is not null and a is not null and k is not null").select("b", "k", "y")
    df = reduce(DataFrame.union, [df] * 3)
    seen, learner = [], trees.RandomForestClassifier

    def noted(**options):
        model = learner(**options)
        seen.append(options)
        return model

    monkeypatch.setattr(trees, "RandomForestClassifier", noted)
    one, two = (trees.forest(x, ["b", "k"], "y", trees=5).collect() for x in (df.repartition(3), df.repartition(7, "k")))
    assert one == two and sum(r.score for r in one) == pytest.approx(1) and len(seen) == 10 and {o["weightCol"] for o in seen} == {"w"}
    told = dict(trees.forest(df, ["b", "k"], "y", trees=5, how="extra").collect())
    rows = trees.encoded(df, ["b", "k"], "y")[0]
    assert rows.count() <= 36
    every = rows.select("features", "label", F.explode(F.array_repeat(F.lit(0), F.col("many").cast("int"))))
    assert every.count() == 1800
    same = learner(bootstrap=False, numTrees=5, seed=0, maxBins=256, maxDepth=12, featureSubsetStrategy="1", minInstancesPerNode=1).fit(every).featureImportances.toArray()
    assert [told["b"], told["k"]] == pytest.approx(same.tolist())
    drawn = [r.draws for r in trees.resampled(spark.range(400).selectExpr("id AS features", "1.0D AS label", "id", "50L AS many"), 20, 1).collect()]
    assert np.mean(drawn) == pytest.approx(50, abs=0.5) and np.var(drawn) == pytest.approx(50, abs=3)


def test_forests_read_equal_rows_once(spark, monkeypatch):
    sizes, save = {}, forests.Tables.save

    def saved(self, df, name, *parts):
        out = save(self, df, name, *parts)
        sizes[name] = out.count()
        return out

    rows, slots = forests.one_hot(table(spark, 200), ["b", "k"], "y", ["id"])
    monkeypatch.setattr(forests.Tables, "save", saved)
    one = forests.forest(rows, slots, [0, 1, 2], 2, 2, 20, depth=2, seed=3)
    assert 0 < sizes["sums0"] <= 36 < sizes["rows"]
    monkeypatch.setattr(forests, "SUMS", 0)  # row by row
    two = forests.forest(rows, slots, [0, 1, 2], 2, 2, 20, depth=2, seed=3)
    assert all((getattr(a, c) == getattr(b, c)).all() for a, b in zip(one.trees, two.trees) for c in ("keys", "slots", "cuts", "n", "sums"))
