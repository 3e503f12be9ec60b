"""Boosting, curves, volumes by slices and pastes of whole numbers and categories against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from explorium.functions import curves
from explorium.operators import boosting
from explorium.operators import boxes as B
from explorium.operators import indicators as I


def grown(x, y, w, classes, depth):
    """A plain tree: (column, cut, left, right), or a class."""
    mass = lambda m: [sum(w[i] for i in m if y[i] == c) for c in classes]

    def part(members, level):
        own = mass(members)
        best = None
        if level and sum(v > 0 for v in own) > 1:
            for c in range(len(x[0])):
                values = sorted({x[i][c] for i in members})
                for a, b in zip(values, values[1:]):
                    cut = a + (b - a) / 2
                    sides = [[i for i in members if x[i][c] <= cut], [i for i in members if x[i][c] > cut]]
                    g = sum(sum(v * v for v in mass(s)) / sum(mass(s)) for s in sides)
                    if best is None or (-round(g, 9), c, cut) < best[0]:
                        best = (-round(g, 9), c, cut), sides, g
        if best is None or best[2] - sum(v * v for v in own) / sum(own) <= 1e-12 * sum(own):
            return classes[own.index(max(own))]
        return best[0][1], best[0][2], *[part(s, level - 1) for s in best[1]]

    return part(list(range(len(x))), depth)


def plain_told(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_boosting_equals_a_plain_version(spark):
    rng = np.random.default_rng(5)
    x = [(float(a), float(b)) for a, b in rng.integers(0, 12, (150, 2))]
    y = ["abc"[int((a + 2 * b) % 3 if rng.random() < 0.2 else (a > 5) + (b > 7))] for a, b in x]
    w, errors = [1 / len(x)] * len(x), []
    for _ in range(4):
        tree = grown(x, y, w, ["a", "b", "c"], 2)
        wrong = [plain_told(tree, r) != c for r, c in zip(x, y)]
        e = sum(v for v, bad in zip(w, wrong) if bad) / sum(w)
        errors.append(e)
        w = [v * ((1 - e) / e * 2 if bad else 1) for v, bad in zip(w, wrong)]
        w = [v / sum(w) for v in w]
    df = spark.createDataFrame([(a, b, c) for (a, b), c in zip(x, y)], "p double, q double, y string")
    model, rows = boosting.boost(df, ["p", "q"], "y", rounds=4, depth=2)
    assert model.errors == pytest.approx(errors, abs=1e-9)
    assert sorted(r.w for r in rows.collect()) == pytest.approx(sorted(w), abs=1e-9)
    told = rows.select((model.vote(F.col("x")) == F.col("y")).cast("int").alias("right")).agg(F.avg("right")).first()[0]
    assert told > 0.6 and sum(s for _, s in model.scores()) == pytest.approx(1)


def test_boosting_without_anything_to_learn(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (None, None)], "p double, y string")
    model, rows = boosting.boost(df, ["p"], "y")
    assert model.trees == [] and model.scores() == [("p", 0.0)] and {r[0] for r in rows.select(model.vote(F.col("x"))).collect()} == {"a"}
    alike = spark.createDataFrame([(1.0, "a"), (1.0, "b")], "p double, y string")  # no better than guessing
    assert boosting.boost(alike, ["p"], "y")[0].trees == []
    clear = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (2.0, "b")], "p double, y string")
    model, rows = boosting.boost(clear, ["p"], "y")
    assert model.errors == [0.0] and rows.where(model.vote(F.col("x")) != F.col("y")).count() == 0
    assert boosting.boost(df.where("false"), ["p"], "y")[0].classes == []
    with pytest.raises(ValueError):
        boosting.boost(df, ["p"], "y", rounds=0)


def test_curves(spark):
    df = spark.createDataFrame([(2.0, 0.5, 3.0), (0.5, 0.2, 1.0), (0.0, 0.5, 1.0), (1.0, 1.0, 1.0), (None, 0.5, 1.0)], "k double, m double, top double")
    got = [r[0] for r in df.select(curves.rising(F.col("k"), F.col("m"), F.col("top"), 11)).collect()]
    assert got[2:] == [None] * 3
    for (k, m, top), ys in zip([(2, 0.5, 3), (0.5, 0.2, 1)], got):
        assert ys[0] == 0 and ys[-1] == pytest.approx(top) and ys == sorted(ys)
        assert ys[round(m * 10)] == pytest.approx(top / 2)
        assert ys[3] == pytest.approx(top * 0.3**k / (0.3**k + (m / (1 - m)) ** k * 0.7**k))
    rows = spark.createDataFrame([([0.0, 1.0, 4.0], v) for v in (-1.0, 0.0, 0.25, 0.75, 1.0, 2.0, None, float("nan"))] + [([], 0.5), ([7.0], 0.5), (None, 0.5)], "c array<double>, x double")
    assert [r[0] for r in rows.select(curves.read(F.col("c"), F.col("x"))).collect()] == [0.0, 0.0, 0.5, 2.5, 4.0, 4.0, None, None, None, 7.0, None]
    back = spark.createDataFrame([([0.0, 1.0, 1.0, 4.0], v) for v in (-1.0, 0.5, 1.0, 2.5, 4.0, 5.0, None)], "c array<double>, y double")
    assert [r[0] for r in back.select(curves.inverse(F.col("c"), F.col("y"), 0.0, 3.0)).collect()] == [0.0, 0.5, 1.0, 2.5, 3.0, None, None]


@pytest.mark.parametrize("d", [1, 2, 3, 4])
def test_volumes_by_slices_add_up(spark, d):
    rng = np.random.default_rng(d)
    x = np.round(rng.uniform(-0.1, 1.1, (150, d)), 2 if d < 4 else 1)
    rows = [(g, *map(float, r)) for g in (1, 2) for r in x[: 150 // g]] + [(3, *[1.5] * d), (4, *[None] * d), (None, *[0.5] * d)]
    names = [f"c{k}" for k in range(d)]
    df = spark.createDataFrame(rows, "nfe int, " + ", ".join(f"{c} double" for c in names))
    for most in (10, 10_000):
        got = {r.nfe: r.hypervolume for r in I.hypervolume(df, names, rows=most).collect()}
        assert got == pytest.approx({1: I.volume(x), 2: I.volume(x[:75]), 3: 0.0, 4: 0.0, None: 0.5**d})
    assert I.hypervolume(df.where("false"), names).collect() == []


def test_volume_of_a_large_front(spark):
    """20,000 points that none beats, on x + y + z = 1 and a little around it: close to what lies beyond the plane."""
    u = np.random.default_rng(1).dirichlet([1, 1, 1], 20_000)
    df = spark.createDataFrame([(1, *map(float, r)) for r in u], "nfe int, a double, b double, c double")
    got = I.hypervolume(df, ["a", "b", "c"]).first().hypervolume
    assert 1 - 1 / 6 - 0.02 < got < 1 - 1 / 6 and math.isclose(got, I.hypervolume(df, ["c", "a", "b"], rows=10**6).first().hypervolume, rel_tol=1e-9)


def test_whole_numbers_and_categories_are_pasted(spark):
    rows = [(i, c, 1 if i >= 3 and c != "x" else 0) for i in range(10) for c in "xyz" for _ in range(5)]
    df = spark.createDataFrame(rows, "i long, c string, y int")
    box = {"i": (6, 9), "c": frozenset("y")}
    for compat in (False, True):
        prim = B.Prim(df, "y", ["i", "c"], compat=compat)
        got = prim.pastes(box)
        if compat:
            assert got == []
        else:
            assert ({"i": (5, 9), "c": frozenset("y")}, 25, 1.0) in got and ({"i": (6, 9), "c": frozenset("yz")}, 40, 1.0) in got and ({"i": (6, 9), "c": frozenset("xy")}, 40, 0.5) in got
            assert len(prim.pastes({"i": (0, 9), "c": frozenset("y")})) == 2  # only a category is restricted
        prim.close()
