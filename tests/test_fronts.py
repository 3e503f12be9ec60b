"""All fronts against peeling one front after another, and volumes of large fronts."""

import time

import numpy as np
import pytest

from explorium.operators import fronts as FR


def peeled(x):
    """Front of each row, by removing what nothing left beats."""
    out, left, k = np.zeros(len(x), int), np.arange(len(x)), 0
    while len(left):
        k += 1
        y = x[left]
        beaten = ((y[None, :, :] >= y[:, None, :]).all(axis=2) & (y[None, :, :] > y[:, None, :]).any(axis=2)).any(axis=1)
        out[left[~beaten]] = k
        left = left[beaten]
    return out.tolist()


@pytest.mark.parametrize(("d", "levels", "ranges"), [(1, 30, 2), (2, 1000, 1), (2, 25, 4), (3, 1000, 2), (3, 6, 2), (4, 5, 1)])
def test_fronts_equal_peeling(spark, d, levels, ranges):
    x = np.random.default_rng(d * levels).integers(-levels, levels, (300, d)).astype(float)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, " + ", ".join(f"c{k} double" for k in range(d)))
    got = FR.fronts(df, [f"c{k}" for k in range(d)], ranges).orderBy("i").collect()
    assert [r.front for r in got] == peeled(x)


def test_a_chain_and_a_front(spark):
    df = spark.range(200).selectExpr("id AS up", "-id AS down", "7 AS same")
    assert {(r.up, r.front) for r in FR.fronts(df, ["up", "same"], 3).collect()} == {(k, 200 - k) for k in range(200)}
    assert {r.front for r in FR.fronts(df, ["up", "down"], 3).collect()} == {1}
    assert {r.front for r in FR.fronts(df, ["same", "same"]).collect()} == {1}


def test_nulls_ties_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 1.0), (1.0, 1.0), (None, 5.0), (nan, 5.0), (0.0, -0.0), (-0.0, 0.0), (-inf, inf), (-inf, -inf)]
    df = spark.createDataFrame(rows, "a double, b double")
    for ranges in (1, 2):
        got = sorted(((str(r.a), str(r.b), r.front) for r in FR.fronts(df, ["a", "b"], ranges).collect()), key=str)
        assert got == sorted([("1.0", "1.0", 1), ("1.0", "1.0", 1), ("None", "5.0", None), ("nan", "5.0", None), ("0.0", "-0.0", 2), ("-0.0", "0.0", 2), ("-inf", "inf", 1), ("-inf", "-inf", 3)], key=str)
    assert FR.fronts(df.where("false"), ["a", "b"]).collect() == []
    assert [r.front for r in FR.fronts(df.where("a is null"), ["a", "b"]).collect()] == [None]
    with pytest.raises(ValueError):
        FR.fronts(df, [])


def test_ranks_in_three_objectives_are_not_quadratic():
    """Against the plain rule on small cells, and a large cell in seconds; staircases of two values likewise."""
    rng = np.random.default_rng(3)
    for n, levels in ((60, 4), (120, 30), (1, 2)):
        x = np.unique(rng.integers(-levels, levels, (n, 3)).astype(float), axis=0)
        rng.shuffle(x)
        base, want = rng.integers(0, 5, len(x)), {}
        for i in np.lexsort(-x.T[::-1]).tolist():
            want[i] = 1 + max([int(base[i]), *(f for j, f in want.items() if (x[j] >= x[i]).all())])
        assert FR.rank(x, base).tolist() == [want[i] for i in range(len(x))]
        v, f, q = x[:, :2], base + 1, rng.integers(-levels, levels, (40, 2)).astype(float)
        assert FR.above(q, v, f).tolist() == [max([0, *(int(b) for a, b in zip(v, f) if (a >= p).all())]) for p in q]
        kept = FR.staircase(v, f)
        assert FR.above(q, v[kept], f[kept]).tolist() == FR.above(q, v, f).tolist()
    n = 100_000
    x = np.stack([rng.permutation(n), rng.integers(0, 25, n), rng.permutation(n)], axis=1).astype(float)
    start = time.process_time()
    found = FR.rank(x, np.zeros(n, int))
    at = FR.staircase(x[:, [0, 2]], found)
    FR.above(x[:, [0, 2]], x[at][:, [0, 2]], found[at])
    assert time.process_time() - start < 20 and found.min() == 1 and found[x[:, 0].argmax()] == 1
