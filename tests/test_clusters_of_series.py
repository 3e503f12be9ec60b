"""Clusters of many runs: by rounds over tables, without a table of pairs, as by one merge after the other."""

import math
import time

import numpy as np
import pyarrow as pa
import pytest

from explorium.operators import analysis as A
from explorium.operators import clustering as C

LINKS = {"average": lambda d: sum(d) / len(d), "complete": max, "single": min}


def far(p, q):
    """The distance of two series, infinite where there is none."""
    if p is None or q is None or len(p) != len(q) or None in p or None in q:
        return math.inf
    rough = [math.dist(x[1:], x[:-1]) for x in (p, q)]
    return math.dist(p, q) * max(rough) / min(rough) if min(rough) > 0 else math.inf


def plain(series, count, linkage):
    """Merges the nearest two, the first of them if several are, until ``count`` are left."""
    groups = [[k] for k in range(len(series))]
    d = [[far(p, q) for q in series] for p in series]
    while len(groups) > max(count, 1):
        _, i, j = min((LINKS[linkage]([d[p][q] for p in groups[i] for q in groups[j]]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[i] += groups.pop(j)
    return {k: g for g, group in enumerate(groups) for k in group}


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    out = [[float(v) for v in rng.normal(size=6)] for _ in range(26)] + [[float(v) for v in rng.normal(size=3)] for _ in range(4)]
    out[9], out[17], out[20], out[25] = out[4], out[4], out[2], out[4]  # copies
    return [*out, [2.0] * 6, None, [1.0, None, 2.0, 0.0, 0.0, 1.0], [], [7.0]]


@pytest.mark.parametrize(("linkage", "most"), [("average", 2), ("complete", 6), ("single", 100)])
def test_series_cluster_as_one_merge_after_the_other(spark, series, monkeypatch, linkage, most):
    monkeypatch.setattr(A, "PAIR_ROWS", 7)  # several blocks
    df = spark.createDataFrame([*((f"k{i:02}", x) for i, x in enumerate(series)), (None, [1.0, 2.0])], "k string, x array<double>").repartition(3)
    for count in (4,) if linkage != "average" else (3, len(series) - 2):
        got = C.series_clusters(df, "k", "x", count, linkage, most).collect()
        assert sorted((r.id, r.cluster) for r in got) == [(f"k{i:02}", c) for i, c in sorted(plain(series, count, linkage).items())]


def test_pairs_of_several_blocks_can_be_used_in_part(spark, series, monkeypatch):
    """What reads some columns of the pairs, or reads them twice, gets them all."""
    monkeypatch.setattr(A, "PAIR_ROWS", 7)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(series)], "k long, x array<double>").repartition(3)
    pairs = A.cid(df, "k", "x")
    assert pairs.selectExpr("a AS id").union(pairs.selectExpr("b AS id")).distinct().count() == len(series)
    assert {r.id: r.cluster for r in C.clusters(pairs, 3).collect()} == plain(series, 3, "average")


def test_one_run_is_a_cluster(spark):
    df = spark.createDataFrame([(5, [1.0, 2.0])], "k long, x array<float>")
    assert [tuple(r) for r in C.series_clusters(df, "k", "x", 4).collect()] == [(5, 0)]
    assert C.series_clusters(df.where("false"), "k", "x", 4).collect() == []


@pytest.mark.parametrize("linkage", ["average", "complete", "single"])
def test_pairs_cluster_by_rounds_as_on_the_driver(spark, linkage):
    x = np.random.default_rng(8).normal(size=(60, 3))
    rows = [(i, j, None if i == 7 else float(np.linalg.norm(x[i] - x[j]))) for i in range(60) for j in range(i + 1, 60)]
    pairs = spark.createDataFrame(rows, "a long, b long, distance double")
    one, many = (C.dendrogram(pairs, linkage, most).orderBy("step").collect() for most in (5000, 8))
    assert len(one) == 59 and [(r.step, r.one, r.other, r.rows) for r in one] == [(r.step, r.one, r.other, r.rows) for r in many]
    assert [r.height for r in one] == pytest.approx([r.height for r in many])


def test_three_thousand_rows_merge_in_seconds():
    """The least of all distances isn't looked for anew at each step."""
    x = np.random.default_rng(2).normal(size=(3000, 2))
    d = np.hypot(*(x[:, None] - x).transpose(2, 0, 1))
    began = time.time()
    steps = C.merges(d)
    assert len(steps) == 2999 and steps[-1][3] == 3000 and time.time() - began < 30


def test_runs_are_sent_a_bounded_number_of_times(spark):
    """Blocks grow instead of becoming more, so what is sent grows with the runs and not with their square."""
    n = A.PAIR_ROWS * 40
    blocks = A.block_count(n, 64)
    runs = spark.range(n).selectExpr("id AS k", f"id % {blocks} AS block")

    def tile(left, right):
        yield pa.table({"rows": [left.num_rows + (0 if left is right else right.num_rows)]})

    assert A.blocks_met(runs, "block", blocks, tile, "rows long").agg({"rows": "sum"}).first()[0] <= A.BLOCKS * n
    assert A.block_count(n, A.BLOCK_VALUES) == n and A.block_count(0, None) == 1


@pytest.mark.parametrize(("linkage", "listed", "most", "few"), [("average", 2, 2, 1), ("average", 1, 8, 0), ("complete", 1, 8, 0), ("single", 1, 8, 0)])
def test_series_cluster_by_lists_without_a_table_of_distances(spark, series, monkeypatch, linkage, listed, most, few):
    """Short lists, clusters that blocks cut and merges of the nearest few by themselves give the same; no round writes a table."""
    monkeypatch.setattr(A, "PAIR_ROWS", 4)
    monkeypatch.setattr(C, "LISTED", 1)
    monkeypatch.setattr(C, "LEAST_LISTED", listed)
    monkeypatch.setattr(C, "FEW_MERGED", few)
    saved, save = [], C.Tables.save
    monkeypatch.setattr(C.Tables, "save", lambda self, df, name, *parts: (saved.append(name), save(self, df, name, *parts))[1])
    df = spark.createDataFrame([(f"k{i:02}", x) for i, x in enumerate(series)], "k string, x array<double>").repartition(3)
    got = C.series_clusters(df, "k", "x", 3, linkage, most).collect()
    assert sorted((r.id, r.cluster) for r in got) == [(f"k{i:02}", c) for i, c in sorted(plain(series, 3, linkage).items())]
    assert not [name for name in saved if name.startswith("rows")] and (few or saved.count("square") > 1)


def test_quick_distances_are_right_to_twelve_digits():
    """Near beside their lengths, far, and too large for a product."""
    x = np.random.default_rng(3).normal(size=(40, 9)) * 10.0 ** np.arange(-2, 7, 1)
    x[20:] = x[:20] * (1 + 1e-9)
    x[39] *= 1e160
    table = pa.table({"x": pa.array(list(x), pa.list_(pa.float64())), "c": np.sqrt((np.diff(x) ** 2).sum(axis=1))})
    with np.errstate(all="ignore"):
        ((_, quick, none),), ((_, slow, also),) = A.far(table, table, 40, quick=True), A.far(table, table, 40)
    assert (none == also).all() and np.allclose(quick, slow, rtol=1e-11, atol=0, equal_nan=True)
