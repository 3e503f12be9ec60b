"""Queries over whole tables, not over some of their ids or labels."""

import math
from itertools import combinations

import pytest

from explorium.plans import more, registry, rules  # noqa: F401  (more and rules add their queries to the registry)


def test_every_supplier_is_a_scenario(spark, tmp_path):
    spark.createDataFrame([(k, f"n{k}") for k in range(3)], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    keys = [*range(150), 155, 400]  # more than a hundred, with gaps
    spark.createDataFrame([(k, f"s{k}") for k in keys], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = registry.QUERIES["join_experiments_whole"](spark, str(tmp_path)).collect()
    assert sorted(r.experiment_id for r in rows) == list(range(2 * 3 * len(keys)))
    assert {(r.model, r.policy, r.scenario) for r in rows} == {(m, f"n{p}", f"s{k}") for m in ("one", "two") for p in range(3) for k in keys}
    assert all(r.scenario == f"s{keys[r.scenario_id]}" and r.experiment_id == (r.model_id * 3 + r.policy_id) * len(keys) + r.scenario_id for r in rows)


@pytest.fixture()
def few_vectors(spark, tmp_path):
    """Vectors of several labels, one of them null, in two far groups that cross the labels."""
    rows = [(k, [float((k * (i + 3) * 7) % 11) + (100.0 * i if k % 2 else 0.0) for i in range(6)], (3, 3, 1, 0, None)[k % 5]) for k in range(15)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return {r[0]: r[1] for r in rows}, str(tmp_path)


def test_all_pairs_of_all_labels(spark, few_vectors):
    vectors, folder = few_vectors
    rough = {k: math.dist(x[1:], x[:-1]) for k, x in vectors.items()}
    want = {(a, b): math.dist(vectors[a], vectors[b]) * max(rough[a], rough[b]) / min(rough[a], rough[b]) if min(rough[a], rough[b]) else None for a, b in combinations(sorted(vectors), 2)}
    got = {(r.a, r.b): r.distance for r in registry.QUERIES["join_cid_whole"](spark, folder).collect()}
    assert got.keys() == want.keys()
    for pair, far in want.items():
        assert got[pair] is None if far is None else got[pair] == pytest.approx(far, abs=2e-5)


def test_vectors_of_all_labels_are_clustered(spark, few_vectors):
    vectors, folder = few_vectors
    rows = registry.QUERIES["cluster_series"](spark, folder).collect()
    assert {r.id for r in rows} == set(vectors) and {r.cluster for r in rows} == {0, 1, 2, 3}


def test_pairs_across_blocks_and_odd_series(spark, monkeypatch):
    """Several blocks give what plain Python gives, bit by bit; series that are null, hold a null, stand still or differ in length have no distance."""
    from explorium.operators import analysis as A

    monkeypatch.setattr(A, "PAIR_ROWS", 7)
    whole = {f"k{i:02}": [math.sin((i + 1) * (k + 1)) * 10**(i % 4) for k in range(9)] for i in range(30)} | {"m1": [1.0, 2.0, 4.0], "m2": [2.0, 1.0, 7.0]}
    odd = {"n0": None, "n1": [1.0, None, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], "n2": [3.0] * 9, "n3": [], "n4": [1.0]}
    df = spark.createDataFrame([*(whole | odd).items(), (None, [1.0] * 9)], "k string, x array<double>").repartition(3)

    def root(p, q):
        total = 0.0
        for u, v in zip(p, q):
            total += (u - v) * (u - v)
        return math.sqrt(total)

    rough = {k: root(x[1:], x[:-1]) for k, x in whole.items()}
    got = {(r.a, r.b): r.distance for r in A.cid(df, "k", "x").collect()}
    assert sorted(got) == list(combinations(sorted(whole | odd), 2))
    for (a, b), far in got.items():
        fits = a in whole and b in whole and len(whole[a]) == len(whole[b])
        assert far == (root(whole[a], whole[b]) * max(rough[a], rough[b]) / min(rough[a], rough[b]) if fits else None)
    assert A.cid(df.where("false"), "k", "x").collect() == []
    plan = A.cid(df, "k", "x")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan  # no join over the order of ids
