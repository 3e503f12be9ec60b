"""Every registered query against its SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from explorium.functions import designs as D
from explorium.operators import analysis as A
from explorium.operators import boxes as B
from explorium.plans import models as M
from explorium.plans import more, registry, rules  # noqa: F401  (more and rules add their queries to the registry)

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def plain(rows):
    fix = lambda v: round(v, 3) if isinstance(v, float) and math.isfinite(v) else [fix(x) for x in v] if isinstance(v, (list, tuple)) else str(v)
    return sorted(([fix(v) for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    got = plain(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    assert got
    if name in registry.ORACLE:
        db = duckdb.connect()
        for t in TABLES:
            db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        out = db.sql(registry.ORACLE[name])
        assert sorted(out.columns) == sorted(df.columns)
        want = plain(tuple(dict(zip(out.columns, r, strict=True))[c] for c in sorted(df.columns)) for r in out.fetchall())
        assert got == want


def test_walked_quantile(spark):
    for values, wanted in (([float(v) for v in range(10)], (8.5, 8.5, 0.5, 0.5)), ([1.0], (1.0,) * 4), ([float(v) for v in range(1, 10) for _ in range(2)], (8.5, 8.5, 1.5, 1.5))):
        df = spark.createDataFrame([(values,)], "v array<double>")
        assert df.select(*[B.walked_quantile(F.col("v"), q) for q in (0.9, 0.95, 0.1, 0.05)]).first()[:] == wanted
        rows = spark.createDataFrame([(v,) for v in values], "v double")
        assert tuple(B.quantile(rows, "v", q) for q in (0.9, 0.95, 0.1, 0.05)) == wanted


def test_boxes(spark):
    df = spark.createDataFrame([(0, 1, 2), (2, 5, 6), (3, 2, 1)], "a long, b long, c long")
    start = B.bounding_box(df)
    assert start == {"a": (0, 3), "b": (1, 5), "c": (1, 6)}
    box = {"a": (0, 2), "b": (1, 5), "c": (1, 2)}
    assert B.normalized(box, start) == {"c": (0.0, 0.2), "a": (0.0, 2 / 3)}
    y = df.withColumn("y", F.when(F.col("a") < 3, 1).otherwise(0))
    row = B.box_stats(y, "y", {"a": (0, 2), "b": (1, 5), "c": (1, 6)}).first()
    assert (row.coverage, row.density, row.n) == (1, 1, 2) and row.mass == pytest.approx(2 / 3)


def test_prim_finds_a_planted_box(spark):
    df = D.monte_carlo(spark, [D.Parameter("a"), D.Parameter("b"), D.Parameter("c")], 4000).withColumn("y", ((F.col("a") > 0.6) & (F.col("b") < 0.3)).cast("int"))
    found = B.Prim(df, "y", ["a", "b", "c"]).find_box()
    assert found.trajectory[-1]["mean"] > 0.95 and found.limits["a"][0] > 0.5 and found.limits["b"][1] < 0.4


def test_samplers(spark):
    p = [D.Parameter("a", "real", 0, 10), D.Parameter("b", "integer", 0, 5), D.Parameter("c", "category", categories=("x", "y"))]
    assert D.saltelli(spark, p, 100).count() == 100 * 8 and D.saltelli(spark, p, 100, False).count() == 100 * 5
    assert D.morris(spark, p, 100).count() == 400 and D.fast(spark, p, 129).count() == 387
    for make in (D.monte_carlo, D.latin_hypercube, D.saltelli, D.morris):
        row = make(spark, p, 100).agg(F.min("a"), F.max("a"), F.min("b"), F.max("b"), F.countDistinct("c")).first()
        assert 0 <= row[0] < 2 and 8 < row[1] <= 10 and row[2] == 0 and row[3] == 5 and row[4] == 2
    for n in (1, 2, 37, 100):
        assert D.latin_hypercube(spark, [D.Parameter("u")], n).select(F.countDistinct(F.floor(F.col("u") * n))).first()[0] == n


def test_runs_that_raise_are_told(spark):
    def f(x):
        return {"y": 1 / x}

    rows = M.run(M.Model("f", [M.Outcome("y")], f), spark.createDataFrame([(0.0,), (2.0,)], "x double")).orderBy("x").collect()
    assert rows[0].y is None and rows[0].status.startswith("ZeroDivisionError") and rows[1].y == 0.5


def test_pareto_of_three(spark):
    df = spark.createDataFrame([(1, 2, 3), (3, 2, 1), (1, 1, 1), (1, 2, 3)], "a int, b int, c int")
    assert sorted(map(tuple, A.pareto(df, ["a", "b", "c"]).collect())) == [(1, 2, 3), (1, 2, 3), (3, 2, 1)]
