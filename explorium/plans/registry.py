"""Registered queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from explorium.functions import designs as D
from explorium.operators import analysis as A
from explorium.operators import boxes as B
from explorium.plans import models as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def measured(df: DataFrame, reals: list[str] = (), integers: list[str] = (), levels: list[str] = ()) -> tuple[int, list[D.Parameter]]:
    """Rows of a table, and parameters over what its columns hold: their limits, or their levels in order. One row reaches the driver; levels are few."""
    limits = [f(c).alias(f"{f.__name__}_{c}") for c in (*reals, *integers) for f in (F.min, F.max)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *limits, *[F.array_sort(F.collect_set(c)).alias(f"levels_{c}") for c in levels]).first()
    out = [D.Parameter(c, kind, row[f"min_{c}"], row[f"max_{c}"]) for kind, names in (("real", reals), ("integer", integers)) for c in names]
    return row["n"], out + [D.Parameter(c, "category", categories=tuple(row[f"levels_{c}"])) for c in levels]


@_query("""WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
                n AS (SELECT l_linenumber, row_number() OVER (ORDER BY l_linenumber) - 1 AS j, count(*) OVER () AS nj FROM (SELECT DISTINCT l_linenumber FROM lineitem)),
                f AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS k, count(*) OVER () AS nk FROM (SELECT DISTINCT l_returnflag FROM lineitem))
           SELECT (i * nj + j) * nk + k AS sample_id, round(lo + (hi - lo) * i / 4, 4) AS l_extendedprice, l_linenumber, l_returnflag FROM range(5) t(i), b, n, f""")
def design_full_factorial(spark, d):
    """Five prices between the least and the highest, with every line number and flag there is."""
    _, parameters = measured(_t(spark, d, "lineitem"), ["l_extendedprice"], levels=["l_linenumber", "l_returnflag"])
    return rounded(D.full_factorial(spark, parameters, 5), "l_extendedprice")


@_query()
def design_monte_carlo(spark, d):
    """As many made-up customers as there are real ones, within their limits."""
    n, parameters = measured(_t(spark, d, "customer"), ["c_acctbal"], ["c_nationkey"], ["c_mktsegment"])
    return D.monte_carlo(spark, parameters, n)


@_query("SELECT range AS stratum, 1::BIGINT AS n FROM range((SELECT count(*) FROM customer))")
def design_latin_hypercube_strata(spark, d):
    """A design of a point a customer has one point in each stratum of both columns."""
    n, (x, y) = measured(_t(spark, d, "customer"), ["c_acctbal"], ["c_custkey"])
    y = D.Parameter(y.name, "real", y.lower, y.upper)
    stratum = lambda p: F.floor((F.col(p.name) - p.lower) / (p.upper - p.lower) * n)
    return D.latin_hypercube(spark, [x, y], n).groupBy(stratum(x).alias("stratum")).agg(F.countDistinct(stratum(y)).alias("n"))


@_query()
def design_sobol(spark, d):
    n, parameters = measured(_t(spark, d, "part"), ["p_retailprice"], ["p_size"])
    return D.saltelli(spark, parameters, n)


@_query()
def design_morris(spark, d):
    n, parameters = measured(_t(spark, d, "supplier"), ["s_acctbal"], ["s_nationkey"])
    return D.morris(spark, parameters, n)


@_query()
def design_fast(spark, d):
    n, parameters = measured(_t(spark, d, "customer"), ["c_acctbal"], ["c_nationkey"])
    return D.fast(spark, parameters, n)


@_query("""SELECT m * (SELECT count(*) FROM nation) * (SELECT count(*) FROM supplier) + p * (SELECT count(*) FROM supplier) + s AS experiment_id, m AS model_id, p AS policy_id, s AS scenario_id, n_name AS policy, s_name AS scenario, ['one', 'two'][m + 1] AS model
           FROM range(2) t(m), (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS p, n_name FROM nation),
                (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS s, s_name FROM supplier)""")
def join_experiments(spark, d):
    """Every supplier is a scenario and every nation a policy; keys may have gaps."""

    def numbered(name: str, key: str, *columns):
        return A.ranked(_t(spark, d, name), [], key).select(F.col("__rank").cast("long").alias("sample_id"), *columns)

    models = spark.range(2).select(F.col("id").alias("sample_id"), F.element_at(F.array(F.lit("one"), F.lit("two")), (F.col("id") + 1).cast("int")).alias("model"))
    return D.experiments(models, numbered("nation", "n_nationkey", F.col("n_name").alias("policy")), numbered("supplier", "s_suppkey", F.col("s_name").alias("scenario")))


# the name under which the query over every supplier was first registered
QUERIES["join_experiments_whole"], ORACLE["join_experiments_whole"] = QUERIES["join_experiments"], ORACLE["join_experiments"]


@_query("""WITH n AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation), r AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS j, count(*) OVER () AS m FROM region)
           SELECT i AS sample_id, n_name, r_name FROM n JOIN r ON j = i % m""")
def join_cycle(spark, d):
    """Nations in order, with regions that begin anew."""
    numbered = lambda name, key, c: A.ranked(_t(spark, d, name), [], key).select(F.col("__rank").cast("long").alias("sample_id"), c)
    return D.combine(numbered("nation", "n_nationkey", "n_name"), numbered("region", "r_regionkey", "r_name"), "cycle")


@_query("""SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
           WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.06 AND l_returnflag IN ('A', 'R')""")
def filter_in_box(spark, d):
    box = {"l_quantity": (10, 20), "l_discount": (0.02, 0.06), "l_returnflag": frozenset("AR")}
    return _t(spark, d, "lineitem").where(B.in_box(box)).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@_query("""SELECT min(l_quantity) AS lo_quantity, max(l_quantity) AS hi_quantity, min(l_tax) AS lo_tax, max(l_tax) AS hi_tax,
                  list_sort(list(DISTINCT l_returnflag))::VARCHAR[] AS flags FROM lineitem""")
def box_bounds(spark, d):
    box = B.bounding_box(_t(spark, d, "lineitem").select("l_quantity", "l_tax", "l_returnflag"))
    row = (*map(float, box["l_quantity"]), *map(float, box["l_tax"]), sorted(box["l_returnflag"]))
    return spark.createDataFrame([row], "lo_quantity double, hi_quantity double, lo_tax double, hi_tax double, flags array<string>")


_STEEP = "(CASE WHEN l_extendedprice > 50000 THEN 1 ELSE 0 END)"


@_query(f"""SELECT round(count_if(b AND y = 1)::DOUBLE / greatest(sum(y), 1), 6) AS coverage, round(count_if(b AND y = 1)::DOUBLE / count_if(b), 6) AS density,
                   round(count_if(b)::DOUBLE / count(*), 6) AS mass, count_if(b)::BIGINT AS n, count_if(b AND y = 1)::BIGINT AS k
            FROM (SELECT {_STEEP} AS y, l_quantity BETWEEN 30 AND 50 AND l_returnflag IN ('N') AS b FROM lineitem)""")
def agg_box_stats(spark, d):
    df = _t(spark, d, "lineitem").withColumn("y", F.expr(_STEEP))
    return rounded(B.box_stats(df, "y", {"l_quantity": (30, 50), "l_returnflag": frozenset("N")}), "coverage", "density", "mass", digits=6)


@_query("""SELECT o_orderpriority AS policy, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, round(avg(o_totalprice) / stddev_pop(o_totalprice), 4) AS mean_std
           FROM orders GROUP BY 1""")
def agg_robustness(spark, d):
    return rounded(A.robustness(_t(spark, d, "orders").withColumnRenamed("o_orderpriority", "policy"), "policy", "o_totalprice"), "mean", "std", "mean_std")


@_query("SELECT event_type, date_trunc('day', ts) AS t, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def agg_envelope(spark, d):
    return A.envelope(_t(spark, d, "events").withColumn("t", F.date_trunc("day", "ts")), ["event_type"], "t", "value")


@_query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings)
           SELECT label, t::INT AS t, round(avg(value), 5) AS value FROM x GROUP BY 1, 2""")
def agg_replications(spark, d):
    df = A.replications(_t(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e")), "label", "e")
    return rounded(A.long_form(df, ["label"], "e"), "value", digits=5)


@_query("""WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
           SELECT least(9, greatest(0, ceil((l_extendedprice - lo) / ((hi - lo) / 10)) - 1))::BIGINT AS bin, count(*) AS n FROM lineitem, m GROUP BY 1""")
def project_discretize(spark, d):
    return A.equal_width(_t(spark, d, "lineitem"), "l_extendedprice", 10).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@_query("""WITH m AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS total FROM events)
           SELECT least(10, floor((value - lo) / ((hi - lo) / 11)))::BIGINT AS bin, count(*) AS n, round(count(*) / (max(total) * max((hi - lo) / 11)), 8) AS density
           FROM events, m WHERE value IS NOT NULL GROUP BY 1""")
def agg_histogram(spark, d):
    return rounded(A.histogram(_t(spark, d, "events"), "value"), "density", digits=8)


@_query("""WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS h FROM events)
           SELECT i::INT AS i, round(min(lo + (hi - lo) * i / 49), 6) AS at, round(sum(exp(-0.5 * pow((lo + (hi - lo) * i / 49 - value) / h, 2))) / (min(n) * min(h) * sqrt(2 * pi())), 6) AS density
           FROM events, s, range(50) r(i) GROUP BY 1""")
def agg_kde(spark, d):
    return rounded(A.kde(_t(spark, d, "events"), [], "value"), "at", "density", digits=6)


@_query("""SELECT o_orderstatus, o_totalprice, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1)::DOUBLE / count(*) OVER (PARTITION BY o_orderstatus) AS f FROM orders""")
def window_cdf(spark, d):
    return A.cdf(_t(spark, d, "orders"), "o_orderstatus", "o_totalprice")


@_query("""WITH n AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
           SELECT o_orderstatus, o_orderpriority, n::DOUBLE / sum(n) OVER (PARTITION BY o_orderstatus) AS share,
                  (sum(n) OVER (PARTITION BY o_orderstatus ORDER BY n, o_orderpriority))::DOUBLE / sum(n) OVER (PARTITION BY o_orderstatus) AS f FROM n""")
def window_discrete_cdf(spark, d):
    return A.discrete_cdf(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@_query("""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
                c AS (SELECT vec_id, x, sqrt(list_sum(list_transform(range(1, len(x)), lambda i: pow(x[i + 1] - x[i], 2)))) AS c FROM x)
           SELECT p.vec_id AS a, q.vec_id AS b, round(sqrt(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: pow(p.x[i] - q.x[i], 2)))) * greatest(p.c, q.c) / least(p.c, q.c), 5) AS distance
           FROM c p JOIN c q ON p.vec_id < q.vec_id""")
def join_cid(spark, d):
    df = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return rounded(A.cid(df, "vec_id", "x"), "distance", digits=5)


# the name under which the query over every label was first registered
QUERIES["join_cid_whole"], ORACLE["join_cid_whole"] = QUERIES["join_cid"], ORACLE["join_cid"]


@_query("""SELECT p_partkey, p_retailprice, p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice >= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice > a.p_retailprice OR b.p_size > a.p_size))""")
def skyline_pareto(spark, d):
    return A.pareto(_t(spark, d, "part"), ["p_retailprice", "p_size"]).select("p_partkey", "p_retailprice", "p_size")


@_query("""WITH b AS (SELECT c_custkey, c_acctbal, c_nationkey, floor(c_acctbal / 50) AS i, floor(c_nationkey / 2.0) AS j FROM customer),
                o AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY pow(c_acctbal - i * 50, 2) + pow(c_nationkey - j * 2.0, 2), c_custkey) AS r FROM b)
           SELECT c_custkey, c_acctbal, c_nationkey FROM o a WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM o c WHERE c.i <= a.i AND c.j <= a.j AND (c.i < a.i OR c.j < a.j))""")
def skyline_epsilon(spark, d):
    return A.epsilon_nondominated(_t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"], [50, 2.0], "c_custkey")


@_query("""WITH m AS (SELECT min(c_acctbal) AS lo, min(c_nationkey) AS k FROM customer)
           SELECT floor((c_acctbal - lo) / 500.0)::BIGINT AS cell_c_acctbal, floor((c_nationkey - k) / 5.0)::BIGINT AS cell_c_nationkey, count(*) AS hits,
                  round(list_sum(list_transform(range(1, count(*) + 1), lambda i: 1.0::DOUBLE / i)), 8) AS novelty FROM customer, m GROUP BY 1, 2""")
def agg_grid_cells(spark, d):
    return rounded(A.grid_cells(_t(spark, d, "customer"), ["c_acctbal", "c_nationkey"], [500.0, 5.0]), "novelty", digits=8)


@_query("""WITH s AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS q, corr(l_discount, l_extendedprice) AS c, corr(l_tax, l_extendedprice) AS t FROM lineitem)
           SELECT f AS feature, round(r * r / (1 - r * r) * (n - 2), 3) AS score FROM (SELECT n, unnest(['l_quantity', 'l_discount', 'l_tax']) AS f, unnest([q, c, t]) AS r FROM s)""")
def score_f_regression(spark, d):
    return rounded(A.f_regression(_t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), "score", digits=3)


@_query("""WITH p AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mq, var_pop(l_quantity) AS vq, avg(l_tax) AS mt, var_pop(l_tax) AS vt FROM lineitem GROUP BY 1),
                g AS (SELECT avg(l_quantity) AS gq, avg(l_tax) AS gt FROM lineitem),
                r AS (SELECT sum(n) AS n, count(*) AS k, sum(n * pow(mq - gq, 2)) AS bq, sum(n * vq) AS wq, sum(n * pow(mt - gt, 2)) AS bt, sum(n * vt) AS wt FROM p, g)
           SELECT f AS feature, round((b / (k - 1)) / (w / (n - k)), 6) AS score FROM (SELECT n, k, unnest(['l_quantity', 'l_tax']) AS f, unnest([bq, bt]) AS b, unnest([wq, wt]) AS w FROM r)""")
def score_f_classif(spark, d):
    return rounded(A.f_classif(_t(spark, d, "lineitem"), ["l_quantity", "l_tax"], "l_returnflag"), "score", digits=6)


@_query(f"""WITH x AS (SELECT (l_quantity / 50)::DOUBLE AS p, {_STEEP} AS y, s FROM lineitem, range(11) r(s))
            SELECT s::INT AS step, round(count_if(p > s / 10 AND y = 1)::DOUBLE / greatest(count_if(p > s / 10), 1), 6) AS density, round(count_if(p > s / 10 AND y = 1)::DOUBLE / greatest(sum(y), 1), 6) AS coverage FROM x GROUP BY 1""")
def agg_covered(spark, d):
    df = _t(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("p"), F.expr(_STEEP).alias("y"))
    return rounded(A.covered(df, "p", "y"), "density", "coverage", digits=6)


@_query("""WITH g AS (SELECT * FROM (SELECT DISTINCT o_orderstatus FROM orders), (SELECT DISTINCT o_orderpriority FROM orders))
           SELECT g.o_orderstatus, g.o_orderpriority, round(avg(o_totalprice), 4) AS mean FROM g LEFT JOIN orders o ON o.o_orderstatus = g.o_orderstatus AND o.o_orderpriority = g.o_orderpriority GROUP BY 1, 2""")
def agg_pivot_mean(spark, d):
    return rounded(A.pivot_mean(_t(spark, d, "orders"), ["o_orderstatus"], ["o_orderpriority"], "o_totalprice"), "mean")


def toy(x1, x2, x3):
    return {"y": x1 * x2 + x3}


@_query("SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount + l_tax, 6) AS y, 'ok' AS status FROM lineitem")
def run_python_model(spark, d):
    design = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"))
    return rounded(M.run(M.Model("toy", [M.Outcome("y")], toy), design).select("l_orderkey", "l_linenumber", "y", "status"), "y", digits=6)


@_query("SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount + l_tax, 6) AS y, 'ok' AS status FROM lineitem")
def run_column_model(spark, d):
    design = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    model = M.Model("toy", [M.Outcome("y")], expressions={"y": lambda df: df.l_quantity * df.l_discount + df.l_tax})
    return rounded(M.run(model, design).select("l_orderkey", "l_linenumber", "y", "status"), "y", digits=6)


@_query()
def prim_box(spark, d):
    df = _t(spark, d, "lineitem").select("l_quantity", "l_discount", "l_returnflag", F.expr(_STEEP).alias("y"))
    found = B.Prim(df, "y", ["l_quantity", "l_discount", "l_returnflag"], mass_min=0.1).find_box()
    rows = [(i, int(t["n"]), float(t["mean"]), float(t["mass"])) for i, t in enumerate(found.trajectory)]
    return spark.createDataFrame(rows, "step long, n long, mean double, mass double")
