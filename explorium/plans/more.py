"""More registered queries: scores, sensitivity, discovery, indicators, figures, experiments and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from explorium.functions import curves
from explorium.functions import designs as D
from explorium.operators import analysis as A
from explorium.operators import boxes as B
from explorium.operators import boosting
from explorium.operators import clustering as C
from explorium.operators import discovery, figures, forests, fronts, indicators, sensitivity, trees
from explorium.plans import experiments, search
from explorium.plans import models as M
from explorium.plans.registry import _STEEP, _query, _t, rounded
from explorium.sources.archive_source import ArchiveSource
from explorium.sources.shared import Tables
from explorium.streaming import consumers

@_query("""WITH p AS (SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q, sum(l_tax) AS t FROM lineitem GROUP BY 1),
                l AS (SELECT n, unnest(['l_quantity', 'l_tax']) AS feature, unnest([q, t]) AS o FROM p),
                s AS (SELECT feature, n, o, n::DOUBLE / sum(n) OVER (PARTITION BY feature) * sum(o) OVER (PARTITION BY feature) AS e FROM l)
           SELECT feature, round(sum((o - e) * (o - e) / e), 4) AS score FROM s GROUP BY 1""")
def score_chi2(spark, d):
    return rounded(trees.chi2(_t(spark, d, "lineitem"), ["l_quantity", "l_tax"], "l_returnflag"), "score")


@_query("""WITH b AS (SELECT floor((o_orderkey - 1) / 4) AS block, count(*) AS n, max(CASE WHEN (o_orderkey - 1) % 4 = 0 THEN o_totalprice END) AS a,
                             max(CASE WHEN (o_orderkey - 1) % 4 = 1 THEN o_totalprice END) AS p, max(CASE WHEN (o_orderkey - 1) % 4 = 2 THEN o_totalprice END) AS q,
                             max(CASE WHEN (o_orderkey - 1) % 4 = 3 THEN o_totalprice END) AS b FROM orders GROUP BY 1 HAVING count(*) = 4),
                m AS (SELECT avg((a + b) / 2) AS mean, avg(a * a + b * b) / 2 - avg((a + b) / 2) * avg((a + b) / 2) AS v FROM b),
                x AS (SELECT avg((b - mean) * (p - a)) / max(v) AS sp, avg((a - p) * (a - p)) / 2 / max(v) AS tp, avg((b - mean) * (q - a)) / max(v) AS sq, avg((a - q) * (a - q)) / 2 / max(v) AS tq FROM b, m)
           SELECT a, round(s1, 6) AS s1, round(st, 6) AS st FROM (SELECT unnest(['p', 'q']) AS a, unnest([sp, sq]) AS s1, unnest([tp, tq]) AS st FROM x)""")
def sens_sobol(spark, d):
    runs = _t(spark, d, "orders").select((F.col("o_orderkey") - 1).alias("sample_id"), "o_totalprice")
    return rounded(sensitivity.sobol_indices(runs, ["p", "q"], "o_totalprice", second_order=False), "s1", "st", digits=6).select("a", "s1", "st")


@_query("""WITH k AS (SELECT floor((o_orderkey - 1) / 6) AS block, (o_orderkey - 1) % 6 AS place, o_totalprice AS y FROM orders),
                x AS (SELECT block, max(y) FILTER (place = 0) AS a, max(y) FILTER (place = 1) AS ap, max(y) FILTER (place = 2) AS aq, max(y) FILTER (place = 3) AS bp, max(y) FILTER (place = 4) AS bq, max(y) FILTER (place = 5) AS b
                      FROM k WHERE y IS NOT NULL GROUP BY 1 HAVING count(*) = 6),
                m AS (SELECT avg((a + b) / 2) AS mean, avg(a * a + b * b) / 2 - avg((a + b) / 2) * avg((a + b) / 2) AS v FROM x),
                s AS (SELECT max(v) AS v, avg((b - mean) * (ap - a)) AS fp, avg((b - mean) * (aq - a)) AS fq, avg((a - ap) * (a - ap)) / 2 AS tp, avg((a - aq) * (a - aq)) / 2 AS tq,
                             avg((bp - mean) * (aq - mean) - (a - mean) * (b - mean)) AS pq FROM x, m)
           SELECT 'p' AS a, NULL::VARCHAR AS b, round(fp / v, 6) AS s1, round(tp / v, 6) AS st, NULL::DOUBLE AS s2 FROM s
           UNION ALL SELECT 'q', NULL, round(fq / v, 6), round(tq / v, 6), NULL FROM s UNION ALL SELECT 'p', 'q', NULL, NULL, round((pq - fp - fq) / v, 6) FROM s""")
def sens_sobol_second_order(spark, d):
    """Orders in the shape of a design of two parameters, six a block."""
    runs = _t(spark, d, "orders").select((F.col("o_orderkey") - 1).alias("sample_id"), "o_totalprice")
    return rounded(sensitivity.sobol_indices(runs, ["p", "q"], "o_totalprice"), "s1", "st", "s2", digits=6)


@_query("""WITH w AS (SELECT floor((l_orderkey - 1) / 3) AS path, l_orderkey AS step, avg(l_quantity) AS q, max(l_discount) AS c, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2),
                x AS (SELECT path, step, y - lag(y) OVER p AS dy, sign(q - lag(q) OVER p) AS q, sign(c - lag(c) OVER p) AS c, count(*) OVER (PARTITION BY path) AS n FROM w WINDOW p AS (PARTITION BY path ORDER BY step)),
                e AS (SELECT 'q' AS parameter, dy / (q * 4 / 6.0::DOUBLE) AS e FROM x WHERE n = 3 AND q <> 0 AND dy IS NOT NULL UNION ALL SELECT 'c', dy / (c * 4 / 6.0::DOUBLE) FROM x WHERE n = 3 AND c <> 0 AND dy IS NOT NULL)
           SELECT parameter, round(avg(e), 4) AS mu, round(avg(abs(e)), 4) AS mu_star, round(stddev_samp(e), 4) AS sigma FROM e GROUP BY 1""")
def sens_morris(spark, d):
    """Three orders in a row are a trajectory; its steps change the mean quantity and the highest discount."""
    runs = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("q"), F.max("l_discount").alias("c"), F.sum("l_extendedprice").alias("y"))
    runs = runs.withColumn("sample_id", F.col("l_orderkey") - 1)
    return rounded(sensitivity.morris_indices(runs, [D.Parameter("q"), D.Parameter("c")], "y"), "mu", "mu_star", "sigma")


@_query("""WITH y AS (SELECT o_custkey % 130 AS id, avg(o_totalprice) AS y FROM orders GROUP BY 1), x AS (SELECT id // 65 AS curve, 2 * pi() / 65 * (id % 65) AS s, y FROM y),
                v AS (SELECT curve, count(*) AS n, var_pop(y) AS v FROM x GROUP BY 1),
                p AS (SELECT curve, k, 2 * (pow(sum(y * cos(k * s)), 2) + pow(sum(y * sin(k * s)), 2)) / (65 * 65) AS power FROM x, (SELECT unnest([1, 2, 3, 4, 8, 16, 24, 32]) AS k) GROUP BY 1, 2)
           SELECT CASE curve WHEN 0 THEN 'p' ELSE 'q' END AS parameter, round(sum(power) FILTER (k % 8 = 0) / max(v), 6) AS s1, round(1 - sum(power) FILTER (k <= 4) / max(v), 6) AS st
           FROM p JOIN v USING (curve) WHERE n = 65 GROUP BY curve""")
def sens_fast(spark, d):
    """All orders, their mean price by customer number along two curves of 65 points."""
    runs = _t(spark, d, "orders").groupBy(F.pmod("o_custkey", F.lit(130)).alias("sample_id")).agg(F.avg("o_totalprice").alias("y"))
    return rounded(sensitivity.fast_indices(runs, ["p", "q"], "y", 65), "s1", "st", digits=6)


@_query("""WITH v AS (SELECT DISTINCT l_extendedprice AS v FROM lineitem WHERE l_returnflag IN ('A', 'R')),
                c AS (SELECT l_extendedprice AS v, count_if(l_returnflag = 'A') AS a, count_if(l_returnflag = 'R') AS b FROM lineitem GROUP BY 1),
                r AS (SELECT sum(a) OVER (ORDER BY v)::DOUBLE / sum(a) OVER () AS f, sum(b) OVER (ORDER BY v)::DOUBLE / sum(b) OVER () AS g FROM c)
           SELECT round(max(abs(f - g)), 8) AS d FROM r""")
def score_kolmogorov_smirnov(spark, d):
    at, _ = discovery.kolmogorov_smirnov(_t(spark, d, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "A", F.col("l_returnflag") == "R")
    return spark.createDataFrame([(round(at, 8),)], "d double")


def _steep(spark, d):
    return _t(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", F.expr(_STEEP).alias("y"))


@_query()
def prim_quasi_p(spark, d):
    df = _steep(spark, d)
    start = B.bounding_box(df, ["l_quantity", "l_discount"])
    ps = discovery.quasi_p(df, "y", start | {"l_quantity": (30.0, start["l_quantity"][1]), "l_discount": (0.02, 0.06)}, start)
    return spark.createDataFrame([(c, *p) for c, p in ps.items()], "dimension string, low double, high double")


@_query()
def prim_regression(spark, d):
    prim = discovery.RegressionPrim(_t(spark, d, "lineitem").select("l_quantity", "l_tax", "l_extendedprice"), "l_extendedprice", ["l_quantity", "l_tax"], mass_min=0.2)
    rows = [(i, int(t["n"]), float(t["mean"])) for i, t in enumerate(prim.find_box().trajectory)]
    prim.close()
    return spark.createDataFrame(rows, "step long, n long, mean double")


@_query()
def prim_rotation(spark, d):
    return discovery.rotate(_steep(spark, d), "y", {"r": ["l_quantity", "l_discount", "l_tax"]})[0]


@_query()
def tree_cart(spark, d):
    return trees.Cart(_steep(spark, d), "y", ["l_quantity", "l_discount", "l_returnflag"]).stats()


@_query()
def tree_forest_scores(spark, d):
    return trees.forest(_steep(spark, d), ["l_quantity", "l_discount", "l_tax", "l_returnflag"], "y", trees=20)


@_query()
def tree_extra_trees(spark, d):
    """Random cuts over all rows, with the share of rows that trees which haven't seen them tell rightly."""
    df = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", F.expr(_STEEP).alias("y"))
    told, model, rows = forests.scores(df, ["l_quantity", "l_discount", "l_tax", "l_returnflag"], "y", trees=4, key=["l_orderkey", "l_linenumber"])
    return told.withColumn("out_of_bag", F.lit(forests.oob_score(rows, model)))


@_query()
def tree_stacking(spark, d):
    return trees.stacking(_steep(spark, d), ["l_quantity", "l_discount", "l_tax", "l_returnflag"], "y", levels=1)[0]


@_query()
def model_logit(spark, d):
    model = discovery.Logit(_steep(spark, d), "y", ["l_quantity", "l_discount", "l_tax"])
    model.run()
    return model.tradeoff(0.5)


def _fronts(spark, d):
    ends = {"s_acctbal": 1, "s_suppkey": -1}
    df = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("nfe"), F.col("s_acctbal"), F.col("s_suppkey").cast("double").alias("s_suppkey"))
    top = A.pareto(df.withColumn("s_suppkey", -F.col("s_suppkey")), ["s_acctbal", "s_suppkey"]).withColumn("s_suppkey", -F.col("s_suppkey"))
    return (*indicators.normalized(df, top, ends), ["s_acctbal", "s_suppkey"])


_REF = """WITH t AS (SELECT s_nationkey AS nfe, s_acctbal AS x, s_suppkey::DOUBLE AS y FROM supplier),
     f AS (SELECT x, y FROM t p WHERE NOT EXISTS (SELECT 1 FROM t q WHERE q.x >= p.x AND q.y <= p.y AND (q.x > p.x OR q.y < p.y))),
     l AS (SELECT min(x) AS x0, coalesce(nullif(max(x) - min(x), 0), 1) AS xw, min(y) AS y0, coalesce(nullif(max(y) - min(y), 0), 1) AS yw FROM f),
     a AS (SELECT nfe, 1 - (x - x0) / xw AS u, (y - y0) / yw AS v, row_number() OVER () AS i FROM t, l),
     r AS (SELECT 1 - (x - x0) / xw AS u, (y - y0) / yw AS v, row_number() OVER () AS j FROM f, l)
"""


@_query(_REF + "SELECT nfe, round(avg(d), 6) AS generational_distance FROM (SELECT nfe, i, min(sqrt(pow(a.u - r.u, 2) + pow(a.v - r.v, 2))) AS d FROM a, r GROUP BY 1, 2) GROUP BY 1")
def indicator_generational(spark, d):
    return rounded(indicators.generational_distance(*_fronts(spark, d)), "generational_distance", digits=6)


@_query(_REF + "SELECT nfe, round(avg(d), 6) AS inverted_generational_distance FROM (SELECT nfe, j, min(sqrt(pow(a.u - r.u, 2) + pow(a.v - r.v, 2))) AS d FROM a, r GROUP BY 1, 2) GROUP BY 1")
def indicator_inverted(spark, d):
    return rounded(indicators.inverted_generational_distance(*_fronts(spark, d)), "inverted_generational_distance", digits=6)


@_query(_REF + "SELECT nfe, round(max(d), 6) AS epsilon FROM (SELECT nfe, j, min(greatest(a.u - r.u, a.v - r.v)) AS d FROM a, r GROUP BY 1, 2) GROUP BY 1")
def indicator_epsilon(spark, d):
    return rounded(indicators.epsilon_indicator(*_fronts(spark, d)), "epsilon", digits=6)


@_query(_REF + "SELECT nfe, round(coalesce(stddev_samp(d), 0), 6) AS spacing FROM (SELECT a.nfe, a.i, min(abs(a.u - b.u) + abs(a.v - b.v)) AS d FROM a LEFT JOIN a b ON a.nfe = b.nfe AND a.i <> b.i GROUP BY 1, 2) GROUP BY 1")
def indicator_spacing(spark, d):
    archive, _, names = _fronts(spark, d)
    return rounded(indicators.spacing(archive, names), "spacing", digits=6)


@_query(_REF + """, k AS (SELECT nfe, greatest(u, 0) AS u, greatest(v, 0) AS v FROM a WHERE u < 1 AND v < 1),
     s AS (SELECT nfe, u, coalesce(lead(u) OVER (PARTITION BY nfe ORDER BY u, v), 1) AS z, min(v) OVER (PARTITION BY nfe ORDER BY u, v) AS m FROM k)
SELECT nfe, round(coalesce(sum((z - u) * (1 - m)), 0), 6) AS hypervolume FROM (SELECT DISTINCT nfe FROM a) LEFT JOIN s USING (nfe) GROUP BY 1""")
def indicator_hypervolume(spark, d):
    archive, _, names = _fronts(spark, d)
    return rounded(indicators.hypervolume(archive, names), "hypervolume", digits=6)


@_query("""WITH b AS (SELECT DISTINCT s_nationkey AS nfe, floor(-s_acctbal / 1000.0) AS i, floor(s_suppkey / 10.0) AS j FROM supplier),
                f AS (SELECT *, min(nfe) OVER (PARTITION BY i, j) AS first FROM b)
           SELECT nfe, count(*) AS boxes, count_if(nfe = first)::BIGINT AS new_boxes FROM f GROUP BY 1""")
def window_progress(spark, d):
    return indicators.progress(_t(spark, d, "supplier").withColumnRenamed("s_nationkey", "nfe"), {"s_acctbal": 1, "s_suppkey": -1}, [1000.0, 10.0])


@_query("""WITH q AS (SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
           SELECT o.o_orderstatus, round(max(q1), 4) AS q1, round(max(median), 4) AS median, round(max(q3), 4) AS q3,
                  min(CASE WHEN o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN o_totalprice END) AS low,
                  max(CASE WHEN o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN o_totalprice END) AS high,
                  count_if(NOT o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))::BIGINT AS outliers
           FROM orders o JOIN q USING (o_orderstatus) GROUP BY 1""")
def figure_boxplot(spark, d):
    return rounded(figures.boxplot(_t(spark, d, "orders"), ["o_orderstatus"], "o_totalprice"), "q1", "median", "q3")


@_query("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
                t AS (SELECT level, side, CASE WHEN side = 0 THEN pow(0.5, level + 2) ELSE 1 - pow(0.5, level + 2) END AS p FROM range(4) a(level), range(2) b(side)),
                e AS (SELECT event_type, level::INT AS level, side, max(n) AS n, max((n - 1) * p - floor((n - 1) * p)) AS part,
                             max(CASE WHEN r = floor((n - 1) * p) THEN value END) AS lo, max(CASE WHEN r = ceil((n - 1) * p) THEN value END) AS hi FROM o, t GROUP BY 1, 2, 3)
           SELECT event_type, level, max(CASE WHEN side = 0 THEN lo + (hi - lo) * part END) AS low, max(CASE WHEN side = 1 THEN lo + (hi - lo) * part END) AS high
           FROM e WHERE pow(0.5, level + 2) * n >= 0.5 GROUP BY 1, 2""")
def figure_letter_values(spark, d):
    # the same steps on the same two values, so nothing is rounded
    return figures.letter_values(_t(spark, d, "events"), ["event_type"], "value", depth=4)


@_query("""SELECT o_orderkey, a AS outcome_x, b AS outcome_y, x, y FROM (
             SELECT o_orderkey, 'o_totalprice' AS a, 'o_custkey' AS b, o_totalprice AS x, o_custkey::DOUBLE AS y FROM orders
             UNION ALL SELECT o_orderkey, 'o_custkey', 'o_totalprice', o_custkey::DOUBLE, o_totalprice FROM orders)""")
def figure_pairs(spark, d):
    return figures.pairs(_t(spark, d, "orders"), "o_orderkey", ["o_totalprice", "o_custkey"])


@_query("""WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
                g AS (SELECT least(4, floor((o_totalprice - lo) / ((hi - lo) / 5)))::BIGINT AS g FROM orders, m)
           SELECT g AS interval, count(*) AS n FROM g GROUP BY 1""")
def group_intervals(spark, d):
    df = _t(spark, d, "orders")
    cut = figures.intervals(df, "o_totalprice", 5)
    return figures.grouped(df, "o_totalprice", cut, [str(k) for k in range(5)]).groupBy(F.col("group").cast("long").alias("interval")).agg(F.count(F.lit(1)).alias("n"))


@_query("""WITH s AS (SELECT event_type, count(value) AS n, stddev_samp(value) AS sd FROM events GROUP BY 1), l AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
                x AS (SELECT e.event_type, i, sum(exp(-0.5 * pow((lo + (hi - lo) * i / 19 - value) / (sd * pow(n, -0.2)), 2))) AS d FROM events e JOIN s USING (event_type), l, range(20) r(i) GROUP BY 1, 2)
           SELECT event_type, i::INT AS i, round(d / max(d) OVER (PARTITION BY event_type), 6) AS density FROM x""")
def agg_kde_over_time(spark, d):
    return rounded(figures.kde_over_time(_t(spark, d, "events"), "event_type", "value", 20), "density", digits=6).select("event_type", "i", "density")


@_query("""WITH l AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), s AS (SELECT c_mktsegment, (row_number() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE / (count(*) OVER () - 1) AS at FROM (SELECT DISTINCT c_mktsegment FROM customer))
           SELECT c_custkey, 'c_acctbal' AS axis, round((c_acctbal - lo) / (hi - lo), 6) AS at FROM customer, l
           UNION ALL SELECT c_custkey, 'c_mktsegment', round(s.at, 6) FROM customer JOIN s USING (c_mktsegment)""")
def figure_parallel_axes(spark, d):
    return rounded(figures.parallel_axes(_t(spark, d, "customer"), "c_custkey", ["c_acctbal", "c_mktsegment"]), "at", digits=6)


@_query("""WITH m AS (SELECT min(o_totalprice) AS x0, max(o_totalprice) AS x1, min(o_custkey) AS y0, max(o_custkey) AS y1 FROM orders),
                s AS (SELECT *, (x1 - x0) / 20 AS sx, (y1 - y0) / 11.0::DOUBLE AS sy FROM m),
                p AS (SELECT *, (o_totalprice - x0) / sx AS u, (o_custkey - y0) / sy AS v FROM orders, s),
                c AS (SELECT *, floor(u + 0.5) AS i1, floor(v + 0.5) AS j1, floor(u) + 0.5 AS i2, floor(v) + 0.5 AS j2 FROM p),
                d AS (SELECT *, pow(u - i1, 2) + 3 * pow(v - j1, 2) < pow(u - i2, 2) + 3 * pow(v - j2, 2) AS one FROM c)
           SELECT round(x0 + CASE WHEN one THEN i1 ELSE i2 END * sx, 4) AS cx, round(y0 + CASE WHEN one THEN j1 ELSE j2 END * sy, 4) AS cy, count(*) AS n FROM d GROUP BY 1, 2""")
def figure_hexbins(spark, d):
    return rounded(figures.hexbins(_t(spark, d, "orders"), "o_totalprice", "o_custkey"), "cx", "cy")


@_query("""WITH l AS (SELECT o_orderstatus AS class, unnest(['o_totalprice', 'o_custkey']) AS dimension, unnest([o_totalprice, o_custkey::DOUBLE]) AS value FROM orders),
                e AS (SELECT * FROM l UNION ALL SELECT NULL, dimension, value FROM l)
           SELECT dimension, class, value, (row_number() OVER (PARTITION BY dimension, class ORDER BY value) - 1)::DOUBLE / count(*) OVER (PARTITION BY dimension, class) AS f FROM e""")
def window_cdf_set(spark, d):
    return A.cdf_set(_t(spark, d, "orders"), ["o_totalprice", "o_custkey"], "o_orderstatus")


@_query("""WITH n AS (SELECT o_orderstatus AS class, o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 1, 2),
                w AS (SELECT category, sum(n)::BIGINT AS n FROM n GROUP BY 1),
                g AS (SELECT c.class, w.category, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT class FROM n) c CROSS JOIN w LEFT JOIN n ON n.class = c.class AND n.category = w.category
                      UNION ALL SELECT NULL, category, n FROM w)
           SELECT 'o_orderpriority' AS dimension, class, category, n::DOUBLE / sum(n) OVER (PARTITION BY class) AS share,
                  1 - sum(n) OVER (PARTITION BY class ORDER BY n, category)::DOUBLE / sum(n) OVER (PARTITION BY class) AS f FROM g""")
def window_discrete_ccdf_set(spark, d):
    return A.discrete_cdf_set(_t(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", complement=True)


@_query("""WITH m AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 11 AS w FROM orders)
           SELECT o_orderstatus, least(10, floor((o_totalprice - lo) / w))::BIGINT AS bin, count(*) AS n FROM orders, m GROUP BY 1, 2""")
def figure_histograms(spark, d):
    return figures.histograms(_t(spark, d, "orders"), ["o_orderstatus"], "o_totalprice").drop("low")


@_query("""WITH x AS (SELECT label::VARCHAR AS "group", unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS t FROM embeddings WHERE label IS NOT NULL)
           SELECT "group", 'embedding' AS outcome, t::INT AS t, round(min(v), 5) AS low, round(max(v), 5) AS high FROM x GROUP BY 1, 3""")
def figure_envelopes(spark, d):
    df = _t(spark, d, "embeddings").withColumn("label", F.col("label").cast("string"))
    return rounded(figures.over_time(df, "vec_id", ["embedding"], "envelope", "label"), "low", "high", digits=5)


@_query("""SELECT 'o_totalprice' AS outcome_x, 'o_custkey' AS outcome_y, min(o_totalprice) AS low_x, max(o_totalprice) AS high_x, min(o_custkey)::DOUBLE AS low_y, max(o_custkey)::DOUBLE AS high_y FROM orders
           UNION ALL SELECT 'o_custkey', 'o_totalprice', min(o_custkey)::DOUBLE, max(o_custkey)::DOUBLE, min(o_totalprice), max(o_totalprice) FROM orders""")
def figure_extents(spark, d):
    return figures.extents(_t(spark, d, "orders"), ["o_totalprice", "o_custkey"])


@_query("""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT vec_id, list_transform(range(1, len(e)), lambda i: e[i + 1] - e[i]) AS d FROM x)
           SELECT vec_id, round(CASE WHEN abs(list_max(d)) >= abs(list_min(d)) THEN list_max(d) ELSE list_min(d) END, 5) AS jump FROM s""")
def project_jumps(spark, d):
    return rounded(trees.jumps(_t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "e").select("vec_id", "jump"), "jump", digits=5)


@_query("SELECT o_orderkey AS sample_id, c_acctbal, o_totalprice, round(o_totalprice - c_acctbal, 4) AS owed, greatest(0, c_acctbal - 5000)::DOUBLE AS rich FROM orders JOIN customer ON c_custkey = o_custkey")
def run_constraints(spark, d):
    """A run an order: what its customer owes, and how far the customer's balance breaks a constraint."""
    design = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("sample_id"), "c_acctbal", "o_totalprice")
    model = M.Model("owed", [M.Outcome("owed")], expressions={"owed": lambda df: F.round(df.o_totalprice - df.c_acctbal, 4)})
    return M.constrained(M.run(model, design), [M.Constraint("rich", ("c_acctbal",), lambda b: F.greatest(F.lit(0.0), b - 5000))]).drop("status")


@_query()
def cluster_series(spark, d):
    df = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return C.series_clusters(df, "vec_id", "x", 4)


@_query("""WITH n AS (SELECT n_regionkey::BIGINT AS l, row_number() OVER (ORDER BY n_nationkey) - 1 AS p, n_name AS policy, count(*) OVER () AS np FROM nation),
                s AS (SELECT s_acctbal AS a, row_number() OVER (ORDER BY s_suppkey) - 1 AS s, s_name AS scenario, count(*) OVER () AS ns FROM supplier)
           SELECT (m * np + p) * ns + s AS experiment_id, ['linear', 'bent'][m + 1] AS model, l, policy, a, scenario, round(CASE m WHEN 0 THEN a * (l + 1) ELSE a * a / 1000 - l END, 4) AS y, 'ok' AS status FROM range(2) t(m), n, s""")
def run_experiments(spark, d):
    """Two models under every nation as a policy and every supplier as a scenario."""

    def numbered(name: str, key: str, *columns):
        return A.ranked(_t(spark, d, name), [], key).select(F.col("__rank").cast("long").alias("sample_id"), *columns)

    policies = numbered("nation", "n_nationkey", F.col("n_regionkey").cast("long").alias("l"), F.col("n_name").alias("policy"))
    scenarios = numbered("supplier", "s_suppkey", F.col("s_acctbal").alias("a"), F.col("s_name").alias("scenario"))
    known = {"uncertainties": (D.Parameter("a"),), "levers": (D.Parameter("l", "integer", 0, 3),)}
    models = [M.Model("linear", [M.Outcome("y")], expressions={"y": lambda df: F.round(df.a * (df.l + 1), 4)}, **known), M.Model("bent", [M.Outcome("y")], expressions={"y": lambda df: F.round(df.a * df.a / 1000 - df.l, 4)}, **known)]
    return experiments.perform(spark, models, scenarios, policies)


@_query()
def search_front(spark, d):
    """Least quantity and discount of lines, so that many of the dear lines are among them and few others; every point is measured on all lines."""
    lines = _t(spark, d, "lineitem").groupBy("l_quantity", "l_discount").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(_STEEP)).alias("k"))
    lines = Tables(spark, "search").save(lines, "lines")
    dear = lines.agg(F.sum("k")).first()[0] or 1

    def evaluate(points):
        inside = (F.col("l_quantity") >= F.col("q")) & (F.col("l_discount") >= F.col("c"))
        n, k = F.sum(F.when(inside, F.col("n")).otherwise(0)), F.sum(F.when(inside, F.col("k")).otherwise(0))
        return lines.crossJoin(F.broadcast(points)).groupBy("sample_id").agg((k / dear).alias("coverage"), F.coalesce(F.try_divide(k, n), F.lit(0.0)).alias("density"))  # points are a population

    found = search.optimize(spark, evaluate, [D.Parameter("q", "real", 1, 50), D.Parameter("c", "real", 0, 0.1)], {"coverage": 1, "density": 1}, [0.05, 0.05], nfe=300, population=50)
    return spark.createDataFrame(found.archive, "q double, c double, coverage double, density double")


@_query("SELECT c_custkey, c_nationkey, c_acctbal, round(c_acctbal * (c_nationkey + 1) / 10, 4) AS y, 'ok' AS status FROM customer")
def run_resumable(spark, d):
    """A run a customer, in batches of a stream that each are written once."""
    model = M.Model("owed", [M.Outcome("y")], function=lambda c_acctbal, c_nationkey: {"y": c_acctbal * (c_nationkey + 1) / 10})
    runs = consumers.run_whole(model, _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), Tables(spark, "runs").root)
    return rounded(runs.drop("batch"), "y")


@_query("""SELECT vec_id AS experiment_id, label::BIGINT AS label, list_transform(embedding, lambda v: v::DOUBLE) AS embedding FROM embeddings WHERE embedding IS NOT NULL""")
def source_archives(spark, d):
    """All vectors as series of runs, written as archives and read again."""
    spark.dataSource.register(ArchiveSource)
    path = Tables(spark, "archives").root
    runs = _t(spark, d, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("experiment_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    runs.write.format("run_archives").mode("append").save(path)
    return spark.read.format("run_archives").option("parts", 2).load(path)


@_query()
def tree_boosted_weights(spark, d):
    """What each column adds to telling the four discount classes of all lines, over rounds that weigh wrongly told lines up."""
    df = _t(spark, d, "lineitem").select("l_quantity", "l_tax", "l_returnflag", "l_linestatus", F.expr("CAST(least(3, floor(l_extendedprice / 20000)) AS STRING) AS y"))
    model, _ = boosting.boost(df, ["l_quantity", "l_tax", "l_returnflag", "l_linestatus"], "y", rounds=3)
    return spark.createDataFrame(model.scores(), "feature string, score double")


@_query("""WITH l AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part),
                k AS (SELECT p_partkey, 1 + p_size / 10.0::DOUBLE AS k, (p_retailprice - lo) / (hi - lo) AS x FROM part, l),
                c AS (SELECT p_partkey, x, list_transform(range(10), lambda i: pow(i / 9.0::DOUBLE, k) / (pow(i / 9.0::DOUBLE, k) + pow(0.4 / 0.6::DOUBLE, k) * pow(1 - i / 9.0::DOUBLE, k))) AS y FROM k),
                i AS (SELECT *, least(floor(x * 9), 8)::BIGINT AS i FROM c)
           SELECT p_partkey, list_transform(y, lambda v: round(v, 6)) AS curve, round(y[i + 1] + (y[i + 2] - y[i + 1]) * (x * 9 - i), 6) AS value FROM i""")
def lookup_curves(spark, d):
    """A curve a part, steeper for large parts, read at the place of its price between the least and the highest."""
    part = _t(spark, d, "part")
    lo, hi = part.agg(F.min("p_retailprice"), F.max("p_retailprice")).first()
    curve = curves.rising(1 + F.col("p_size") / 10.0, 0.4)
    found = part.select("p_partkey", curve.alias("c"), "p_retailprice")
    return found.select("p_partkey", F.transform("c", lambda v: F.round(v, 6)).alias("curve"), F.round(curves.read(F.col("c"), F.col("p_retailprice"), F.lit(lo), F.lit(hi)), 6).alias("value"))


def _peeling(rows: str, key: str, objectives: str) -> str:
    """SQL that removes what nothing left beats, again and again. rows: SELECT of the key and the objectives."""
    names = objectives.split()
    ge, gt = " AND ".join(f"y.{c} >= x.{c}" for c in names), " OR ".join(f"y.{c} > x.{c}" for c in names)
    cols, known = ", ".join(names), " AND ".join(f"{c} IS NOT NULL" for c in names)
    return f"""WITH RECURSIVE r AS ({rows}), v AS (SELECT DISTINCT {cols} FROM r WHERE {known}),
        rest AS (SELECT 1::BIGINT AS k, {cols} FROM v
                 UNION ALL SELECT DISTINCT x.k + 1, {", ".join("x." + c for c in names)} FROM rest x JOIN rest y ON {ge} AND ({gt})),
        f AS (SELECT {cols}, max(k) AS front FROM rest GROUP BY {cols})
        SELECT {key}, front FROM r LEFT JOIN f USING ({cols})"""


@_query(_peeling("SELECT p_partkey, p_retailprice::DOUBLE AS a, p_size::DOUBLE AS b FROM part", "p_partkey", "a b"))
def fronts_of_parts(spark, d):
    return fronts.fronts(_t(spark, d, "part"), ["p_retailprice", "p_size"], 3).select("p_partkey", "front")


@_query(_peeling("""SELECT c_custkey, c_acctbal::DOUBLE AS a, n::DOUBLE AS b, -low::DOUBLE AS c FROM customer
                    LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_totalprice) AS low FROM orders GROUP BY 1) ON o_custkey = c_custkey""", "c_custkey", "a b c"))
def fronts_of_customers(spark, d):
    """Customers by balance, number of orders, and smallest order (less is better); those without orders have no front."""
    own = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), (-F.min("o_totalprice")).alias("low"))
    customers = _t(spark, d, "customer")
    return fronts.fronts(customers.join(own, customers["c_custkey"] == own["o_custkey"], "left"), ["c_acctbal", "n", "low"], 2).select("c_custkey", "front")
