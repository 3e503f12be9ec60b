"""Registered queries of single steps of the patient rule induction, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from explorium.operators import boxes as B
from explorium.plans.registry import _STEEP, _query, _t

REALS = ["l_quantity", "l_discount"]
COLUMNS = [*REALS, "l_returnflag"]
#: A box in the middle of a search.
MIDDLE = {"l_quantity": (20.0, 40.0), "l_discount": (0.02, 0.06), "l_returnflag": frozenset("AR")}
_IN = "l_quantity BETWEEN 20 AND 40 AND l_discount BETWEEN 0.02 AND 0.06 AND l_returnflag IN ('A', 'R')"


def _prim(spark, d, **options) -> B.Prim:
    return B.Prim(_t(spark, d, "lineitem").select(*COLUMNS, F.expr(_STEEP).alias("y")), "y", COLUMNS, **options)


def _steps(spark, prim: B.Prim, start: B.Box, options: list[tuple[B.Box, int, float]]) -> DataFrame:
    """dimension, side, limit of a number or category that goes or comes, rows and mean of each candidate."""
    rows = []
    for box, n, mean in options:
        c = next((c for c in box if box[c] != start[c]), None)
        if c is None:
            continue
        if isinstance(box[c], frozenset):
            rows.append((c, "category", None, min(box[c] ^ start[c]), n, round(mean, 8)))
        else:
            side = 0 if box[c][0] != start[c][0] else 1
            rows.append((c, ("low", "high")[side], float(box[c][side]), None, n, round(mean, 8)))
    prim.close()
    return spark.createDataFrame(rows, "dimension string, side string, bound double, category string, n long, mean double")


# a quantile that steps over ties: the value at the rank and the next distinct one beyond it, halved
_WALK = """o AS (SELECT *, row_number() OVER (PARTITION BY dimension, side ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY dimension, side) AS n FROM u),
     v AS (SELECT dimension, side, max(CASE WHEN r = CASE WHEN side = 'low' THEN {low} ELSE {high} END THEN x END) AS v FROM o GROUP BY 1, 2),
     w AS (SELECT v.dimension, v.side, v.v, min(CASE WHEN x > v THEN x END) AS above, max(CASE WHEN x < v THEN x END) AS below FROM v JOIN o USING (dimension, side) GROUP BY 1, 2, 3)"""
_FLOOR, _CEIL = "floor((n - 1) * 0.05::DOUBLE)", "ceil((n - 1) * 0.95::DOUBLE)"


@_query(f"""WITH u AS (SELECT 'l_quantity' AS dimension, side, l_quantity AS x FROM lineitem, (SELECT unnest(['low', 'high']) AS side)
                UNION ALL SELECT 'l_extendedprice', side, l_extendedprice FROM lineitem, (SELECT unnest(['low', 'high']) AS side)),
     {_WALK.format(low=_FLOOR, high=_CEIL)}
SELECT dimension, side, (v + coalesce(CASE WHEN side = 'low' THEN above ELSE below END, v)) / 2 AS value FROM w""")
def quantile_tie_walk(spark, d):
    df = _t(spark, d, "lineitem")
    rows = [(c, side, B.quantile(df, c, q)) for c in ("l_quantity", "l_extendedprice") for side, q in (("low", 0.05), ("high", 0.95))]
    return spark.createDataFrame(rows, "dimension string, side string, value double")


_PEELS = f"""WITH s AS (SELECT l_quantity, l_discount, l_returnflag, {_STEEP} AS y FROM lineitem),
     u AS (SELECT 'l_quantity' AS dimension, side, l_quantity AS x, y FROM s, (SELECT unnest(['low', 'high']) AS side)
           UNION ALL SELECT 'l_discount', side, l_discount, y FROM s, (SELECT unnest(['low', 'high']) AS side)),
     {_WALK.format(low=_FLOOR, high=_CEIL)},
     c AS (SELECT dimension, side, (v + coalesce(CASE WHEN side = 'low' THEN above ELSE below END, v)) / 2 AS bound FROM w),
     p AS (SELECT dimension, side, bound, NULL::VARCHAR AS category, count(*) AS n, round(avg(y), 8) AS mean FROM c JOIN u USING (dimension, side)
           WHERE CASE WHEN side = 'low' THEN x >= bound ELSE x <= bound END GROUP BY 1, 2, 3
           UNION ALL SELECT 'l_returnflag', 'category', NULL, f.f, count(*), round(avg(y), 8) FROM s, (SELECT DISTINCT l_returnflag AS f FROM s) f WHERE l_returnflag <> f.f GROUP BY 4)
"""


@_query(_PEELS + "SELECT * FROM p")
def prim_peel_candidates(spark, d):
    prim = _prim(spark, d)
    return _steps(spark, prim, prim.start, prim.peels(prim.start))


@_query(_PEELS + f""", a AS (SELECT count(*) AS n0, avg(y) AS m0 FROM s),
     r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN n = n0 THEN 0 ELSE (mean - m0) / (n0 - n) END DESC, dimension, side, category) AS r FROM p, a)
SELECT dimension, side, bound, category, n, mean FROM r WHERE r = 1""")
def prim_first_peel(spark, d):
    prim = _prim(spark, d)
    now, = prim._measure(prim.df, [prim.start])
    return _steps(spark, prim, prim.start, [prim.best(now, prim.peels(prim.start))[:3]])


@_query(f"""WITH s AS (SELECT l_quantity AS q, l_discount AS c, l_returnflag AS f, {_STEEP} AS y FROM lineitem),
     e AS (SELECT min(q) AS q0, max(q) AS q1, min(c) AS c0, max(c) AS c1 FROM s),
     u AS (SELECT 'l_quantity' AS dimension, 'low' AS side, q AS x FROM s WHERE q <= 20 AND c BETWEEN 0.02 AND 0.06 AND f IN ('A', 'R')
           UNION ALL SELECT 'l_quantity', 'high', q FROM s WHERE q >= 40 AND c BETWEEN 0.02 AND 0.06 AND f IN ('A', 'R')
           UNION ALL SELECT 'l_discount', 'low', c FROM s WHERE q BETWEEN 20 AND 40 AND c <= 0.02 AND f IN ('A', 'R')
           UNION ALL SELECT 'l_discount', 'high', c FROM s WHERE q BETWEEN 20 AND 40 AND c >= 0.06 AND f IN ('A', 'R')),
     {_WALK.format(low=_CEIL, high=_FLOOR)},
     b AS (SELECT dimension, side, (v + coalesce(CASE WHEN side = 'low' THEN below ELSE above END, v)) / 2 AS bound FROM w)
SELECT dimension, side, bound, NULL::VARCHAR AS category, count(*) AS n, round(avg(y), 8) AS mean FROM b, s
WHERE f IN ('A', 'R') AND q BETWEEN CASE WHEN dimension = 'l_quantity' AND side = 'low' THEN bound ELSE 20 END AND CASE WHEN dimension = 'l_quantity' AND side = 'high' THEN bound ELSE 40 END
  AND c BETWEEN CASE WHEN dimension = 'l_discount' AND side = 'low' THEN bound ELSE 0.02 END AND CASE WHEN dimension = 'l_discount' AND side = 'high' THEN bound ELSE 0.06 END
GROUP BY 1, 2, 3
UNION ALL SELECT 'l_returnflag', 'category', NULL, g.f, count(*), round(avg(y), 8) FROM s, (SELECT DISTINCT f FROM s WHERE f NOT IN ('A', 'R')) g
WHERE q BETWEEN 20 AND 40 AND c BETWEEN 0.02 AND 0.06 AND s.f IN ('A', 'R', g.f) GROUP BY 4""")
def prim_paste_candidates(spark, d):
    prim = _prim(spark, d)
    return _steps(spark, prim, MIDDLE, prim.pastes(MIDDLE))


def _left(spark, d, update: str) -> DataFrame:
    """Rows and cases of interest that the next search starts from, by flag, after one box."""
    prim = _prim(spark, d, update=update)
    prim.found.append(B.PrimBox(MIDDLE))
    return prim._remaining().groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("k"))


@_query(f"SELECT l_returnflag, count(*) AS n, sum({_STEEP})::BIGINT AS k FROM lineitem WHERE NOT ({_IN}) GROUP BY 1")
def remaining_points(spark, d):
    return _left(spark, d, "default")


@_query(f"SELECT l_returnflag, count(*) AS n, sum(CASE WHEN {_IN} THEN 0 ELSE {_STEEP} END)::BIGINT AS k FROM lineitem GROUP BY 1")
def guivarch_update(spark, d):
    return _left(spark, d, "guivarch")
