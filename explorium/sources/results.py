"""Reading and writing of parameters and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from explorium.functions.designs import Parameter
from explorium.plans.models import Outcome


def save_results(results: DataFrame, path: str) -> None:
    """Parquet with typed columns; an existing path is refused."""
    results.write.mode("errorifexists").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_parameters(spark: SparkSession, parameters: list[Parameter], path: str) -> None:
    rows = [(p.name, p.kind, float(p.lower), float(p.upper), "|".join(map(str, p.levels()))) for p in parameters]
    spark.createDataFrame(rows, "name string, type string, lower double, upper double, categories string").coalesce(1).write.mode("errorifexists").csv(path, header=True)


def load_parameters(spark: SparkSession, path: str) -> list[Parameter]:
    """Rows: name, type, lower, upper, categories (split by |)."""
    out = []
    for r in spark.read.csv(path, header=True).orderBy("name").toLocalIterator():
        if r.type in ("real", "integer"):
            out.append(Parameter(r.name, r.type, float(r.lower), float(r.upper)))
        else:
            out.append(Parameter(r.name, r.type, categories=tuple((r.categories or "").split("|")) if r.type == "category" else ()))
    return out


def append_archive(archive: DataFrame, nfe: int, path: str) -> None:
    """One more snapshot of a search, partitioned by the number of evaluations."""
    archive.withColumn("nfe", F.lit(nfe)).write.mode("append").partitionBy("nfe").parquet(path)


def load_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parameters_of(table: DataFrame) -> list[Parameter]:
    """Parameters from a table of one row each: name (or NAME), perhaps type (or TYPE: real, int, cat, bool), then values; nulls in a row are left out.

    Without a type: two whole numbers are an integer's limits, two numbers a real's, all else are categories. The table is read on the driver.
    """
    columns = {c.lower(): c for c in table.columns if c.lower() in ("name", "type")}
    if "name" not in columns:
        raise ValueError("a column called name is asked for")
    out = []
    for r in table.toLocalIterator():
        values = [r[c] for c in table.columns if c not in columns.values() and r[c] is not None]
        numbers = [_number(v) for v in values]
        kind = r[columns["type"]] if "type" in columns else None
        if kind is None:
            kind = "cat" if len(values) != 2 or None in numbers else "int" if all(v == int(v) for v in numbers) else "real"
        name = r[columns["name"]].strip()
        if kind in ("real", "int"):
            out.append(Parameter(name, "real" if kind == "real" else "integer", numbers[0], numbers[1]))
        elif kind == "bool":
            out.append(Parameter(name, "boolean"))
        elif kind == "cat":
            out.append(Parameter(name, "category", categories=tuple(values)))
        else:
            raise ValueError(f"{name}: no type called {kind!r}")
    return out


def _number(v) -> float | None:
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def outcomes_of(table: DataFrame) -> list[Outcome]:
    """Outcomes from a table with name and type, scalar or timeseries. The table is read on the driver."""
    kinds = {"scalar": "scalar", "timeseries": "series"}
    out = []
    for r in table.select("name", "type").toLocalIterator():
        if r.type not in kinds:
            raise ValueError(f"{r.name}: no type called {r.type!r}")
        out.append(Outcome(r.name, kinds[r.type]))
    return out
