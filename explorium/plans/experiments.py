"""Experiments: models by policies by scenarios, sampled, run and kept under one key."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from explorium.functions import designs as D
from explorium.plans import models as M


def gathered(models: list[M.Model], kind: str, union: bool = True) -> list[D.Parameter]:
    """Parameters of all models by name (those that every model has, without ``union``), in order of appearance."""
    own = [{p.name: p for p in getattr(m, kind)} for m in models]
    out: dict[str, D.Parameter] = {}
    for ps in own:
        for name, p in ps.items():
            if name in out and out[name] != p:
                raise ValueError(f"{name} differs between models")
            out.setdefault(name, p)
    return [p for n, p in out.items() if union or all(n in ps for ps in own)]


def design_of(spark: SparkSession, asked: int | DataFrame, parameters: list[D.Parameter], sampler, seed: int, label: str) -> DataFrame:
    """A design: as many points as asked for, one point named None without parameters for 0, or the given table numbered by sample_id."""
    if isinstance(asked, DataFrame):
        df = asked
        if "sample_id" not in df.columns:
            raise ValueError("a design needs sample_id, counting from 0")
    elif asked == 0 or not parameters:
        return spark.range(1).select(F.col("id").alias("sample_id"), F.lit("None").alias(label))
    else:
        options = {} if not isinstance(sampler, str) or sampler in ("ff", "sobol") else {"seed": seed}
        df = D.sample(spark, parameters, asked, sampler, **options)
    return df if label in df.columns else df.withColumn(label, F.col("sample_id").cast("string"))


def experiments(models: DataFrame, policies: DataFrame, scenarios: DataFrame, how: str, seed: int) -> DataFrame:
    if how == "full_factorial":
        return D.experiments(models, policies, scenarios)
    counts = [x.count() for x in (models, policies, scenarios)]
    top = max(counts)
    ids = models.sparkSession.range(top).withColumnRenamed("id", "experiment_id")
    for name, df, n in zip(("model_id", "policy_id", "scenario_id"), (models, policies, scenarios), counts, strict=True):
        pick = F.pmod("experiment_id", F.lit(n)) if how == "cycle" or n == top else F.floor(D.uniform(name, seed, "experiment_id") * n)
        ids = ids.withColumn(name, pick.cast("long")).join(df.withColumnRenamed("sample_id", name), name)
    return ids


def perform(spark: SparkSession, models: list[M.Model], scenarios: int | DataFrame = 0, policies: int | DataFrame = 0, combine: str = "full_factorial", sampler: str | Callable = "lhs", lever_sampler: str | Callable = "lhs", union: bool = True, replications: int | list[dict] = 1, seed: int = 0, constraints: list[M.Constraint] = ()) -> DataFrame:
    """One row an experiment: its id, model, policy, scenario, parameters, outcomes and status, and how far it breaks each constraint.

    Parameters a model lacks aren't passed to it; a parameter with ``variables`` is passed under those names, and where
    null it takes its default. With replications, outcomes are arrays over them in order and the status is the first
    that isn't ok.
    """
    if combine not in ("full_factorial", "cycle", "sample"):
        raise ValueError(f"no way to combine called {combine!r}")
    names = spark.createDataFrame([(i, m.name) for i, m in enumerate(models)], "sample_id long, model string")
    policy = design_of(spark, policies, gathered(models, "levers", union), lever_sampler, seed + 1, "policy")
    scenario = design_of(spark, scenarios, gathered(models, "uncertainties", union), sampler, seed, "scenario")
    if clash := (set(policy.columns) & set(scenario.columns)) - {"sample_id"}:
        raise ValueError(f"both designs have {sorted(clash)}")
    every = experiments(names, policy, scenario, combine, seed)
    parts = []
    for i, m in enumerate(models):
        one = every.where(F.col("model_id") == i)
        parts.append(_replicated(m, _passed(m, one), replications).select(*[c for c in one.columns], *[o.name for o in m.outcomes], "status"))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).drop("model_id", "policy_id", "scenario_id")
    return M.constrained(out, list(constraints))


def _passed(model: M.Model, design: DataFrame) -> DataFrame:
    """Defaults filled in and values under the names of the model's variables."""
    out = design
    for p in (*model.uncertainties, *model.levers):
        if p.name not in out.columns and p.default is not None:
            out = out.withColumn(p.name, F.lit(p.default))
        elif p.default is not None:
            out = out.withColumn(p.name, F.coalesce(F.col(p.name), F.lit(p.default)))
        if p.name in out.columns:
            out = out.withColumns({v: c for v, c in p.passed().items() if v != p.name or p.kind == "category"})
    return out


def _replicated(model: M.Model, design: DataFrame, replications: int | list[dict]) -> DataFrame:
    if replications == 1:
        return M.run(model, design)
    settings = [{"replication": k} for k in range(replications)] if isinstance(replications, int) else [{"replication": k} | r for k, r in enumerate(replications)]
    columns = list(settings[0])
    if any(list(s) != columns for s in settings):
        raise ValueError("every replication needs the same settings")
    arrays = F.array(*[F.struct(*[F.lit(s[c]).alias(c) for c in columns]) for s in settings])
    long = design.withColumn("__r", F.explode(arrays)).select(*design.columns, "__r.*")
    ran = M.run(model, long)
    names = [o.name for o in model.outcomes]
    rows = F.array_sort(F.collect_list(F.struct("replication", "status", *names)))
    # an experiment is one row of the design
    rest = [c for c in design.columns if c != "experiment_id"]
    out = ran.groupBy("experiment_id").agg(rows.alias("__rows"), *[F.first(c).alias(c) for c in rest])
    bad = F.filter("__rows", lambda r: r["status"] != "ok")
    status = F.when(F.size(bad) > 0, F.try_element_at(bad, F.lit(1))["status"]).otherwise("ok")
    return out.select(*design.columns, *[F.col(f"__rows.{c}").alias(c) for c in names], status.alias("status"))
