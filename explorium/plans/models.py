"""Models run over designs: a Python function by batches, or Column expressions that stay in the engine."""

from __future__ import annotations

import inspect
import itertools
import numbers
import warnings
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from explorium.exceptions import CaseError, ExplorationError, ExplorationWarning, OutcomeError
from explorium.functions.designs import Parameter
from explorium.sources.shared import Tables


@dataclass(frozen=True)
class Outcome:
    """kind: scalar, series or array (of rows). sign: -1 minimise, 0 neither, 1 maximise. of: columns it's made from, by ``function``."""

    name: str
    kind: str = "scalar"
    sign: int = 0
    of: tuple[str, ...] = ()
    function: Callable | None = None

    @property
    def type(self) -> str:
        return {"scalar": "double", "series": "array<double>", "array": "array<array<double>>"}[self.kind]


@dataclass
class Model:
    """``function`` takes parameters by name and returns a dict, or a tuple in the order of the outcomes; ``expressions`` make outcomes from columns instead.

    ``variants`` are functions that a column called function of a design, as a policy may have it, chooses by name.
    """

    name: str
    outcomes: list[Outcome]
    function: Callable | None = None
    expressions: dict[str, Callable[[DataFrame], Column]] = field(default_factory=dict)
    constants: dict[str, object] = field(default_factory=dict)
    uncertainties: tuple[Parameter, ...] = ()
    levers: tuple[Parameter, ...] = ()
    variants: dict[str, Callable] = field(default_factory=dict)

    def __post_init__(self):
        if not self.name.isidentifier():
            raise ValueError(f"{self.name!r} is no identifier")


@dataclass(frozen=True)
class Constraint:
    """``function`` of parameters or outcomes (``of``) is how far a run breaks the constraint: 0 if it holds, never below."""

    name: str
    of: tuple[str, ...]
    function: Callable[..., Column]

    @property
    def broken(self) -> Column:
        far = self.function(*map(F.col, self.of))
        return F.when(far < 0, F.raise_error(F.lit(f"constraint {self.name} is below 0"))).otherwise(far).cast("double").alias(self.name)


def constrained(runs: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """The runs with a column for each constraint; one below 0 is an error of the constraint and ends the job."""
    return runs.withColumns({c.name: c.broken for c in constraints})


def checked(outcome: Outcome, value):
    """The value of a run, if it is a number, or for series and arrays a collection; None stands for a missing one."""
    if value is None:
        return None
    if outcome.kind == "scalar":
        if not isinstance(value, (numbers.Number, np.generic)):
            raise OutcomeError(f"{outcome.name} should be a number, but is a {type(value).__name__}")
        return float(value)
    if isinstance(value, (str, bytes)) or not isinstance(value, (Iterable, np.ndarray)):
        raise OutcomeError(f"{outcome.name} should be a collection, but is a {type(value).__name__}")
    return value


def outcomes_of(got, outcomes: list[Outcome]) -> list:
    """Values in the order of the outcomes, from what a function returned: by name, or by place in a tuple. What is missing is None, with a warning."""
    if isinstance(got, tuple):
        names = [n for o in outcomes for n in (o.of or (o.name,))]
        if len(got) != len(names):
            raise OutcomeError(f"{len(got)} values were returned for {len(names)} variables")
        got = dict(zip(names, got, strict=True))
    row = []
    for o in outcomes:
        wanted = o.of or (o.name,)
        if gone := [n for n in wanted if n not in got]:
            warnings.warn(f"the model returned nothing for {gone}", ExplorationWarning, stacklevel=2)
            row.append(None)
        else:
            values = [got[n] for n in wanted]
            row.append(checked(o, o.function(*values) if o.function else values[0]))
    return row


def run(model: Model, design: DataFrame) -> DataFrame:
    """The design with the model's outcomes. A run that raises has null outcomes and its error in ``status``; others have 'ok'.

    An ``ExplorationError`` that isn't a ``CaseError``, such as an outcome of the wrong type, ends the job. A Python
    function is called once a run, inside batches; expressions stay in the engine.
    """
    if clash := set(model.constants) & set(design.columns):
        raise ValueError(f"constants are parameters too: {sorted(clash)}")
    if clash := {*(o.name for o in model.outcomes), "status"} & set(design.columns):
        raise ValueError(f"outcomes are columns of the design too: {sorted(clash)}")
    if model.expressions:
        out = design
        for o in model.outcomes:
            out = out.withColumn(o.name, model.expressions[o.name](design).cast(o.type))
        return out.withColumn("status", F.lit("ok"))
    chosen = bool(model.variants) and "function" in design.columns
    names = [c for c in design.columns if not (chosen and c == "function")]
    functions = model.variants if chosen else {None: model.function}
    takes = {}
    for key, f in functions.items():
        signature = inspect.signature(f).parameters
        loose = any(p.kind is p.VAR_KEYWORD for p in signature.values())
        takes[key] = [c for c in names if loose and c not in ("experiment_id", "sample_id", "model_id", "policy_id", "scenario_id") or c in signature]
    outcomes, constants = model.outcomes, model.constants

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            keys = df["function"] if chosen else itertools.repeat(None, len(df))
            columns = {c: df[c].tolist() for own in takes.values() for c in own}  # values of Python, which raise where NumPy's don't
            for i, key in enumerate(keys):
                try:
                    if key not in functions:
                        raise CaseError(f"no function called {key!r}")
                    got = functions[key](**{c: columns[c][i] for c in takes[key]}, **constants)
                    rows.append([*outcomes_of(got, outcomes), "ok"])
                except Exception as e:
                    if isinstance(e, ExplorationError) and not isinstance(e, CaseError):
                        raise
                    rows.append([*[None] * len(outcomes), f"{type(e).__name__}: {e}"])
            yield pd.concat([df.reset_index(drop=True), pd.DataFrame(rows, columns=[*(o.name for o in outcomes), "status"])], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in design.schema), *(f"`{o.name}` {o.type}" for o in outcomes), "status string"])
    return design.mapInPandas(batches, schema)


def merge(a: DataFrame, b: DataFrame, outcomes: list[str]) -> DataFrame:
    """Results one after the other with the outcomes both have; the second's ids follow the first's."""
    drop = [c for c in outcomes if c not in a.columns or c not in b.columns]
    start = a.agg(F.coalesce(F.max("experiment_id") + 1, F.lit(0))).first()[0]
    return a.drop(*drop).unionByName(b.drop(*drop).withColumn("experiment_id", F.col("experiment_id") + start))


def consumed(runs: DataFrame, consumer: Callable[[DataFrame, int], None], batches: int = 1, key: str = "experiment_id") -> None:
    """Finished runs handed on in as many parts, each once and with its number: the place for a writer of one's own.

    The runs are written first, a folder a part, so the model runs once a design, whatever the consumer does with its part.
    """
    tables = Tables(runs.sparkSession, "consumed")
    saved = tables.save(runs.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int")), "runs", "__part")
    for k in range(batches):
        consumer(saved.where(F.col("__part") == k).drop("__part"), k)
    tables.drop("runs")


def counted(runs: DataFrame, name: str = "runs") -> tuple[DataFrame, Observation]:
    """The runs, and an observation that has the number of finished and of failed ones once a job over them ends."""
    seen = Observation(name)
    return runs.observe(seen, F.count(F.lit(1)).alias("finished"), F.count_if(F.col("status") != "ok").alias("failed")), seen
