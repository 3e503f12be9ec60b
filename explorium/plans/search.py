"""Search over a model's parameters: many objectives at once, or as much of the outcome space as can be reached.

A generation is a table and its evaluation one job; the driver holds one population and its archive, both bounded by their
parameters or by the epsilon boxes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from explorium.functions.designs import Parameter
from explorium.plans import models as M

Evaluate = Callable[[DataFrame], DataFrame]


def of_model(model: M.Model, constraints: dict[str, Column] | None = None, reference: dict[str, object] | None = None) -> Evaluate:
    """Objectives of each point from one run of the model; the other parameters are those of ``reference``."""

    def evaluate(points: DataFrame) -> DataFrame:
        out = M.run(model, points.withColumns({c: F.lit(v) for c, v in (reference or {}).items()}))
        return out.withColumns({f"constraint_{c}": e for c, e in (constraints or {}).items()})

    return evaluate


def robust(model: M.Model, scenarios: DataFrame, functions: dict[str, Column], constraints: dict[str, Column] | None = None) -> Evaluate:
    """Objectives of each point from its runs under every scenario; ``functions`` are aggregates over the outcomes."""

    def evaluate(points: DataFrame) -> DataFrame:
        runs = M.run(model, scenarios.drop("sample_id").crossJoin(F.broadcast(points)))  # a population's rows
        out = runs.groupBy("sample_id").agg(*[e.alias(c) for c, e in functions.items()])
        return out.withColumns({f"constraint_{c}": e for c, e in (constraints or {}).items()})

    return evaluate


@dataclass
class Solution:
    x: np.ndarray
    y: np.ndarray
    violation: float = 0.0
    operator: str = ""


@dataclass
class Outcome:
    """``archive`` and ``convergence`` are tables' rows; the archive's columns are the parameters, then the objectives."""

    columns: list[str]
    archive: list[tuple]
    convergence: list[dict] = field(default_factory=list)
    snapshots: dict[int, list[tuple]] = field(default_factory=dict)


class Evaluator:
    """Runs populations on the cluster."""

    def __init__(self, spark: SparkSession, parameters: list[Parameter], outcomes: dict[str, int], evaluate: Evaluate):
        self.spark, self.parameters, self.outcomes, self.evaluate, self.nfe = spark, parameters, outcomes, evaluate, 0

    def values(self, x: np.ndarray) -> list:
        out = []
        for p, v in zip(self.parameters, x, strict=True):
            out.append(float(v) if p.kind == "real" else int(v) if p.kind == "integer" else p.levels()[int(v)])
        return out

    def __call__(self, xs: list[tuple[np.ndarray, str]]) -> list[Solution]:
        kinds = {"real": "double", "integer": "long", "boolean": "boolean"}
        of = lambda p: kinds.get(p.kind) or {bool: "boolean", int: "long", float: "double"}.get(type(p.levels()[0]), "string")
        schema = ", ".join(["sample_id long", *(f"`{p.name}` {of(p)}" for p in self.parameters)])
        points = self.spark.createDataFrame([(i, *self.values(x)) for i, (x, _) in enumerate(xs)], schema)
        table = self.evaluate(points.repartition(self.spark.sparkContext.defaultParallelism))
        limits = [c for c in table.columns if c.startswith("constraint_")]
        rows = {r.sample_id: r for r in table.select("sample_id", *self.outcomes, *limits).collect()}
        self.nfe += len(xs)
        out = []
        for i, (x, operator) in enumerate(xs):
            r = rows.get(i)
            y = [r[c] if r is not None else None for c in self.outcomes]
            failed = any(v is None or not math.isfinite(v) for v in y)
            violation = math.inf if failed else sum(abs(r[c] or 0.0) for c in limits)
            out.append(Solution(x, np.array([math.inf if failed else -s * v if s else v for v, s in zip(y, self.outcomes.values(), strict=True)]), violation, operator))
        return out


class Variation:
    """Children of parents. Reals by several crossovers whose shares follow their members in the archive; bits of integers and categories are swapped."""

    def __init__(self, parameters: list[Parameter], rng: np.random.Generator, adaptive: bool):
        self.ps, self.rng = parameters, rng
        self.low = np.array([p.lower if p.kind in ("real", "integer") else 0 for p in parameters], float)
        self.high = np.array([p.upper if p.kind in ("real", "integer") else len(p.levels()) - 1 for p in parameters], float)
        self.real = np.array([p.kind == "real" for p in parameters])
        self.category = np.array([p.kind not in ("real", "integer") for p in parameters])
        self.adaptive = adaptive and bool(self.real.all())
        self.arity = {"sbx": 2, "de": 4, "pcx": 3, "undx": 3, "spx": 3, "um": 1} if self.adaptive else {"sbx": 2}
        self.share = dict.fromkeys(self.arity, 1 / len(self.arity))

    def first(self) -> np.ndarray:
        u = self.rng.random(len(self.ps))
        return np.where(self.real, self.low + u * (self.high - self.low), np.minimum(self.low + np.floor(u * (self.high - self.low + 1)), self.high))

    def follow(self, archive: list[Solution]) -> None:
        """Shares by members made, one added to each so none dies out."""
        counts = {k: 1 + sum(s.operator == k for s in archive) for k in self.arity}
        self.share = {k: v / sum(counts.values()) for k, v in counts.items()}

    def choose(self) -> str:
        return str(self.rng.choice(list(self.share), p=list(self.share.values())))

    def children(self, how: str, parents: list[np.ndarray]) -> list[np.ndarray]:
        made = getattr(self, how)(parents)
        if how != "um":
            made = [self.mutate(x) for x in made]
        return [np.where(self.real, np.clip(x, self.low, self.high), np.clip(np.round(x), self.low, self.high)) for x in made]

    def sbx(self, parents: list[np.ndarray], eta: float = 15.0) -> list[np.ndarray]:
        a, b = parents[0].copy(), parents[1].copy()
        for i in range(len(a)):
            if self.rng.random() >= 0.5 or a[i] == b[i]:
                continue
            if self.category[i]:
                a[i], b[i] = b[i], a[i]
            elif not self.real[i]:
                base = int(self.low[i])
                m, n = int(a[i]) - base, int(b[i]) - base
                mask = int(self.rng.integers(0, 1 << max(1, int(self.high[i] - self.low[i]).bit_length()))) & (m ^ n)
                a[i], b[i] = base + (m ^ mask), base + (n ^ mask)
            else:
                u = self.rng.random()
                spread = (2 * u) ** (1 / (eta + 1)) if u <= 0.5 else (0.5 / (1 - u)) ** (1 / (eta + 1))
                a[i], b[i] = 0.5 * ((1 + spread) * a[i] + (1 - spread) * b[i]), 0.5 * ((1 - spread) * a[i] + (1 + spread) * b[i])
        return [a, b]

    def de(self, parents: list[np.ndarray], rate: float = 0.1, step: float = 0.5) -> list[np.ndarray]:
        x, a, b, c = parents
        take = self.rng.random(len(x)) < rate
        take[self.rng.integers(len(x))] = True
        return [np.where(take, c + step * (a - b), x)]

    def pcx(self, parents: list[np.ndarray], eta: float = 0.1, zeta: float = 0.1) -> list[np.ndarray]:
        x, centre = parents[0], np.mean(parents, axis=0)
        d = x - centre
        size = np.linalg.norm(d)
        noise = self.rng.normal(0, eta, len(x))
        if size > 0:
            unit = d / size
            gaps = [np.linalg.norm((p - x) - ((p - x) @ unit) * unit) for p in parents[1:]]
            noise = (noise - (noise @ unit) * unit) * float(np.mean(gaps))
        return [x + self.rng.normal(0, zeta) * d + noise]

    def undx(self, parents: list[np.ndarray], zeta: float = 0.5, eta: float = 0.35) -> list[np.ndarray]:
        a, b, c = parents
        axis = b - a
        size = np.linalg.norm(axis)
        off = c - a
        noise = self.rng.normal(0, eta / math.sqrt(len(a)), len(a))
        if size > 0:
            unit = axis / size
            noise = (noise - (noise @ unit) * unit) * float(np.linalg.norm(off - (off @ unit) * unit))
        return [(a + b) / 2 + self.rng.normal(0, zeta) * axis + noise]

    def spx(self, parents: list[np.ndarray], epsilon: float = 2.0) -> list[np.ndarray]:
        centre = np.mean(parents, axis=0)
        corners = [centre + epsilon * (p - centre) for p in parents]
        x = np.zeros_like(centre)
        for k in range(1, len(corners)):
            x = self.rng.random() ** (1 / k) * (corners[k - 1] - corners[k] + x)
        return [corners[-1] + x]

    def um(self, parents: list[np.ndarray]) -> list[np.ndarray]:
        x, new = parents[0].copy(), self.first()
        swap = self.rng.random(len(x)) < 1 / len(x)
        return [np.where(swap, new, x)]

    def mutate(self, x: np.ndarray, eta: float = 20.0) -> np.ndarray:
        x = x.copy()
        for i in np.flatnonzero(self.rng.random(len(x)) < 1 / len(x)):
            if self.real[i]:
                u = self.rng.random()
                wide = self.high[i] - self.low[i]
                near = (x[i] - self.low[i]) / wide if u < 0.5 else (self.high[i] - x[i]) / wide
                base = 2 * u + (1 - 2 * u) * (1 - np.clip(near, 0, 1)) ** (eta + 1) if u < 0.5 else 2 * (1 - u) + (2 * u - 1) * (1 - np.clip(near, 0, 1)) ** (eta + 1)
                x[i] += wide * ((base ** (1 / (eta + 1)) - 1) if u < 0.5 else (1 - base ** (1 / (eta + 1))))
            elif self.category[i]:
                x[i] = self.rng.integers(0, int(self.high[i]) + 1)
            else:
                bit = 1 << int(self.rng.integers(max(1, int(self.high[i] - self.low[i]).bit_length())))
                x[i] = self.low[i] + ((int(x[i]) - int(self.low[i])) ^ bit)
        return x


def better(a: Solution, b: Solution) -> bool:
    """Less violation, or no worse in any objective and not the same."""
    if a.violation != b.violation:
        return a.violation < b.violation
    return bool((a.y <= b.y).all() and (a.y < b.y).any())


class Archive:
    """One solution an epsilon box, none in a box that another box beats."""

    def __init__(self, epsilons: list[float]):
        self.epsilons, self.boxes, self.gains = np.array(epsilons, float), {}, 0

    def add(self, s: Solution) -> None:
        if s.violation > 0:
            return
        key = tuple(np.floor(s.y / self.epsilons).astype(int).tolist())
        far = lambda v: float(((v.y / self.epsilons - key) ** 2).sum())
        if key in self.boxes:
            if better(s, self.boxes[key]) or (not better(self.boxes[key], s) and far(s) < far(self.boxes[key])):
                self.boxes[key] = s
            return
        beats = lambda p, q: all(i <= j for i, j in zip(p, q, strict=True))
        if any(beats(k, key) for k in self.boxes):
            return
        self.boxes = {k: v for k, v in self.boxes.items() if not beats(key, k)} | {key: s}
        self.gains += 1

    def members(self) -> list[Solution]:
        return list(self.boxes.values())


def ranked(pool: list[Solution], keep: int) -> list[Solution]:
    """The best by fronts, the last front's most crowded left out."""
    left, out = list(range(len(pool))), []
    while left and len(out) < keep:
        front = [i for i in left if not any(better(pool[j], pool[i]) for j in left)]
        inside = set(front)
        left = [i for i in left if i not in inside]
        if len(out) + len(front) > keep:
            y = np.array([pool[i].y for i in front])
            crowd = np.zeros(len(front))
            for c in range(y.shape[1]):
                order = y[:, c].argsort(kind="stable")
                wide = y[order[-1], c] - y[order[0], c]
                crowd[order[[0, -1]]] = math.inf
                if wide > 0 and math.isfinite(wide):
                    crowd[order[1:-1]] += (y[order[2:], c] - y[order[:-2], c]) / wide
            front = [front[k] for k in np.argsort(-crowd, kind="stable")[: keep - len(out)]]
        out += front
    return [pool[i] for i in out]


def optimize(spark: SparkSession, evaluate: Evaluate, parameters: list[Parameter], objectives: dict[str, int], epsilons: list[float], nfe: int = 10_000, population: int = 100, seed: int = 0, adaptive: bool = False, frequency: int = 1000, initial: list[np.ndarray] | None = None) -> Outcome:
    """Sorting by fronts with an epsilon archive; when the archive stops growing in keeping with the population, a restart from the archive.

    ``objectives`` gives each -1 (minimise) or 1 (maximise). ``adaptive`` lets six operators compete (real parameters only).
    """
    if len(epsilons) != len(objectives):
        raise ValueError("an epsilon for each objective is asked for")
    if any(s not in (-1, 1) for s in objectives.values()):
        raise ValueError("every objective must be minimised or maximised")
    rng = np.random.default_rng(seed)
    run, vary, archive = Evaluator(spark, parameters, objectives, evaluate), Variation(parameters, rng, adaptive), Archive(epsilons)
    out = Outcome([p.name for p in parameters] + list(objectives), [])
    signs = np.array([-s for s in objectives.values()])
    rows = lambda: [(*run.values(s.x), *map(float, s.y * signs)) for s in archive.members()]
    told, size, since = 0, population, 0

    def note(last: bool = False) -> None:
        nonlocal told
        if last or run.nfe - told >= frequency:
            told = run.nfe
            out.convergence.append({"nfe": run.nfe, "epsilon_progress": archive.gains, "archive": len(archive.boxes), **vary.share})
            out.snapshots[run.nfe] = rows()

    def take(xs: list[tuple[np.ndarray, str]]) -> list[Solution]:
        made = run(xs)
        for s in made:
            archive.add(s)
        note()
        return made

    people = take([(x, "") for x in [*(initial or []), *(vary.first() for _ in range(population))][:population]])
    while run.nfe < nfe:
        vary.follow(archive.members())
        children: list[tuple[np.ndarray, str]] = []
        want = min(size, nfe - run.nfe)
        while len(children) < want:
            how = vary.choose()
            parents = []
            for _ in range(vary.arity[how]):
                a, b = rng.integers(len(people), size=2)
                parents.append(people[a].x if better(people[a], people[b]) else people[b].x)
            children += [(x, how) for x in vary.children(how, parents)]
        people = ranked(people + take(children[:want]), size)
        since += 1
        members = archive.members()
        if since >= 25 and members and run.nfe < nfe and not 0.75 <= 4 * len(members) / size <= 1.25:
            size, since = max(population, 4 * len(members)), 0
            fresh = [(vary.children("um" if vary.adaptive else "sbx", [members[rng.integers(len(members))].x] * 2)[0], "") for _ in range(min(max(size - len(members), 0), nfe - run.nfe))]
            people = members + (take(fresh) if fresh else [])
    note(last=True)
    out.archive = rows()
    return out


def explore(spark: SparkSession, evaluate: Evaluate, parameters: list[Parameter], outcomes: list[str], grid: list[tuple[float, float, float]], nfe: int = 10_000, population: int = 100, seed: int = 0, adaptive: bool = False) -> Outcome:
    """Spreads runs over a grid of outcomes, (low, high, width) each; parents are those in cells hit less often. The archive holds, for each cell hit, the run nearest to the cell's centre, and the hits last."""
    rng = np.random.default_rng(seed)
    run, vary = Evaluator(spark, parameters, dict.fromkeys(outcomes, 0), evaluate), Variation(parameters, rng, adaptive)
    low, _, width = (np.array(v, float) for v in zip(*grid, strict=True))
    best: dict[tuple, Solution] = {}
    hits: dict[tuple, int] = {}
    gains = 0
    cell = lambda s: tuple(np.floor((s.y - low) / width).astype(int).tolist())
    out = Outcome([p.name for p in parameters] + outcomes + ["hits"], [])

    def take(xs: list[tuple[np.ndarray, str]]) -> list[Solution]:
        nonlocal gains
        made = [s for s in run(xs) if s.violation == 0]
        for s in made:
            key = cell(s)
            far = lambda v, k=key: float((((v.y - low) / width - k - 0.5) ** 2).sum())
            gains += key not in hits
            hits[key] = hits.get(key, 0) + 1
            if key not in best or far(s) < far(best[key]):
                best[key] = s
        out.convergence.append({"nfe": run.nfe, "cells": gains, "novelty": sum(sum(1 / k for k in range(1, n + 1)) for n in hits.values())})
        return made

    people = take([(vary.first(), "") for _ in range(population)])
    while run.nfe < nfe:
        vary.follow(list(best.values()))
        children = []
        want = min(population, nfe - run.nfe)
        while len(children) < want:
            how = vary.choose()
            parents = []
            for _ in range(vary.arity[how]):
                if not people:
                    parents.append(vary.first())
                    continue
                a, b = (people[k] for k in rng.integers(len(people), size=2))
                parents.append(a.x if hits[cell(a)] <= hits[cell(b)] else b.x)
            children += [(x, how) for x in vary.children(how, parents)]
        made = take(children[:want])
        people = sorted(people + made, key=lambda s: hits[cell(s)])[:population]
    out.archive = [(*run.values(s.x), *map(float, s.y), hits[k]) for k, s in sorted(best.items())]
    return out
