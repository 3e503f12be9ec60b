"""Boxes over experiment tables: filters, statistics, and the patient rule induction method.

A box maps a column to (low, high) or to a set of categories. Every step of the search is a few aggregations over the
data; only limits, counts and bins come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from explorium.exceptions import BoxError

Box = dict[str, "tuple[float, float] | frozenset"]


def in_box(box: Box) -> Column:
    """Closed limits and membership; plain predicates, so they reach the scan."""
    out = F.lit(True)
    for name, limit in box.items():
        out = out & (F.col(name).isin(*sorted(limit, key=str)) if isinstance(limit, frozenset) else F.col(name).between(*limit))
    return out


def bounding_box(df: DataFrame, columns: list[str] | None = None) -> Box:
    kinds = {f.name: f.dataType for f in df.schema.fields if columns is None or f.name in columns}
    numeric = [c for c, k in kinds.items() if isinstance(k, T.NumericType)]
    row = df.agg(*[F.min(c).alias(f"lo_{c}") for c in numeric], *[F.max(c).alias(f"hi_{c}") for c in numeric], *[F.collect_set(c).alias(f"set_{c}") for c in kinds if c not in numeric]).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) if c in numeric else frozenset(row[f"set_{c}"]) for c in kinds}


def restricted(box: Box, start: Box) -> list[str]:
    return [c for c in start if box[c] != start[c]]


def normalized(box: Box, start: Box) -> dict[str, tuple[float, float]]:
    """Restricted limits on the unit interval; of categories, 0 to their share. Narrowest first."""
    out = {}
    for c in restricted(box, start):
        if isinstance(box[c], frozenset):
            out[c] = (0.0, len(box[c]) / len(start[c]))
        else:
            lo, hi = start[c]
            out[c] = ((box[c][0] - lo) / (hi - lo), (box[c][1] - lo) / (hi - lo))
    return dict(sorted(out.items(), key=lambda kv: (kv[1][1] - kv[1][0], kv[0])))


def box_stats(df: DataFrame, y: str, box: Box) -> DataFrame:
    """coverage, density, mass, n, k of a 0/1 outcome in a box; one pass. A box without rows has no density (null), an empty table no mass."""
    inside = in_box(box)
    n, k = F.count_if(inside), F.sum(F.when(inside, F.col(y)).otherwise(0))
    return df.agg((k / F.greatest(F.sum(y), F.lit(1))).alias("coverage"), F.try_divide(k, n).alias("density"), F.try_divide(n, F.count(F.lit(1))).alias("mass"), n.alias("n"), k.alias("k"))


def walked_quantile(values: Column, q: float) -> Column:
    """Quantile of a sorted array in which a tie at the rank steps out to the next distinct value and the middle is taken."""
    rank = (F.size(values) - 1) * q
    if q <= 0.5:
        v = F.element_at(values, (F.floor(rank) + 1).cast("int"))
        return (v + F.coalesce(F.array_min(F.filter(values, lambda x: x > v)), v)) / 2
    v = F.element_at(values, (F.ceil(rank) + 1).cast("int"))
    return (v + F.coalesce(F.array_max(F.filter(values, lambda x: x < v)), v)) / 2


BINS = 1000


@dataclass(frozen=True)
class Bin:
    """Values from low to high (both occur), how many, and the sum of the outcome over them."""

    low: float
    high: float
    n: int
    total: float


@dataclass
class Spread:
    """A numeric column over some rows, as bins in order."""

    rows: Column
    value: Column
    bins: list[Bin]

    def at(self, q: float) -> int:
        """The place of the bin that holds the rank of a share: from below up to a half, from above beyond."""
        rank = (sum(b.n for b in self.bins) - 1) * q
        rank, before = math.floor(rank) if q <= 0.5 else math.ceil(rank), 0
        for k, b in enumerate(self.bins):
            before += b.n
            if rank < before:
                return k
        raise ValueError("a quantile of no rows")

    def quantile(self, q: float) -> float:
        """Halfway from the value at the rank to the next distinct one, that is above up to a half and below beyond."""
        k = self.at(q)
        v = self.bins[k].low
        if q <= 0.5:
            return (v + self.bins[k + 1].low) / 2 if k + 1 < len(self.bins) else v
        return (self.bins[k - 1].high + v) / 2 if k else v


def _binned(df: DataFrame, y: str, ranges: list[tuple[Column, Column, float, float]]) -> list[list[Bin]]:
    """Bins of one width between the limits of each range (rows, value, low, high), empty ones left out; one pass for all, at most BINS rows each come back."""
    structs = []
    for i, (rows, value, low, high) in enumerate(ranges):
        x = value.cast("double")
        if math.isfinite(high - low) and math.isfinite(BINS / (high - low) if high > low else 0.0):
            place = F.least(F.lit(BINS - 1), F.floor((x - low) * (BINS / (high - low)))) if high > low else F.lit(0)
        else:  # no width to count in: only the ends are told from the rest
            place = F.when(x == low, 0).when(x == high, BINS - 1).otherwise(BINS // 2)
        structs.append(F.when(rows & x.between(low, high), F.struct(F.lit(i).alias("i"), place.cast("int").alias("place"), x.alias("x"))))
    long = df.select(y, F.explode(F.array(*structs)).alias("s")).where("s is not null")
    found = long.groupBy("s.i", "s.place").agg(F.min("s.x").alias("low"), F.max("s.x").alias("high"), F.count(F.lit(1)).alias("n"), F.sum(y).alias("total")).collect()
    out: list[list[Bin]] = [[] for _ in ranges]
    for r in sorted(found, key=lambda r: (r.i, r.place)):
        out[r.i].append(Bin(r.low, r.high, r.n, float(r.total or 0)))
    return out


def spreads(df: DataFrame, y: str, wanted: list[tuple[Column, Column, float, float, tuple[float, ...]]]) -> list[Spread]:
    """Each column (rows, value, low, high, shares) over its rows, exact at its shares.

    Bins that hold a share's rank are cut again until they hold one value: a pass for columns of few values, some
    more for others, each for all columns at once. Values never come to the driver, bins do.
    """
    out = [Spread(w[0], w[1], bins) for w, bins in zip(wanted, _binned(df, y, [w[:4] for w in wanted]), strict=True)] if wanted else []
    while True:
        wide = {(i, s.at(q)) for i, (s, w) in enumerate(zip(out, wanted, strict=True)) if s.bins for q in w[4]}
        wide = sorted((i, k) for i, k in wide if out[i].bins[k].low != out[i].bins[k].high)
        if not wide:
            return out
        parts = _binned(df, y, [(out[i].rows, out[i].value, out[i].bins[k].low, out[i].bins[k].high) for i, k in wide])
        for (i, k), bins in reversed(list(zip(wide, parts, strict=True))):
            out[i].bins[k : k + 1] = bins


def quantile(df: DataFrame, column: str, q: float) -> float | None:
    """``walked_quantile`` of a column of any size."""
    x = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    low, high = x.agg(F.min("x"), F.max("x")).first()
    return None if low is None else spreads(x, "x", [(F.lit(True), F.col("x"), low, high, (q,))])[0].quantile(q)


@dataclass
class PrimBox:
    """A box and the steps that led to it. ``at`` is the step that counts; once a later box is searched for it can't change."""

    limits: Box
    trajectory: list[dict] = field(default_factory=list)
    frozen: bool = False
    at: int = -1

    def select(self, step: int) -> dict:
        """The step of the trajectory whose limits are the box's from now on."""
        if self.frozen:
            raise BoxError("a later box has been found without the rows of this one")
        if not -len(self.trajectory) <= step < len(self.trajectory):
            raise BoxError(f"the trajectory has {len(self.trajectory)} steps")
        self.at, self.limits = step, self.trajectory[step]["limits"]
        return self.trajectory[step]

    @property
    def current(self) -> dict:
        return self.trajectory[self.at]

    def nearest(self, what: str, value: float) -> int:
        """The first step whose coverage, density or other measure is nearest to a value."""
        return min(range(len(self.trajectory)), key=lambda i: abs(self.trajectory[i][what] - value))


class Prim:
    """Peels a share ``alpha`` off the box again and again while the mean of a 0/1 outcome rises, then pastes back.

    Rows without an outcome are left out. Rows in earlier boxes are left out of later searches, or, with ``update`` guivarch, stay as no cases of interest.
    With ``compat`` nothing is pasted to a box in which no real column is restricted, as older results have it.
    """

    def __init__(self, df: DataFrame, y: str, columns: list[str], alpha: float = 0.05, mass_min: float = 0.05, objective: str = "lenient1", update: str = "default", compat: bool = False):
        if objective not in ("lenient1", "lenient2", "original") or update not in ("default", "guivarch"):
            raise ValueError(f"no objective {objective!r} or update {update!r}")
        # read once for all steps; what an executor loses is computed again
        df = df.select(*columns, y).where(F.col(y).isNotNull()).persist()
        self.df, self.y, self.alpha, self.mass_min, self.objective = df, y, alpha, mass_min, objective
        self.update, self.compat = update, compat
        self.real = {c for c, k in df.dtypes if k in ("double", "float")}
        self.start = {c: v for c, v in bounding_box(df, columns).items() if not isinstance(v, frozenset) or len(v) > 1}
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("k")).first()
        self.total, self.interest = row.n, float(row.k or 0)
        self.found: list[PrimBox] = []

    def score(self, old: tuple[int, float], new: tuple[int, float]) -> float:
        (n, m), (n2, m2) = old, new
        if not n2:
            return -1.0
        if self.objective == "original":
            return m2
        if m2 == m or n2 == n:  # of the same rows
            return 0.0
        return (m2 - m) / abs(n2 - n) * (n2 if self.objective == "lenient2" else 1)

    def entry(self, box: Box, n: int, mean: float) -> dict:
        """A step of a trajectory. Coverage is of all cases of interest, those in earlier boxes too."""
        k = n * mean
        return {"limits": box, "n": n, "mean": mean, "mass": n / max(self.total, 1), "k": k, "coverage": k / max(self.interest, 1), "density": mean, "res_dim": len(restricted(box, self.start))}

    def append(self, found: PrimBox, box: Box) -> dict:
        """Measures one more box and puts it last."""
        if found.frozen:
            raise BoxError("a later box has been found without the rows of this one")
        found.trajectory.append(self.entry(box, *self._measure(self._remaining(found), [box])[0]))
        found.limits, found.at = box, -1
        return found.trajectory[-1]

    def _remaining(self, found: PrimBox | None = None) -> DataFrame:
        """Rows that count after the boxes found before this one."""
        data = self.df
        for b in self.found:
            if b is found:
                break
            if self.update == "guivarch":
                data = data.withColumn(self.y, F.when(in_box(b.limits), F.lit(0)).otherwise(F.col(self.y)))
            else:
                data = data.where(~in_box(b.limits))
        return data

    def close(self) -> None:
        self.df.unpersist()

    def _measure(self, data: DataFrame, boxes: list[Box]) -> list[tuple[int, float]]:
        """Rows and mean of each box, all in one pass."""
        aggs = []
        for i, b in enumerate(boxes):
            aggs += [F.count_if(in_box(b)).alias(f"n{i}"), F.avg(F.when(in_box(b), F.col(self.y))).alias(f"m{i}")]
        row = data.agg(*aggs).first()
        return [(row[f"n{i}"], row[f"m{i}"] or 0.0) for i in range(len(boxes))]

    def peels(self, box: Box, data: DataFrame | None = None) -> list[tuple[Box, int, float]]:
        """Each box one peel away with its rows and mean, reals first, then whole numbers, then categories.

        A real's new limit is the exact quantile that steps over ties; a whole number's is the last value that stays, and
        a limit that the quantile doesn't move loses its own value. All from bins by column, in one pass or a few.
        """
        data, inside = self._remaining() if data is None else data, in_box(box)
        numeric = sorted((c for c, v in box.items() if not isinstance(v, frozenset)), key=lambda c: c not in self.real)
        found = spreads(data, self.y, [(inside, F.col(c), *box[c], (self.alpha, 1 - self.alpha)) for c in numeric])
        out = []
        for c, s in zip(numeric, found, strict=True):
            for side, q in ((1, 1 - self.alpha), (0, self.alpha)) if s.bins else ():
                cut = s.quantile(q)
                real = c in self.real
                cut = cut if real else int(cut)
                stays = [b for b in s.bins if (b.high <= cut if side else b.low >= cut)]
                if not real and cut == box[c][side]:
                    stays = [b for b in s.bins if (b.high < cut if side else b.low > cut)]
                n, total = sum(b.n for b in stays), sum(b.total for b in stays)
                end = stays or s.bins
                limit = cut if real else int(end[-1].high if side else end[0].low)
                out.append((box | {c: (box[c][0], limit) if side else (limit, box[c][1])}, n, total / n if n else 0.0))
        removed = [box | {c: v - {level}} for c, v in box.items() if isinstance(v, frozenset) and len(v) > 1 for level in sorted(v, key=str)]
        return out + self._measured(data, removed)

    def pastes(self, box: Box, data: DataFrame | None = None) -> list[tuple[Box, int, float]]:
        """Each box one paste away with its rows and mean.

        Of the rows beyond a limit that are in the box otherwise, the share nearest to it comes in. Beyond a whole number's
        limit is what comes after it, so its paste always takes in a value, if there is one.
        """
        data, limited = self._remaining() if data is None else data, restricted(box, self.start)
        numeric = sorted((c for c in limited if not isinstance(box[c], frozenset)), key=lambda c: c not in self.real)
        if self.compat and not any(c in self.real for c in numeric):
            return []
        # a real's limit belongs to what is beyond it, a whole number's doesn't
        gap = {c: 0 if c in self.real or self.compat else 1 for c in numeric}
        ends = [(c, side, (self.start[c][0], box[c][0] - gap[c]) if side == 0 else (box[c][1] + gap[c], self.start[c][1])) for c in numeric for side in (0, 1)]
        shares = (1 - self.alpha, self.alpha)
        found = spreads(data, self.y, [(in_box(box | {c: beyond}), F.col(c), *beyond, (shares[side],)) for c, side, beyond in ends])
        out: list[Box] = []
        for (c, side, _), s in zip(ends, found, strict=True):
            limit = s.quantile(shares[side]) if s.bins else self.start[c][side]
            limit = limit if c in self.real else int(limit) if self.compat else math.floor(limit) if side else math.ceil(limit)
            out.append(box | {c: (limit, box[c][1]) if side == 0 else (box[c][0], limit)})
        out += [box | {c: box[c] | {x}} for c in limited if isinstance(box[c], frozenset) for x in sorted(self.start[c] - box[c], key=str)]
        return self._measured(data, out)

    def _measured(self, data: DataFrame, boxes: list[Box]) -> list[tuple[Box, int, float]]:
        return [(b, *m) for b, m in zip(boxes, self._measure(data, boxes), strict=True)] if boxes else []

    def find_box(self) -> PrimBox | None:
        """The next box; None if no rows are left. Boxes found before can't change any more."""
        for earlier in self.found:
            earlier.frozen = True
        data = self._remaining()
        box, (now,) = dict(self.start), self._measure(data, [self.start])
        if not now[0]:
            return None
        result = PrimBox(box, [self.entry(box, *now)])
        for candidates, larger in ((self.peels, False), (self.pastes, True)):
            while options := candidates(box, data):
                chosen, n, mean, score = self.best(now, options)
                if n < self.mass_min * self.total or score <= 0 or (n <= now[0] if larger else n >= now[0]) or larger and mean <= now[1]:
                    break
                box, now = chosen, (n, mean)
                result.trajectory.append(self.entry(box, n, mean))
        result.limits = box
        self.found.append(result)
        return result

    def best(self, now: tuple[int, float], options: list[tuple[Box, int, float]]) -> tuple[Box, int, float, float]:
        """The candidate of the highest score, then of the fewest restrictions, then the first."""
        scored = [(self.score(now, (n, m)), len(self.start) - len(restricted(b, self.start)), -i) for i, (b, n, m) in enumerate(options)]
        at = max(range(len(options)), key=lambda i: scored[i])
        return *options[at], scored[at][0]

    def stats(self) -> DataFrame:
        """The current measures of each box found: box, and what a step of its trajectory has but its limits."""
        rows = [(i, {k: float(v) for k, v in b.current.items() if k != "limits"}) for i, b in enumerate(self.found)]
        names = [k for k in self.found[0].current if k != "limits"] if self.found else []
        table = [(i, *(r[k] for k in names)) for i, r in rows]
        return self.df.sparkSession.createDataFrame(table, "box int" + "".join(f", {k} double" for k in names))
