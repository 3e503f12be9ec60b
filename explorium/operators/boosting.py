"""Boosting by weights: after each round the rows that its tree tells wrongly weigh more, for two classes or several."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from explorium.operators import forests
from explorium.sources.shared import Tables


@dataclass
class Boosted:
    """Rounds of boosting: trees, their errors (shares of the weight told wrongly) and their say in the vote."""

    features: list[str]
    slots: list[forests.Slot]
    classes: list
    trees: list[dict[int, forests.Node]] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    says: list[float] = field(default_factory=list)

    def scores(self) -> list[tuple[str, float]]:
        """Importance of each column: its share of what all cuts gain, trees weighted by their say. Largest first."""
        found = dict.fromkeys(self.features, 0.0)
        for tree, say in zip(self.trees, self.says, strict=True):
            whole = sum(n.gain for n in tree.values())
            for n in tree.values():
                if n.slot is not None and whole:
                    found[self.slots[n.slot].column] += say * n.gain / whole
        total = sum(found.values()) or 1.0
        return sorted(((c, v / total) for c, v in found.items()), key=lambda s: (-s[1], s[0]))

    def vote(self, x: Column) -> Column:
        """The class with most say; ties go to the first. x: an encoded row."""
        said = [(told(t, x, self.classes), s) for t, s in zip(self.trees, self.says, strict=True)]
        if not said:
            return F.lit(self.classes[0] if self.classes else None)
        votes = [reduce(Column.__add__, [F.when(c == F.lit(k), s).otherwise(0.0) for c, s in said]) for k in self.classes]
        best = F.array_max(F.array(*[F.struct(v.alias("v"), F.lit(-i).alias("i")) for i, v in enumerate(votes)]))
        return F.element_at(F.array(*map(F.lit, self.classes)), 1 - best["i"])


def told(tree: dict[int, forests.Node], x: Column, classes: list, node: int = 0) -> Column:
    """The class that a tree tells of an encoded row, as an expression; a leaf's class is the one of most weight, then the first."""
    n = tree[node]
    if n.slot is None:
        return F.lit(classes[max(range(len(classes)), key=lambda k: (n.sums[k], -k))])
    return F.when(x[n.slot] <= n.cut, told(tree, x, classes, 2 * node + 1)).otherwise(told(tree, x, classes, 2 * node + 2))


def boost(df: DataFrame, features: list[str], y: str, rounds: int = 10, depth: int = 3, least: int = 1) -> tuple[Boosted, DataFrame]:
    """The rounds, and the encoded rows (x, y, id, w: their weights after the last round, which sum up to 1).

    A round is a tree of exact cuts on weighted rows, then one pass that measures its error e, and one that writes new
    weights: rows told wrongly weigh (1 - e) / e * (classes - 1) times as much. It ends early with a tree that tells all
    rows rightly, which is the only one to vote, or one no better than guessing, which is left out. Rows without a class
    are left out; nulls in columns are what ``forests.one_hot`` makes of them. Equal rows weigh the same, so rounds read
    each once, with its number; ``df`` is read again where the encoded rows are used.
    """
    if rounds < 1 or depth < 1:
        raise ValueError("a round and a level at least")
    rows, slots = forests.one_hot(df, features, y)
    tables = Tables(df.sparkSession, "boost")
    whole_rows = rows.where(F.col("y").isNotNull())
    rows = tables.save(forests.folded(whole_rows), "rows")
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.sum("many").alias("n")).collect()}  # a row a class
    model, total = Boosted(features, slots, sorted(counts)), sum(counts.values())
    now = tables.save(rows.withColumn("w", F.lit(1.0 / max(total, 1))), "round0")
    if len(counts) < 2:
        return model, whole_rows.withColumn("w", F.lit(1.0 / max(total, 1)))
    for k in range(rounds):
        tree = forests.exact_tree(now, slots, model.classes, least, depth, "w", "many")
        wrong = told(tree, F.col("x"), model.classes) != F.col("y")
        error, whole = now.agg(F.sum(F.when(wrong, F.col("w") * F.col("many")).otherwise(0.0)), F.sum(F.col("w") * F.col("many"))).first()
        error /= whole
        if error >= 1 - 1 / len(counts):
            break
        model.trees.append(tree)
        model.errors.append(error)
        if error <= 1e-12:
            model.trees, model.errors, model.says = [tree], [error], [1.0]
            break
        model.says.append(math.log((1 - error) / error) + math.log(len(counts) - 1))
        more = math.exp(model.says[-1])
        after = (whole * (1 - error)) + more * whole * error
        now = tables.save(now.withColumn("w", F.when(wrong, F.col("w") * more).otherwise(F.col("w")) / after), f"round{k + 1}")
        tables.drop(f"round{k}")
    return model, whole_rows.join(now.select("x", "y", "w"), ["x", "y"]).select(*whole_rows.columns, "w")
