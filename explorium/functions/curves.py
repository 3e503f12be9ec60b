"""Lookup curves made of one to three sampled numbers: arrays of points, built and read inside the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rising(steepness: Column, middle: Column | float = 0.5, top: Column | float = 1.0, points: int = 10) -> Column:
    """y of an S-shaped curve at ``points`` even places of 0..1, from 0 to ``top``, monotone: it passes half its way at ``middle``.

    x^k / (x^k + r (1 - x)^k), with r so that it holds ``middle``. A middle of 0 or 1 and a steepness of 0 or less have no
    such curve: null, as with any null.
    """
    if points < 2:
        raise ValueError("two points at least")
    k = steepness.cast("double")
    m = (middle if isinstance(middle, Column) else F.lit(middle)).cast("double")
    end = (top if isinstance(top, Column) else F.lit(top)).cast("double")
    known = (k > 0) & (m > 0) & (m < 1) & end.isNotNull()
    r = F.pow(m / F.when(m < 1, 1 - m), k)

    def at(i: Column) -> Column:
        x = i / float(points - 1)
        return end * F.pow(x, k) / (F.pow(x, k) + r * F.pow(1 - x, k))

    return F.when(known, F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at))


def read(curve: Column, x: Column, low: Column | float = 0.0, high: Column | float = 1.0) -> Column:
    """The curve's value at x, straight between neighbouring points; beyond its ends that of the end. Null for an empty curve, a null or NaN, and where low isn't below high."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    n = F.size(curve)
    place = F.least(F.greatest(F.try_divide(x - lo, hi - lo), F.lit(0.0)), F.lit(1.0)) * (n - 1)
    i = F.least(F.floor(place), F.greatest(n - 2, F.lit(0))).cast("int")
    a, b = F.try_element_at(curve, i + 1), F.try_element_at(curve, F.least(i + 2, n))
    return F.when((n > 0) & x.isNotNull() & ~F.isnan(x.cast("double")) & (lo < hi), a + (b - a) * (place - i))


def inverse(curve: Column, y: Column, low: Column | float = 0.0, high: Column | float = 1.0) -> Column:
    """The least x at which a curve that never falls reaches y; null if it doesn't, or anything is null."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    n = F.size(curve)
    below = F.size(F.filter(curve, lambda v: v < y))
    a, b = F.try_element_at(curve, F.greatest(below, F.lit(1))), F.try_element_at(curve, below + 1)
    part = F.when(below == 0, 0.0).otherwise(below - 1 + F.try_divide(y - a, b - a))
    return F.when((below < n) & y.isNotNull(), lo + (hi - lo) * F.coalesce(F.try_divide(part, n - 1), F.lit(0.0)))
