"""Numeric functions (FM-*)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float, high: float) -> Column:
    """Value within bounds; null stays null (FM-01)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null (FM-02)."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def percentage(a: Column, b: Column) -> Column:
    """100 a / b, null without a denominator (FM-03)."""
    return F.try_divide(a * 100.0, b)


def symmetric_ratio(a: Column, b: Column) -> Column:
    """Smaller over larger, null where the larger is 0 (FM-04)."""
    return F.try_divide(F.least(a, b).cast("double"), F.greatest(a, b))


def by_label(c: Column, values: Mapping[str, float], default: float | None = None) -> Column:
    """A number for each label (FM-06)."""
    out = F.lit(default).cast("double")
    for label, v in values.items():
        out = F.when(c == label, F.lit(v)).otherwise(out)
    return out


def four_decimals(c: Column) -> Column:
    """Text with four decimals (FM-08)."""
    return F.format_string("%.4f", F.round(c.cast("double"), 4))


def lenient_int(c: Column) -> Column:
    """Integer of a text, null where it is none (FM-09)."""
    return F.trim(c.cast("string")).try_cast("bigint")


def ladder(c: Column, steps: list[tuple[float, str]], default: str) -> Column:
    """The label of the first bound that the value reaches, bounds from high to low; null gives the default."""
    out = F.lit(default)
    for bound, label in reversed(steps):
        out = F.when(c >= bound, F.lit(label)).otherwise(out)
    return out


def flags(*conditions: tuple[Column, str]) -> Column:
    """Texts of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in conditions]))


def percent_coverage(current: Column, overall: Column) -> Column:
    """A share in percent: the current one, else that over all time, else 0 (FM-05)."""
    return F.coalesce(current, overall, F.lit(0.0)) * 100.0


def by_volume(confidence: Column, n: Column, many: int = 1000, few: int = 50) -> Column:
    """Confidence raised by a tenth up to 1 for many works, lowered by a fifth down to 0.1 for few (FM-10)."""
    return F.when(n >= many, F.least(confidence * 1.1, F.lit(1.0))).when(n < few, F.greatest(confidence * 0.8, F.lit(0.1))).otherwise(confidence)


def size_class(n: Column) -> Column:
    """very small below 50, small to medium below 10,000, else large (FLT-24)."""
    return F.when(n < 50, "very small").when(n < 10_000, "small to medium").when(n.isNotNull(), "large")


def backoff_seconds(attempt: Column, first: float = 1.0, most: float = 60.0) -> Column:
    """Wait before an attempt, doubled each time up to a bound; attempts count from 0 (FM-07)."""
    return F.least(F.lit(first) * F.pow(F.lit(2.0), attempt), F.lit(most))
