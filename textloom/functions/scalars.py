"""Dates, numbers, arrays and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def iso_day(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def day_index(day: Column, total: Column) -> Column:
    """0-based day of the year modulo total; 0 for an empty list."""
    return F.when(total <= 0, F.lit(0)).otherwise(F.pmod(F.dayofyear(day) - 1, F.greatest(total, F.lit(1)))).cast("long")


def percent(position: Column, total: Column) -> Column:
    """100 * (position + 1) / total to two places; an empty work counts as one."""
    return F.round(F.lit(100.0) * (position + 1) / F.greatest(total, F.lit(1)), 2).cast("double")


def next_speed(current: Column, speeds: list[float]) -> Column:
    """The least listed speed above the current one, else the first."""
    listed = F.array(*[F.lit(s) for s in speeds])
    return F.coalesce(F.array_min(F.filter(listed, lambda s: s > current)), F.lit(speeds[0]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def enum_position(col: Column, declared: list[str]) -> Column:
    """Declaration order of an enum, for sorting."""
    return F.array_position(F.array(*[F.lit(x) for x in declared]), col)
