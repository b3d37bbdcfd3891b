"""Interval arithmetic and rounding."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson score interval, within 0 and 1; NULL where n is 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    down = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / down
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / down
    keep = lambda c: F.when(n.isNotNull(), c)
    return keep(F.greatest(F.lit(0.0), centre - half)), keep(F.least(F.lit(1.0), centre + half))


def row_sum(*columns: Column) -> Column:
    return reduce(add, [F.coalesce(c, F.lit(0)) for c in columns])


def row_mean(*columns: Column) -> Column:
    """The mean of those that are not NULL."""
    return F.try_divide(row_sum(*columns), reduce(add, [c.isNotNull().cast("int") for c in columns]))


def round_half_even(c: Column) -> Column:
    return F.bround(c)


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def significant(c: Column, digits: int) -> Column:
    """Rounded to so many significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, c).otherwise(F.round(c * scale) / scale)


def backoff(attempt: Column, base: float, most: float, retry_after: Column | None = None) -> Column:
    """min(most, base * 2^(attempt - 1)), but no less than a server asked for."""
    wait = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))
    return wait if retry_after is None else F.greatest(wait, F.coalesce(retry_after, F.lit(0.0)))


def joint_failures(rates: Column) -> Column:
    """P(0), P(1), ... failures of independent events with the given rates, by convolution."""
    start = F.array(F.lit(1.0))

    def add_one(acc: Column, p: Column) -> Column:
        return F.zip_with(F.array_append(F.transform(acc, lambda a: a * (1 - p)), F.lit(0.0)), F.concat(F.array(F.lit(0.0)), F.transform(acc, lambda a: a * p)), lambda x, y: x + y)

    return F.aggregate(rates, start, add_one)
