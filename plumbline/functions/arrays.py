"""Helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: an array of one gives it a name.

    An expression that a lambda or several fields mention is else worked out anew each time."""
    return F.transform(F.array(value), use)[0]
