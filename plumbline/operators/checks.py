"""Integrity checks.  Each returns the offending rows, and ``require_none`` raises on any."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def dangling(df: DataFrame, reference: str, key: str) -> DataFrame:
    """Rows that refer to a key that is not there."""
    return df.where(F.col(reference).isNotNull()).join(df.select(F.col(key).alias(reference)), reference, "left_anti")


def empty_tasks(df: DataFrame, tasks: Sequence[str]) -> DataFrame:
    wanted = df.sparkSession.createDataFrame([(t,) for t in tasks], "task string")
    return wanted.join(df.select("task"), "task", "left_anti")


def require_none(offending: DataFrame, what: str, show: int = 5) -> None:
    rows = offending.limit(show).collect()
    if rows:
        raise ValueError(f"{what}: {[tuple(r) for r in rows]}")


def check_questions(df: DataFrame, key: str = "id", reference: str = "ablation_of") -> None:
    require_none(duplicates(df, [key]), "ids that stand more than once")
    require_none(dangling(df, reference, key).select(key, reference), "references to no question")


def same_settings(old: dict, new: dict) -> None:
    """Refuses to go on with a run whose settings have changed."""
    changed = sorted(k for k in old.keys() | new.keys() if old.get(k) != new.get(k))
    if changed:
        raise ValueError(f"the run was begun with other settings: {changed}")


def same_counts(a: DataFrame, b: DataFrame, what: str) -> None:
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{what}: {n} rows against {m}")
