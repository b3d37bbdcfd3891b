"""Latest-wins, positions, shares, bins and streaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import ranges
from plumbline.operators.reshape import with_row_index


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key.  An aggregate, so a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*").select(*df.columns)


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    packed = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*").select(*df.columns)


def position_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """0-based position within the key."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def share_within(df: DataFrame, keys: Sequence[str], n: str = "n", name: str = "share") -> DataFrame:
    """n over its key's total; without keys over all rows."""
    return df.withColumn(name, F.col(n) / F.sum(n).over(Window.partitionBy(*keys)))


def number_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "number") -> DataFrame:
    """1, 2, ... for the distinct values of ``order`` within the key."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order)))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], most: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def quantiles(df: DataFrame, value: str, shares: Sequence[float], name: str = "quantiles") -> DataFrame:
    """One row with an array of exact, linearly interpolated quantiles of a column.

    The values are numbered by a distributed sort, of which only the neighbours of each
    quantile are looked at; an exact percentile aggregate would hold every distinct value in one task."""
    ranked = with_row_index(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v")), ["_v"], "_at")
    n = ranked.agg(F.count("*").alias("_n"))
    places = [F.lit(float(q)) * (F.col("_n") - 1) for q in shares]
    near = ranked.crossJoin(F.broadcast(n)).where(F.array_contains(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)]), F.col("_at")))
    found = near.groupBy("_n").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_v"))).alias("_m"))
    at = lambda p: F.element_at("_m", F.floor(p).cast("long")) + (p - F.floor(p)) * (F.element_at("_m", F.ceil(p).cast("long")) - F.element_at("_m", F.floor(p).cast("long")))
    return found.select(F.array(*[at(p) for p in places]).alias(name))


def tercile_bins(df: DataFrame, value: str, labels: Sequence[str] = ("low", "medium", "high"), name: str = "quality") -> DataFrame:
    """Right-closed quantile bins with edges over all rows; equal values share a bin, NULL has none."""
    k = len(labels)
    edges = quantiles(df, value, [i / k for i in range(1, k)], "_e")
    bin_ = F.element_at(F.array(*map(F.lit, labels)), F.size(F.filter("_e", lambda e: F.col(value) > e)) + 1)
    # a left join, so that a column of NULLs, which has no edges, keeps its rows
    return df.join(F.broadcast(edges), how="left").withColumn(name, F.when(F.col(value).isNotNull(), bin_)).drop("_e")


def fixed_bins(value: Column, edges: Sequence[float], left_closed: bool = False) -> Column:
    """How many edges lie below (right-closed bins) or at or below (left-closed) the value."""
    total = F.lit(0)
    for e in edges:
        total = total + ((value >= e) if left_closed else (value > e)).cast("int")
    return total


def failure_streaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column, name: str = "streak") -> DataFrame:
    """Consecutive failures up to each row; a success resets them.  A key of any size is spread over ranges."""
    return ranges.failure_streaks(df, keys, order, failed, name)


def first_trip(df: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column, threshold: int) -> DataFrame:
    """For each key the first row at which its streak reaches the threshold; 0 turns the breaker off."""
    streaks = failure_streaks(df, keys, order, failed).where((F.col("streak") >= threshold) & (F.lit(threshold) > 0))
    return earliest(streaks, keys, order)


def rolling_count(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, name: str = "recent") -> DataFrame:
    """Rows of the key within the last ``seconds`` up to each row's time.  A key of any size is spread over ranges."""
    return ranges.rolling_count(df, keys, ts, seconds, name)
