"""Unions, set operations, pivots and nested arrays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.store import written


def collect_ordered(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], into: str) -> DataFrame:
    """One row per key with an array of structs in the order of ``order``."""
    packed = F.array_sort(F.collect_list(F.struct(order, *columns)))
    return df.groupBy(*keys).agg(F.transform(packed, lambda s: F.struct(*[s[c].alias(c) for c in columns])).alias(into))


def concat_frames(frames: Sequence[DataFrame], relaxed: bool = False) -> DataFrame:
    """Rows of all frames; relaxed: missing columns are NULL and numbers widen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=relaxed), frames)


def pivot_first(df: DataFrame, keys: Sequence[str], names: str, value: str, wanted: Sequence) -> DataFrame:
    return df.groupBy(*keys).pivot(names, list(wanted)).agg(F.first(value, ignorenulls=True))


def pivot_counts(df: DataFrame, keys: Sequence[str], names: str, wanted: Sequence[str], total: str | None = None) -> DataFrame:
    """Counts per key and name, 0 where there are none, in a fixed column order."""
    out = df.groupBy(*keys).agg(*[F.count_if(F.col(names) == w).alias(w) for w in wanted])
    return out if total is None else out.withColumn(total, reduce(lambda a, b: a + b, [F.col(w) for w in wanted]))


def melt_map(df: DataFrame, column: str, key: str = "key", value: str = "value") -> DataFrame:
    """One row per entry of a map column that is not NULL."""
    return df.select("*", F.explode(column).alias(key, value)).drop(column).where(F.col(value).isNotNull())


def melt(df: DataFrame, keys: Sequence[str], values: Sequence[str], key: str = "key", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(values), key, value).where(F.col(value).isNotNull())


def ensure_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Adds the columns that are missing as NULL."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def reindex(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Exactly the given columns; missing ones and NaN are NULL."""
    out = ensure_columns(df, types)
    clean = lambda c, t: F.when(~F.isnan(c), F.col(c)).cast(t) if t in ("double", "float") else F.col(c).cast(t)
    return out.select(*[clean(c, t).alias(c) for c, t in types.items()])


def keep_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of the columns that the frame has."""
    return df.select(*[c for c in columns if c in df.columns])


def prefixed(df: DataFrame, prefix: str, keys: Sequence[str] = (), legacy: dict[str, str] | None = None) -> DataFrame:
    """All but the keys renamed with a prefix, legacy names replaced, '-' as '_'."""
    new = lambda c: c if c in keys else prefix + (legacy or {}).get(c, c).replace("-", "_")
    return df.select(*[F.col(f"`{c}`").alias(new(c)) for c in df.columns])


def duplicate_variants(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Every row once for each of the values."""
    return df.withColumn(column, F.explode(F.array(*map(F.lit, values))))


def with_row_index(df: DataFrame, order: Sequence[Column | str], name: str = "row_index") -> DataFrame:
    """0-based positions in a total order, without one task that sees every row.

    Rows are sorted by range over partitions and written, since range bounds are sampled and
    must not differ between counting a partition and numbering its rows; counts are then added up."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    spread = spread.withColumns({"_p": F.shiftright("_m", 33).cast("int"), "_i": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m")
    spread = written(spread)
    ahead = spread.groupBy("_p").agg(F.count("*").alias("_n"))
    # one row per partition of the sort
    ahead = ahead.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return spread.join(F.broadcast(ahead.select("_p", "_b")), "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def in_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows that every frame has."""
    return reduce(DataFrame.intersect, frames)


def in_some_not_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames).distinct().subtract(in_all(frames))
