"""Ordered work over keys of any size: running sums, streaks, rolling counts, exact quantiles.

Rows are sorted by range over (keys, order), so that a key with most of the rows is many ranges.  Within a range rows are
summed by a window over that range's part of the key; what a range hands on to the next is worked out on a table
of one row per range and key.  No window, buffer or task holds a whole key.

Keys may be NULL, which is a key like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.store import written

_PLACE = (1 << 33) - 1


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``df`` as a table sorted by range: ``_p`` is the range and ``_i`` the row's place in it.

    It is written, since the bounds of ranges are sampled and must not change between two readings."""
    by = [*keys, *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    return written(rows.withColumns({"_p": F.shiftright("_m", 33).cast("int"), "_i": F.col("_m").bitwiseAND(_PLACE)}).drop("_m"))


def _cell(keys: Sequence[str]):
    """The window over a range's part of a key, up to the row."""
    return Window.partitionBy("_p", *keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)


def _handed(rows: DataFrame, cells: DataFrame, keys: Sequence[str], carry: str, empty: Column) -> DataFrame:
    """``rows`` with what earlier ranges of their key hand on.

    Only a range's first key can have begun before it: one row per range is broadcast, at most."""
    handed = F.broadcast(cells.select("_p", F.struct(F.lit(0), *keys).alias("_k"), carry).where(F.col(carry) != empty)).alias("h")
    on = (F.col("r._p") == F.col("h._p")) & F.struct(F.lit(0), *[F.col(f"r.{k}") for k in keys]).eqNullSafe(F.col("h._k"))
    return rows.alias("r").join(handed, on, "left").select("r.*", F.coalesce(f"h.{carry}", empty).alias(carry))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """The sum of ``value`` (a bigint) over the rows of the key up to each row, itself included."""
    rows = ranged(df, keys, order).withColumn("_own", F.sum(value).over(_cell(keys)))
    cells = rows.groupBy("_p", *keys).agg(F.sum(value).alias("_all"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_all").over(before), F.lit(0)).cast("long"))
    out = _handed(rows, cells, keys, "_before", F.lit(0).cast("long"))
    return out.withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_p", "_i", "_own", "_before")


def failure_streaks(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], failed: Column, name: str) -> DataFrame:
    """Consecutive failures up to each row, as a segmented scan; a success resets them, NULL is neither.

    A range's part of a key is reduced to two numbers, whether it has a success and the failures after its last
    one (all of them without one), which is all that the next range needs to know."""
    cell = _cell(keys)
    rows = ranged(df.withColumn("_f", failed), keys, order)
    rows = rows.withColumn("_fails", F.count_if("_f").over(cell))
    rows = rows.withColumn("_at_ok", F.max(F.when(~F.col("_f"), F.col("_fails"))).over(cell))
    cells = rows.groupBy("_p", *keys).agg((F.max("_fails") - F.coalesce(F.max("_at_ok"), F.lit(0))).alias("_tail"), F.max("_at_ok").isNotNull().alias("_reset"))
    along = Window.partitionBy(*keys).orderBy("_p")
    cells = cells.withColumn("_run", F.count_if("_reset").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy(*keys, "_run").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_grown", F.sum("_tail").over(in_run)).withColumn("_before", F.coalesce(F.lag("_grown").over(along), F.lit(0)).cast("long"))
    out = _handed(rows, cells, keys, "_before", F.lit(0).cast("long"))
    streak = F.col("_fails") - F.coalesce("_at_ok", -F.col("_before"))
    return out.withColumn(name, streak.cast("long")).drop("_p", "_i", "_f", "_fails", "_at_ok", "_before")


def rolling_count(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, name: str) -> DataFrame:
    """Rows of the key within the last ``seconds`` up to each row's time, rows of the same time included.

    Rows of a time are counted first.  Each time then marks itself and the moment ``seconds`` before it on one line of
    running counts; the difference of the two is what lies between."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    times = df.groupBy(*keys, at.alias("_at")).agg(F.count("*").alias("_n"))
    own = times.select(*keys, F.col("_at").alias("_of"), "_at", F.lit(1).alias("_side"), "_n")
    reach = times.select(*keys, F.col("_at").alias("_of"), (F.col("_at") - seconds * 1_000_000).alias("_at"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_n"))
    line = running_sum(own.unionByName(reach), keys, ["_at", "_side"], "_n", "_upto")
    counts = line.groupBy(*keys, "_of").agg((F.max("_upto") - F.min("_upto")).alias(name)).alias("c")
    # the larger side is left to adaptive execution, which splits a time that most rows share
    rows = df.withColumn("_of", at).alias("r")
    on = F.col("r._of").eqNullSafe(F.col("c._of"))
    for k in keys:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}"))
    return rows.join(counts, on).select(*[F.col(f"r.{c}") for c in df.columns], F.col(f"c.{name}").alias(name))


def group_quantiles(df: DataFrame, keys: Sequence[str], value: Column, shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """One row per key with exact, linearly interpolated quantiles; NULL where a key has no value, NULLs are left out.

    Equal values are counted first; a running count over the values tells which of them stand at a quantile's two
    neighbouring ranks, and only these meet in an aggregate."""
    counts = df.select(*keys, value.cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count("_v").alias("_n"))
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    upto = running_sum(counts, keys, ["_v"], "_n", "_upto").alias("v")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"v.{k}").eqNullSafe(F.col(f"s.{k}"))
    known = upto.join(sizes.alias("s"), on).select("v.*", "s._size")
    below = lambda rank: (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
    aggregates = []
    for share, name in zip(shares, names):
        place = float(share) * (F.col("_size") - 1)
        low, high = (F.max(F.when(below(rank(place)), F.col("_v"))) for rank in (F.floor, F.ceil))
        part = F.max(place - F.floor(place))
        aggregates.append((low + part * (high - low)).alias(name))
    return known.groupBy(*keys).agg(*aggregates)
