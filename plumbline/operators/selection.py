"""Exact, seeded selections.  Every draw sorts by a digest of the seed and the row's key, so it
depends on neither partitions nor which other draws are made."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import draw_key
from plumbline.operators.reshape import with_row_index
from plumbline.store import written


class Shortfall(ValueError):
    """A quota that the candidates cannot meet; the message says what to loosen."""


def _draw(df: DataFrame, by: Sequence[str], seed: int, key: Sequence[str], first: Sequence[Column] = ()) -> DataFrame:
    order = [*first, draw_key(seed, *[F.col(c) for c in key]), *[F.col(c) for c in key]]
    if not by:  # all rows are one group: a distributed sort, not one task
        return with_row_index(df, order, "_r").withColumn("_r", F.col("_r") + 1)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def quota(df: DataFrame, cls: str, key: Sequence[str], per_class: int | None = None, classes: int | None = None, seed: int = 0) -> DataFrame:
    """Exactly ``per_class`` rows of every class, or of exactly ``classes`` of those that have so many.

    Raises Shortfall, from counts per class (a small table), where that is impossible."""
    if per_class is None and classes is None:
        return df
    if per_class:  # the rows of a quota are few: drawn and written once, they tell which classes are short
        df = written(_draw(df, [cls], seed, key).where(F.col("_r") <= per_class).drop("_r"))
    counts = {r[0]: r[1] for r in df.groupBy(cls).agg(F.count("*")).collect()}
    if classes is None:
        short = {c: n for c, n in counts.items() if n < per_class}
        if short:
            raise Shortfall(f"each class needs {per_class} rows; too few: {short}. Lower the quota or loosen the thresholds.")
        return df if per_class else df.limit(0)
    able = sorted(c for c, n in counts.items() if n >= (per_class or 0))
    if len(able) < classes:
        raise Shortfall(f"{classes} classes with {per_class or 'any'} rows are asked for, {len(able)} of {len(counts)} have them. Lower either or loosen the thresholds.")
    named = df.sparkSession.createDataFrame([(c,) for c in able], f"{cls} string")
    chosen = named.orderBy(draw_key(seed, F.col(cls)), cls).limit(classes)
    out = df.join(F.broadcast(chosen), cls, "left_semi")
    return out if per_class is None or per_class else out.limit(0)


def coupled_quota(boxed: DataFrame, plain: DataFrame, cls: str, key: Sequence[str], n_boxed: int, n_plain: int, per_class: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two selections whose plain classes are among the boxed ones; classes that can serve both are drawn first."""
    if n_plain > n_boxed:
        raise Shortfall("the plain classes are a subset of the boxed ones")
    able = [{r[0] for r in df.groupBy(cls).count().where(F.col("count") >= per_class).collect()} for df in (boxed, plain)]
    rank = {r[0]: k for k, r in enumerate(boxed.sparkSession.createDataFrame([(c,) for c in sorted(able[0])] or [("",)], f"{cls} string").orderBy(draw_key(seed, F.col(cls)), cls).collect())}
    both = sorted(able[0] & able[1], key=rank.get)
    if len(able[0]) < n_boxed or len(both) < n_plain:
        raise Shortfall(f"{n_boxed} boxed and {n_plain} plain classes are asked for; {len(able[0])} and {len(both)} have {per_class} rows")
    chosen = (both + sorted(able[0] - able[1], key=rank.get))[:n_boxed]
    take = lambda df, names: _draw(df.where(F.col(cls).isin(names)), [cls], seed, key).where(F.col("_r") <= per_class).drop("_r")
    return take(boxed, chosen), take(plain, both[:n_plain])


def _beside(df: DataFrame, sizes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each row beside its group's figures; NULL is a group like any other."""
    other = sizes.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(by)})
    match = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    return (df.join(other, match) if by else df.crossJoin(F.broadcast(other))).drop(*[f"_k{i}" for i in range(len(by))])


def fraction(df: DataFrame, by: Sequence[str], key: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """round-half-even(n * share) rows of each group."""
    sizes = df.groupBy(*by).agg(F.bround(F.count("*") * share).alias("_n"))
    sized = _beside(_draw(df, by, seed, key), sizes, by)
    return sized.where(F.col("_r") <= F.col("_n")).select(*df.columns)


def sample_n(df: DataFrame, by: Sequence[str], key: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group."""
    return _draw(df, by, seed, key).where(F.col("_r") <= n).drop("_r")


def stratified(df: DataFrame, strata: Sequence[str], key: str, share: float, variant: Column, of: str, seed: int = 0) -> DataFrame:
    """max(1, floor(n * share + 1/2)) rows of each stratum; first the variants' strata, then the
    others, of which originals of chosen variants come first, so a variant is never kept without its original
    as long as a stratum of originals is as large."""
    target = F.greatest(F.lit(1), F.floor(F.count("*") * share + 0.5))
    cut = lambda d: _beside(d, d.groupBy(*strata).agg(target.alias("_t")), strata).where(F.col("_r") <= F.col("_t")).drop("_r", "_t")
    flagged = df.withColumn("_v", variant)
    variants = cut(_draw(flagged.where("_v"), strata, seed, [key]))
    wanted = variants.select(F.col(of).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("_w", F.lit(True))
    others = flagged.where("not _v").join(wanted, key, "left").withColumn("_w", F.coalesce("_w", F.lit(False)))
    rest = cut(_draw(others, strata, seed, [key], [F.desc("_w")])).drop("_w")
    return variants.unionByName(rest).drop("_v")


def right_and_wrong(df: DataFrame, by: Sequence[str], key: Sequence[str], right: Column, share: float, wrong: int, seed: int = 0) -> DataFrame:
    """A share of the right rows and at most ``wrong`` wrong ones, per group."""
    rows = df.withColumn("_ok", right)
    return fraction(rows.where("_ok"), by, key, share, seed).unionByName(sample_n(rows.where("not _ok"), by, key, wrong, seed)).drop("_ok")


def spread(df: DataFrame, groups: Sequence[str], key: Sequence[str], limit: int, seed: int = 0) -> DataFrame:
    """Round robin over the groups up to a limit."""
    ranked = _draw(df, groups, seed, key)
    return ranked.orderBy("_r", *groups, *key).limit(limit).drop("_r")


def cell_spread(df: DataFrame, cells: Sequence[str], inner: str, key: Sequence[str], limit: int, seed: int = 0) -> DataFrame:
    """Round robin over cells, and inside a cell over the values of ``inner``."""
    ranked = _draw(df, [*cells, inner], seed, key).withColumnRenamed("_r", "_i")
    turn = Window.partitionBy(*cells).orderBy("_i", draw_key(seed, F.col(inner)), inner)
    ranked = ranked.withColumn("_r", F.row_number().over(turn))
    return ranked.orderBy("_r", draw_key(seed, *[F.col(c) for c in cells]), *cells).limit(limit).drop("_r", "_i")


def distractors(df: DataFrame, pool: Column, truth: Column, key: Column, choices: int, seed: int = 0) -> DataFrame:
    """choices (the truth and up to choices - 1 others of the pool, in drawn order) and answer_index."""
    rank = lambda salt: lambda s: F.struct(F.md5(F.concat_ws(":", F.lit(f"{seed}:{salt}"), key, s)).alias("k"), s.alias("s"))
    names = lambda a: F.transform(a, lambda x: x["s"])
    others = names(F.slice(F.array_sort(F.transform(F.array_except(pool, F.array(truth)), rank("pick"))), 1, choices - 1))
    mixed = names(F.array_sort(F.transform(F.array_append(others, truth), rank("order"))))
    return df.withColumn("choices", mixed).withColumn("answer_index", F.array_position("choices", truth) - 1)


def folds(df: DataFrame, key: Sequence[str], k: int = 5, seed: int = 0) -> DataFrame:
    """Fold 0 .. k - 1 by position in a drawn order, so folds differ in size by one at most."""
    return _draw(df, [], seed, key).withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def shuffled(df: DataFrame, key: Sequence[str], seed: int = 0) -> DataFrame:
    return df.orderBy(draw_key(seed, *[F.col(c) for c in key]), *key)


def example_of(df: DataFrame, by: Sequence[str], order: Sequence[str], index: int = 0) -> DataFrame:
    """The index-th row of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") == index + 1).drop("_r")


def resolve_wrong(wrong: int | dict[str, int], tasks: Sequence[str]) -> dict[str, int]:
    """One number for all tasks, or exactly one for each."""
    if isinstance(wrong, int):
        return dict.fromkeys(tasks, wrong)
    unknown, missing = set(wrong) - set(tasks), set(tasks) - set(wrong)
    if unknown or missing:
        raise ValueError(f"unknown tasks {sorted(unknown)}, missing tasks {sorted(missing)}")
    return dict(wrong)
