"""Joins, each by what it is for.  No side is hinted: sizes decide at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.store import written


def attach(left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str] = ("_left", "_right"), how: str = "inner") -> DataFrame:
    """A join in which other columns of the same name get a suffix each."""
    same = [c for c in left.columns if c in right.columns and c not in on]
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in same})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in same})
    return a.join(b, list(on), how)


#: Rows of a right side that a join may broadcast.
BROADCAST_ROWS = 400_000


def growing(left: DataFrame, right: DataFrame, on: str, tasks: int) -> DataFrame:
    """An inner join with a table that grows as the left does and is never broadcast beyond BROADCAST_ROWS, in at least ``tasks`` tasks
    if it is shuffled.  ``right`` must be a table whose rows are counted from its files."""
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(right, on)
    # a number that is asked for stays: adaptive execution would put partitions together by their compressed bytes, many rows to a task
    tasks = max(tasks, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return left.repartition(tasks, on).join(right.repartition(tasks, on).hint("shuffle_merge"), on)


def attach_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """A left join that raises, when run, if the right side has a key twice (rows would multiply)."""
    once = right.groupBy(*on).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in right.columns if c not in on])
    checked = once.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit(f"a key of {list(on)} stands twice on the right"))).otherwise(F.lit(True)))
    return left.join(checked.where(F.coalesce("_ok", F.lit(True))).drop("_n", "_ok"), list(on), "left")


def missing(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of the left whose key the right lacks."""
    return left.join(right, list(on), "left_anti")


def mismatches(left: DataFrame, right: DataFrame, on: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """Rows whose compared columns differ from the right side's."""
    other = right.select(*on, *[F.col(c).alias(f"{c}_expected") for c in compared])
    differs = F.lit(False)
    for c in compared:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"{c}_expected"))
    return left.join(other, list(on)).where(differs)


def restrict(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_semi")


def exclude(df: DataFrame, by: DataFrame, on: Sequence[str], whole: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows left after the exclusion, rows of ``whole`` that are empty now)."""
    kept = df.join(by, list(on), "left_anti")
    return kept, whole.join(kept, list(key), "left_anti")


def pending(questions: DataFrame, models: DataFrame, done: DataFrame, keys: Sequence[str] = ("question_id", "model")) -> DataFrame:
    """Every pair of question and model that has no finished answer.

    The product is what is asked for: models are a handful, so they are an array on each question."""
    names = models.agg(F.array_sort(F.collect_set("model")).alias("_models"))
    every = questions.crossJoin(F.broadcast(names)).withColumn("model", F.explode("_models")).drop("_models")
    return every.join(done.select(*keys).distinct(), list(keys), "left_anti")


def pairs_within(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Unordered pairs of rows of a key, as columns with suffixes _a and _b."""
    return _pairs(df, keys, columns, [order], lambda a, b: a[order] < b[order])


def pairs_across(df: DataFrame, keys: Sequence[str], group: str, columns: Sequence[str]) -> DataFrame:
    """Pairs of rows of a key in different groups, each once, the smaller group first."""
    return _pairs(df, keys, columns, [group], lambda a, b: a[group] < b[group])


def pairs_ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Unordered pairs of rows of a key that differ in ``order``, the smaller first; a NULL there is smaller than nothing."""

    def before(a: Column, b: Column) -> Column:
        rule = F.lit(False)
        for c in reversed(order):
            rule = (a[c] < b[c]) | ((a[c] == b[c]) & rule)
        return rule

    return _pairs(df, keys, columns, order, before)


def pairs_all(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """All ordered pairs of rows of a key, a row with itself included."""
    return _pairs(df, keys, columns, [], lambda a, b: F.lit(True))


#: Rows of a key that one task pairs with as many others.
BLOCK = 1024


def _pairs(df, keys, columns, more, rule, block: int | None = None) -> DataFrame:
    """Keys of up to ``block`` rows are joined as they lie.  The rows of a crowded key are dealt into blocks by a hash of their
    values, and each pair of blocks is a join key of its own, so that its pairs are spread over tasks."""
    block = block or BLOCK
    names = list(dict.fromkeys([*columns, *more]))
    rows = df.select(*keys, F.struct(*names).alias("_r"))
    side = lambda part, name, *cells: part.select(*keys, *cells, F.col("_r").alias(name))
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > block)
    crowded = written(counts.select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_blocks")))
    if crowded.isEmpty():
        both = side(rows, "_a").join(side(rows, "_b"), list(keys))
    else:
        quiet = rows.join(crowded, list(keys), "left_anti")
        dealt = rows.join(crowded, list(keys))
        own, every = F.pmod(F.xxhash64("_r"), F.col("_blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
        blocks = side(dealt, "_a", own.alias("_i"), every.alias("_j")).join(side(dealt, "_b", every.alias("_i"), own.alias("_j")), [*keys, "_i", "_j"]).drop("_i", "_j")
        both = side(quiet, "_a").join(side(quiet, "_b"), list(keys)).unionByName(blocks)
    both = both.where(rule(F.col("_a"), F.col("_b")))
    return both.select(*keys, *[F.col(f"_{s}")[c].alias(f"{c}_{s}") for s in "ab" for c in columns])


def with_original(df: DataFrame, key: str, of: str, shared: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows that vary an original beside that original's columns (suffix _original)."""
    original = df.select(*shared, F.col(key).alias(of), *[F.col(c).alias(f"{c}_original") for c in columns])
    return df.where(F.col(of).isNotNull()).join(original, [*shared, of])


def fresh_scores(records: DataFrame, scores: DataFrame, on: Sequence[str], stamp: str = "created_at") -> DataFrame:
    """Records with their scores where both carry the same stamp; ``stale`` where they do not."""
    other = scores.withColumnRenamed(stamp, "_stamp").withColumn("_scored", F.lit(True))
    out = records.join(other, list(on), "left")
    usable = F.col("_scored") & F.coalesce(F.col(stamp) == F.col("_stamp"), F.lit(True))
    values = [c for c in scores.columns if c not in (*on, stamp)]
    plain = [c for c in out.columns if c not in (*values, "_stamp", "_scored")]
    return out.select(*plain, *[F.when(usable, F.col(c)).alias(c) for c in values], F.coalesce(F.col("_scored") & ~usable, F.lit(False)).alias("stale"))


def union_of_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """A full join with columns in_left and in_right."""
    a = left.withColumn("in_left", F.lit(True))
    b = right.withColumn("in_right", F.lit(True))
    out = a.join(b, list(on), "full")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_left", "in_right")})


def first_known(df: DataFrame, sources: Sequence[tuple[DataFrame, str]], on: Sequence[str], name: str) -> DataFrame:
    """The first of several lookups that knows the key."""
    out, found = df, []
    for k, (source, column) in enumerate(sources):
        out = out.join(source.select(*on, F.col(column).alias(f"_s{k}")), list(on), "left")
        found.append(F.col(f"_s{k}"))
    return out.withColumn(name, F.coalesce(*found)).drop(*[f"_s{k}" for k in range(len(sources))])


def text_lookup(df: DataFrame, column: str, table: DataFrame, key: str, value: str) -> DataFrame:
    """A lookup by lower-case, trimmed text; an unknown key raises when the value is read."""
    norm = lambda c: F.lower(F.trim(c))
    out = df.join(table.select(norm(F.col(key)).alias("_k"), F.col(value).alias(value)), norm(F.col(column)) == F.col("_k"), "left").drop("_k")
    return out.withColumn(value, F.coalesce(value, F.raise_error(F.concat(F.lit("no description of "), F.coalesce(F.col(column), F.lit("NULL"))))))


def current(answers: DataFrame, images: DataFrame, on: str = "image_path", digest: str = "image_sha256") -> Column | DataFrame:
    """Answers whose image still has the digest they were given for."""
    return answers.join(images.select(on, F.col(digest).alias("_now")), on).where(F.col(digest) == F.col("_now")).drop("_now")
