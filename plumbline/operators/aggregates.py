"""Aggregates: rates, blocks of outcome counts, confusion, usage and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import wilson
from plumbline.operators.ranges import group_quantiles


def rate(df: DataFrame, keys: Sequence[str], flag: Column, name: str = "rate") -> DataFrame:
    """The mean of a boolean; NULLs are left out."""
    return df.groupBy(*keys).agg(F.avg(flag.cast("int")).alias(name))


def means(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def error_stats(df: DataFrame, keys: Sequence[str], error: Column) -> DataFrame:
    """n, mean and median absolute error, and bias."""
    plain = df.groupBy(*keys).agg(F.count(error).alias("n"), F.avg(F.abs(error)).alias("mean_absolute"), F.avg(error).alias("bias"))
    return with_medians(plain, df, keys, F.abs(error), "median_absolute").select(*keys, "n", "mean_absolute", "median_absolute", "bias")


def with_medians(grouped: DataFrame, df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """``grouped`` (a row per key) with the key's exact median, for which no buffer holds a key's values."""
    found = group_quantiles(df, keys, value, [0.5], [name]).alias("m")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"g.{k}").eqNullSafe(F.col(f"m.{k}"))
    return grouped.alias("g").join(found, on, "left").select("g.*", f"m.{name}")


def ratio_mean(df: DataFrame, keys: Sequence[str], over: Column, under: Column, name: str) -> DataFrame:
    """The mean of a quotient per row; rows without one are left out."""
    return df.groupBy(*keys).agg(F.avg(F.try_divide(over, under)).alias(name))


def distinct_with_null(df: DataFrame, keys: Sequence[str], column: str, name: str = "n_distinct") -> DataFrame:
    """Distinct values, of which NULL is one."""
    return df.groupBy(*keys).agg((F.count_distinct(column) + F.max(F.col(column).isNull().cast("int"))).alias(name))


def value_counts(df: DataFrame, columns: Sequence[str], share: str | None = None) -> DataFrame:
    """Counts of each value (arrays too), and their share of all rows."""
    out = df.groupBy(*columns).agg(F.count("*").alias("n"))
    if share:
        out = out.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).withColumn(share, F.col("n") / F.col("_all")).drop("_all")
    return out


def _outcomes(answered: Column, outcome: Column, z: float = 1.96) -> list[Column]:
    n, ok = F.count("*"), F.count_if(answered)
    hits = F.count_if(outcome == "correct")
    lo, hi = wilson(hits, ok, z)
    return [
        n.alias("n_total"), ok.alias("n_answered"), F.count_if(~answered).alias("n_failed"),
        *[F.count_if(outcome == k).alias(k) for k in ("correct", "incorrect", "unsure", "invalid")],
        F.try_divide(hits, ok).alias("accuracy"), F.try_divide(hits, n).alias("accuracy_all"),
        F.try_divide(F.count_if(outcome == "unsure"), ok).alias("unsure_rate"), lo.alias("lo"), hi.alias("hi"),
    ]


def accuracy_block(df: DataFrame, keys: Sequence[str], answered: Column, outcome: Column) -> DataFrame:
    """Outcome counts, rates over answered and over all rows, and the interval of the accuracy."""
    return df.groupBy(*keys).agg(*_outcomes(answered, outcome))


def breakdown(df: DataFrame, keys: Sequence[str], by: Sequence[str], answered: Column, outcome: Column) -> DataFrame:
    """The accuracy of answered rows by each of several columns, and over all: one pass with grouping sets."""
    rows = df.where(answered).withColumn("_hit", (outcome == "correct").cast("int"))
    sets = [[*map(F.col, keys), F.col(c)] for c in by] + [[*map(F.col, keys)]]
    out = rows.groupingSets(sets, *keys, *by).agg(F.count("*").alias("n"), F.avg("_hit").alias("accuracy"), F.grouping_id().alias("_g"))
    kinds = F.lit("all")
    for k, c in enumerate(by):
        kinds = F.when(F.col("_g").bitwiseAND(1 << (len(by) - 1 - k)) == 0, F.lit(c)).otherwise(kinds)
    return out.select(*keys, kinds.alias("by"), F.coalesce(*[F.when(F.col("_g").bitwiseAND(1 << (len(by) - 1 - k)) == 0, F.col(c).cast("string")) for k, c in enumerate(by)]).alias("value"), "n", "accuracy")


def confusion(df: DataFrame, keys: Sequence[str], truth: str, guess: str, classes: Sequence[str]) -> DataFrame:
    """truth x guess counts over a fixed class list, 0 where there are none."""
    seen = df.where(F.col(guess).isNotNull()).groupBy(*keys, truth).agg(*[F.count_if(F.col(guess) == c).alias(c) for c in classes])
    every = df.select(*keys).distinct().withColumn(truth, F.explode(F.array(*map(F.lit, classes))))
    return every.join(seen, [*keys, truth], "left").na.fill(0, list(classes))


def macro_f1(df: DataFrame, keys: Sequence[str], truth: str, guess: str) -> DataFrame:
    """The mean F1 over the classes that occur as truth; 0 for a class never hit or guessed."""
    pairs = df.groupBy(*keys, truth, guess).agg(F.count("*").alias("n"))
    by_truth = pairs.groupBy(*keys, F.col(truth).alias("_c")).agg(F.sum("n").alias("_t"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).alias("_tp"))
    by_guess = pairs.groupBy(*keys, F.col(guess).alias("_c")).agg(F.sum("n").alias("_g"))
    each = by_truth.join(by_guess, [*keys, "_c"], "left")
    f1 = F.coalesce(F.try_divide(2 * F.col("_tp"), F.col("_t") + F.coalesce("_g", F.lit(0))), F.lit(0.0))
    return each.groupBy(*keys).agg(F.avg(f1).alias("macro_f1"), F.count("*").alias("n_classes"))


def localisation_block(df: DataFrame, keys: Sequence[str], score: Column, placed: Column, error: Column, answered: Column) -> DataFrame:
    """Scores over scored rows, and over all rows with 0 for the rest."""
    plain = df.groupBy(*keys).agg(
        F.count(score).alias("n_scored"), F.count_if(answered & score.isNull()).alias("n_invalid"), F.avg(score).alias("mean_score"), F.try_divide(F.coalesce(F.sum(score), F.lit(0.0)), F.count("*")).alias("mean_score_all"), F.avg(placed).alias("mean_iou"),
        F.avg((error == 0).cast("int")).alias("count_exact_rate"), F.avg(F.abs(error)).alias("count_mae"), F.avg(error).alias("count_bias"),
    )
    return with_medians(plain, df, keys, score, "median_score")


def usage_block(df: DataFrame, keys: Sequence[str], failed: Column, cost: Column, tokens: Column, latency: Column, retries: Column) -> DataFrame:
    """Requests, failures, cost, tokens, latency of answered requests, and retried ones."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.count_if(failed).alias("failed"), F.sum(cost).alias("total_cost"), F.avg(cost).alias("mean_cost"),
        F.avg(tokens).alias("mean_tokens"), F.avg(F.when(~failed, latency)).alias("mean_latency"), F.count_if(retries > 0).alias("retried"),
    )


def problem_groups(df: DataFrame, keys: Sequence[str], problems: Column) -> DataFrame:
    """Counts of struct(kind, message, code) problems in arrays, with the first known code."""
    each = df.select(*keys, F.explode(problems).alias("_p")).select(*keys, "_p.kind", "_p.message", "_p.code")
    return each.groupBy(*keys, "kind", "message").agg(F.count("*").alias("n"), F.min("code").alias("code"))


def top_counts(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    return value_counts(df, columns).orderBy(F.desc("n"), *columns).limit(k)


def histogram(df: DataFrame, keys: Sequence[str], value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Rows per equal-width bin 1..bins; the top edge belongs to the last bin."""
    bin_ = F.least(F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins).cast("long"))
    return df.where(value.isNotNull() & (value >= low) & (value <= high)).groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))


def class_tally(df: DataFrame, column: str, classes: Sequence[str], scarce_below: int, exempt: Sequence[str] = ()) -> DataFrame:
    """Counts over a fixed class list, and which classes are scarce."""
    seen = df.groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(c, k) for k, c in enumerate(classes)], "class string, ord int")
    n = F.coalesce("n", F.lit(0))
    return every.join(seen, "class", "left").select("class", "ord", n.alias("n"), ((n < scarce_below) & ~F.col("class").isin(list(exempt))).alias("scarce"))


def composition(quotas: DataFrame) -> DataFrame:
    """Questions of each task: classes x quota, NULL where either is open, and whether that is exact."""
    n = F.col("classes") * F.col("quota") * F.col("variants")
    ablations = F.bround(n * F.col("ablated_share")).cast("long")
    return quotas.select("task", n.alias("questions"), ablations.alias("ablations"), (n + F.coalesce(ablations, F.lit(0))).alias("total"), n.isNotNull().alias("exact"))
