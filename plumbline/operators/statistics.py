"""Intervals, agreement, correlation and resampling."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import joint_failures, wilson

SEED = 20240601


def wilson_table(df: DataFrame, by: Sequence[str], success: Column, z: float = 1.96) -> DataFrame:
    """n, k, rate and interval per group; rows whose success is NULL are not in n."""
    counts = df.groupBy(*by).agg(F.count(success).alias("n"), F.count_if(success).alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"), z)
    return counts.withColumns({"rate": F.try_divide("k", "n"), "lo": lo, "hi": hi})


def bootstrap_by(df: DataFrame, by: Sequence[str], stat: Callable[[pd.DataFrame], float | None], order: Sequence[str], cluster: str | None = None, n_boot: int = 2000, alpha: float = 0.05, seed: int = SEED) -> DataFrame:
    """estimate, lo and hi of any statistic of a group by resampling its clusters.

    A group is one pandas frame, sorted by ``order`` so that a seed gives one result; the
    statistic is arbitrary Python, so groups must fit a task.  Replicates that are None or
    not finite are skipped; with fewer than 90 % left there is no interval.  For means use
    :func:`bootstrap_mean`, which has no such bound."""
    types = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in by)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(list(order), kind="stable").reset_index(drop=True)
        rows = [np.array(r) for r in part.groupby(cluster, sort=True, dropna=False).indices.values()] if cluster else None
        n = len(rows) if rows else len(part)
        rng = np.random.default_rng(seed)
        got = []
        for _ in range(n_boot):
            pick = rng.integers(0, n, n)
            value = stat(part.iloc[np.concatenate([rows[i] for i in pick]) if rows else pick])
            if value is not None and np.isfinite(value):
                got.append(value)
        lo, hi = np.quantile(got, [alpha / 2, 1 - alpha / 2]) if got and len(got) >= 0.9 * n_boot else (None, None)
        return pd.DataFrame([{**{c: part[c].iloc[0] for c in by}, "n": len(part), "estimate": stat(part), "lo": lo, "hi": hi}])

    return df.groupBy(*by).applyInPandas(run, f"{types}, n long, estimate double, lo double, hi double")


#: Where the Poisson(1) distribution function passes 0, 1, ... 7: how many of them a uniform number reaches is its weight.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]
#: Weights that are held at once.
_HELD = 1 << 21


def poisson_weights(codes: np.ndarray, n_boot: int, seed: int) -> np.ndarray:
    """A Poisson(1) weight for each code (a 32-bit number) and replicate 1 to n_boot, hashed in plain 32-bit arithmetic."""
    low = np.uint64(0xFFFFFFFF)
    b = (np.arange(1, n_boot + 1, dtype=np.uint64) * np.uint64(0x9E3779B1) + np.uint64(seed)) & low
    x = codes.astype(np.uint64)[:, None] ^ b[None, :]
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x45D9F3B)) & low
    x ^= x >> np.uint64(16)
    return np.searchsorted(np.array(POISSON), x / 4294967296.0, "right")


def cluster_code(df: DataFrame, key: Sequence[str]) -> Column:
    """32 bits that name a cluster: an integer key itself, anything else its crc32."""
    if len(key) == 1 and dict(df.dtypes)[key[0]] in ("tinyint", "smallint", "int", "bigint"):
        return F.pmod(F.coalesce(F.col(key[0]), F.lit(-1)).cast("long"), F.lit(1 << 32))
    return F.crc32(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}).cast("binary"))


def replicate_sums(clusters: DataFrame, by: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """(by, _over, _under): arrays of the weighted sums of ``_o`` and ``_u`` of each replicate, over clusters (by, _code, _o, _u).

    A task adds its clusters up before anything is sent: a row per group and task, of 16 bytes a replicate."""
    types = ", ".join(f"{c} {dict(clusters.dtypes)[c]}" for c in by)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list[np.ndarray]] = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame({**{c: [k[i] for k in sums] for i, c in enumerate(by)}, "_over": [v[0] for v in sums.values()], "_under": [v[1] for v in sums.values()]})

        for part in parts:
            for at in range(0, len(part), max(1, _HELD // n_boot)):
                piece = part.iloc[at : at + max(1, _HELD // n_boot)]
                weights = poisson_weights(piece["_code"].to_numpy(), n_boot, seed)
                groups = piece.groupby(list(by), sort=False, dropna=False).indices if by else {(): np.arange(len(piece))}
                for group, places in groups.items():
                    k = tuple(None if pd.isna(x) else x for x in (group if isinstance(group, tuple) else (group,)))
                    over, under = (piece[c].to_numpy(np.float64)[places] @ weights[places] for c in ("_o", "_u"))
                    known = sums.setdefault(k, [np.zeros(n_boot), np.zeros(n_boot)])
                    known[0] += over
                    known[1] += under
                if len(sums) * n_boot > _HELD:
                    yield rows()
                    sums.clear()
        if sums:
            yield rows()

    partial = clusters.select(*by, "_code", "_o", "_u").mapInPandas(run, f"{types + ', ' if by else ''}_over array<double>, _under array<double>")
    add = lambda c: F.aggregate(F.collect_list(c), F.array_repeat(F.lit(0.0), n_boot), lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q)).alias(c)
    return partial.groupBy(*by).agg(add("_over"), add("_under"))


def bootstrap_ratio(df: DataFrame, by: Sequence[str], over: Column, under: Column, cluster: Sequence[str], n_boot: int = 2000, alpha: float = 0.05, seed: int = SEED) -> DataFrame:
    """n (clusters), estimate, lo and hi of sum(over) / sum(under) per group, resampling whole clusters.

    Poisson resampling: a cluster counts in each replicate as often as a hash of its key says, so groups and clusters of any
    size are added up wherever they lie.  Replicates without a quotient are skipped; with fewer than 90 % left there is no interval."""
    clusters = df.groupBy(*by, *[c for c in cluster if c not in by]).agg(F.coalesce(F.sum(over), F.lit(0)).cast("double").alias("_o"), F.coalesce(F.sum(under), F.lit(0)).cast("double").alias("_u"))
    clusters = clusters.withColumn("_code", cluster_code(df, cluster))
    whole = clusters.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.sum("_o"), F.sum("_u")).alias("estimate"))
    quotients = F.sort_array(F.filter(F.zip_with("_over", "_under", lambda o, u: F.try_divide(o, u)), lambda q: q.isNotNull() & ~F.isnan(q)))
    found = replicate_sums(clusters, by, n_boot, seed).select(*by, quotients.alias("_q"))

    def quantile(share: float) -> Column:
        place = F.lit(share) * (F.size("_q") - 1)
        low, high = (F.get("_q", rank(place).cast("int")) for rank in (F.floor, F.ceil))
        return F.when(F.size("_q") >= 0.9 * n_boot, low + (place - F.floor(place)) * (high - low))

    on = F.lit(True)
    for c in by:
        on = on & F.col(f"w.{c}").eqNullSafe(F.col(f"f.{c}"))
    found = found.select(*by, quantile(alpha / 2).alias("lo"), quantile(1 - alpha / 2).alias("hi"))
    return whole.alias("w").join(found.alias("f"), on).select("w.*", "f.lo", "f.hi")


def bootstrap_mean(df: DataFrame, by: Sequence[str], value: str, key: Sequence[str], n_boot: int = 2000, alpha: float = 0.05, seed: int = SEED) -> DataFrame:
    """n, estimate and interval of a mean, resampling rows by their key; NULLs are left out."""
    known = F.col(value).isNotNull().cast("int")
    return bootstrap_ratio(df.where(F.col(value).isNotNull()), by, F.col(value), known, key, n_boot, alpha, seed)


def paired_differences(df: DataFrame, group: str, a: str, b: str, value: str, key: str) -> DataFrame:
    """a - b on the keys that both answered."""
    wide = df.where(F.col(group).isin(a, b)).groupBy(key).agg(*[F.min_by(F.when(F.col(group) == g, F.col(value).cast("double")), F.when(F.col(group) == g, F.lit(0))).alias(f"_{k}") for k, g in enumerate((a, b))])
    return wide.where(F.col("_0").isNotNull() & F.col("_1").isNotNull()).select(key, (F.col("_0") - F.col("_1")).alias("difference"))


def paired_diff_ci(df: DataFrame, group: str, a: str, b: str, value: str, key: str, n_boot: int = 2000, alpha: float = 0.05, seed: int = SEED) -> DataFrame:
    """mean, lo, hi and n of the paired differences, resampling keys."""
    diffs = paired_differences(df, group, a, b, value, key).withColumns({"_all": F.lit(1)})
    return bootstrap_mean(diffs, ["_all"], "difference", [key], n_boot, alpha, seed).drop("_all")


def kappa(df: DataFrame, by: Sequence[str], a: str, b: str, weights: str | None = None) -> DataFrame:
    """Cohen's kappa (weights None, 'linear' or 'quadratic'); NULL where chance alone cannot disagree."""
    gap = {None: lambda x, y: (x != y).cast("double"), "linear": lambda x, y: F.abs(x - y).cast("double"), "quadratic": lambda x, y: F.pow(x - y, F.lit(2))}[weights]
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").alias("_n"))
    observed = cells.groupBy(*by).agg(F.sum(F.col("_n") * gap(F.col(a), F.col(b))).alias("_o"), F.sum("_n").alias("n"))
    rows = cells.groupBy(*by, F.col(a).alias("_a")).agg(F.sum("_n").alias("_ra"))
    cols = cells.groupBy(*by, F.col(b).alias("_b")).agg(F.sum("_n").alias("_rb"))
    # classes x classes, which are few; keys keep groups apart
    product = rows.join(cols, list(by)) if by else rows.crossJoin(F.broadcast(cols))
    expected = product.groupBy(*by).agg(F.sum(F.col("_ra") * F.col("_rb") * gap(F.col("_a"), F.col("_b"))).alias("_e"))
    both = observed.join(expected, list(by)) if by else observed.crossJoin(F.broadcast(expected))
    return both.select(*by, "n", (1 - F.try_divide(F.col("_o") * F.col("n"), F.col("_e"))).alias("kappa"))


def agreement(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    flag = lambda c: F.avg(c.cast("int"))
    return df.groupBy(*by).agg(
        flag(d == 0).alias("exact"), flag(F.abs(d) <= 1).alias("within_one"), flag(d > 0).alias("a_higher"), flag(d < 0).alias("b_higher"), F.avg(d).alias("mean_difference")
    )


def spearman(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks for ties.

    Ranks come from the distinct values' counts, so the window holds values, not rows."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    out = both
    for c in (a, b):
        counts = both.groupBy(*by, c).agg(F.count("*").alias("_n"))
        before = Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        ranks = counts.select(*by, c, (F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2).alias(f"_r{c}"))
        out = out.join(ranks, [*by, c])
    return out.groupBy(*by).agg(F.corr(f"_r{a}", f"_r{b}").alias("spearman"), F.count("*").alias("n"))


def flag_kappa(df: DataFrame, by: Sequence[str], flags: Sequence[str], a: str, b: str) -> DataFrame:
    """Kappa of each flag between two columns of flag arrays."""
    each = df.withColumn("flag", F.explode(F.array(*map(F.lit, flags))))
    each = each.withColumns({"_x": F.array_contains(a, F.col("flag")).cast("int"), "_y": F.array_contains(b, F.col("flag")).cast("int")})
    return kappa(each, [*by, "flag"], "_x", "_y")


def prevalence(df: DataFrame, by: Sequence[str], flags: Sequence[str], a: str, b: str, strict: bool) -> DataFrame:
    """How often a flag is raised by both (strict) or by either, with Wilson intervals."""
    each = df.withColumn("flag", F.explode(F.array(*map(F.lit, flags))))
    x, y = F.array_contains(a, F.col("flag")), F.array_contains(b, F.col("flag"))
    return wilson_table(each, [*by, "flag"], (x & y) if strict else (x | y))


def expected_overlap(rates: DataFrame, rate: str = "rate", order: str = "model", n: str | None = None) -> DataFrame:
    """How many of several independent models fail together: probability per number."""
    listed = rates.agg(F.transform(F.array_sort(F.collect_list(F.struct(order, rate))), lambda s: s[rate]).alias("_r"))
    return listed.select(F.posexplode(joint_failures(F.col("_r"))).alias("failures", "probability"))


def observed_overlap(df: DataFrame, key: str, failed: Column) -> DataFrame:
    """Over keys, how many rows of a key failed."""
    return df.groupBy(key).agg(F.count_if(failed).alias("failures")).groupBy("failures").agg(F.count("*").alias("n"))


def co_abstention(df: DataFrame, key: str, model: str, abstained: str, models: Sequence[str]) -> DataFrame:
    """For each pair of models, how often both abstain, and how often chance would have it."""
    wide = df.groupBy(key).agg(*[F.max(F.when(F.col(model) == m, F.col(abstained).cast("int"))).alias(f"_{i}") for i, m in enumerate(models)])
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("x"), F.col(f"_{j}").alias("y")) for (i, a), (j, b) in combinations(enumerate(models), 2)])
    each = wide.select(F.explode(pairs).alias("p")).select("p.*").where("x is not null and y is not null")
    return each.groupBy("a", "b").agg(F.avg(F.col("x") * F.col("y")).alias("observed"), (F.avg("x") * F.avg("y")).alias("expected"), F.count("*").alias("n"))


def others_given(df: DataFrame, key: str, model: str, abstained: Column, correct: Column) -> DataFrame:
    """Others' accuracy on the keys where a model abstained, and where it did not."""
    own = df.groupBy(key, F.col(model).alias("given")).agg(F.bool_or(abstained).alias("abstained"))
    other = df.select(key, F.col(model).alias("_m"), correct.cast("int").alias("_c"))
    return own.join(other, key).where("given <> _m").groupBy("given", "abstained").agg(F.avg("_c").alias("accuracy"), F.count("_c").alias("n"))


def chance_level(df: DataFrame, by: Sequence[str], choices: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.try_divide(F.lit(1.0), F.size(choices))).alias("chance"))
