"""Density rules fitted to labelled images, by aggregates alone.

A score rule is searched one number at a time: its candidates are quantiles of what the number is
held against in the data, and one aggregate scores all of them.  A tree grows level by level from
one histogram of all open nodes; the best cut of each node is picked by a window over its bins,
so the driver sees one row per node whatever the table's size.

Several fits go on at once.  A lot is a training set: of ``k`` lots, lot i has all rows but those of fold i, and a
row whose fold is ``NOWHERE`` is in all of them.  Lot and candidate are keys of the same aggregate, so cross-validation runs
as many jobs as a single fit, and its folds side by side.

Rows alike in all that a fit looks at are one row with their number (``_n``) while candidates are scored; quantiles are taken of all rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.density import CLASSES, ScoreRule, density_level, density_score, tree_column
from plumbline.operators.selection import folds

FEATURES = ("count", "coverage", "typical_size", "spread")
#: The fold of rows that every lot holds.
NOWHERE = -1
#: Cuts tried on a feature: every value where it has no more than this many, else as many quantiles.
BINS = 256
#: The order in which a rule's numbers are searched.
NUMBERS = ("count_high", "coverage_low", "coverage_high", "medium_score", "high_score", "medium_min_count", "high_min_count", "count_low")


def measure(df: DataFrame, label: str, guess: Column, by: Sequence[str] = ()) -> DataFrame:
    """Agreement of a rule: n, exact, within_one, mean_error."""
    d = F.abs(guess - F.col(label))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((d == 0).cast("int")).alias("exact"), F.avg((d <= 1).cast("int")).alias("within_one"), F.avg(d).alias("mean_error"))


@dataclass
class Search:
    """A rule on its way: the best so far for a lot, and its loss there."""

    lot: int
    rule: ScoreRule
    loss: int = 0


def _given(value: object, ddl: str) -> Column:
    """A driver-side table as one literal, so that a plan's size does not follow it."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def _alike(rows: DataFrame) -> DataFrame:
    """The distinct rows, each with its number ``_n``."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))


def _numbers(rule: ScoreRule) -> list[float]:
    return [float(v) for v in (*rule.count_scale, *rule.coverage_scale, rule.medium_score, rule.high_score, rule.medium_min_count, rule.high_min_count)]


def _rule_of(r: Column) -> ScoreRule:
    """A rule whose numbers are columns."""
    c0, c1, v0, v1, *rest = [r[k] for k in range(8)]
    return ScoreRule((c0, c1), (v0, v1), *rest)


def _losses(rows: DataFrame, label: str, tries: Sequence[tuple[int, Sequence[ScoreRule]]]) -> list[list[int]]:
    """Total class distance of every rule of each (lot, rules), in one pass over rows with their numbers: the rules are data, so one plan serves all."""
    if not any(rules for _, rules in tries):
        return [[] for _ in tries]
    table = _given([{"lot": lot, "rules": [_numbers(r) for r in rules]} for lot, rules in tries], "array<struct<lot:int,rules:array<array<double>>>>")
    each = rows.select("count", "coverage", "fold", "_n", F.col(label).alias("label"), F.posexplode(table).alias("search", "s")).where("s.lot <> fold")
    each = each.select("count", "coverage", "label", "_n", "search", F.posexplode("s.rules").alias("rule", "r"))
    off = F.abs(density_level(F.col("count"), F.col("coverage"), _rule_of(F.col("r"))) - F.col("label"))
    # one row per candidate
    found = {(r.search, r.rule): r.loss for r in each.groupBy("search", "rule").agg(F.sum(off * F.col("_n")).alias("loss")).collect()}
    return [[int(found.get((i, k)) or 0) for k in range(len(rules))] for i, (_, rules) in enumerate(tries)]


def losses(df: DataFrame, label: str, rules: Sequence[ScoreRule]) -> list[int]:
    """Total class distance of each rule over all rows."""
    return _losses(df.withColumns({"fold": F.lit(NOWHERE), "_n": F.lit(1)}), label, [(0, rules)])[0]


def _ranks(steps: int, *values: Column) -> list[Column]:
    """The values at ``steps`` + 1 even ranks."""
    return [F.percentile_approx(v.cast("double"), [k / steps for k in range(steps + 1)], 10_000).alias(f"q{i}") for i, v in enumerate(values)]


def _lots(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` once for each lot that holds them."""
    return rows.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("lot <> fold")


def lot_quantiles(rows: DataFrame, k: int, values: Sequence[Column], steps: int) -> list[list[list[float]]]:
    """For each lot and value the distinct values at even ranks, in one aggregate."""
    found = {r.lot: r for r in _lots(rows, k).groupBy("lot").agg(*_ranks(steps, *values)).collect()}  # one row per lot
    return [[sorted(set((found[i][f"q{v}"] if i in found else None) or [])) for v in range(len(values))] for i in range(k)]


def _score_quantiles(rows: DataFrame, searches: Sequence[Search], steps: int) -> list[list[float]]:
    """Of the scores that each search's rule gives to its lot."""
    table = _given([{"lot": s.lot, "rule": _numbers(s.rule)} for s in searches], "array<struct<lot:int,rule:array<double>>>")
    each = rows.select("count", "coverage", "fold", F.posexplode(table).alias("search", "s")).where("s.lot <> fold")
    found = each.groupBy("search").agg(*_ranks(steps, density_score(F.col("count"), F.col("coverage"), _rule_of(F.col("s.rule"))))).collect()
    by = {r.search: sorted(set(r.q0 or [])) for r in found}
    return [by.get(i, []) for i in range(len(searches))]


def _variants(rule: ScoreRule, number: str, values: Sequence[float]) -> list[ScoreRule]:
    """``rule`` with one of its numbers set to each value that leaves it a rule."""
    out = []
    for v in values:
        change = {
            "count_low": lambda v: {"count_scale": (v, rule.count_scale[1])},
            "count_high": lambda v: {"count_scale": (rule.count_scale[0], v)},
            "coverage_low": lambda v: {"coverage_scale": (v, rule.coverage_scale[1])},
            "coverage_high": lambda v: {"coverage_scale": (rule.coverage_scale[0], v)},
        }.get(number, lambda v: {number: int(v) if number.endswith("count") else v})(v)
        try:
            out.append(rule.with_(**change))
        except ValueError:
            continue
    return out


def _descend(rows: DataFrame, alike: DataFrame, label: str, searches: list[Search], counts: list[list[float]], covers: list[list[float]], steps: int, rounds: int) -> None:
    """Takes each search down its numbers, all searches by the same jobs, until none falls any more."""
    for s, (loss,) in zip(searches, _losses(alike, label, [(s.lot, [s.rule]) for s in searches]), strict=True):
        s.loss = loss
    for _ in range(rounds):
        before = [s.loss for s in searches]
        for number in NUMBERS:
            if number.endswith("score"):
                values = _score_quantiles(rows, searches, steps)
            else:
                values = [(covers if number.startswith("coverage") else counts)[s.lot] for s in searches]
            tries = [_variants(s.rule, number, v) for s, v in zip(searches, values, strict=True)]
            for s, rules, got in zip(searches, tries, _losses(alike, label, [(s.lot, t) for s, t in zip(searches, tries, strict=True)]), strict=True):
                for rule, loss in zip(rules, got, strict=True):
                    if loss < s.loss:
                        s.loss, s.rule = loss, rule
        if before == [s.loss for s in searches]:
            break


def fit_rules(df: DataFrame, label: str, start: ScoreRule, k: int, steps: int = 24, rounds: int = 6) -> list[ScoreRule]:
    """For each of ``k`` lots (column ``fold``) a rule no worse there than ``start``: the better of the descents from ``start``
    and from scales that span the middle nine tenths of the lot.  It is deterministic."""
    rows = df.select("count", "coverage", "fold", label).where(F.col(label).isNotNull()).cache()
    alike = _alike(rows).cache()
    try:
        positive = rows.where("count > 0")
        both = lot_quantiles(positive, k, [F.col("count"), F.when(F.col("coverage") > 0, F.col("coverage"))], steps)
        counts, covers = [q[0] for q in both], [q[1] for q in both]
        searches = [Search(lot, start.checked()) for lot in range(k)]
        inner = lambda q: (q[len(q) // 20], q[-1 - len(q) // 20])
        for lot in range(k):
            if len(counts[lot]) > 2 and len(covers[lot]) > 2:
                searches += [Search(lot, r) for r in _variants(start.with_(coverage_scale=inner(covers[lot])), "count_high", [inner(counts[lot])[1]])]
        _descend(rows, alike, label, searches, counts, covers, steps, rounds)
        return [min((s for s in searches if s.lot == lot), key=lambda s: s.loss).rule for lot in range(k)]
    finally:
        alike.unpersist()
        rows.unpersist()


def fit_rule(df: DataFrame, label: str, start: ScoreRule, steps: int = 24, rounds: int = 6) -> ScoreRule:
    """As :func:`fit_rules`, over all rows."""
    return fit_rules(df.withColumn("fold", F.lit(NOWHERE)), label, start, 1, steps, rounds)[0]


def _place(splits: dict[int, tuple[str, float]], node: int = 1) -> Column:
    """The node a row falls into; node n has the children 2n (below) and 2n + 1."""
    if node not in splits:
        return F.lit(node)
    feature, cut = splits[node]
    return F.when(F.col(feature) < cut, _place(splits, 2 * node)).otherwise(_place(splits, 2 * node + 1))


def _placed(rows: DataFrame, k: int, splits: list[dict[int, tuple[str, float]]]) -> DataFrame:
    """The rows of every lot with the node of that lot's tree into which they fall."""
    node = F.lit(1)
    for lot, cuts in enumerate(splits):
        node = F.when(F.col("lot") == lot, _place(cuts)).otherwise(node)
    return _lots(rows, k).withColumn("node", node)


def best_splits(placed: DataFrame, label: str, edges: Sequence[dict[str, list[float]]], least: int) -> DataFrame:
    """(lot, node, feature, bin, gain): for every node of each lot's tree the cut that leaves the purest sides.

    Rows of a bin b or lower lie below the feature's edge b; a missing feature lies above every edge.  The gain is what the
    sides' sums of squared class counts over their sizes have over the node's, n times
    the fall of Gini impurity; ties go to the feature named first, then to the lower cut."""
    squares = lambda counts, n: F.coalesce(F.try_divide(sum(c * c for c in counts), n), F.lit(0.0))
    features = list(edges[0])

    def reached(f: str) -> Column:
        cuts = F.element_at(_given([e[f] for e in edges], "array<array<double>>"), F.col("lot") + 1)
        return F.when(F.col(f).isNull(), F.size(cuts)).otherwise(F.size(F.filter(cuts, lambda e: e <= F.col(f))))

    bins = [F.struct(F.lit(i).alias("ord"), F.lit(f).alias("feature"), reached(f).alias("bin")) for i, f in enumerate(features)]
    kinds = [f"c{i}" for i in range(len(CLASSES))]
    stacked = placed.select("lot", "node", "_n", F.col(label).alias("label"), F.explode(F.array(*bins)).alias("b")).select("lot", "node", "_n", "label", "b.*")
    table = stacked.groupBy("lot", "node", "ord", "feature", "bin").agg(*[F.sum(F.when(F.col("label") == i, F.col("_n")).otherwise(0)).alias(c) for i, c in enumerate(kinds)])
    every = Window.partitionBy("lot", "node", "feature")
    up_to = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    table = table.select("lot", "node", "ord", "feature", "bin", *[F.sum(c).over(up_to).alias(f"b{c}") for c in kinds], *[F.sum(c).over(every).alias(f"a{c}") for c in kinds])
    below, whole = [F.col(f"b{c}") for c in kinds], [F.col(f"a{c}") for c in kinds]
    above = [a - b for a, b in zip(whole, below, strict=True)]
    gain = squares(below, sum(below)) + squares(above, sum(above)) - squares(whole, sum(whole))
    fair = table.withColumn("gain", F.round(gain, 9)).where((sum(below) >= least) & (sum(above) >= least) & (F.col("gain") > 0))
    best = fair.groupBy("lot", "node").agg(F.max_by(F.struct("feature", "bin", "gain"), F.struct("gain", -F.col("ord"), -F.col("bin"))).alias("best"))
    return best.select("lot", "node", "best.*")


def leaves(placed: DataFrame, label: str) -> DataFrame:
    """(lot, node, label, counts): a node's commonest class, of equal ones that nearest to the mean, then the lower."""
    each = placed.groupBy("lot", "node", F.col(label).alias("label")).agg(F.sum("_n").alias("n"))
    node = Window.partitionBy("lot", "node")
    off = F.abs(F.col("label") - F.sum(F.col("label") * F.col("n")).over(node) / F.sum("n").over(node))
    ranked = each.withColumn("off", F.round(off, 9))
    counts = F.transform(F.sequence(F.lit(0), F.lit(len(CLASSES) - 1)), lambda c: F.coalesce(F.try_element_at(F.col("m"), c.cast("long")), F.lit(0)))
    found = ranked.groupBy("lot", "node").agg(
        F.max_by("label", F.struct("n", -F.col("off"), -F.col("label"))).alias("label"),
        F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("long"), "n"))).alias("m"),
    )
    return found.select("lot", "node", "label", counts.alias("counts"))


def _grown(splits: dict[int, tuple[str, float]], ends: dict[int, dict]) -> dict:
    """The tree of a lot's cuts and leaves; a cut between equal labels decides nothing and goes."""
    for node in sorted(splits, reverse=True):
        feature, cut = splits[node]
        low, high = ends.pop(2 * node), ends.pop(2 * node + 1)
        if "label" in low and "label" in high and low["label"] == high["label"]:
            ends[node] = {"label": low["label"], "counts": [a + b for a, b in zip(low["counts"], high["counts"], strict=True)]}
        else:
            ends[node] = {"feature": feature, "threshold": cut, "below": low, "above": high}
    return ends.get(1, {"label": 0, "counts": [0] * len(CLASSES)})


def fit_trees(df: DataFrame, label: str, k: int, depth: int = 3, least: int = 5, features: Sequence[str] = FEATURES, bins: int = BINS) -> list[dict]:
    """For each of ``k`` lots (column ``fold``) a Gini tree {feature, threshold, below, above} / {label, counts}; a threshold is a
    value of the data.  A level of all trees is one job.

    Rows without a label are left out; a missing feature lies above every cut."""
    rows = df.select(F.col(label), "fold", *features).where(F.col(label).isNotNull()).cache()
    alike = _alike(rows).cache()
    try:
        edges = [dict(zip(features, q, strict=True)) for q in lot_quantiles(rows, k, [F.col(f) for f in features], bins)]
        splits: list[dict[int, tuple[str, float]]] = [{} for _ in range(k)]
        for level in range(depth if any(cuts for e in edges for cuts in e.values()) else 0):
            open_nodes = _placed(alike, k, splits).where(F.col("node") >= 1 << level)
            got = best_splits(open_nodes, label, edges, least).collect()  # one row a node
            if not got:
                break
            for r in got:
                splits[r.lot][r.node] = (r.feature, edges[r.lot][r.feature][r.bin])
        ends: list[dict[int, dict]] = [{} for _ in range(k)]
        for r in leaves(_placed(alike, k, splits), label).collect():  # one row a leaf
            ends[r.lot][r.node] = {"label": r.label, "counts": list(r.counts)}
    finally:
        alike.unpersist()
        rows.unpersist()
    return [_grown(s, e) for s, e in zip(splits, ends, strict=True)]


def fit_tree(df: DataFrame, label: str, depth: int = 3, least: int = 5, features: Sequence[str] = FEATURES, bins: int = BINS) -> dict:
    """As :func:`fit_trees`, over all rows."""
    return fit_trees(df.withColumn("fold", F.lit(NOWHERE)), label, 1, depth, least, features, bins)[0]


def cross_validated(df: DataFrame, label: str, key: Sequence[str], start: ScoreRule, k: int = 5, seed: int = 0, **options: int) -> DataFrame:
    """(rule, fold, n, exact, within_one, mean_error): how refitted rules and trees do on the fold that they have not seen."""
    dealt = folds(df.where(F.col(label).isNotNull()), key, k, seed).cache()
    try:
        rules, trees = fit_rules(dealt, label, start, k, **options), fit_trees(dealt, label, k)
    finally:
        dealt.unpersist()
    fold = lambda guesses: F.coalesce(*[F.when(F.col("fold") == i, g) for i, g in enumerate(guesses)])
    refit, tree = fold([density_level(F.col("count"), F.col("coverage"), r) for r in rules]), fold([tree_column(t) for t in trees])
    guesses = F.explode(F.array(F.struct(F.lit("refit").alias("rule"), refit.alias("guess")), F.struct(F.lit("tree").alias("rule"), tree.alias("guess"))))
    each = dealt.select("fold", label, guesses.alias("g")).select("fold", label, "g.rule", "g.guess")
    return measure(each, label, F.col("guess"), ["rule", "fold"])


def cross_validate(df: DataFrame, label: str, key: Sequence[str], start: ScoreRule, k: int = 5, least_rows: int = 30, seed: int = 0, **options: int) -> list[tuple[str, int, float]]:
    """(rule, fold, mean error on the fold) of refitted rules and trees; nothing for fewer than ``least_rows`` rows."""
    if df.where(F.col(label).isNotNull()).count() < least_rows:
        return []
    return sorted((r.rule, r.fold, r.mean_error) for r in cross_validated(df, label, key, start, k, seed, **options).collect())


def fit_all(df: DataFrame, label: str, key: Sequence[str], current: ScoreRule = ScoreRule()) -> dict:
    """The current rule, a refitted one and a tree, each with its agreement."""
    refit, tree = fit_rule(df, label, current), fit_tree(df, label)
    guess = {"current": density_level(F.col("count"), F.col("coverage"), current), "refit": density_level(F.col("count"), F.col("coverage"), refit), "tree": tree_column(tree)}
    return {"rule": refit, "tree": tree, "agreement": {k: measure(df, label, g).first().asDict() for k, g in guess.items()}, "folds": cross_validate(df, label, key, current)}
