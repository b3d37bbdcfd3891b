"""Density of a scene from its count and coverage, and threshold trees as Columns."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ("none", "low", "medium", "high")


@dataclass(frozen=True)
class ScoreRule:
    """Anchors of the two log scales, and the scores and counts that a class needs."""

    count_scale: tuple[float, float] = (1, 40)
    coverage_scale: tuple[float, float] = (0.01, 0.4)
    medium_score: float = 0.3
    high_score: float = 0.6
    medium_min_count: int = 2
    high_min_count: int = 5

    def checked(self) -> ScoreRule:
        for low, high in (self.count_scale, self.coverage_scale):
            if not 0 < low < high:
                raise ValueError(f"a scale must rise from above 0: {low}, {high}")
        if not self.medium_score < self.high_score or self.medium_min_count > self.high_min_count:
            raise ValueError("high must ask for more than medium")
        return self

    def with_(self, **changes: Any) -> ScoreRule:
        return replace(self, **changes).checked()


def log_scale(v: Column, low: float, high: float) -> Column:
    return F.when(v <= low, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.ln(v / low) / F.ln(F.lit(high) / F.lit(low))))


def density_score(count: Column, coverage: Column, rule: ScoreRule = ScoreRule()) -> Column:
    return (log_scale(count, *rule.count_scale) + log_scale(coverage, *rule.coverage_scale)) / 2


def density_level(count: Column, coverage: Column, rule: ScoreRule = ScoreRule()) -> Column:
    """0 (none) to 3 (high)."""
    score = density_score(count, coverage, rule)
    return (
        F.when(count == 0, 0)
        .when((score >= rule.high_score) & (count >= rule.high_min_count), 3)
        .when((score >= rule.medium_score) & (count >= rule.medium_min_count), 2)
        .otherwise(1)
    )


def level_name(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CLASSES)), level + 1)


def rank_distance(a: Column, b: Column) -> Column:
    """How many classes apart two class names are; NULL for a name that is none."""
    order = F.array(*map(F.lit, CLASSES))
    at = lambda c: F.nullif(F.array_position(order, c), F.lit(0).cast("long"))
    return F.abs(at(a) - at(b))


def tree_column(node: dict) -> Column:
    """A threshold tree {feature, threshold, below, above} with leaves {label} as nested CASE."""
    if "label" in node:
        return F.lit(node["label"])
    return F.when(F.col(node["feature"]) < node["threshold"], tree_column(node["below"])).otherwise(tree_column(node["above"]))


def tree_text(node: dict, indent: int = 0) -> str:
    pad = "  " * indent
    if "label" in node:
        return f"{pad}{CLASSES[node['label']]}"
    return f"{pad}if {node['feature']} < {node['threshold']:g}:\n{tree_text(node['below'], indent + 1)}\n{pad}else:\n{tree_text(node['above'], indent + 1)}"


def rule_yaml(rule: ScoreRule) -> str:
    pair = lambda p: f"[{p[0]:g}, {p[1]:g}]"
    return "\n".join(f"{k}: {pair(v) if isinstance(v, tuple) else f'{v:g}'}" for k, v in vars(rule).items())
