"""Prompts for questions and for judges, in this engine's own words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.density import CLASSES, ScoreRule
from plumbline.functions.text import bullet_list

#: What a reply must hold, by question type; the first field is the answer itself.
FIELDS = {
    "multiple_choice": ("answer", "reasoning"),
    "open_ended": ("answer", "reasoning"),
    "fine_grained": ("answer", "reasoning"),
    "grounded": ("answer", "reasoning"),
    "density": ("answer", "count", "coverage_percent", "reasoning"),
    "localisation": ("bboxes", "response_format", "reasoning"),
}


def reply_fields(kind: Column) -> Column:
    pairs = [F.lit(x) for k, f in FIELDS.items() for x in (k, ", ".join(f))]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.lit("answer, reasoning"))


def question_prompt(question: Column, kind: Column, options: Column) -> Column:
    """The question, its options as a list where it has some, and the JSON fields of the reply."""
    listed = F.when(F.coalesce(F.size(options), F.lit(0)) > 0, F.concat(F.lit("Options:\n"), bullet_list(options)))
    return F.concat_ws("\n", question, listed, F.concat(F.lit("Reply with one JSON object with the fields "), reply_fields(kind), F.lit(".")))


def density_rules(rule: ScoreRule) -> str:
    """What the density classes mean under a rule, with one scene of each."""
    lines = [
        f"Count and coverage each get a place between 0 and 1 on a log scale: counts from {rule.count_scale[0]:g} to {rule.count_scale[1]:g}, coverage from {rule.coverage_scale[0]:.2%} to {rule.coverage_scale[1]:.0%}; the score is their mean.",
        f"{CLASSES[1]}: below {rule.medium_score:g}; {CLASSES[2]}: from {rule.medium_score:g} with at least {rule.medium_min_count} plants; {CLASSES[3]}: from {rule.high_score:g} with at least {rule.high_min_count}; {CLASSES[0]}: no plants.",
    ]
    return "\n".join(lines)


def judge_prompt(task: str, kind: str, criteria: dict[str, str], image_fields: tuple[str, ...] = ()) -> str:
    """A judge's instructions for a task; a textual judge is told nothing of the image."""
    if kind == "textual" and image_fields:
        raise ValueError("a textual judge sees no image fields")
    seen = "the reasoning and the image" if kind == "visual" else "the reasoning alone"
    rubric = "\n".join(f"- {name} (0-4): {text}" for name, text in criteria.items())
    return f"You judge answers to {task} questions from {seen}.\n{rubric}\nReply with one JSON object with these fields and notes."


def judge_user_text(kind: str, question: Column, answer: Column, reasoning: Column, seen: Column) -> Column:
    """What a judge gets of one response; ``seen`` (what the image shows) goes to visual judges only."""
    parts = [F.concat(F.lit("Question: "), question), F.concat(F.lit("Answer: "), answer), F.concat(F.lit("Reasoning: "), reasoning)]
    return F.concat_ws("\n", *parts, *([F.concat(F.lit("Image: "), seen)] if kind == "visual" else []))
