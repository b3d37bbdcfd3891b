"""CASE classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import light

#: Ways to decline that the synonym mode knows (fixed values).
UNSURE = ("unsure", "unknown", "not sure", "i don't know", "cannot determine", "can't tell", "uncertain", "n/a")


def localisation_outcome(placed: Column, n_found: Column, n_true: Column) -> Column:
    return (
        F.when(placed.isNull(), "miss").when(placed < 0.5, "poor_placement").when(n_found > n_true, "over_detect").when(n_found < n_true, "under_detect").otherwise("correct")
    )


def count_outcome(estimate: Column, truth: Column) -> Column:
    """NULL estimates count as under_estimated."""
    return F.when(estimate == truth, "correct").when(estimate > truth, "over_estimated").otherwise("under_estimated")


def coverage_outcome(error_pp: Column, tolerance: float = 3.0) -> Column:
    return F.when(F.abs(error_pp) < tolerance, "correct").when(error_pp > 0, "over_estimated").otherwise("under_estimated")


def answer_outcome(answer: Column, correct: Column, mode: str = "match_first") -> Column:
    """correct, unsure or incorrect.

    mode 'exact': unsure is the word 'Unsure', after a match; 'lower_first': any case, before a match;
    'trimmed': any case and spaces, after a match; 'synonyms': one of UNSURE, before a match;
    'match_first': one of UNSURE, after a match.  A NULL match is incorrect."""
    unsure = {
        "exact": answer == "Unsure", "lower_first": F.lower(answer) == "unsure", "trimmed": F.lower(F.trim(answer)) == "unsure",
        "synonyms": light(answer).isin(list(UNSURE)), "match_first": light(answer).isin(list(UNSURE)),
    }[mode]
    if mode in ("lower_first", "synonyms"):
        return F.when(unsure, "unsure").when(correct, "correct").otherwise("incorrect")
    return F.when(correct, "correct").when(unsure, "unsure").otherwise("incorrect")


def choice_outcome(answer: Column, correct: Column, choices: Column, scored: Column) -> Column:
    """As shown for review: correct, unsure, invalid (no option), incorrect; NULL where not scored."""
    options = F.transform(choices, light)
    return (
        F.when(~scored, F.lit(None))
        .when(correct, "correct")
        .when(light(answer).isin(list(UNSURE)), "unsure")
        .when(choices.isNotNull() & ~F.array_contains(options, light(answer)), "invalid")
        .otherwise("incorrect")
    )


def suite(kind: Column, annotated: Column) -> Column:
    shown = F.when(annotated, "boxed").otherwise("unannotated")
    return (
        F.when(kind == "multiple_choice", F.concat(F.lit("species/multiple_choice/"), shown))
        .when(kind == "open_ended", F.concat(F.lit("species/open_ended/"), shown))
        .when(kind == "density", F.concat(F.lit("density/"), shown))
        .otherwise(kind)
    )


def error_flags(interpretation: Column, knowledge: Column, visual: Column) -> Column:
    """What a judge's 0-4 scores say went wrong: perception, knowledge, evaluation, or else unsure."""
    flags = F.array_compact(
        F.array(F.when(visual <= 2, F.lit("perception")), F.when(knowledge <= 2, F.lit("knowledge")), F.when((interpretation <= 2) & (knowledge >= 3), F.lit("evaluation")))
    )
    return F.when(F.size(flags) == 0, F.array(F.lit("unsure"))).otherwise(flags)


def failure_kind(status: Column) -> Column:
    """How an HTTP status failed (fixed values): worth another try, fatal for the whole run, or a fault of this request."""
    return F.when(status.isin(408, 429) | (status >= 500), "transient").when(status.isin(401, 402), "fatal").otherwise("request")


def pair_agreement(choice_ok: Column, open_ok: Column) -> Column:
    return (
        F.when(choice_ok.isNull() | open_ok.isNull(), "incomplete").when(choice_ok & open_ok, "both").when(choice_ok, "choice_only").when(open_ok, "open_only").otherwise("neither")
    )


def relabel(c: Column, names: dict[str, str]) -> Column:
    """A lookup that leaves other values as they are."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), c) if pairs else c


def run_state(pending: Column, stopped: Column, aborted: Column) -> Column:
    return F.when(aborted, "aborted").when(stopped, "stopped").when(pending == 0, "finished").otherwise("interrupted")


def level_at_least(line: Column, level: str, levels: Sequence[str] = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")) -> Column:
    """Whether a log line's level is the given one or above; lines without one continue others and stay."""
    found = F.regexp_extract(line, rf"\b({'|'.join(levels)})\b", 1)
    order = F.array(*map(F.lit, levels))
    return (found == "") | (F.array_position(order, found) >= levels.index(level) + 1)
