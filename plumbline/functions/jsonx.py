"""JSON in and out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A brace that may begin an object: a name or the end of the object comes next.
_BRACE = r"\{(?=\s*[\"}])"


def json_object(text: Column) -> Column:
    """The first JSON object in noisy text as JSON; NULL without one.

    The text is cut at the braces that may begin an object.  A fold over the pieces knows where each brace stands
    and hands the text from there to the parser, which stops where the object ends, until one is read; the rest of
    the pieces cost nothing.  Fences, prose and braces around the object need no care of their own."""
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        brace = acc["at"] + F.length(piece)
        here = F.when(brace < F.length(text), F.to_json(F.try_parse_json(F.substr(text, brace + 1))))
        return F.struct((brace + 1).alias("at"), F.coalesce(acc["found"], here).alias("found"))

    return F.aggregate(F.split(text, _BRACE, -1), start, step, lambda acc: acc["found"])


def field(parsed: Column, name: str) -> Column:
    return F.get_json_object(parsed, f"$.{name}")


def missing_fields(parsed: Column, required: list[str]) -> Column:
    """Names of required fields that are absent, null or blank."""
    return F.array_compact(F.array(*[F.when(F.trim(F.coalesce(field(parsed, n), F.lit(""))) == "", F.lit(n)) for n in required]))


def interpret(text: Column, finish: Column, required: list[str]) -> Column:
    """What is wrong with a reply: truncated, empty, no_json, missing_answer, warnings or ok."""
    parsed = json_object(text)
    lacks = missing_fields(parsed, required)
    return (
        F.when(finish == "length", "truncated").when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").when(parsed.isNull(), "no_json")
        .when(F.array_contains(lacks, required[0]), "missing_answer").when(F.size(lacks) > 0, "warnings").otherwise("ok")
    )


def judge_score(parsed: Column, name: str, low: int = 0, high: int = 4) -> Column:
    """A whole number within bounds, also as 2.0 or "2"; anything else, true and false too, is NULL."""
    text = field(parsed, name)
    number = F.when(text.rlike(r"^-?\d+(\.0+)?$"), F.regexp_replace(text, r"\.0+$", "").try_cast("int"))
    return F.when(number.between(low, high), number)


def text_or_json(c: Column, is_text: bool) -> Column:
    return c if is_text else F.to_json(c)


def decode_array(c: Column, element: str = "string") -> Column:
    """A JSON array; NULL where the text is not one."""
    return F.from_json(c, f"array<{element}>")


def content(body: Column) -> Column:
    """The reply text of a chat response body, given as a string or as a list of parts; empty where it is anything
    else, NULL without a message.  The kind of the JSON value tells them apart, so a text may begin as a list does."""
    parsed = F.try_parse_json(body)
    found = F.try_variant_get(parsed, "$.choices[0].message.content", "variant")
    kind = F.schema_of_variant(found)
    parts = F.transform(F.try_variant_get(found, "$", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    message = F.try_variant_get(parsed, "$.choices[0].message", "variant")
    text = F.when(kind == "STRING", F.try_variant_get(found, "$", "string")).when(kind.startswith("ARRAY"), F.array_join(parts, ""))
    return F.when(message.isNotNull(), F.coalesce(text, F.lit("")))


def body_error(body: Column) -> Column:
    """An error at the top of a response body or inside its first choice."""
    return F.coalesce(F.get_json_object(body, "$.error.message"), F.get_json_object(body, "$.choices[0].error.message"))
