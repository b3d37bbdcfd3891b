"""Answers scored against questions, and judges' scores merged onto responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import boxes as bx
from plumbline.functions import geometry as geo
from plumbline.functions.text import light, open_ended_match
from plumbline.operators.joins import attach_one
from plumbline.operators.reshape import in_all, melt_map
from plumbline.operators.windows import latest


def alias_table(df: DataFrame, aliases: dict[str, Sequence[str]], truth: str) -> DataFrame:
    """``df`` with ``accepted``: the normalised truth and its aliases."""
    rows = [(k, list(v)) for k, v in aliases.items()]
    table = df.sparkSession.createDataFrame(rows, "_k string, _v array<string>").select(light(F.col("_k")).alias("_k"), F.transform("_v", light).alias("_v"))
    out = df.withColumn("_k", light(F.col(truth))).join(table, "_k", "left")
    return out.withColumn("accepted", F.array_union(F.array("_k"), F.coalesce("_v", F.array().cast("array<string>")))).drop("_k", "_v")


def species_match(df: DataFrame, aliases: dict[str, Sequence[str]], answer: str = "answer", truth: str = "expected_answer") -> DataFrame:
    return alias_table(df, aliases, truth).withColumn("match", open_ended_match(F.col(answer), F.col("accepted"))).drop("accepted")


def task_match(answer: Column, truth: Column, kind: Column) -> Column:
    """Equality as each task asks for it: density by lower case, the others exactly."""
    return F.when(kind == "density", F.lower(answer) == F.lower(truth)).otherwise(answer == truth)


def localisation_scores(df: DataFrame, reply: str, description: str, truth: str, width: str = "width", height: str = "height", configured: str | None = None) -> DataFrame:
    """Score columns of a reply's boxes against ``truth`` (x, y, w, h); an unreadable reply scores 0."""
    if configured:
        order, scale = bx.parse_format(configured)
        fmt = F.struct(F.lit(order).alias("ord"), F.lit(scale).cast("double").alias("scale"), F.lit(True).alias("known"))
    else:
        fmt = bx.infer_format(F.col(description))
    out = df.withColumn("_f", fmt).withColumn("_raw", bx.read_boxes(F.col(reply), F.col("_f.ord")))
    found = bx.to_pixels(F.col("_raw"), F.col("_f.scale"), F.col("_f.known"), F.col(width), F.col(height))
    out = out.withColumn("pred_boxes", found)
    out = out.withColumn("_s", geo.box_scores(geo.all_corners(F.col(truth)), F.col("pred_boxes"))).select("*", "_s.*")
    out = out.withColumn("localisation_score", F.when(F.col("pred_boxes").isNull(), F.lit(0.0)).otherwise(F.col("localisation_score")))
    return out.drop("_f", "_raw", "_s")


def density_errors(df: DataFrame, count: str, true_count: str, coverage: str, true_coverage: str) -> DataFrame:
    """Count error, and coverage error in percentage points of a fraction."""
    c, p = F.col(count) - F.col(true_count), F.col(coverage) - 100 * F.col(true_coverage)
    return df.withColumns({"count_error": c, "abs_count_error": F.abs(c), "coverage_error_pp": p, "abs_coverage_error_pp": F.abs(p)})


def judge_scores(judgements: DataFrame, prefix: str, criteria: Sequence[str]) -> DataFrame:
    """One row per response: the latest valid judgement of each kind, a column per criterion."""
    done = judgements.where("status = 'ok'")
    last = latest(done.select("response_id", "kind", "scores", "judge_model", "judged_at"), ["response_id", "kind"], ["judged_at"])
    long = melt_map(last, "scores", "criterion", "value").where(F.col("value").between(0, 4))
    wide = long.groupBy("response_id").agg(*[F.first(F.when(F.col("criterion") == c, F.col("value")), ignorenulls=True).alias(f"{prefix}{c}") for c in criteria])
    names = last.groupBy("response_id").agg(*[F.first(F.when(F.col("kind") == k, F.col("judge_model")), ignorenulls=True).alias(f"{prefix}{k}_model") for k in ("textual", "visual")])
    return names.join(wide, "response_id", "left")


def merge_judges(table: DataFrame, judges: Sequence[DataFrame], prefixes: Sequence[str], needed: Sequence[str]) -> DataFrame:
    """Judge columns on a response table; older ones are dropped first, so a rerun gives the same.

    A response counts as evaluated where every judge gave every needed criterion."""
    out = table.drop(*[c for c in table.columns if any(c.startswith(p) for p in prefixes)])
    complete = [j.where(" and ".join(f"{p}{c} is not null" for c in needed)).select("response_id") for j, p in zip(judges, prefixes, strict=True)]
    everywhere = in_all(complete).withColumn("_all", F.lit(True))
    for j in judges:
        out = attach_one(out, j.withColumnRenamed("response_id", "id"), ["id"])
    out = out.join(everywhere.withColumnRenamed("response_id", "id"), "id", "left")
    return out.withColumn("evaluated", F.coalesce("_all", F.lit(False))).drop("_all")
