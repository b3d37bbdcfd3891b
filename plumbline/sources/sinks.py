"""Writers.  A table that is read and replaced gets a new version (see ``versions``)."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import draw_key
from plumbline.operators.checks import check_questions
from plumbline.operators.windows import position_within
from plumbline.sources.versions import read_table, replace_table


def write_questions(df: DataFrame, images: DataFrame, path: str, order: str = "ord") -> None:
    """Checked questions with their image's digest and their position within the task."""
    check_questions(df)
    out = position_within(df.join(images, "image_path", "left"), ["task"], [order])
    replace_table(out.drop(order), path)


def question_rows(df: DataFrame) -> DataFrame:
    """The expected answer of each variant, and lists as JSON; localisation has no answer."""
    t = F.col("question_type")
    answer = F.when(t == "density", F.col("benchmark_class")).when(t == "localisation", F.lit(None)).otherwise(F.col("answer"))
    lists = {c: F.to_json(c) for c, kind in df.dtypes if kind.startswith("array")}
    return df.withColumns({"expected_answer": answer.cast("string"), **lists})


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_judge_columns(table_path: str, merge: Callable[[DataFrame], DataFrame], spark) -> None:
    """Rewrites a table in place with merged columns; running it again changes nothing."""
    replace_table(merge(read_table(spark, table_path)), table_path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_document(path: str, value: Any) -> None:
    """A small driver-side JSON or text file, by rename."""
    new = f"{path}.new"
    with open(new, "w") as f:
        f.write(value if isinstance(value, str) else json.dumps(value, indent=1, sort_keys=True))
    os.replace(new, path)


def draw_all(plan: DataFrame, draw: Callable[[Iterator], None]) -> int:
    """Runs ``draw`` over the plan's rows on the executors, each output once; how many there were."""
    once = plan.dropDuplicates(["out_path"]).repartition(draw_key(0, F.col("out_path")))
    once.foreachPartition(draw)
    return once.count()
