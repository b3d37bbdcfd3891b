"""Append-only JSON-lines logs: the last line of a key wins, broken lines are skipped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.hashing import response_id
from plumbline.operators.windows import latest

from plumbline.schemas import JUDGEMENT, RESPONSE_RECORD
from plumbline.sources.versions import file_system


def read_log(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """Parsed lines with ``_file`` and ``_line``, in which order lines stand; torn and blank lines are left out."""
    return parse_lines(read_lines(spark, path), schema)


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(_file, _line, _text).  A large file is read in splits, by several tasks.

    _line says in which order a file's lines stand: by the byte at which the split begins, then by the
    place within the split, which rises in the order in which a task reads it."""
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), place.alias("_line"), F.col("value").alias("_text"))


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Records of rows (_file, _line, _text)."""
    parsed = lines.where(F.trim("_text") != "").withColumn("_r", F.from_json("_text", schema, {"mode": "PERMISSIVE"}))
    whole = F.try_parse_json("_text").isNotNull()
    return parsed.where(whole & F.col("_r").isNotNull()).select("_file", "_line", "_r.*")


def replay(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last line of each key in its file."""
    return latest(log, ["_file", *keys], ["_line"])


def responses(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return replay(read_log(spark, path, RESPONSE_RECORD), ["model", "question_id"])


def judgements(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return replay(read_log(spark, path, JUDGEMENT), ["response_id", "kind"])


def flatten(records: DataFrame, run: str) -> DataFrame:
    """The columns of the response table from log records."""
    answer = F.coalesce(F.get_json_object("parsed", "$.answer"), F.get_json_object("parsed", "$.bboxes"))
    return records.select(
        response_id(F.lit(run), F.col("model"), F.col("question_id")).alias("id"), F.lit(run).alias("run"), "model", "question_id", "status", answer.alias("answer"), "reasoning",
        "parsed", "raw_response", F.to_json("warnings").alias("warnings"), F.col("error.kind").alias("error_kind"), F.col("error.message").alias("error_message"),
        F.col("error.http_status").alias("error_http_status"), "attempts", F.to_json("retry_log").alias("retry_log"), "finish_reason", "latency_seconds", "usage",
        F.get_json_object("usage", "$.total_tokens").cast("long").alias("total_tokens"), "cost_usd", "generation_id", "provider", "image_sha256", "prompt_version", "created_at",
    )


def consolidate(last: DataFrame, order: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Rows of the keys in ``order`` (question_id, model, ord), sorted by it; ids given before are kept."""
    out = last.join(order, ["question_id", "model"])
    if previous is not None:
        out = out.join(previous.select("question_id", "model", F.col("id").alias("_id")), ["question_id", "model"], "left").withColumn("id", F.coalesce("_id", "id")).drop("_id")
    return out.orderBy("ord").drop("ord")


def tail(spark: SparkSession, path: str, n: int) -> tuple[list[str], int]:
    """The last n non-blank lines and how many there are.

    The lines come from the file's end, of which twice as much is read until it holds them; counting is a job over splits."""
    return last_lines(spark, path, n), spark.read.text(path).where(F.trim("value") != "").count()


def last_lines(spark: SparkSession, path: str, n: int, block: int = 1 << 16) -> list[str]:
    """The last n non-blank lines, read by seeking."""
    fs, at = file_system(spark, path)
    size = fs.getFileStatus(at(path)).getLen()
    while True:
        start = max(0, size - block)
        stream = fs.open(at(path))
        try:
            stream.seek(start)
            data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size - start))
        finally:
            stream.close()
        # what stands before the first line break may be the rest of a longer line
        lines = [x.decode("utf-8", "replace") for x in data.split(b"\n")[bool(start) :] if x.strip()]
        if len(lines) >= n or not start:
            return lines[-n:] if n > 0 else []
        block *= 2
