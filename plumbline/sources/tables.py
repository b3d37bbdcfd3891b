"""Parquet question tables, key-value documents, SQLite, HTML and configuration."""

from __future__ import annotations

import glob
import json
import os
import sqlite3
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from plumbline.functions.hashing import draw_key
from plumbline.operators.classify import failure_kind
from plumbline.schemas import QUESTIONS
from plumbline.sources.pages import metadata
from plumbline.sources.versions import folders


def questions(spark: SparkSession, path: str, tasks: Sequence[str] | None = None) -> DataFrame:
    """The question table, of some tasks, in order of task and position."""
    out = spark.read.schema(QUESTIONS).parquet(*folders(spark, path))
    return (out.where(F.col("task").isin(list(tasks))) if tasks is not None else out).orderBy("task", "position")


def decoded(questions: DataFrame) -> DataFrame:
    """JSON columns as arrays; NULL where a variant has none or the text is broken."""
    kinds = {"choices": "array<string>", "annotation_ids": "array<bigint>", "boxes": "array<array<double>>"}
    return questions.withColumns({c: F.from_json(c, t) for c, t in kinds.items() if c in questions.columns})


def image_hashes(questions: DataFrame) -> DataFrame:
    return questions.select("image_path", "image_sha256").distinct()


def runs(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Response tables of all runs; ``run`` is in their rows."""
    return spark.read.schema(schema).parquet(pattern)


def key_values(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Rows (key, value fields) of a JSON object; an absent file is empty."""
    try:
        text = spark.read.option("wholetext", True).text(path)
        text.schema  # noqa: B018
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        text = spark.createDataFrame([], "value string")
    return text.select(F.explode(F.from_json("value", f"map<string, struct<{value}>>")).alias("key", "v")).select("key", "v.*")


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            yield from db.execute(self.options["query"])


class SqliteSource(DataSource):
    """format("sqlite"), options path, query and ddl: rows of a query on a file that executors can open."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return self.options["ddl"]

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(dict(self.options))


def sqlite(spark: SparkSession, path: str, query: str, ddl: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").options(path=path, query=query, ddl=ddl).load()


def page_metadata(df: DataFrame, html: str, key: str) -> DataFrame:
    """key, title, ld (JSON), rows, cards and error of each page; a page that cannot be read says why."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, text in zip(part[key], part[html], strict=True):
                try:
                    out.append({key: k} | metadata(text or ""))
                except Exception as e:  # the row keeps the error
                    out.append({key: k, "title": None, "ld": None, "rows": None, "cards": None, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=[key, "title", "ld", "rows", "cards", "error"])

    return df.select(key, html).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, title string, ld string, rows array<array<string>>, cards map<string, string>, error string")


def from_endpoint(df: DataFrame, key: str, prompt: str, client: Callable[[str], tuple[int, str]]) -> DataFrame:
    """key, http_status, body and failure (NULL if none) from a client called on the executors.

    The client is given: a stub in tests, an HTTP client where there is a network."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [client(p) for p in part[prompt]]
            yield pd.DataFrame({key: part[key], "http_status": [s for s, _ in got], "body": [b for _, b in got]})

    out = df.select(key, prompt).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, http_status int, body string")
    return out.withColumn("failure", F.when(F.col("http_status") != 200, failure_kind(F.col("http_status"))))


def config(path: str, defaults: dict[str, Any] | None = None) -> dict[str, Any]:
    """A YAML file over defaults; unknown keys raise."""
    with open(path) as f:
        found = yaml.safe_load(f) or {}
    if defaults is not None and set(found) - set(defaults):
        raise ValueError(f"unknown settings: {sorted(set(found) - set(defaults))}")
    return (defaults or {}) | found


def share(value: str | float) -> float:
    """'1/3' or a number, between 0 and 1."""
    a, _, b = str(value).partition("/")
    out = float(a) / float(b) if b else float(a)
    if not 0 <= out <= 1:
        raise ValueError(f"{value!r} is no share")
    return out


def enabled_tasks(settings: dict[str, dict]) -> list[str]:
    return [t for t, s in settings.items() if s.get("enabled", True)]


def descriptions(spark: SparkSession, path: str) -> DataFrame:
    """species, description and sources of a YAML map; another shape raises."""
    found = config(path)
    for name, d in found.items():
        if not isinstance(d, dict) or set(d) != {"description", "sources"} or not isinstance(d["sources"], list):
            raise ValueError(f"{name}: a description and a list of sources are asked for")
    return spark.createDataFrame([(n, d["description"], d["sources"]) for n, d in found.items()], "species string, description string, sources array<string>")


def dataset_folders(folder: str, name: str) -> list[str]:
    """Files of that name one folder below, sorted."""
    return sorted(glob.glob(os.path.join(folder, "*", name)))


def fixture(images: DataFrame, categories: int = 3, seed: int = 0) -> DataFrame:
    """Synthetic annotations of given images (image_id, width, height): one or two boxes for each image and category, drawn
    from digests of the seed and the box's own key."""
    digit = lambda k, top, *key: F.conv(F.substring(draw_key(seed, F.lit(k), *key), 1, 6), 16, 10).cast("long") % top
    each = images.select("image_id", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(categories - 1))).alias("category"))
    each = each.withColumn("ord", F.explode(F.sequence(F.lit(0), digit(0, 2, F.col("image_id"), F.col("category")).cast("int"))))
    u = lambda k, top: digit(k, top, F.col("image_id"), F.col("category"), F.col("ord")).cast("double")
    return each.select(
        F.lit("synthetic").alias("dataset"), "image_id", "width", "height", F.concat(F.lit("species "), "category").alias("species"), F.lit("weed").alias("role"), "ord",
        u(1, 200).alias("x"), u(2, 150).alias("y"), (u(3, 90) + 20).alias("w"), (u(4, 60) + 20).alias("h"),
    )
