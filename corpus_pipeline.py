"""A training corpus from raw documents, in five stages.

Each stage gets what its predecessor kept and returns the columns of documents;
the last returns the mix.  Nulls, empty texts, repeated rows and empty tables have the
results that the operators define.  Ids may be null or stand on several rows: a
stage that drops documents names them by a row key of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontam, langid, minhash, mixing, suffix
from plumbline.llm._store import discard, keep, maybe_broadcast

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as a kept table with _row, another number on every row."""
    return keep(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def _without(numbered: DataFrame, dropped: DataFrame) -> DataFrame:
    """``numbered`` but for the dropped rows (_row), and without the numbers."""
    return numbered.join(maybe_broadcast(keep(dropped.select("_row").distinct(), "dropped")), "_row", "left_anti").drop("_row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without letters go.

    The model learns from all of them that name their language."""
    model = langid.train(docs, F.lit(True))
    if not model.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs, model, into=("_language", "_share", "_languages"))
    return found.where("_language <> 'und'").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that with the smallest id; a null id comes last."""
    numbered = _numbered(docs)
    groups = keep(minhash.near_duplicates(numbered, "_row").select("_row", "component_id", "kept"), "groups")
    several = keep(groups.where("not kept").select("component_id").distinct(), "several")
    members = groups.join(maybe_broadcast(several), "component_id", "left_semi").join(numbered.select("_row", "doc_id"), "_row")
    members = keep(members, "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first")).select(F.col("first._row").alias("_row"))
    return _without(numbered, members.join(first, "_row", "left_anti"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 400 bytes and the passages of 50 words that stand more than once; n_chars follows.

    A document of which nothing but white space is left goes, if it had more before."""
    had = docs.withColumn("_had", F.coalesce(F.col("text"), F.lit("")).rlike(r"\S"))
    left = suffix.without_repeated(had).where(F.expr(r"not _had or text rlike '\\S'"))
    chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return left.withColumn("n_chars", chars.cast(dict(docs.dtypes)["n_chars"])).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    numbered = _numbered(docs)
    return _without(numbered, decontam.contaminated(numbered, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "_row"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
]

#: Mixtures, MinHash components and repeated byte strings have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, keep(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
