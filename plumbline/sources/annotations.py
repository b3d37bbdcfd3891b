"""Nested annotation documents: images, annotations and categories in one JSON file per dataset."""

from __future__ import annotations

import gc
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import required_species
from plumbline.operators.checks import require_none
from plumbline.schemas import ANNOTATION_DOCUMENT
from plumbline.store import new_path, removed, written, written_files, written_groups

#: Files that a task makes or reads, and tasks (or twice the cores, if these are more) whose files exist at a time.
FILES_A_TASK, TASKS_AT_ONCE = 1_000, 24


def read_documents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per document; ``dataset`` is its folder's name."""
    raw = spark.read.option("multiLine", True).schema(ANNOTATION_DOCUMENT).json(paths)
    return raw.withColumn("dataset", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_lines(lines: DataFrame) -> DataFrame:
    """Documents that stand on one line each (``value``), named by their place in the table."""
    parsed = lines.select(F.from_json("value", ANNOTATION_DOCUMENT).alias("d"), F.monotonically_increasing_id().cast("string").alias("dataset"))
    return written(parsed.where("d is not null").select("d.*", "dataset"))


def images(documents: DataFrame) -> DataFrame:
    return documents.select("dataset", F.explode("images").alias("i")).select("dataset", F.col("i.id").alias("image_id"), "i.width", "i.height", "i.file_name")


def annotations(documents: DataFrame) -> DataFrame:
    """One row per box with its species; an unknown category or a name that is none raises."""
    boxes = documents.select("dataset", F.posexplode("annotations").alias("ord", "a")).select("dataset", "ord", F.col("a.id").alias("annotation_id"), F.col("a.image_id").alias("image_id"), F.col("a.category_id").alias("category_id"), F.col("a.bbox").alias("b"))
    names = documents.select("dataset", F.explode("categories").alias("c")).select("dataset", F.col("c.id").alias("category_id"), required_species(F.col("c.name")).alias("species"))
    out = boxes.join(names, ["dataset", "category_id"], "left")
    known = F.coalesce(F.col("species"), F.raise_error(F.format_string("no category %d in %s", "category_id", "dataset")))
    return out.withColumn("species", known).select("dataset", "image_id", "annotation_id", "ord", F.col("species.role").alias("role"), F.col("species.name").alias("species"), F.col("species.qualifier").alias("qualifier"), *[F.col("b")[k].alias(c) for k, c in enumerate("xywh")])


def resolve_paths(images: DataFrame, files: DataFrame, folders: Sequence[str]) -> DataFrame:
    """``path`` of each image, in the first folder that has it; all that are missing raise at once."""
    out = images
    for k, folder in enumerate(folders):
        listed = files.where(F.col("folder") == folder).select("file_name", F.concat_ws("/", "folder", "file_name").alias(f"_p{k}"))
        out = out.join(listed, "file_name", "left")
    out = out.withColumn("path", F.coalesce(*[F.col(f"_p{k}") for k in range(len(folders))])).drop(*[f"_p{k}" for k in range(len(folders))])
    require_none(out.where("path is null").select("dataset", "file_name"), "images that no folder has")
    return out


def filter_categories(document: dict, names: Sequence[str]) -> tuple[dict, int]:
    """A document (driver-side, one file) without the named categories, and how many images are empty then."""
    gone = {c["id"] for c in document["categories"] if c["name"] in set(names)}
    kept = [a for a in document["annotations"] if a["category_id"] not in gone]
    held = {a["image_id"] for a in kept}
    out = {**document, "categories": [c for c in document["categories"] if c["id"] not in gone], "annotations": kept}
    return out, sum(i["id"] not in held for i in document["images"])


def image_digests(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path and sha256 of every image file there, in folders of folders too."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return found.select("path", F.sha2("content", 256).alias("image_sha256"))


def digests_of_texts(files: DataFrame) -> DataFrame:
    """:func:`image_digests` of ``files`` (name, value), each of which becomes a file of its own, as a table.

    Some thousands are made, read and deleted at a time, since the driver holds the names of all files that one read opens."""
    spark, path, schema = files.sparkSession, new_path(files), "path string, image_sha256 string"
    tasks = max(TASKS_AT_ONCE, 2 * spark.sparkContext.defaultParallelism)
    spark.createDataFrame([], schema).write.parquet(path)
    for group in written_groups(files, FILES_A_TASK, tasks):
        folders = written_files(group, new_path(group))
        image_digests(spark, folders).coalesce(tasks).write.mode("append").parquet(path)
        removed(spark, folders)
        gc.collect()  # references between Python and the JVM run in circles, which nothing else ends in time
    return spark.read.schema(schema).parquet(path)


def media_type(path):
    """The media type by suffix."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    return F.when(suffix.isin("jpg", "jpeg"), "image/jpeg").when(suffix == "png", "image/png").when(suffix == "webp", "image/webp")
