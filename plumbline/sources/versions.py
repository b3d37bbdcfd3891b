"""Tables that are replaced while others read them.

Every version of a table is a folder of its own, which nothing changes once it is written.  A manifest, one small
file per version, names what belongs to it; it is written aside and appears by one rename, and its name is
the version's number.  Readers take the greatest number that is there, so they see the old version or the
new one and never a gap.  The versions before are kept for those who still read them, and cleared later.

Folders are reached through Hadoop's file systems, so any store that Spark writes to will do.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_manifests"


class Conflict(Exception):
    """Another writer published the same version first."""


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(Hadoop's file system of a path, a function that makes its Paths)."""
    made = spark._jvm.org.apache.hadoop.fs.Path
    return made(path).getFileSystem(spark._jsc.hadoopConfiguration()), made


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, at = file_system(spark, path)
    folder = at(f"{path}/{MANIFESTS}")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())


def _read(spark: SparkSession, path: str, number: int) -> dict:
    fs, at = file_system(spark, path)
    stream = fs.open(at(f"{path}/{MANIFESTS}/{number:020d}"))
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def manifest(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    """The number and content of the newest version; None where there is none."""
    numbers = _numbers(spark, path)
    return (numbers[-1], _read(spark, path, numbers[-1])) if numbers else None


def publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Makes ``content`` version ``number``, unless another writer was first."""
    fs, at = file_system(spark, path)
    target, aside = at(f"{path}/{MANIFESTS}/{number:020d}"), at(f"{path}/{MANIFESTS}/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise Conflict(f"{path} has a version {number}")


def clear(spark: SparkSession, path: str, grace: float = 600) -> None:
    """Deletes versions that were replaced ``grace`` seconds ago or earlier, and the folders that only they name.

    A reader that has begun has that long to finish."""
    fs, at = file_system(spark, path)
    numbers = _numbers(spark, path)
    born = lambda n: fs.getFileStatus(at(f"{path}/{MANIFESTS}/{n:020d}")).getModificationTime() / 1000
    old = []
    for n, successor in zip(numbers, numbers[1:]):
        if born(successor) > time.time() - grace:
            break
        old.append(n)
    used = {f for n in numbers[len(old) :] for f in _read(spark, path, n)["folders"]} if old else set()
    for n in old:
        for folder in set(_read(spark, path, n)["folders"]) - used:
            fs.delete(at(f"{path}/{folder}"), True)
        fs.delete(at(f"{path}/{MANIFESTS}/{n:020d}"), False)


def replace_table(df: DataFrame, path: str, grace: float = 600) -> None:
    """Parquet at ``path``, even if ``df`` reads from there.  :func:`read_table` reads it, during the replacement too.

    A plain folder of Parquet files becomes a table of versions; its own files stay where they are, unread."""
    spark = df.sparkSession
    now = manifest(spark, path)
    number = now[0] + 1 if now else 0
    folder = f"v{number}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    publish(spark, path, number, {"folders": [folder]})
    clear(spark, path, grace)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders of the newest version, or the path itself where it is a plain table."""
    now = manifest(spark, path)
    return [f"{path}/{folder}" for folder in now[1]["folders"]] if now else [path]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(*folders(spark, path))
