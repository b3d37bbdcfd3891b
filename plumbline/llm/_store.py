"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder.  Where it is unset (tests, one
machine) a temporary folder stands in.  A written table cuts the lineage, so a
lost executor costs the tasks it held and not the whole job.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow (a few numbers wide) table that may be broadcast.
BROADCAST_ROWS = 400_000

#: Rows of whole texts that a task hands to Python at once.
TEXT_ROWS = 1000

_fallback: list[str] = []


def root(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="plumbline-"))
        atexit.register(shutil.rmtree, _fallback[0], ignore_errors=True)
    return f"file://{_fallback[0]}"


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{root(spark)}/plumbline/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._kept_at = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`keep` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_kept_at", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast where the counted rows are few; else leave the join to shuffle.

    ``df`` must be a kept table of narrow rows: the count reads only footers.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(left: DataFrame, right: DataFrame, on: str | list[str], by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """A join on a key that may hold a third of the left rows: they are dealt by the key and a hash of
    ``by`` too, and the right side, one row per key, stands once for each salt.  It is never broadcast:
    written out its copies look smaller than they are."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("shuffle_merge")
    return a.join(b, [*([on] if isinstance(on, str) else on), "_salt"], how).drop("_salt")


def release() -> None:
    """Give freed memory back: workers are reused, and what one holds its executor lacks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean_group(run: Callable) -> Callable:
    """A function of a group (or of two) after which memory is given back."""

    def lean(key, *tables):
        try:
            return run(key, *tables)
        finally:
            release()

    return (lambda key, table: lean(key, table)) if run.__code__.co_argcount == 2 else (lambda key, a, b: lean(key, a, b))


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow for rows that hold whole texts: small batches, and memory is given back at the end."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(lean, schema)
