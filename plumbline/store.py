"""Tables written once between two steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: list[str] = []
_owned: set[str] = set()


def shared_folder(df: DataFrame) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset, as in tests."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not df.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="plumbline-"))
        atexit.register(shutil.rmtree, _fallback[0], ignore_errors=True)
    return f"file://{_fallback[0]}"


def application_folder(df: DataFrame) -> str:
    """Where this application's tables lie; the file system deletes it when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(df)}/plumbline/{spark.sparkContext.applicationId}"
    if path not in _owned:
        _owned.add(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return path


def new_path(df: DataFrame) -> str:
    """A path in :func:`application_folder` where nothing lies yet."""
    return f"{application_folder(df)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table: evaluated once, however often it is read, and with its lineage cut."""
    path = new_path(df)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """:func:`written` in ``parts`` buckets of ``keys``: what joins by them, or groups or ranks by them and more, finds its rows
    together and shuffles nothing.  The table has a name only until it is open."""
    spark, name = df.sparkSession, f"plumbline_{uuid.uuid4().hex}"
    df.repartition(parts, *keys).write.bucketBy(parts, *keys).option("path", new_path(df)).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def written_logs(lines: DataFrame, by: str) -> str:
    """``lines`` (by, value) as text files in the order of their partitions, a folder per value of ``by``; where they are."""
    path = new_path(lines)
    lines.write.partitionBy(by).text(path)
    return path


def written_groups(df: DataFrame, rows: int, files: int) -> list[DataFrame]:
    """``df`` written in files of about ``rows`` rows, and a table of every ``files`` of them: what is done group by group
    reads each row once."""
    path = new_path(df)
    parts = max(1, -(-df.count() // rows))
    df.repartition(parts).withColumn("group", F.floor(F.spark_partition_id() / files)).write.partitionBy("group").parquet(path)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).listStatus(at)
    return [df.sparkSession.read.schema(df.schema).parquet(f"{path}/{s.getPath().getName()}") for s in found if s.getPath().getName().startswith("group=")]


def written_files(files: DataFrame, path: str) -> list[str]:
    """``files`` (name, value), all names different, as text files of one line each below ``path``; the folders that hold them.

    On a mounted file system (``file:``) the tasks write them: Hadoop's writer starts two processes there for the permissions of each
    file and its folder.  An attempt of a task has a folder of its own, and only folders of attempts that ended well are returned.
    In any other store Spark's writer makes them, with a folder for each name."""
    at = files.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(files.sparkSession._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file":
        files.withColumn("part", F.spark_partition_id()).write.partitionBy("part", "name").text(path)
        return sorted(s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName().startswith("part="))
    fs.mkdirs(at)
    root = at.toUri().getPath()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = None
        for batch in batches:
            if folder is None:
                folder = uuid.uuid4().hex
                os.mkdir(os.path.join(root, folder))
            for name, value in zip(batch["name"], batch["value"], strict=True):
                with open(os.path.join(root, folder, name.as_py()), "wb") as f:
                    f.write(value.as_py() + b"\n")
        if folder is not None:
            yield pa.RecordBatch.from_pydict({"folder": [folder]})

    return [f"{path}/{r.folder}" for r in files.select("name", F.col("value").cast("binary")).mapInArrow(write, "folder string").collect()]


def removed(spark: SparkSession, folders: Sequence[str]) -> None:
    """Deletes folders that nothing reads any more, in tasks where they are mounted; the end of the application deletes what is left."""
    made = spark._jvm.org.apache.hadoop.fs.Path
    mounted = []
    for folder in folders:
        fs = made(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.getUri().getScheme() == "file":
            mounted.append((made(folder).toUri().getPath(),))
        else:
            fs.delete(made(folder), True)
    if mounted:
        spark.createDataFrame(mounted, "folder string").repartition(len(mounted)).foreach(lambda r: shutil.rmtree(r.folder, ignore_errors=True))


def written_text(lines: DataFrame) -> DataFrame:
    """``lines`` (value) as text files, read back."""
    path = new_path(lines)
    lines.write.text(path)
    return lines.sparkSession.read.text(path)
