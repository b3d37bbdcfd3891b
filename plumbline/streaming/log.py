"""The append-only log as a stream: latest state per key, failure streaks and completion rates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.streaming.state import KeyedState


def read_stream(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """Records of new files in a folder; lines that are no JSON are left out."""
    raw = spark.readStream.option("maxFilesPerTrigger", files).text(folder)
    return raw.select(F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNotNull().alias("ok")).where("ok").select("r.*")


def upsert(stream: DataFrame, path: str, keys: Sequence[str], order: str | None, checkpoint: str) -> StreamingQuery:
    """Keeps the latest record of each key at ``path``, where :class:`KeyedState` reads it.

    With ``order`` the greatest value of that column wins (event time), else what arrives later."""

    def merge(batch: DataFrame, epoch: int) -> None:
        KeyedState(batch.sparkSession, path, keys, order).apply(batch, epoch)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def breaker(stream: DataFrame, key: str, failed: str, threshold: int) -> DataFrame:
    """(key, tripped, streak): a key's first streak of ``threshold`` failures, once; 0 turns it off.

    Within a micro-batch rows count in the order of ``seq``."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, tripped = state.get if state.exists else (0, False)
        fresh = False
        # a key's rows of a micro-batch may come in several parts, in no order
        rows = pd.concat([p[["seq", failed]] for p in parts]).sort_values("seq", kind="stable")
        for bad in rows[failed]:
            streak = streak + 1 if bad else 0
            if threshold and streak >= threshold and not tripped:
                tripped = fresh = True
        state.update((int(streak), tripped))
        if fresh:
            yield pd.DataFrame([{key: k[0], "tripped": True, "streak": threshold}])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} string, tripped boolean, streak int", "streak int, tripped boolean", "append", GroupStateTimeout.NoTimeout)


def completion_rate(stream: DataFrame, ts: str, keys: Sequence[str] = (), window: str = "60 seconds", slide: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Records per sliding window of event time."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window, slide), *keys).agg(F.count("*").alias("n"))


def snapshots(stream: DataFrame, write: Callable[[dict], None], every: str, checkpoint: str) -> StreamingQuery:
    """Calls ``write`` with the totals of what arrived, every so often.

    Each micro-batch's totals stay beside the checkpoint, so that a restarted query goes on
    from there, and a batch that is done again counts once."""
    folder, schema = f"{checkpoint}-totals", "done long, failed long, epoch long"

    def add(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        counted = batch.agg(F.count("*").alias("done"), F.count_if(F.col("status") != "ok").alias("failed"))
        counted.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
        row = spark.read.schema(schema).parquet(folder).where(F.col("epoch") <= epoch).agg(F.sum("done").alias("done"), F.sum("failed").alias("failed")).first()
        write(row.asDict())

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def signatures(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, modified, size) of the files, from their listing alone: no content is read."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change) between two listings: added, changed or removed."""
    state = lambda df: df.select("path", F.struct("modified", "size").alias("s"))
    both = state(now).alias("n").join(state(before).alias("b"), "path", "full")
    change = F.when(F.col("b.s").isNull(), "added").when(F.col("n.s").isNull(), "removed").when(F.col("n.s") != F.col("b.s"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


class Reloaded:
    """A table that is loaded anew when its files change.

    Files that cannot be loaded, as one caught half-written, leave the table as it was; they are tried again
    at the next call.  The first load must succeed."""

    def __init__(self, spark: SparkSession, pattern: str, load: Callable[[], DataFrame]):
        self.spark, self.pattern, self.load = spark, pattern, load
        self.seen: tuple | None = None
        self.table: DataFrame | None = None
        self.failure: Exception | None = None

    def signature(self) -> tuple:
        """Of all the files, as two numbers; the driver holds no listing."""
        return tuple(signatures(self.spark, self.pattern).agg(F.count("*"), F.bit_xor(F.xxhash64("path", "modified", "size"))).first())

    def get(self) -> DataFrame:
        now = self.signature()
        if now != self.seen:
            try:
                # before loading: a change meanwhile is found at the next call
                self.table, self.seen, self.failure = self.load(), now, None
            except Exception as e:
                if self.table is None:
                    raise
                self.failure = e
        return self.table


def replay_attempts(attempts: DataFrame, keys: Sequence[str], transient: int, parse: int) -> DataFrame:
    """How a request with separate retry budgets ends: ok, failed or open, and the attempts it used.

    ``attempts`` has per key the array ``outcomes`` of ok / transient / parse / truncated / fatal; a
    truncated reply is never tried again."""
    start = F.struct(F.lit(0).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("n"), F.lit("open").alias("end"))

    def step(acc, o):
        t = acc["t"] + (o == "transient").cast("int")
        p = acc["p"] + (o == "parse").cast("int")
        end = F.when(o == "ok", "ok").when(o.isin("truncated", "fatal"), "failed").when((t > transient) | (p > parse), "failed").otherwise("open")
        return F.when(acc["end"] != "open", acc).otherwise(F.struct(t.alias("t"), p.alias("p"), (acc["n"] + 1).alias("n"), end.alias("end")))

    return attempts.withColumn("_s", F.aggregate("outcomes", start, step)).select(*keys, F.col("_s.end").alias("state"), F.col("_s.n").alias("used"))
