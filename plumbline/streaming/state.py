"""The latest record of each key as a compacted base and appended deltas, merged on read.

Keys are hashed into buckets.  A micro-batch is reduced to its latest record of each key and appended as a delta, so
what it writes follows its own size.  A bucket whose deltas have grown to a share of its base is compacted: both are
merged into a new base of that bucket, and the other buckets are left alone.  What belongs together is named
by a manifest (see ``sources.versions``), so readers and restarts see whole batches only, each once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.operators.windows import latest
from plumbline.sources import versions


class KeyedState:
    """State at ``path``.  With ``order`` the greatest value of that column wins and arrival breaks ties, else what arrives later.

    ``compact_at``: the share of a bucket's base that its deltas may reach; ``most_deltas``: how many they may be."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: str | None = None, buckets: int = 16, compact_at: float = 0.5, most_deltas: int = 20):
        self.spark, self.path, self.keys, self.order = spark, path, list(keys), order
        self.buckets, self.compact_at, self.most_deltas = buckets, compact_at, most_deltas

    def _now(self) -> tuple[int, dict]:
        empty = {"epoch": -1, "buckets": self.buckets, "base": {}, "deltas": {}, "folders": [], "schema": None}
        number, content = versions.manifest(self.spark, self.path) or (-1, empty)
        if content["buckets"] != self.buckets:
            raise ValueError(f"{self.path} has {content['buckets']} buckets")
        return number, content

    def _publish(self, number: int, content: dict) -> None:
        content["folders"] = sorted({b["folder"] for b in content["base"].values()} | {d["folder"] for d in content["deltas"].values()})
        versions.publish(self.spark, self.path, number + 1, content)
        versions.clear(self.spark, self.path)

    def _latest(self, rows: DataFrame) -> DataFrame:
        return latest(rows, self.keys, [*([self.order] if self.order else []), "_epoch", "_n"])

    def _write(self, rows: DataFrame, folder: str) -> dict[str, int]:
        """Rows by bucket, as written."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows.withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fs, at = versions.file_system(self.spark, self.path)
        if not any(s.isDirectory() for s in fs.listStatus(at(f"{self.path}/{folder}"))):
            return {}
        # at most one row per bucket
        return {str(r["_bucket"]): r["count"] for r in self.spark.read.parquet(f"{self.path}/{folder}").groupBy("_bucket").count().collect()}

    def _rows(self, content: dict, buckets: Sequence[str] | None = None) -> DataFrame:
        """Base and deltas of these buckets, not yet merged."""
        wanted = set(map(str, range(self.buckets)) if buckets is None else buckets)
        paths = [f"{self.path}/{b['folder']}/_bucket={k}" for k, b in content["base"].items() if k in wanted]
        paths += [f"{self.path}/{d['folder']}/_bucket={k}" for d in content["deltas"].values() for k in d["rows"] if k in wanted]
        schema = StructType.fromJson(content["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """Takes a micro-batch in, once: an epoch that is there already is left out."""
        number, content = self._now()
        if epoch <= content["epoch"]:
            return
        stamped = batch.withColumn("_epoch", F.lit(epoch).cast("long")).withColumn("_n", F.monotonically_increasing_id())
        folder = f"delta-{epoch}-{uuid.uuid4().hex}"
        rows = self._write(self._latest(stamped), folder)
        content["epoch"] = epoch
        content["schema"] = self._merged(content["schema"], stamped.schema)
        content["deltas"][str(epoch)] = {"folder": folder, "rows": rows}
        self._publish(number, content)
        self.compact()

    @staticmethod
    def _merged(before: dict | None, now: StructType) -> dict:
        """Columns of before and, after these, new ones."""
        known = StructType.fromJson(before) if before else StructType()
        return StructType(known.fields + [f for f in now.fields if f.name not in known.names]).jsonValue()

    def due(self, content: dict) -> list[str]:
        """Buckets whose deltas are to be merged."""
        pending: dict[str, list[int]] = {}
        for d in content["deltas"].values():
            for k, n in d["rows"].items():
                pending.setdefault(k, []).append(n)
        size = lambda k: content["base"].get(k, {"rows": 0})["rows"]
        return [k for k, ns in pending.items() if len(ns) >= self.most_deltas or (size(k) and sum(ns) > self.compact_at * size(k))]

    def compact(self, everything: bool = False) -> list[str]:
        """Merges the buckets that are due; which these were."""
        number, content = self._now()
        touched = sorted({k for d in content["deltas"].values() for k in d["rows"]}) if everything else self.due(content)
        if touched:
            folder = f"base-{uuid.uuid4().hex}"
            for k, n in self._write(self._latest(self._rows(content, touched)), folder).items():
                content["base"][k] = {"folder": folder, "rows": n}
            left = {e: {"folder": d["folder"], "rows": {k: n for k, n in d["rows"].items() if k not in touched}} for e, d in content["deltas"].items()}
            content["deltas"] = {e: d for e, d in left.items() if d["rows"]}
            self._publish(number, content)
        return touched

    def read(self) -> DataFrame:
        """The latest record of each key."""
        _, content = self._now()
        if content["schema"] is None:
            raise ValueError(f"nothing has arrived at {self.path} yet")
        return self._latest(self._rows(content)).drop("_epoch", "_n")
