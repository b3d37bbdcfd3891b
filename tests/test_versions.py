"""Tables that are replaced while read, state of base and deltas, logs in splits."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from plumbline.sources import logs, versions
from plumbline.streaming import log as stream
from plumbline.streaming.state import KeyedState


def test_readers_never_see_a_gap(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace_table(spark.range(3).withColumn("v", F.lit(0)), path)
    failures, seen, done = [], [], threading.Event()

    def read():
        while not done.is_set():
            try:
                rows = versions.read_table(spark, path).collect()
                seen.append({r.v for r in rows})
                assert len(rows) == 3 and len(seen[-1]) == 1
            except Exception as e:
                failures.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 51):
        versions.replace_table(spark.range(3).withColumn("v", F.lit(k)), path)
    done.set()
    reader.join()
    assert not failures and len(seen) > 5
    assert versions.read_table(spark, path).first().v == 50


def test_replace_from_itself_clear_and_conflict(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).write.parquet(path)  # a plain table becomes one of versions
    for _ in range(3):
        versions.replace_table(versions.read_table(spark, path).select((F.col("id") * 2).alias("id")), path, grace=-1)
    assert sorted(r.id for r in versions.read_table(spark, path).collect()) == [0, 8, 16, 24]
    assert sum(d.startswith("v") for d in os.listdir(path)) == 1
    number, content = versions.manifest(spark, path)
    with pytest.raises(versions.Conflict):
        versions.publish(spark, path, number, content)
    assert versions.manifest(spark, path) == (number, content)


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_state_writes_follow_the_batch(spark, tmp_path):
    path = str(tmp_path / "s")
    state = KeyedState(spark, path, ["k"], buckets=4)
    rows = lambda lo, hi, v: spark.range(lo, hi).select(F.concat(F.lit("key"), "id").alias("k"), F.lit(v).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    state.apply(rows(0, 20_000, 0), 0)
    state.compact(everything=True)
    before = size(path)
    state.apply(rows(5, 25, 1), 1)
    state.apply(rows(20, 30, 2), 2)
    state.apply(rows(0, 20_000, 9), 2)  # a batch that is done again
    assert size(path) - before < before / 20
    want = {f"key{i}": 0 for i in range(20_000)} | {f"key{i}": 1 for i in range(5, 25)} | {f"key{i}": 2 for i in range(20, 30)}
    assert {r.k: r.v for r in state.read().collect()} == want
    again = KeyedState(spark, path, ["k"], buckets=4)  # after a restart
    assert sorted(again.compact(everything=True)) == ["0", "1", "2", "3"] and again.compact() == []
    again.apply(rows(0, 1, 7).withColumn("more", F.lit("x")), 3)
    got = {r.k: (r.v, r.more) for r in again.read().where("k in ('key0', 'key1')").collect()}
    assert got == {"key0": (7, "x"), "key1": (0, None)}
    with pytest.raises(ValueError, match="buckets"):
        KeyedState(spark, path, ["k"], buckets=5).read()


def test_only_buckets_that_are_due_are_compacted(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "s"), ["k"], buckets=8, compact_at=0.5)
    state.apply(spark.range(80).select(F.col("id").alias("k"), F.lit(0).alias("v")), 0)
    state.compact(everything=True)
    before = dict(state._now()[1]["base"])
    bucket = spark.range(80).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(8))).where("b = 3")
    state.apply(bucket.select(F.col("id").alias("k"), F.lit(1).alias("v")), 1)
    after = state._now()[1]
    assert {k for k in before if before[k] != after["base"][k]} == {"3"} and not after["deltas"]
    assert {r.v for r in state.read().join(bucket, F.col("k") == F.col("id")).collect()} == {1}


def test_state_orders(spark, tmp_path):
    rows = lambda *v: spark.createDataFrame([("a", t, x) for t, x in v], "k string, t int, x string").coalesce(1)
    for order, want in ((None, "late"), ("t", "new")):
        state = KeyedState(spark, str(tmp_path / f"s{order}"), ["k"], order)
        with pytest.raises(ValueError, match="nothing"):
            state.read()
        state.apply(rows((1, "old"), (5, "new")), 0)
        state.apply(rows((2, "later"), (3, "late")), 1)
        assert state.read().first().x == want
        state.apply(rows().limit(0), 2)
        assert state.read().count() == 1


def test_restart_of_the_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "k string, v int"
    for k in range(3):
        (folder / f"{k}.jsonl").write_text("\n".join(json.dumps({"k": f"k{i}", "v": k}) for i in range(k, 5)))
        os.utime(folder / f"{k}.jsonl", (1_700_000_000 + k, 1_700_000_000 + k))
        stream.upsert(stream.read_stream(spark, str(folder), schema), str(tmp_path / "s"), ["k"], None, str(tmp_path / "cp")).awaitTermination()
    assert {r.k: r.v for r in KeyedState(spark, str(tmp_path / "s"), ["k"]).read().collect()} == {"k0": 0, "k1": 1, "k2": 2, "k3": 2, "k4": 2}


def test_a_log_of_several_splits(spark, tmp_path):
    """The last line of a key wins though several tasks read the file, and the tail reads its end only."""
    path = tmp_path / "run.jsonl"
    with path.open("w") as f:
        for i in range(20_000):
            f.write(json.dumps({"model": f"m{i % 3}", "question_id": f"q{i % 7}", "status": "ok", "attempts": i}) + "\n" + ("\n" if i % 100 == 0 else ""))
        f.write('{"model": "m0", "quest')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        lines = logs.read_lines(spark, str(path))
        assert lines.rdd.getNumPartitions() > 5
        ordered = [json.loads(r["_text"])["attempts"] for r in lines.orderBy("_line").where("_text like '%attempts%'").collect()]
        assert ordered == list(range(20_000))
        last = {(r.model, r.question_id): r.attempts for r in logs.responses(spark, str(path)).select("model", "question_id", "attempts").collect()}
        assert last == {(f"m{i % 3}", f"q{i % 7}"): i for i in range(20_000)}
        got, n = logs.tail(spark, str(path), 3)
        assert n == 20_001 and got[-1].startswith('{"model": "m0", "quest') and json.loads(got[0])["attempts"] == 19_998
        assert logs.last_lines(spark, str(path), 50, block=64)[0] == logs.tail(spark, str(path), 50)[0][0]
        assert len(logs.last_lines(spark, str(path), 10**6)) == 20_001 and logs.last_lines(spark, str(path), 0) == []
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
