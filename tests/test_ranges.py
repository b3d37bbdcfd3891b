"""Keys of any size: one key in all rows, several, and NULL keys, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import joins, ranges, windows

random.seed(5)
SHAPES = {"one key": lambda i: "hot", "skewed": lambda i: "hot" if i % 3 else f"k{i % 7}", "null key": lambda i: None if i % 2 else "x", "own keys": lambda i: f"k{i}"}


def frame(spark, keys, n=600):
    rows = [(i, keys(i), random.random() < 0.8 if i % 50 else None, random.randrange(40) * 1_000_000) for i in range(n)]
    df = spark.createDataFrame([(i, k, f, t) for i, k, f, t in rows], "i long, k string, failed boolean, us long").withColumn("ts", F.timestamp_micros("us"))
    return rows, df.repartition(5)


@pytest.fixture(scope="module", params=SHAPES, ids=lambda s: s)
def case(request, spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small data are many ranges then
    yield frame(spark, SHAPES[request.param])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_streaks(case):
    rows, df = case
    got = {r.i: r.streak for r in windows.failure_streaks(df, ["k"], ["i"], F.col("failed")).collect()}
    now, want = {}, {}
    for i, k, failed, _ in rows:
        now[k] = now.get(k, 0) + (failed is True) if failed is not False else 0
        want[i] = now[k]
    assert got == want


def test_trip(case):
    rows, df = case
    got = {r.k: r.i for r in windows.first_trip(df, ["k"], ["i"], F.col("failed"), 5).collect()}
    now, want = {}, {}
    for i, k, failed, _ in rows:
        now[k] = now.get(k, 0) + (failed is True) if failed is not False else 0
        if now[k] >= 5:
            want.setdefault(k, i)
    assert got == want
    assert windows.first_trip(df, ["k"], ["i"], F.col("failed"), 0).count() == 0


def test_running_sum(case):
    rows, df = case
    got = {r.i: r.s for r in ranges.running_sum(df, ["k"], ["i"], "us", "s").collect()}
    now, want = {}, {}
    for i, k, _, us in rows:
        now[k] = now.get(k, 0) + us
        want[i] = now[k]
    assert got == want


def test_rolling_count(case):
    rows, df = case
    got = windows.rolling_count(df, ["k"], "ts", 3)
    assert got.columns == [*df.columns, "recent"]
    want = {i: sum(k == k2 and us - 3_000_000 <= us2 <= us for _, k2, _, us2 in rows) for i, k, _, us in rows}
    assert {r.i: r.recent for r in got.collect()} == want


def test_quantiles(case):
    rows, df = case
    value = F.when(F.col("i") % 9 != 0, F.col("us") / 7)
    got = {r.k: (r.a, r.b, r.c) for r in ranges.group_quantiles(df, ["k"], value, [0.0, 0.5, 0.9], ["a", "b", "c"]).collect()}
    by = {}
    for i, k, _, us in rows:
        by.setdefault(k, []).extend([us / 7] if i % 9 else [])

    def quantile(v, q):
        v, p = sorted(v), q * (len(v) - 1)
        return v[math.floor(p)] + (p - math.floor(p)) * (v[math.ceil(p)] - v[math.floor(p)]) if v else None

    assert set(got) == set(by)
    for k, v in by.items():
        assert got[k] == (pytest.approx(tuple(quantile(v, q) for q in (0.0, 0.5, 0.9))) if v else (None, None, None))


def test_empty(spark):
    df = frame(spark, SHAPES["one key"], 1)[1].limit(0)
    assert windows.failure_streaks(df, ["k"], ["i"], F.col("failed")).count() == windows.rolling_count(df, ["k"], "ts", 3).count() == 0
    assert ranges.group_quantiles(df, ["k"], F.col("us"), [0.5], ["m"]).count() == 0


def test_no_window_over_a_key(spark):
    """All windows over rows are within a range; those over a key see one row per range."""
    df = frame(spark, SHAPES["one key"])[1]
    plan = windows.failure_streaks(df, ["k"], ["i"], F.col("failed"))._jdf.queryExecution().optimizedPlan().toString()
    over_rows = [line for line in plan.splitlines() if "Window" in line and "_f#" in line]
    assert over_rows and all("_p#" in line.split("], [")[1] for line in over_rows)


@pytest.mark.parametrize("block", [3, 1000])
def test_pairs_of_crowded_keys(spark, monkeypatch, block):
    monkeypatch.setattr(joins, "BLOCK", block)
    rows = [(i, "hot" if i < 30 else f"k{i % 4}", f"g{i % 3}") for i in range(44)]
    df = spark.createDataFrame(rows, "i long, k string, g string")
    a = sorted((r.i_a, r.i_b) for r in joins.pairs_within(df, ["k"], "i", ["i"]).collect())
    assert a == sorted((i, j) for i, k, _ in rows for j, m, _ in rows if k == m and i < j)
    b = sorted((r.i_a, r.i_b) for r in joins.pairs_across(df, ["k"], "g", ["i"]).collect())
    assert b == sorted((i, j) for i, k, g in rows for j, m, h in rows if k == m and g < h)
    assert joins.pairs_all(df, ["k"], ["i"]).count() == sum(k == m for _, k, _ in rows for _, m, _ in rows)


def test_a_crowded_key_is_spread(spark):
    """10,000 rows of one key: no task of the join pairs more than a block with a block."""
    df = spark.range(10_000).select(F.lit("hot").alias("k"), "id")
    sizes = joins.pairs_within(df, ["k"], "id", ["id"]).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in sizes) == 10_000 * 9_999 // 2 and len(sizes) > 1
