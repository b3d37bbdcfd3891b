import math

import brute
import pytest

from plumbline.llm.mixing import mix_sources, mixed_documents

SCHEMA = "doc_id long, text string, source string, size long, target string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 5, "x") for i, t, s in rows], SCHEMA)


def water(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return {s: share.get(s, cap * sizes[s]) for s in names}
        capped |= over


ROWS = [(i, "w " * (i % 37 * 3), f"s{(i * i) % 5}") for i in range(400)] + [(1000 + i, "only a few words", None) for i in range(3)] + [(2000, None, "s1"), (None, "Some words", "s2"), (7, "w " * 21, "s4"), (7, "w " * 21, "s4"), (3000, "", "void")]


def test_targets_and_words(spark):
    got = mixed_documents(frame(spark, ROWS), block=16).collect()
    assert len(got) == len(ROWS)
    sizes = {}
    for i, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = water(sizes)
    source = {i: s for i, _, s in ROWS}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-12)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixed_documents(frame(spark, ROWS[::-1]).repartition(3), block=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_schedule_is_even_at_every_prefix(spark):
    docs = frame(spark, [(i, "w " * 50, f"s{i % 3}") for i in range(300)])
    rows, mix = mix_sources(docs, block=10)
    target = {r.sid: r.target for r in rows.select("sid", "target").distinct().collect()}
    by_slot = sorted({(r.position, r.sid, r["rank"]) for r in mix.collect()})
    total, seen = sum(target.values()), dict.fromkeys(target, 0)
    for n, (_, sid, rank) in enumerate(by_slot, 1):
        assert rank == seen[sid]
        seen[sid] += 1
        assert all(abs(seen[s] - n * target[s] / total) < 4 for s in target)
    words = mix.groupBy("sid", "rank").sum("words").collect()
    assert sum(r[2] != 10 for r in words) <= len(target)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, " ", "b")]])
def test_nothing_to_mix(spark, rows):
    assert [r.taken for r in mixed_documents(frame(spark, rows)).collect()] == [0] * len(rows)
