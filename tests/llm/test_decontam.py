import random

import brute
import pytest

from plumbline.llm.decontam import contaminated


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, 2.0) for i, t in docs], "doc_id long, text string, id long, similarity double")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.similarity for r in contaminated(d, b, **options).collect()}


def test_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute.contaminated([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()])
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(docs, items).collect()}
    assert got == pytest.approx(want) and len(want) > 3


def test_edited_passages(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(14, 60)))) for i in range(40)]
    docs = []
    for i, t in items:
        w = t.split()
        if i % 2:
            w[rng.randrange(len(w))] = "edited"
        if i % 3 == 0:
            w.insert(rng.randrange(len(w)), "added")
        docs.append((100 + i, " ".join(rng.choices(vocabulary, k=80) + w + rng.choices(vocabulary, k=80)).upper()))
    want = brute.contaminated(docs, items)
    assert len(want) > 20
    assert run(spark, docs, items) == pytest.approx(want)
    assert run(spark, docs, items, block_words=200) == {k: pytest.approx(v, abs=0.05) for k, v in want.items()}


def test_odd_rows(spark):
    items = [(1, "one two three four five six seven"), (2, None), (3, ""), (4, "Tiny item"), (5, "one two three four five six seven"), (6, "a a a a a a a a a a")]
    docs = [(10, None), (11, ""), (12, "x one TWO three four five six seven y"), (12, "x one TWO three four five six seven y"), (13, "tiny item"), (14, "one two three four five six"), (15, "a " * 50), (16, "so tiny item there"), (17, "one two three")]
    real = [(i, t) for i, t in items if t]
    assert run(spark, docs, items) == pytest.approx(brute.contaminated(docs, real))
    assert run(spark, [], items) == {} and run(spark, docs, []) == {}


def test_items_that_repeat_a_run(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    items, docs = [], []
    for i in range(30):
        run_ = rng.choices(vocabulary, k=rng.choice([1, 1, 2, 6]))
        items.append((i, " ".join(rng.choices(vocabulary, k=8) + run_ * rng.randint(5, 14) + rng.choices(vocabulary, k=9))))
        docs.append((100 + i, " ".join(rng.choices(vocabulary, k=70) + items[i][1].split() + rng.choices(vocabulary, k=70))))
    want = brute.contaminated(docs, items)
    assert all(want[100 + i, i] == pytest.approx(1) for i in range(30))
    assert run(spark, docs, items) == pytest.approx(want)
    exact = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.bits_apart for r in exact.collect() if r.doc_id == 100 + r.item_id} == {0}


def test_results_do_not_depend_on_blocks(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    stem = "answer the following question with one of the letters given below and explain why".split()
    items = [(i, " ".join(stem + rng.choices(vocabulary, k=rng.randint(4, 30)))) for i in range(30)] + [(90, "tiny item"), (91, "tiny item"), (92, "three small words")]
    docs = [(100 + i, " ".join(rng.choices(vocabulary, k=20) + stem * (i % 2) + t.split()[i % 16 :] + rng.choices(vocabulary, k=20))) for i, t in items]
    docs += [(300, " ".join(stem)), (301, " ".join(stem + rng.choices(vocabulary, k=9))), (302, "tiny item"), (None, items[3][1]), (302, items[4][1])]
    got = []
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for words in (1_000_000, 400, 120):
        rows = contaminated(d, b, block_words=words).collect()
        got.append(sorted(((r.doc_id or 0, r.item_id, round(r.similarity, 9), r.first_word, r.n_words, r.bits_apart) for r in rows)))
    assert got[0] == got[1] == got[2] and len(got[0]) > 10
    want = brute.contaminated([(i or 0, t) for i, t in docs if i != 302] + [(302, "tiny item")], items)
    assert {r[:2]: r[2] for r in got[0] if r[0] != 302} == pytest.approx({k: v for k, v in want.items() if k[0] != 302})


def test_blocks_of_edited_passages_equal_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(vocabulary[:12] + rng.choices(vocabulary, k=rng.randint(14, 60)))) for i in range(24)]
    docs = [(100 + i, " ".join(rng.choices(vocabulary, k=40) + t.split() + rng.choices(vocabulary, k=40))) for i, t in items]
    assert run(spark, docs, items, block_words=100) == pytest.approx(brute.contaminated(docs, items))
