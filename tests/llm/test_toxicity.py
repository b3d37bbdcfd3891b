import bisect
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.toxicity import FEATURES, Lexicon, Trees, Units, features, fit, isotonic, scores, toxicity


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return docs.count(), {r.doc_id: r for r in toxicity(docs, labels).collect()}, {r.doc_id: r.toxic for r in labels.collect()}


def test_held_out_accuracy(scored):
    count, got, truth = scored
    assert len(got) == count and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    test = [(r.predicted, r.score, truth[i]) for i, r in got.items() if r.held_out and i in truth]
    hit = sum(p and y for p, _, y in test)
    assert hit / sum(y for *_, y in test) > 0.8 and hit / sum(p for p, *_ in test) > 0.8
    assert abs(np.mean([s for _, s, _ in test]) - np.mean([y for *_, y in test])) < 0.03


def test_isotonic():
    rng = np.random.default_rng(0)
    s = rng.normal(size=300).round(1)
    y = (rng.random(300) < 1 / (1 + np.exp(-s))).astype(float)
    xs, ys = isotonic(s, y)
    fit = np.interp(s, xs, ys)
    assert (np.diff(ys) >= 0).all() and abs(fit.mean() - y.mean()) < 1e-9


def test_trees_find_an_interaction():
    x = np.random.default_rng(1).random((2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.4)).astype(float)
    assert ((Trees().fit(x, y).raw(x) > 0) == (y > 0)).mean() > 0.97


def test_features_of_a_text():
    texts = ["You are a TRASH person!! id1ot", "", "trash. trash"]
    data = [t.encode() for t in texts]
    units = Units(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    name = units.names(None)[[3]]
    got = dict(zip(FEATURES, features(units, Lexicon(name, np.array([3.0], np.float32))).T))
    assert got["hit"].tolist() == [pytest.approx(1 / 6), 0, 1.0]
    assert got["near_you"].tolist() == [pytest.approx(1 / 6), 0, 0]
    assert got["shouted"][0] == pytest.approx(1 / 6) and got["obfuscated"][0] == pytest.approx(1 / 6)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a", 1), (2, "", "b", 0), (None, "text", "c", 1), (3, "x " * 5000, "d", 1), (3, "x", "d", 1)], "doc_id long, text string, score string, toxic int")
    for labels in ([], [(1, 1, 1), (1, 1, 0), (2, None, None), (3, 0, 0)]):
        got = toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).collect() == []


def plain_score(model, text):
    """One document's score, tree by tree in plain loops."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    x = features(Units(data, np.array([0, len(data)])), model.lexicon)[0]
    raw = model.trees.base
    for tree in model.trees.trees:
        node = 0
        while tree[node][0] >= 0:
            feature, edge, _ = tree[node]
            node = 2 * node + (2 if x[feature] > edge else 1)
        raw += tree[node][2]
    xs, ys = model.knots
    at = bisect.bisect_left(xs, raw)
    if at == 0 or at == len(xs):
        level = ys[min(at, len(xs) - 1)]
    else:
        level = ys[at - 1] if xs[at] == xs[at - 1] else ys[at - 1] + (ys[at] - ys[at - 1]) * (raw - xs[at - 1]) / (xs[at] - xs[at - 1])
    return min(1.0, max(0.0, 0.999 * level + 0.001 / (1 + math.exp(-raw))))


def test_against_plain_loops_and_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit(docs, labels, ~out)
    assert model.trees is not None
    got = {r.doc_id: r for r in scores(docs, model).collect()}
    for r in docs.collect():
        assert got[r.doc_id].score == pytest.approx(plain_score(model, r.text), abs=1e-9)
    flipped = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same = sorted(map(tuple, toxicity(docs, labels).collect()))
    assert same == sorted(map(tuple, toxicity(docs, flipped).collect()))
    assert all(held == (zlib.crc32(str(i).encode()) % 4 == 2) for i, held, *_ in same)
