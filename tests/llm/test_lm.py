import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from plumbline.llm.lm import BUCKETS, LEVELS, _level, bucket, lm_scores, mixture_weights, pack, unpack

END = "\n"


def model(docs):
    held = {k: zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False for k, (i, _) in enumerate(docs)}
    tokens = [brute.words(t) + [END] for _, t in docs]
    train = [t for k, t in enumerate(tokens) if not held[k]]
    uni, bi = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([END, *t[:-1]], t))
    return held, tokens, train, uni, bi, sum(uni.values()), len(uni)


def want(docs):
    held, tokens, train, uni, bi, n, v = model(docs)
    cells = {}
    for t in train:
        for h, w in zip([END, *t[:-1]], t):
            c, one, two = uni[h] - 1, uni[w] - 1, bi[h, w] - 1
            f = ((two / c if c else 0) * (v + 1), one / max(n - 1, 1) * (v + 1))
            level = [int(_level(np.array([x]))[0]) for x in f]
            cells.setdefault((int(bucket(np.array([c]))[0]) * LEVELS + level[0]) * LEVELS + level[1], []).append(f)
    means = np.array([np.mean(f, axis=0) for f in cells.values()]).reshape(-1, 2)
    a = mixture_weights(np.array(list(cells), np.int64), np.array([len(f) for f in cells.values()], float), *means.T)
    out = []
    for k, t in enumerate(tokens):
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for h, w in zip([END, *t[:-1]], t):
            b = a[bucket(np.array([uni[h]]))[0]]
            score += math.log10(b[0] * (bi[h, w] / uni[h] if uni[h] else 0) + b[1] * uni[w] / n + b[2] / (v + 1)) if n else 0
        out.append((held[k], len(t), sum(uni[w] > 0 for w in t), n, base, score))
    return out


def same(got, docs):
    got = sorted((tuple(r) for r in got), key=str)
    expected = sorted(((i, *w) for (i, _), w in zip(docs, want(docs))), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in expected]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in expected], rtol=1e-9, atol=1e-9)


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = lm_scores(docs).collect()
    same(got, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # it predicts unseen text better


@pytest.mark.parametrize("size", [3_000_000, 2_000])
def test_number_of_batches(spark, size):
    """One batch, and over 200, of which long texts are some alone; a third of the rows are equal."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(None, "one text that stands on many rows")] * 100
    same(lm_scores(spark.createDataFrame(rows, docs.schema), batch_bytes=size).collect(), rows)


def test_odd_rows(spark):
    schema = "doc_id long, text string, train string, score double"
    for docs in ([(1, None), (2, ""), (None, "a B a"), (7, "a b A c"), (7, "a b A c"), (9, "x " * 3000)], [(i, "w") for i in range(20)]):
        same(lm_scores(spark.createDataFrame([(i, t, "x", 0.0) for i, t in docs], schema)).collect(), docs)
    assert lm_scores(spark.createDataFrame([], schema)).collect() == []
    only = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = lm_scores(spark.createDataFrame([(i, "some text", "x", 0.0) for i in only], schema)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(0, 0, 0.0, 0.0)] * 3


@pytest.mark.parametrize("a", [np.zeros(0, np.uint64), np.array([5, 2**63], np.uint64), np.arange(1000, dtype=np.uint32)])
def test_packing(a):
    assert unpack(pack(a), a.dtype).tolist() == a.tolist()


def test_weights_find_the_mixture():
    rng = np.random.default_rng(0)
    f2, f1 = rng.random(50) * 30, rng.random(50) * 30
    cells = (3 * LEVELS + _level(f2)) * LEVELS + _level(f1)
    w = mixture_weights(cells, np.ones(50), f2, f1)
    assert w.shape == (BUCKETS, 3) and np.allclose(w.sum(axis=1), 1)
