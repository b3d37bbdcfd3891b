import math
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm.langid import BINS, ROUNDS, SMOOTH, grams, language_id, predict, train
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in test) / len(test) > 0.98
    assert 0.25 < len(test) / len(got) < 0.42


def test_mixtures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(docs, F.lit(True))
    text = {r.lang: r.text[:1500] for r in docs.where("length(text) > 1500").select("lang", "text").collect()}
    rows = [("en", text["en"]), ("half", text["en"][:700] + " " + text["de"][:700]), ("most", text["fr"] + " " + text["es"][:300])]
    got = {r.k: r for r in predict(spark.createDataFrame(rows, "k string, text string"), model).collect()}
    assert got["en"].languages == ["en"] and got["en"].score == 1.0
    assert got["half"].languages == ["de", "en"] and got["half"].score == pytest.approx(0.5, abs=0.1)
    assert got["most"].lang_pred == "fr" and got["most"].languages == ["es", "fr"]


def test_odd_rows(spark):
    rows = [(1, None, "en", 1.0), (2, "", "en", 1.0), (3, "12 %% !!", "en", 1.0), (4, "the cat sat", None, 1.0), (None, "the cat", "en", 1.0), *((i, "the cat sat on the mat " * 4000, "en", 1.0) for i in range(5, 10)), *((i // 2, "漢字", "zh", 0.0) for i in range(20, 30))]
    schema = "doc_id long, text string, lang string, score double"
    got = sorted((r.doc_id or 0, r.lang_pred, r.score > 0) for r in language_id(spark.createDataFrame(rows, schema)).collect())
    assert got[1:4] == [(1, "und", False), (2, "und", False), (3, "und", False)]
    assert {x[1] for x in got[:1] + got[4:10]} == {"en"} and {x[1] for x in got[10:]} == {"zh"}
    assert {r.lang_pred for r in language_id(spark.createDataFrame([(1, "word", None, 0.0)], schema)).collect()} == {"und"}
    assert language_id(spark.createDataFrame([], schema)).collect() == []


def bag(text):
    data = text.encode()
    return Counter(grams(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist())


def fitted(counts, p, share):
    total = sum(counts.values())
    for _ in range(ROUNDS):
        new = dict.fromkeys(share, 0.0)
        for b, n in counts.items():
            mass = sum(share[k] * p[k][b] for k in share)
            for k in share:
                new[k] += n * share[k] * p[k][b] / mass / total
        moved, share = max(abs(new[k] - share[k]) for k in share), new
        if moved < 0.003:
            break
    return share, sum(n * math.log(sum(share[k] * p[k][b] for k in share)) for b, n in counts.items())


def mixture(text, p, penalty=1.0):
    """Shares of the chosen languages, one document at a time in plain loops."""
    counts = bag(text)
    share, fit = fitted(counts, p, dict.fromkeys(p, 1 / len(p)))
    while len(share) > 1:
        weakest = min(share, key=share.get)
        rest = {k: v for k, v in share.items() if k != weakest}
        rest, lower = fitted(counts, p, {k: v / sum(rest.values()) for k, v in rest.items()})
        if fit - lower >= penalty * 0.5 * math.log(max(sum(counts.values()), 2)):
            break
        share, fit = rest, lower
    return share


def test_against_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows}
    counts = {}
    for r in rows:
        if not held[r.doc_id] and r.lang is not None and r.text is not None:
            counts.setdefault(r.lang, Counter()).update(bag(r.text))
    p = {}
    for k, c in sorted(counts.items()):
        whole = sum(c.values()) + SMOOTH * BINS
        p[k] = {b: (n + SMOOTH) / whole for b, n in c.items()}
        p[k] = type("P", (dict,), {"__missing__": lambda self, b, low=SMOOTH / whole: low})(p[k])
    got = {r.doc_id: r for r in language_id(docs).collect()}
    assert {i: r.held_out for i, r in got.items()} == held
    for r in rows[:80]:
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        want = mixture(r.text, p)
        best = max(want, key=want.get)
        assert got[r.doc_id].score == pytest.approx(want[best], abs=0.04), r.doc_id
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].languages == sorted(want), r.doc_id


def test_held_out_labels_are_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(map(tuple, language_id(docs).collect())) == sorted(map(tuple, language_id(other).collect()))
