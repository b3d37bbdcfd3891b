"""One text of several megabytes through the operators that hold whole texts."""

import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.chat import digests, render_turns
from plumbline.llm.decontam import contaminated
from plumbline.llm.langid import language_id
from plumbline.llm.minhash import near_duplicates
from plumbline.llm.mixing import mixed_documents
from plumbline.llm.toxicity import Units, features, fit, scores

RNG = random.Random(11)
WORDS = [f"Word{k}" for k in range(5000)]
LONG = " ".join(RNG.choice(WORDS) for _ in range(500_000))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_near_duplicates(spark):
    edited = LONG.replace(LONG[1_000_000:1_000_100], "something else here", 1)
    got = {r.doc_id: r for r in near_duplicates(docs(spark, [(1, LONG, "", ""), (2, edited, "", ""), (3, "a short text of its own", "", "")])).collect()}
    assert [got[i].component_id for i in (1, 2, 3)] == [1, 1, 3]
    assert got[1].n_shingles == len(brute.shingles(LONG))


def test_decontamination_with_many_items(spark):
    """20,000 items; the long text holds three of them, one edited."""
    items = [(k, " ".join(RNG.choice(WORDS) for _ in range(12 + k % 40))) for k in range(20_000)]
    parts = LONG.split(" ")
    edited = items[77][1].split()
    edited[3] = "other"
    places = {items[5][0]: 1000, items[19_999][0]: 250_000, items[77][0]: 499_000}
    inside = [*parts[:1000], items[5][1], *parts[1000:250_000], items[19_999][1], *parts[250_000:499_000], " ".join(edited), *parts[499_000:]]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.item_id: r for r in contaminated(docs(spark, [(1, " ".join(inside), "", ""), (2, "nothing of it", "", "")]), table).collect()}
    assert set(places) == set(got) and got[5].first_word == 1000 and got[5].similarity == pytest.approx(1)
    assert 0.75 <= got[77].similarity < 1


def test_language(spark):
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    french = " ".join(r.text for r in small.where("lang = 'fr'").collect())
    long = (french + " ") * (4_000_000 // len(french) + 1)
    got = {r.doc_id: r for r in language_id(small.unionByName(docs(spark, [(10**6, long, None, "")]))).collect()}
    assert got[10**6].lang_pred == "fr" and got[10**6].score > 0.9


def test_chat(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi", 0), (1, 1, "assistant", LONG + "</s>", 0)], "conv_id long, turn long, role string, text string, piece int")
    got = digests(render_turns(rows)).first()
    assert (got.loss_chars, got.loss_sha256) == (len(LONG) + 4, hashlib.sha256((LONG + "</s>").encode()).hexdigest())
    assert got.turns_sha256 == hashlib.sha256(f"user\nhi\nassistant\n{LONG}</s>\n".encode()).hexdigest()


def test_toxicity(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = fit(table, labels, F.lit(True))
    data = np.frombuffer(LONG.encode(), np.uint8)
    assert features(Units(data, np.array([0, len(data)])), model.lexicon).shape[0] == 1
    assert 0 <= scores(docs(spark, [(1, LONG, "", "")]), model).first().score <= 1


def test_toxicity_sample_is_bounded_in_bytes(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    whole, some = fit(table, labels, F.lit(True)), fit(table, labels, F.lit(True), max_bytes=50_000)
    again = fit(table.repartition(3), labels, F.lit(True))
    text = [r.text for r in table.limit(20).collect()]
    data = [np.frombuffer(t.encode(), np.uint8) for t in text]
    score = lambda m: [float(m.score(d, np.array([0, len(d)]))[0]) for d in data]
    assert score(whole) == score(again) and score(some) != score(whole)


def test_too_many_languages_are_refused(spark, monkeypatch):
    from plumbline.llm import langid

    monkeypatch.setattr(langid, "MOST", 2)
    with pytest.raises(ValueError, match="more than 2"):
        language_id(docs(spark, [(i, "some words", f"l{i}", "") for i in range(9)]))


def test_many_null_ids_in_a_mix(spark):
    """Half of all rows have no id, and some of these are copies."""
    rows = [(None if k % 2 else k, f"text {k % 150} " + "w " * (k % 30), None, f"s{k % 3}") for k in range(600)]
    got = mixed_documents(docs(spark, rows), block=16)
    table = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in table) == 600 and all(abs(r.taken - r.target) <= 0.5 for r in table)
    again = mixed_documents(docs(spark, rows[::-1]).repartition(3), block=16)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
