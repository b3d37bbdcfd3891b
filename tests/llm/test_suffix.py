import hashlib
import random

import brute
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline.llm.suffix import remove_repeated, without_repeated

SCHEMA = "doc_id long, text string, k long, g long, at string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(texts)], SCHEMA)


def check(spark, texts, length):
    size = max(2, length // 8)
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeated(frame(spark, texts), length=length, passage=size).collect()}
    want = {i: (n, g, s, hashlib.sha256(rest).hexdigest(), *said[:2]) for i, ((n, g, s, rest), said) in enumerate(zip(brute.repeated_bytes(texts, length), brute.passages(texts, size)))}
    assert got == want
    return want


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    want = brute.repeated_bytes([r.text for r in rows])
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeated(docs).collect()}
    said = brute.passages([r.text for r in rows])
    assert got == {r.doc_id: (n, g, s, hashlib.sha256(rest).hexdigest(), *p[:2]) for r, (n, g, s, rest), p in zip(rows, want, said)}
    assert sum(0 < g < n for n, g, _, _ in want) > 5 and sum(p[0] > 0 for p in said) > 5
    cut = {r.doc_id: r.text for r in without_repeated(docs).collect()}
    assert cut == dict(zip([r.doc_id for r in rows], brute.without_repeated([r.text for r in rows])))


def test_hot_passage_and_one_long_text(spark):
    """A passage of 60 short words in a third of the rows, under 400 bytes, and a text of several pieces."""
    rng = random.Random(9)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    passage, long = line(60), line(900_000)
    texts = [f"{line(90)} {passage} {line(30)}" if i % 3 == 0 else line(80) for i in range(60)] + [long, line(200) + " " + long[4_194_000:4_194_800] + " " + line(20)]
    got = {r.doc_id: r for r in remove_repeated(frame(spark, texts)).collect()}
    for i in range(60):
        assert (got[i].n_removed, got[i].n_passages, got[i].n_passage_words) == ((0, 1, 60) if i % 3 == 0 else (0, 0, 0))
    assert 400 <= got[60].n_removed <= 810 and got[60].n_removed == got[61].n_removed and got[60].n_spans == 1
    left = {r.doc_id: r.text for r in without_repeated(frame(spark, texts)).collect()}
    assert passage not in left[0] and left[0] == texts[0].replace(passage, "") and left[1] == texts[1]


def test_edges(spark):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choices("abcdefgh é\n", k=n))
    core = noise(70)
    texts = [None, "", "short", "a" * 200, "ab" * 90, noise(300), core, noise(9) + core + noise(200), noise(200) + core[:64] + noise(5), core[6:] + noise(3), noise(100) + core + core, "é" * 64, "x" + "é" * 40]
    want = check(spark, texts + texts[5:6], 64)
    assert want[0] == (0, 0, 0, hashlib.sha256(b"").hexdigest(), 0, 0)
    assert remove_repeated(frame(spark, [])).collect() == []


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab", max_size=90), min_size=1, max_size=6), st.integers(17, 40))
def test_random_texts(spark, texts, length):
    check(spark, texts, length)
