import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.resampling import bucket_stream, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, id int, score string, rank string, _p int"


def features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for i in range(len(w)) for k in (1, 2, 3) if i + k <= len(w)], len(w)


def by_hand(docs, target, least=20, percent=5):
    own = [features(t) for _, t in docs]
    s, t = Counter(b for f, _ in own for b in f), Counter(b for x in target for b in features(x)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (S + 10_000)) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    rows = []
    for (i, _), (f, n) in zip(docs, own):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    long = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(long[: len(long) * percent // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


def frames(spark, docs, target):
    return spark.createDataFrame([(i, t, 7, "x", "y", 1) for i, t in docs], SCHEMA), spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZé9_ .\n\0世", max_size=30), min_size=1, max_size=6))
def test_streams(texts):
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    stream, n_features, n_words = bucket_stream(np.frombuffer(b"".join(data), np.uint8), offsets)
    want = [features(t) for t in texts]
    assert n_words.tolist() == [n for _, n in want] and n_features.tolist() == [len(f) for f, _ in want]
    assert stream.tolist() == [b for f, _ in want for b in f]


WORDS = ["red", "Green", "été", "x1", "9", "blue-grey", "a_b", "straße", "w" * 100, "日本"]
DOCS = [(i, " ".join(WORDS[(i * k + k * k) % 10] for k in range(i % 50))) for i in range(1, 400)]
ODD = [(None, "one two three " * 9), (None, None), (500, ""), (501, " -- "), (7, "same words " * 15), (7, "same words " * 15), (502, "é"), (503, "A-b C"), (-3, "z " * 30)]
TARGET = ["red green red", None, "", "blue grey été", "x1 9 x1 9 x1"]


@pytest.mark.parametrize(("docs", "target"), [([], TARGET), (ODD, []), (DOCS + ODD, TARGET)], ids=["empty", "no target", "all"])
def test_against_hand(spark, docs, target):
    got = [tuple(r) for r in resample(*frames(spark, docs, target)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, by_hand(docs, target)))
    again = [tuple(r) for r in resample(*frames(spark, docs[::-1], target)).collect()] if docs else []
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_long_texts_and_words(spark):
    docs = [(1, "é" * 400_000 + " tail of it"), (2, "many words here " * 60_000), (3, "short one")]
    got = [tuple(r) for r in resample(*frames(spark, docs, TARGET)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, by_hand(docs, TARGET)))


def test_draw_follows_the_target(spark):
    """Texts like the target are drawn more often than others."""
    docs = [(i, " ".join(("red green été" if i % 2 else "far off words").split()[(i + k) % 3] for k in range(25))) for i in range(1000)]
    rows = resample(*frames(spark, docs, ["red green été " * 40]), percent=10).where("rank is not null").collect()
    assert len(rows) == 100 and sum(r.doc_id % 2 for r in rows) == 100
