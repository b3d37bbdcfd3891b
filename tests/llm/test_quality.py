import re
from collections import Counter, defaultdict

import pytest

from plumbline.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, host int, id int, lines string, kept string, _row int"


def norm(line):
    plain = "".join("0" if "0" <= c <= "9" else c.lower() if "A" <= c <= "Z" else c for c in line)
    return " ".join(WORD.findall(plain))


def by_hand(rows, max_docs=10, percent=1):
    docs = Counter(s for _, _, s in rows)
    have = defaultdict(int)
    split = [[x for x in (t or "").split("\n") if WORD.search(x)] for _, t, _ in rows]
    for lines, (_, _, s) in zip(split, rows):
        for x in {norm(x) for x in lines}:
            have[s, x] += 1
    out = []
    for (i, t, s), lines in zip(rows, split):
        t = t or ""
        w = WORD.findall(t)
        places = defaultdict(list)
        for k in range(len(w) - 7):
            places[tuple(w[k : k + 8])].append(k)
        repeated = {p for ks in places.values() if len(ks) > 1 for k in ks for p in range(k, k + 8)}
        cut = [x for x in lines if have[s, norm(x)] > max_docs and 100 * have[s, norm(x)] > percent * docs[s]]
        left = len(w) - sum(len(WORD.findall(x)) for x in cut)
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        depleted = bool(cut) and 100 * left < 30 * len(w)
        symbols = sum(c in "#*$%&|<>" for c in t)
        out.append((i, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated), failed, not failed and not depleted, len(cut), left))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", 3) for r in rows], SCHEMA)


def own(i, n=30):
    letters = lambda x: "".join("abcdefghij"[int(c)] for c in str(x))  # noqa: E731  digits are all one digit in a normalised line
    return " ".join(f"w{letters(i)}x{letters(k)}" for k in range(n))


SHARED = "Share THIS page  7 times"
ROWS = [(400 + i, own(i) + "\n" + SHARED.replace("7", str(i % 10)) + ("\n" + own(0, 3)) * (i % 4) + " #&", "a.org") for i in range(40)]
ROWS += [(100 + i, own(i), "b.org") for i in range(30)]
COPY = "\n".join(own(900 + k, 12) for k in range(5))
ROWS += [(200 + i, COPY + f"\n{i}", "c.org") for i in range(15)] + [(300 + i, COPY, "d.org") for i in range(10)]
ODD = [(None, None, None), (None, "", "a.org"), (1, " \n\t\r\n", "a.org"), (2, "one two " * 30, None), (3, "a b c d e f g h i j k l m n o p q r s t u\na b c d e f g h", None)]
ODD += [(4, "x\x0by\x0cz\r\n" * 12, "e"), (4, "x\x0by\x0cz\r\n" * 12, "e"), (5, "é 日本 <b>|</b> " + own(5), ""), (6, "a " * 8, "e"), (7, "a " * 9 + own(7), "e"), (8, own(8) + "\n\n\n" + own(8), "e")]


@pytest.mark.parametrize("rows", [[], ODD, ROWS + ODD], ids=len)
def test_against_hand(spark, rows):
    got = [tuple(r) for r in q.quality(frame(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, by_hand(rows)))


def test_verdicts(spark):
    kept = {r.doc_id: r.kept for r in q.quality(frame(spark, ROWS)).collect()}
    assert all(kept[i] for i in [*range(400, 440), *range(100, 130), *range(300, 310)]) and not any(kept[i] for i in range(200, 215))


def test_shuffled_common_lines_are_the_same(spark, monkeypatch):
    """Where common lines are too many to broadcast."""
    monkeypatch.setattr(q, "maybe_broadcast", lambda df: df)
    got = [tuple(r) for r in q.quality(frame(spark, ROWS + ODD)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, by_hand(ROWS + ODD)))


def test_texts_lose_their_common_lines(spark):
    docs = frame(spark, ROWS + ODD)
    out = q.without_common_lines(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    kept = [r for r in by_hand(ROWS + ODD) if r[7]]
    assert len(kept) == out.count() and set(got) == {r[0] for r in kept}
    have = Counter(x for _, t, _ in ROWS[:40] for x in {norm(x) for x in t.split("\n")})
    assert max(have.values()) > 10
    for i, t, _ in ROWS[:40]:
        assert got[i] == "\n".join(x for x in t.split("\n") if have[norm(x)] <= 10)
    assert got[100] == own(0) and got[5] == ODD[7][1]


def test_a_long_text(spark):
    rows = [(1, " ".join(f"w{k % 90_000}" for k in range(180_000)), "x"), (2, "line of words here\n" * 50_000, "x"), (3, own(3), "x")]
    got = [tuple(r) for r in q.quality(frame(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, by_hand(rows)))


def test_no_python_in_the_plan(spark, monkeypatch):
    plans = []
    keep = q.keep
    monkeypatch.setattr(q, "keep", lambda df, tag: plans.append(df) or keep(df, tag))
    plans.append(q.quality(frame(spark, ROWS)))
    text = "".join(p._jdf.queryExecution().toString() for p in plans)
    assert "Python" not in text and "Arrow" not in text
