import hashlib
import zlib
from itertools import groupby

import pytest

from plumbline.llm.manifest import digest, folded, manifest, proof_digest, tamper_check

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, grp string, path string, idx int"


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(leaves, fanout=8):
    """(top, for each leaf the (left, right) siblings of every level)"""
    level, paths = [(x, [k]) for k, x in enumerate(leaves)], [[] for _ in leaves]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), fanout):
            run = level[at : at + fanout]
            for k, (_, members) in enumerate(run):
                for m in members:
                    paths[m].append(("".join(x for x, _ in run[:k]), "".join(x for x, _ in run[k + 1 :])))
            above.append((h(*[x for x, _ in run]), [m for _, members in run for m in members]))
        level = above
    return level[0][0], paths


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def by_hand(rows):
    """rows: (doc_id, text, lang, source, n_chars) -> the manifest's rows"""
    made = [(lang, i, leaf(i, s, lang, n, t), leaf(i, s, lang, n, lower(t) if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else t)) for i, t, lang, s, n in rows]
    made.sort(key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
    groups = [list(g) for _, g in groupby(made, key=lambda r: r[0])]
    below = [tree([r[2] for r in g]) for g in groups]
    root, above = tree([top for top, _ in below])
    out = []
    for g, (subroot, paths), rest in zip(groups, below, above):
        for (_, i, own, other), path in zip(g, paths):
            node = other
            for left, right in path + rest:
                node = h(left, node, right)
            out.append((i, own, subroot, root, h(*[a + b for a, b in path + rest]), node, node == root))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA)


def checked(spark, rows):
    got = [tuple(r) for r in tamper_check(frame(spark, rows)).collect()]
    want = by_hand(rows) if rows else []
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got


LANGS = ["de", "en", "é", None, "", "EN", "a", "b", "c", "d"]
MANY = [(i, f"Text Number {i}" if i % 5 else "lower only", LANGS[(i * i) % 10 if i % 3 else 1], f"s{i % 4}", i % 7) for i in range(-20, 300)]
ODD = [(None, "A", "de", None, None), (None, "B", "de", None, None), (5, None, "de", "s", None), (5, "", "de", "s", 0), (7, "Same", "de", "s", 4), (7, "Same", "de", "s", 4), (9, "Lone", "xx", "s", 4)]


@pytest.mark.parametrize("rows", [[], MANY[:1], [(i, "T", "en", "s", 1) for i in range(65)], MANY + ODD], ids=len)
def test_against_hand(spark, rows):
    got = checked(spark, rows)
    for i, *_, verified in got:
        assert i is None or zlib.crc32(str(i).encode()) % 3 == 0 or verified


def test_tampering_is_seen_in_any_order_of_rows(spark):
    got = {r.doc_id: r.verified for r in tamper_check(frame(spark, MANY[::-1]).repartition(7)).collect()}
    assert got == {r[0]: r[-1] for r in by_hand(MANY)}
    assert all(got[i] == (zlib.crc32(str(i).encode()) % 3 != 0 or t == "lower only") for i, t, *_ in MANY)


def test_other_fanout_and_parts(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, MANY)
    rows = manifest(docs, parts=("doc_id", "text"), group="source", fanout=3)
    rows = rows.select("doc_id", "leaf", "root", proof_digest(F.col("path")).alias("p"), folded(F.col("leaf"), F.col("path")).alias("f")).collect()
    assert len(rows) == len(MANY) and len({r.root for r in rows}) == 1 and all(r.f == r.root for r in rows)
    own = {r[0]: r[1] for r in docs.select("doc_id", digest([F.col("doc_id"), F.col("text")])).collect()}
    assert all(own[r.doc_id] == r.leaf for r in rows)


def test_a_long_text(spark):
    text = "Aé " * 1_500_000
    checked(spark, [(3, text, "en", "s", 1), (4, "x", "en", "s", 1)])
