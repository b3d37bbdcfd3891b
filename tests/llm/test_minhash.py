import brute
import pytest

from plumbline.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string, key string, cls string"


def run(spark, rows):
    got = near_duplicates(spark.createDataFrame([(i, t, "k", "c") for i, t in rows], SCHEMA)).collect()
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got)


def test_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = brute.near_duplicates(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_chain_and_edge_cases(spark):
    base = [f"w{i}" for i in range(60)]
    chain = [(10 + k, " ".join(base[2 * k : 2 * k + 40])) for k in range(8)]  # neighbours are similar, ends are not
    rows = chain + [(1, None), (2, ""), (3, " \n\t"), (4, "Only three Words"), (5, "only\tthree words"), (6, "one"), (7, "x " * 3000)]
    want = brute.near_duplicates(rows)
    assert len({want[10 + k][1] for k in range(8)}) == 1
    got = run(spark, rows)
    assert {i: (n, c) for _, i, n, c, _ in got} == want


def test_repeated_rows_null_ids_and_empty(spark):
    got = run(spark, [(3, "a b c d e f g"), (3, "a b c d e f g"), (9, "a b c d e f g"), (None, "a b c d e f g"), (3, "totally other words in here now")])
    assert [(i, c, k) for null, i, n, c, k in got if not null] == [(3, 3, True), (3, 3, True), (3, 3, True), (9, 3, False)]
    assert [(c, k) for null, i, n, c, k in got if null] == [(None, True)]
    assert run(spark, []) == []


@pytest.mark.parametrize("changes", [0, 1])
def test_large_group(spark, changes):
    base = [f"v{i}" for i in range(80)]
    rows = [(i, " ".join(base[:40] + [f"n{i}"] * changes + base[40:])) for i in range(300)]
    assert {c for *_, c, _ in run(spark, rows)} == {0}
