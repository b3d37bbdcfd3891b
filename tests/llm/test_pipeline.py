import brute

import corpus_pipeline as pipeline


def test_stages_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(400)
    rows = {r.doc_id: r for r in docs.collect()}
    benchmark = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def step(k, frame, before):
        out = pipeline.STAGES[k][1](spark, spark.createDataFrame(list(before.values()), docs.schema), folder)
        return {r.doc_id: r for r in out.collect()}

    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "decontaminated", "mixed"]
    first = step(0, None, rows)
    assert set(first) == {i for i, r in rows.items() if any(c.isalpha() for c in r.text)}
    second = step(1, None, first)
    groups = brute.near_duplicates([(i, r.text) for i, r in first.items()])
    assert set(second) == {i for i, (_, c) in groups.items() if c == i}
    third = step(2, None, second)
    want = dict(zip(second, brute.without_repeated([r.text for r in second.values()])))
    assert {i: r.text for i, r in third.items()} == {i: t for i, t in want.items() if t.strip()}
    assert all(r.n_chars == len(r.text) for r in third.values())
    fourth = step(3, None, third)
    dirty = {d for d, _ in brute.contaminated([(i, r.text) for i, r in third.items()], benchmark)}
    assert dirty and set(fourth) == set(third) - dirty
    last = step(4, None, fourth)
    assert {i: r["size"] for i, r in last.items()} == {i: len(brute.words(r.text)) for i, r in fourth.items()}


def test_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "the words", "en", None, 9), (4, "some words", "en", "a", 10), (4, "some words", "en", "a", 10), (5, "x" * 900, "en", "b", 900)]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, spark.createDataFrame(rows, schema), "/root/testdata/sf0.001")
        assert out.columns == [c.split()[0] for c in schema.split(", ")], name
        assert stage(spark, spark.createDataFrame([], schema), "/root/testdata/sf0.001").count() == 0
        kept = [tuple(r) for r in out.collect()]
        assert (None, "the words", "en", None, 9) in kept
    last = pipeline.STAGES[-1][1](spark, spark.createDataFrame(rows, schema), "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in last) == [(False, 1, 0), (False, 2, 0), (False, 4, 2), (False, 4, 2), (False, 5, 1), (True, 0, 2)]
    assert pipeline.STAGES[-1][1](spark, spark.createDataFrame([], schema), "/root/testdata/sf0.001").count() == 0


def test_repeated_rows_and_null_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = "/root/testdata/sf0.001"
    row = lambda i, t: (i, t, "en", "a", len(t))
    one, two, three, four = (" ".join(f"{w}{k}" for k in range(120)) for w in ("alpha", "beta", "gamma", "delta"))
    item = next(r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if len(r.text.split()) > 5)
    dirty = f"{item} " + " ".join(f"tail{k}" for k in range(120))
    rows = [row(7, one), row(7, one), row(None, one), row(None, two), row(None, two), row(9, three), row(8, three + " more"), row(8, four), row(5, dirty), row(5, "clean words of an id that stands twice"), row(None, dirty + " again and again")]
    docs = spark.createDataFrame(rows, schema)
    stages = dict(pipeline.STAGES)
    texts = lambda frame: sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)

    left = stages["near_duplicates"](spark, docs, folder)
    want = [(7, one), (None, two), (8, three + " more"), (8, four), (5, dirty), (5, rows[9][1])]
    assert texts(left) == sorted(want, key=str)
    left = stages["repeated_passages"](spark, left, folder)
    assert texts(left) == sorted(want, key=str)
    assert texts(stages["decontaminated"](spark, left, folder)) == sorted([w for w in want if w[1] != dirty], key=str)
    clean = [r for r in rows if not r[1].startswith(dirty)]
    assert texts(stages["decontaminated"](spark, docs, folder)) == sorted([r[:2] for r in clean], key=str)
