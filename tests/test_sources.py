import hashlib
import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from plumbline.schemas import JUDGEMENT, QUESTIONS, RESPONSE_RECORD
from plumbline.sources import annotations, logs, sinks, tables
from plumbline.streaming import log as stream
from plumbline.streaming.state import KeyedState

DOCUMENT = {
    "images": [{"id": 1, "file_name": "a.jpg", "width": 320, "height": 240, "agcontext_id": 0, "license": None}, {"id": 2, "file_name": "b.jpg", "width": 320, "height": 240, "agcontext_id": 0}],
    "annotations": [{"id": 10, "image_id": 1, "category_id": 5, "bbox": [1, 2, 3, 4]}, {"id": 11, "image_id": 1, "category_id": 6, "bbox": [5, 6, 7.5, 8]}],
    "categories": [{"id": 5, "name": "weed: chickweed (common)"}, {"id": 6, "name": "crop: maize"}],
    "info": {"anything": 1},
}


@pytest.fixture
def dataset(tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "doc.json").write_text(json.dumps(DOCUMENT, indent=1))
    return tmp_path


def test_annotation_documents(spark, dataset):
    paths = tables.dataset_folders(str(dataset), "doc.json")
    docs = annotations.read_documents(spark, paths)
    assert {(r.dataset, r.image_id) for r in annotations.images(docs).collect()} == {(d, i) for d in ("one", "two") for i in (1, 2)}
    rows = annotations.annotations(docs).where("dataset = 'one'").orderBy("ord").collect()
    assert [(r.role, r.species, r.qualifier, r.x, r.h) for r in rows] == [("weed", "chickweed", "common", 1.0, 4.0), ("crop", "maize", None, 5.0, 8.0)]
    (dataset / "one" / "doc.json").write_text(json.dumps(DOCUMENT | {"categories": DOCUMENT["categories"][:1]}))
    with pytest.raises(Exception, match="no category 6"):
        annotations.annotations(annotations.read_documents(spark, paths)).collect()
    kept, empty = annotations.filter_categories(DOCUMENT, ["crop: maize"])
    assert len(kept["annotations"]) == 1 and empty == 1
    files = spark.createDataFrame([("f1", "a.jpg"), ("f2", "a.jpg"), ("f2", "b.jpg")], "folder string, file_name string")
    got = annotations.resolve_paths(annotations.images(docs), files, ["f1", "f2"]).select("file_name", "path").distinct().collect()
    assert sorted(map(tuple, got)) == [("a.jpg", "f1/a.jpg"), ("b.jpg", "f2/b.jpg")]
    with pytest.raises(ValueError, match="no folder has"):
        annotations.resolve_paths(annotations.images(docs), files.where("file_name = 'a.jpg'"), ["f1"])


def record(q, status, k, **more):
    return json.dumps({"model": "m", "question_id": q, "status": status, "parsed": json.dumps({"answer": k}), "usage": '{"total_tokens": 7}', "created_at": f"2024-01-0{k}"} | more)


def test_log_replay(spark, tmp_path):
    path = tmp_path / "responses.jsonl"
    path.write_text("\n".join([record("q1", "failed", 1), "", record("q1", "ok", 2), record("q2", "ok", 3), record("q2", "failed", 4, error={"kind": "fatal", "message": "no", "http_status": 402}), '{"model": "m", "ques']))
    last = {r.question_id: r for r in logs.responses(spark, str(path)).collect()}
    assert last["q1"].status == "ok" and last["q2"].status == "failed"
    flat = logs.flatten(logs.responses(spark, str(path)), "run")
    row = flat.where("question_id = 'q2'").first()
    assert (row.answer, row.error_kind, row.error_http_status, row.total_tokens) == ("4", "fatal", 402, 7)
    order = spark.createDataFrame([("q2", "m", 0), ("q1", "m", 1), ("q3", "m", 2)], "question_id string, model string, ord int")
    before = flat.where("question_id = 'q1'").withColumn("id", F.lit(5).cast("long"))
    assert [(r.question_id, r.id == 5) for r in logs.consolidate(flat, order, before).collect()] == [("q2", False), ("q1", True)]
    assert logs.tail(spark, str(path), 2)[1] == 5
    judged = tmp_path / "j.jsonl"
    judged.write_text("\n".join(json.dumps({"response_id": 1, "kind": "textual", "status": "ok", "scores": {"x": k}, "judged_at": str(k)}) for k in (1, 2)))
    assert [r.scores for r in logs.judgements(spark, str(judged)).collect()] == [{"x": 2}]
    assert JUDGEMENT and RESPONSE_RECORD


def test_question_tables(spark, tmp_path):
    rows = [("a", "t1", None, 2, "img1"), ("b", "t1", "a", 1, "img1"), ("c", "t2", None, 3, "img2")]
    df = spark.createDataFrame(rows, "id string, task string, ablation_of string, ord int, image_path string")
    images = spark.createDataFrame([("img1", "s1"), ("img2", "s2")], "image_path string, image_sha256 string")
    path = str(tmp_path / "questions")
    for _ in range(2):
        sinks.write_questions(df, images, path)
    got = tables.questions(spark, path, ["t1"])
    assert got.columns == [c.split()[0] for c in QUESTIONS.replace("\n", " ").split(", ")]
    assert [(r.id, r.position, r.image_sha256) for r in got.collect()] == [("b", 0, "s1"), ("a", 1, "s1")]
    assert tables.image_hashes(tables.questions(spark, path)).count() == 2
    sinks.replace_table(sinks.read_table(spark, path).where("task = 't2'"), path)
    assert tables.questions(spark, path).count() == 1 and len(os.listdir(tmp_path)) == 1


def test_small_sources(spark, tmp_path):
    store = tmp_path / "kv.json"
    store.write_text(json.dumps({"x": {"label": "low", "n": 1}, "y": {"label": "skip", "n": 2}}))
    assert sorted(map(tuple, tables.key_values(spark, str(store), "label: string, n: int").collect())) == [("x", "low", 1), ("y", "skip", 2)]
    assert tables.key_values(spark, str(tmp_path / "none.json"), "label: string").count() == 0
    with sqlite3.connect(tmp_path / "db") as db:
        db.execute("create table q (id integer, t text)")
        db.executemany("insert into q values (?, ?)", [(1, "a"), (2, None)])
    assert sorted(map(tuple, tables.sqlite(spark, str(tmp_path / "db"), "select id, t from q", "id long, t string").collect())) == [(1, "a"), (2, None)]
    conf = tmp_path / "c.yaml"
    conf.write_text("a: 1\n")
    assert tables.config(str(conf), {"a": 0, "b": 2}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError, match="unknown"):
        tables.config(str(conf), {"b": 2})
    assert tables.share("1/3") == pytest.approx(1 / 3) and tables.enabled_tasks({"x": {"enabled": False}, "y": {}}) == ["y"]
    conf.write_text("p: {description: d, sources: [s]}\n")
    assert tables.descriptions(spark, str(conf)).first().sources == ["s"]
    html = "<html><title> T </title><script type='application/ld+json'>{\"a\": 1}</script><table><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr><tr><td>x</td></tr></table><dl><dt>k</dt><dd>v</dd></dl>"
    pages = spark.createDataFrame([(1, html), (2, "<script type='application/ld+json'>{bad</script>")], "id int, html string")
    got = {r.id: r for r in tables.page_metadata(pages, "html", "id").collect()}
    assert (got[1].title, got[1].ld, got[1].rows, got[1].cards) == ("T", '{"a": 1}', [["1", "2", "3", "4"]], {"k": "v"}) and "JSONDecodeError" in got[2].error
    asked = tables.from_endpoint(pages, "id", "html", lambda p: (200, "fine") if "title" in p else (503, "busy")).orderBy("id").collect()
    assert [(r.http_status, r.failure) for r in asked] == [(200, None), (503, "transient")]
    sinks.write_csv(spark.createDataFrame([('a "q", b', 1)], "t string, n int"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first().t == 'a "q", b'
    sinks.write_document(str(tmp_path / "run.json"), {"b": 1})
    assert json.loads((tmp_path / "run.json").read_text()) == {"b": 1}


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "model string, question_id string, status string, seq int, ts timestamp"
    line = lambda q, s, n: json.dumps({"model": "m", "question_id": q, "status": s, "seq": n, "ts": f"2024-01-01 00:00:{n:02d}"})
    for k, lines in enumerate([[line("q1", "failed", 1), line("q2", "failed", 2)], [line("q1", "ok", 3), '{"torn'], [line("q3", "failed", 4), line("q4", "failed", 5), line("q5", "failed", 6)]]):
        (folder / f"{k}.jsonl").write_text("\n".join(lines))
        os.utime(folder / f"{k}.jsonl", (1_700_000_000 + k, 1_700_000_000 + k))
    source = stream.read_stream(spark, str(folder), schema)
    stream.upsert(source, str(tmp_path / "state"), ["model", "question_id"], None, str(tmp_path / "cp1")).awaitTermination()
    got = {r.question_id: r.status for r in KeyedState(spark, str(tmp_path / "state"), ["model", "question_id"]).read().collect()}
    assert got == {"q1": "ok", "q2": "failed", "q3": "failed", "q4": "failed", "q5": "failed"}
    trips = stream.breaker(source.withColumn("bad", F.col("status") == "failed"), "model", "bad", 3)
    q = trips.writeStream.format("memory").queryName("trips").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("trips").collect()] == [("m", True, 3)]
    rate = stream.completion_rate(source, "ts", window="10 seconds", slide="5 seconds")
    q = rate.writeStream.format("memory").queryName("rate").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("rate").collect()) == 12


def test_streaks_over_several_parts(spark, tmp_path):
    """A key's micro-batch in Arrow batches of two rows, written out of order."""
    rows = [("m", n, n % 7 != 0) for n in range(1, 40)]
    spark.createDataFrame(rows[::-1], "model string, seq int, bad boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        for threshold, want in ((6, [("m", True, 6)]), (7, [])):
            source = spark.readStream.schema("model string, seq int, bad boolean").parquet(str(tmp_path / "in"))
            q = stream.breaker(source, "model", "bad", threshold).writeStream.format("memory").queryName(f"parts{threshold}").option("checkpointLocation", str(tmp_path / f"parts{threshold}")).trigger(availableNow=True).start()
            q.awaitTermination()
            assert [tuple(r) for r in spark.table(f"parts{threshold}").collect()] == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_snapshots_go_on_after_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    seen = []
    for k in range(2):
        (folder / f"{k}.jsonl").write_text("\n".join(json.dumps({"status": s}) for s in ("ok", "failed", "ok")))
        source = stream.read_stream(spark, str(folder), "status string")
        q = stream.snapshots(source, seen.append, "1 second", str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
    assert seen[0] == {"done": 3, "failed": 1} and seen[-1] == {"done": 6, "failed": 2}


def test_retry_budgets(spark):
    df = spark.createDataFrame([(1, ["transient", "ok"]), (2, ["parse", "parse", "ok"]), (3, ["truncated", "ok"]), (4, ["transient"]), (5, ["transient"] * 4)], "id int, outcomes array<string>")
    got = {r.id: (r.state, r.used) for r in stream.replay_attempts(df, ["id"], 3, 1).collect()}
    assert got == {1: ("ok", 2), 2: ("failed", 2), 3: ("failed", 1), 4: ("open", 1), 5: ("failed", 4)}


def test_reload_on_change(spark, tmp_path):
    folder = tmp_path / "q"
    folder.mkdir()
    (folder / "a.json").write_text('{"id": 1}\n')
    loads = []

    def load():
        loads.append(1)
        text = "".join(f.read_text() for f in sorted(folder.iterdir()))
        return spark.createDataFrame([(json.loads(line)["id"],) for line in text.splitlines()], "id long")

    table = stream.Reloaded(spark, str(folder), load)
    ids = lambda: sorted(r.id for r in table.get().collect())
    assert ids() == [1] and ids() == [1] and len(loads) == 1
    before = spark.createDataFrame(stream.signatures(spark, str(folder)).collect())
    (folder / "b.json").write_text('{"id": 2')
    assert ids() == [1] and isinstance(table.failure, ValueError)
    (folder / "b.json").write_text('{"id": 2}\n')
    assert ids() == [1, 2] and table.failure is None
    (folder / "a.json").unlink()
    changes = stream.changed_files(stream.signatures(spark, str(folder)), before)
    assert sorted((os.path.basename(r.path), r.change) for r in changes.collect()) == [("a.json", "removed"), ("b.json", "added")]
    plan = stream.signatures(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_a_title_keeps_what_is_no_complete_reference():
    from plumbline.sources.pages import metadata

    title = lambda t: metadata(f"<html>\n<p>&amp;\n <title>{t}</title><h1>x</h1>")["title"]
    assert title(" a &amp;&amp;&amp") == "a &&&amp"
    assert title("&quot;b&quot &#65;&#66 &ampc; &copy") == '"b&quot A&#66 &ampc; &copy'
    assert title("c & d &amp;quot;") == "c & d &quot;"
    assert title("") == "" and metadata("<p>&amp")["title"] == "" and metadata("a\n\n<title>e &amp")["title"] == "e &amp"


ODD_PAGES = [(1, "a"), (1, "b"), (1, "b"), (None, "c"), (-3, "d"), (4, None), (None, None), (5, ""), (6, "é\r\n\n"), (2**62, "x" * 100_000)]


def test_file_digests_of_odd_pages(spark, tmp_path):
    """Ids that repeat, are negative or missing, pages without text, and more pages than one task writes or one read lists."""
    import duckdb

    from plumbline import catalog

    rows = ODD_PAGES + [(k, f"page {k}") for k in range(100, 130)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute("SELECT page_id, sha256(html || chr(10)) AS sha256, 'image/png' AS media_type FROM pages").fetchall()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(annotations, "FILES_A_TASK", 2)
        m.setattr(annotations, "TASKS_AT_ONCE", 1)
        got = catalog.queries()["src_08_file_digests"](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("store", ["file", "viewfs"])
def test_a_file_for_each_row_in_few_folders(spark, tmp_path, store):
    """Tasks write next to each other, not in a folder for each row; other stores are written by Spark."""
    from plumbline.store import removed, written_files

    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.t.link./w", f"file://{tmp_path}")
    at = f"file://{tmp_path}/files" if store == "file" else "viewfs://t/w/files"
    rows = [(f"{k}.PNG", f"text {k}") for k in range(40)]
    folders = written_files(spark.createDataFrame(rows, "name string, value string").repartition(4), at)
    assert len(folders) == 4
    if store == "file":
        assert sorted(f.name for f in tmp_path.glob("files/*/*")) == sorted(n for n, _ in rows)
    got = annotations.image_digests(spark, folders).select(F.regexp_extract("path", r"([0-9]+\.PNG)", 1), "image_sha256").collect()
    assert sorted(map(tuple, got)) == sorted((n, hashlib.sha256(f"{v}\n".encode()).hexdigest()) for n, v in rows)
    removed(spark, folders)
    assert not [f for f in tmp_path.rglob("*") if "PNG" in f.name]


def test_few_files_exist_at_a_time(spark, monkeypatch):
    """A single input partition is dealt to several tasks, and what is listed at a time does not grow with the rows."""
    seen = []
    read = annotations.image_digests
    monkeypatch.setattr(annotations, "FILES_A_TASK", 5)
    monkeypatch.setattr(annotations, "TASKS_AT_ONCE", 1)
    monkeypatch.setattr(annotations, "image_digests", lambda s, folders: seen.append(sum(len(os.listdir(f.removeprefix("file://"))) for f in folders)) or read(s, folders))
    for n in (0, 3, 200):
        seen.clear()
        rows = [(f"{k}.PNG", f"text {k}") for k in range(n)]
        got = annotations.digests_of_texts(spark.createDataFrame(rows, "name string, value string").coalesce(1)).collect()
        assert sorted(r.image_sha256 for r in got) == sorted(hashlib.sha256(f"{v}\n".encode()).hexdigest() for _, v in rows)
        assert sum(seen) == n and max(seen, default=0) <= 5 * 8 + 8
