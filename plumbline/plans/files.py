"""Queries that write files or tables, from the views, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import checks
from plumbline.plans.registry import query
from plumbline.sources import annotations, sinks, tables, versions
from plumbline.store import new_path, written_text
from plumbline.streaming.log import breaker, read_stream
from plumbline.streaming.state import KeyedState


@query("src_08_file_digests", "SELECT page_id, sha256(html || chr(10)) AS sha256, 'image/png' AS media_type FROM pages")
def _(v):
    """Every page as a file of its own, and the digests of the files' bytes.  A page without text has no file and no digest."""
    name = F.concat(F.monotonically_increasing_id(), F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(".PNG"))
    found = annotations.digests_of_texts(v.pages.where("html is not null").select(name.alias("name"), F.col("html").alias("value")))
    page = lambda k: F.regexp_extract("path", r"/(?:name=)?([0-9]+-(-?[0-9]*)\.PNG)(?:/[^/]+)?$", k)
    none = v.pages.where("html is null").select("page_id", F.lit(None).cast("string").alias("sha256"), annotations.media_type(F.lit("none.PNG")).alias("media_type"))
    return found.select(F.nullif(page(2), F.lit("")).cast("long").alias("page_id"), F.col("image_sha256").alias("sha256"), annotations.media_type(page(1)).alias("media_type")).unionAll(none)


@query("snk_01_question_table", "SELECT question_id::VARCHAR AS id, task, row_number() OVER (PARTITION BY task ORDER BY question_id) - 1 AS position, sha256(image_path) AS image_sha256 FROM questions")
def _(v):
    """The question table written with checks, positions and digests, replaced once, and read back whole."""
    q = v.questions.select(F.col("question_id").cast("string").alias("id"), "task", "question_type", "image_path", F.col("ablation_of").cast("string").alias("ablation_of"), F.col("question_id").alias("ord"))
    images = v.questions.select("image_path", F.sha2("image_path", 256).alias("image_sha256")).distinct()
    path = new_path(q)
    for rows in (q.where("task = 'species'"), q):
        sinks.write_questions(rows, images, path)
    got = tables.questions(v.spark, path)
    checks.same_counts(got, v.questions, "questions written and read")
    return got.select("id", "task", "position", "image_sha256")


@query("snk_03_replaced_table", "SELECT id, model, status, CASE WHEN model = 'm1' THEN 'late' ELSE 'first' END AS written FROM responses WHERE model <> 'm2'")
def _(v):
    """A table that is replaced by what is read from it, twice."""
    path = new_path(v.responses)
    versions.replace_table(v.responses.select("id", "model", "status", F.lit("first").alias("written")), path)
    versions.replace_table(versions.read_table(v.spark, path).where("model <> 'm2'"), path)
    versions.replace_table(versions.read_table(v.spark, path).withColumn("written", F.when(F.col("model") == "m1", "late").otherwise(F.col("written"))), path)
    return versions.read_table(v.spark, path)


@query("stm_01_base_and_deltas", "SELECT run, model, question_id, max(id) AS id FROM responses GROUP BY ALL")
def _(v):
    """The log in four micro-batches, out of order, the second compacted with the first and one of them sent twice."""
    state = KeyedState(v.spark, new_path(v.responses), ["run", "model", "question_id"], "id")
    batch = lambda k: v.responses.where(F.col("id") % 4 == k).select("run", "model", "question_id", "id", "status")
    for epoch, part in enumerate((2, 0, 3, 1)):
        state.apply(batch(part), epoch)
        if epoch == 1:
            state.compact(everything=True)
    state.apply(batch(3), 2)
    return state.read().select("run", "model", "question_id", "id")


@query("stm_05_stream_breaker", "SELECT user_id, count(*) AS n FROM (SELECT user_id, min(event_id) AS n0 FROM (SELECT user_id, event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, island ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS streak FROM (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)) WHERE streak >= 3 GROUP BY user_id) GROUP BY user_id")
def _(v):
    """The events as a stream of files: each user's first streak of three failures trips the breaker once."""
    fields = F.struct(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("user_id"), (F.col("event_type") == "error").alias("bad"))
    lines = written_text(v.events.select(F.to_json(fields).alias("value")))
    folder = lines.inputFiles()[0].rsplit("/", 1)[0]
    stream = read_stream(v.spark, folder, "seq long, user_id string, bad boolean", files=1000)
    out, checkpoint = new_path(lines), new_path(lines)
    query_ = breaker(stream, "user_id", "bad", 3).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query_.awaitTermination()
    return v.spark.read.schema("user_id string, tripped boolean, streak int").parquet(out).groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.count("*").alias("n"))
