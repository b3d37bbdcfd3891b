"""Joins, aggregates, windows, set operations and reshaping on the views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import aggregates as agg
from plumbline.operators import classify as cas
from plumbline.operators import joins, reshape, windows
from plumbline.plans.registry import query
from plumbline.plans.views import Views

ANSWERS = ["click", "purchase", "signup", "view"]
MODELS = ["m0", "m1", "m2", "m3", "m4"]


def r(expression: str, name: str) -> str:
    return f"round({expression}, 9) + 0.0 AS {name}"


LATEST = "(SELECT * FROM responses QUALIFY row_number() OVER (PARTITION BY model, question_id ORDER BY created_at DESC, id DESC) = 1)"


def latest(v: Views) -> DataFrame:
    return windows.latest(v.responses, ["model", "question_id"], ["created_at", "id"])


# -- joins


@query("join_01_responses_with_questions", "SELECT r.question_id, r.id, r.answer, q.expected_answer, q.dataset FROM responses r JOIN questions q USING (question_id)")
def _(v):
    return joins.attach(v.responses, v.questions, ["question_id"]).select("question_id", "id", "answer", "expected_answer", "dataset")


@query("join_02_scores_by_id", "SELECT r.id, s.outcome FROM responses r LEFT JOIN (SELECT id, outcome FROM scored WHERE status = 'ok') s USING (id)")
def _(v):
    return joins.attach(v.responses.select("id"), v.scored.where("status = 'ok'").select("id", "outcome"), ["id"], how="left")


@query("join_03_composite_key", "SELECT r.id, r.run, r.question_id, s.correct FROM responses r LEFT JOIN (SELECT id, run, question_id, correct FROM scored WHERE id % 2 = 0) s ON s.id = r.id AND s.run = r.run AND s.question_id = r.question_id")
def _(v):
    return v.responses.select("id", "run", "question_id").join(v.scored.where("id % 2 = 0").select("id", "run", "question_id", "correct"), ["id", "run", "question_id"], "left")


@query("join_04_references", "SELECT doc_id AS id, 'missing' AS problem FROM labels WHERE doc_id NOT IN (SELECT id FROM responses) UNION ALL SELECT l.doc_id, 'mismatch' FROM labels l JOIN responses r ON r.id = l.doc_id WHERE r.question_id <> l.doc_id % 300")
def _(v):
    found = v.labels.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 300).alias("question_id"))
    return joins.missing(found, v.responses, ["id"]).select("id", F.lit("missing").alias("problem")).unionByName(joins.mismatches(found, v.responses.select("id", "question_id"), ["id"], ["question_id"]).select("id", F.lit("mismatch").alias("problem")))


@query("join_05_one_judge_row", "SELECT r.id, j.interpretation1::BIGINT AS interpretation1 FROM responses r LEFT JOIN judges j ON j.response_id = r.id")
def _(v):
    return joins.attach_one(v.responses.select("id"), v.judges.select(F.col("response_id").alias("id"), "interpretation1"), ["id"])


@query("join_06_dimension", "SELECT l.l_orderkey, l.l_linenumber::BIGINT AS l_linenumber, l.l_partkey, l.l_suppkey, p.p_type FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey")
def _(v):
    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(v.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")


@query("join_07_images_without_boxes", "SELECT i.image_id, count(a.ord) AS n FROM images i LEFT JOIN annotations a ON a.image_id = i.image_id GROUP BY i.image_id")
def _(v):
    return v.images.join(v.annotations.select("image_id", "ord"), "image_id", "left").groupBy("image_id").agg(F.count("ord").alias("n"))


@query("join_08_excluded_species", "WITH kept AS (SELECT * FROM annotations WHERE species NOT IN ('promo', 'small')) SELECT (SELECT count(*) FROM kept) AS n_kept, (SELECT count(*) FROM images WHERE image_id NOT IN (SELECT image_id FROM kept)) AS n_empty")
def _(v):
    gone = v.spark.createDataFrame([("promo",), ("small",)], "species string")
    kept, empty = joins.exclude(v.annotations, gone, ["species"], v.images, ["image_id"])
    return kept.agg(F.count("*").alias("n_kept")).crossJoin(empty.agg(F.count("*").alias("n_empty")))


@query("join_09_same_images", "SELECT dataset, image_id FROM images WHERE (dataset, image_id) IN (SELECT dataset, image_id FROM annotations WHERE role = 'crop')")
def _(v):
    return joins.restrict(v.images, v.annotations.where("role = 'crop'"), ["dataset", "image_id"]).select("dataset", "image_id")


@query("join_10_kept_ids", "SELECT question_id, task FROM questions WHERE question_id IN (SELECT question_id FROM responses WHERE tokens > 1500)")
def _(v):
    return joins.restrict(v.questions, v.responses.where("tokens > 1500"), ["question_id"]).orderBy("question_id").select("question_id", "task")


@query("join_11_pending_jobs", f"SELECT q.question_id, m.model FROM questions q CROSS JOIN (SELECT DISTINCT model FROM responses) m WHERE NOT EXISTS (SELECT 1 FROM {LATEST} d WHERE d.status = 'ok' AND d.model = m.model AND d.question_id = q.question_id)")
def _(v):
    return joins.pending(v.questions.select("question_id"), v.responses.select("model"), latest(v).where("status = 'ok'"))


@query("join_12_current_images", "SELECT q.question_id FROM questions q JOIN (SELECT image_path, min(question_id) AS first FROM questions GROUP BY image_path) i ON i.image_path = q.image_path WHERE q.question_id % 3 = i.first % 3")
def _(v):
    images = v.questions.groupBy("image_path").agg((F.min("question_id") % 3).alias("image_sha256"))
    return joins.current(v.questions.withColumn("image_sha256", F.col("question_id") % 3), images).select("question_id")


@query("join_13_same_species_pairs", "SELECT a.image_id, a.species, count(*) AS n, sum(a.ord * 100 + b.ord)::BIGINT AS checksum FROM annotations a JOIN annotations b ON a.image_id = b.image_id AND a.species = b.species AND a.ord < b.ord GROUP BY ALL")
def _(v):
    pairs = joins.pairs_within(v.annotations, ["image_id", "species"], "ord", ["ord"])
    return pairs.groupBy("image_id", "species").agg(F.count("*").alias("n"), F.sum(F.col("ord_a") * 100 + F.col("ord_b")).alias("checksum"))


@query("join_14_cross_species_pairs", "SELECT a.image_id, a.species AS species_a, b.species AS species_b, count(*) AS n FROM annotations a JOIN annotations b ON a.image_id = b.image_id AND a.species < b.species GROUP BY ALL")
def _(v):
    return joins.pairs_across(v.annotations, ["image_id"], "species", ["species", "ord"]).groupBy("image_id", "species_a", "species_b").agg(F.count("*").alias("n"))


PAIRED = f"(SELECT o.model, q.question_id, q.annotated, o.answer = q.expected_answer AS open_ok, c.answer = p.expected_answer AS choice_ok FROM {LATEST} o JOIN questions q USING (question_id) JOIN {LATEST} c ON c.model = o.model AND c.question_id = q.ablation_of JOIN questions p ON p.question_id = c.question_id WHERE o.status = 'ok' AND c.status = 'ok')"


def paired(v: Views) -> DataFrame:
    q = v.questions.select("question_id", "annotated", "ablation_of", "expected_answer")
    last = latest(v).where("status = 'ok'").join(q, "question_id").withColumn("ok", F.col("answer") == F.col("expected_answer"))
    both = joins.with_original(last.select("model", "question_id", "annotated", "ablation_of", "ok"), "question_id", "ablation_of", ["model"], ["ok"])
    return both.select("model", "question_id", "annotated", F.col("ok").alias("open_ok"), F.col("ok_original").alias("choice_ok"))


@query("join_15_variant_and_original", f"SELECT model, question_id, annotated, open_ok, choice_ok FROM {PAIRED}")
def _(v):
    return paired(v)


@query("join_17_summaries", "SELECT coalesce(a.question_id, b.question_id) AS question_id, a.question_id IS NOT NULL AS in_left, b.question_id IS NOT NULL AS in_right FROM (SELECT DISTINCT question_id FROM responses WHERE tokens > 900) a FULL JOIN (SELECT question_id FROM questions WHERE question_id % 3 = 0) b ON a.question_id = b.question_id")
def _(v):
    return joins.union_of_keys(v.responses.where("tokens > 900").select("question_id").distinct(), v.questions.where("question_id % 3 = 0").select("question_id"), ["question_id"])


@query("join_18_fresh_scores", f"SELECT l.id, CASE WHEN s.created_at = l.created_at THEN s.correct END AS correct, coalesce(s.created_at <> l.created_at, false) AS stale FROM {LATEST} l LEFT JOIN (SELECT model, question_id, correct, created_at FROM scored QUALIFY row_number() OVER (PARTITION BY model, question_id ORDER BY id) = 1) s ON s.model = l.model AND s.question_id = l.question_id")
def _(v):
    scores = windows.earliest(v.scored.select("model", "question_id", "correct", "created_at", "id"), ["model", "question_id"], ["id"]).drop("id")
    return joins.fresh_scores(latest(v).select("model", "question_id", "id", "created_at"), scores, ["model", "question_id"]).select("id", "correct", "stale")


@query("join_19_failed_added", "SELECT id, status FROM scored WHERE status = 'ok' UNION ALL SELECT id, status FROM responses WHERE status = 'failed' AND id NOT IN (SELECT id FROM scored WHERE status = 'ok')")
def _(v):
    done = v.scored.where("status = 'ok'").select("id", "status")
    return done.unionByName(joins.missing(v.responses.where("status = 'failed'").select("id", "status"), done, ["id"]))


@query("join_20_labelled", "SELECT d.doc_id, l.quality::BIGINT AS quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IN (0, 1) AND d.lang = 'en'")
def _(v):
    return v.documents.where("lang = 'en'").select("doc_id").join(v.labels.where("quality in (0, 1)").select("doc_id", "quality"), "doc_id")


@query("join_21_described", "SELECT p_partkey, lower(p_type) || ' goods' AS description FROM part")
def _(v):
    known = v.spark.createDataFrame([(f" {t.lower()} ", f"{t.lower()} goods") for t in ("ECONOMY", "LARGE", "STANDARD", "MEDIUM", "PROMO", "SMALL")], "species string, description string")
    return joins.text_lookup(v.part, "p_type", known, "species", "description").select("p_partkey", "description")


@query("join_22_two_rates", f"SELECT a.expected_answer, {r('a.x', 'choice')}, {r('b.x', 'open')} FROM (SELECT expected_answer, avg(correct::INT) AS x FROM scored WHERE question_type = 'multiple_choice' GROUP BY 1) a JOIN (SELECT expected_answer, avg(correct::INT) AS x FROM scored WHERE question_type = 'open_ended' GROUP BY 1) b USING (expected_answer)")
def _(v):
    side = lambda kind, name: agg.rate(v.scored.where(F.col("question_type") == kind), ["expected_answer"], F.col("correct"), name)
    return side("multiple_choice", "choice").join(side("open_ended", "open"), "expected_answer")


@query("join_23_three_tables", "SELECT r.id, q.image_path, i.width::BIGINT AS width FROM responses r JOIN questions q USING (question_id) JOIN images i ON i.image_id = q.question_id")
def _(v):
    sql = "SELECT r.id, q.image_path, i.width FROM {r} r JOIN {q} q USING (question_id) JOIN {i} i ON i.image_id = q.question_id"
    return v.spark.sql(sql, r=v.responses, q=v.questions, i=v.images)


@query("join_24_first_known_path", "SELECT q.question_id, coalesce(i.file_name, q.image_path) AS path FROM questions q LEFT JOIN (SELECT image_id, file_name FROM images WHERE image_id % 2 = 0) i ON i.image_id = q.question_id")
def _(v):
    own = v.images.where("image_id % 2 = 0").select(F.col("image_id").alias("question_id"), "file_name")
    return joins.first_known(v.questions.select("question_id"), [(own, "file_name"), (v.questions, "image_path")], ["question_id"], "path")


# -- aggregates


@query("agg_01_accuracy", f"SELECT run, model, question_type, {r('avg(correct::INT)', 'accuracy')} FROM scored GROUP BY ALL")
def _(v):
    return agg.rate(v.scored, ["run", "model", "question_type"], F.col("correct"), "accuracy")


@query("agg_02_global_ratio", f"SELECT {r('sum(correct::INT) / count(correct)', 'accuracy')} FROM scored")
def _(v):
    return v.scored.agg((F.sum(F.col("correct").cast("int")) / F.count("correct")).alias("accuracy"))


@query("agg_03_mae_and_bias", f"SELECT model, {r('avg(abs(est_count - true_count))', 'mae')}, {r('avg(est_count - true_count)', 'bias')} FROM scored GROUP BY model")
def _(v):
    return agg.error_stats(v.scored, ["model"], F.col("est_count") - F.col("true_count")).select("model", F.col("mean_absolute").alias("mae"), "bias")


@query("agg_04_means", f"SELECT model, {r('avg(latency)', 'latency')}, {r('avg(tokens)', 'tokens')}, {r('avg(cost)', 'cost')} FROM responses GROUP BY model")
def _(v):
    return agg.means(v.responses, ["model"], ["latency", "tokens", "cost"])


@query("agg_05_mean_ratio", f"SELECT model, {r('avg(tokens / latency)', 'tokens_per_second')} FROM responses WHERE latency > 0 GROUP BY model")
def _(v):
    return agg.ratio_mean(v.responses, ["model"], F.col("tokens"), F.col("latency"), "tokens_per_second")


@query("agg_06_distinct_with_null", "SELECT run, count(*) AS n, count(DISTINCT answer) + max((answer IS NULL)::INT) AS n_answers FROM responses GROUP BY run")
def _(v):
    return agg.distinct_with_null(v.responses, ["run"], "answer", "n_answers").join(v.responses.groupBy("run").agg(F.count("*").alias("n")), "run")


@query("agg_07_relative_mae", f"SELECT model, {r('avg(abs(est_count - true_count)) / avg(true_count)', 'relative_mae')} FROM scored WHERE est_count IS NOT NULL GROUP BY model")
def _(v):
    rows = v.scored.where("est_count is not null")
    return rows.groupBy("model").agg(F.avg(F.abs(F.col("est_count") - F.col("true_count"))).alias("mae"), F.avg("true_count").alias("truth")).select("model", (F.col("mae") / F.col("truth")).alias("relative_mae"))


FLAGS = "CASE WHEN len(f) = 0 THEN ['unsure'] ELSE f END"
FLAGGED = """(SELECT *, CASE WHEN len(f1) = 0 THEN ['unsure'] ELSE f1 END AS flags1, CASE WHEN len(f2) = 0 THEN ['unsure'] ELSE f2 END AS flags2 FROM (SELECT *,
  list_filter([CASE WHEN visual1 <= 2 THEN 'perception' END, CASE WHEN knowledge1 <= 2 THEN 'knowledge' END, CASE WHEN interpretation1 <= 2 AND knowledge1 >= 3 THEN 'evaluation' END], lambda x: x IS NOT NULL) AS f1,
  list_filter([CASE WHEN visual2 <= 2 THEN 'perception' END, CASE WHEN knowledge2 <= 2 THEN 'knowledge' END, CASE WHEN interpretation2 <= 2 AND knowledge2 >= 3 THEN 'evaluation' END], lambda x: x IS NOT NULL) AS f2 FROM judges))"""


def flagged(v: Views) -> DataFrame:
    flags = lambda k: cas.error_flags(*[F.col(f"{c}{k}") for c in ("interpretation", "knowledge", "visual")])
    return v.judges.withColumns({"flags1": flags(1), "flags2": flags(2)})


@query("agg_08_list_value_counts", f"SELECT array_to_string(flags1, '+') AS flags, count(*) AS n, {r('count(*) / (SELECT count(*) FROM judges)', 'share')} FROM {FLAGGED} GROUP BY flags1")
def _(v):
    return agg.value_counts(flagged(v), ["flags1"], "share").select(F.array_join("flags1", "+").alias("flags"), "n", "share")


@query("agg_09_unsure_rate", f"SELECT model, {r('avg((outcome = $$unsure$$)::INT)', 'unsure_rate')} FROM scored GROUP BY model")
def _(v):
    return agg.rate(v.scored, ["model"], F.col("outcome") == "unsure", "unsure_rate")


Z = 1.96


def wilson_sql(k: str, n: str, sign: str) -> str:
    p = f"({k} / {n}::DOUBLE)"
    e = f"(({p} + {Z * Z / 2} / {n}) {sign} {Z} * sqrt({p} * (1 - {p}) / {n} + {Z * Z / 4} / ({n}::DOUBLE * {n}))) / (1 + {Z * Z} / {n})"
    return f"CASE WHEN {n} > 0 THEN {'greatest(0.0' if sign == '-' else 'least(1.0'}, {e}) END"


BLOCK = f"""count(*) AS n_total, count_if(status = 'ok') AS n_answered, count_if(status <> 'ok') AS n_failed, count_if(outcome = 'correct') AS correct, count_if(outcome = 'incorrect') AS incorrect,
  count_if(outcome = 'unsure') AS unsure, count_if(outcome = 'invalid') AS invalid, {r("count_if(outcome = 'correct') / count_if(status = 'ok')", 'accuracy')}, {r("count_if(outcome = 'correct') / count(*)", 'accuracy_all')},
  {r("count_if(outcome = 'unsure') / count_if(status = 'ok')", 'unsure_rate')}, {r(wilson_sql("count_if(outcome = 'correct')", "count_if(status = 'ok')", '-'), 'lo')}, {r(wilson_sql("count_if(outcome = 'correct')", "count_if(status = 'ok')", '+'), 'hi')}"""


@query("agg_10_accuracy_block", f"SELECT model, question_type, {BLOCK} FROM scored GROUP BY model, question_type")
def _(v):
    return agg.accuracy_block(v.scored, ["model", "question_type"], F.col("status") == "ok", F.col("outcome"))


@query("agg_11_breakdown", f"""WITH ok AS (SELECT model, expected_answer, dataset, (outcome = 'correct')::INT AS hit FROM scored WHERE status = 'ok')
SELECT model, 'expected_answer' AS by, expected_answer AS value, count(*) AS n, {r('avg(hit)', 'accuracy')} FROM ok GROUP BY model, expected_answer UNION ALL
SELECT model, 'dataset', dataset, count(*), round(avg(hit), 9) FROM ok GROUP BY model, dataset UNION ALL SELECT model, 'all', NULL, count(*), round(avg(hit), 9) FROM ok GROUP BY model""")
def _(v):
    return agg.breakdown(v.scored, ["model"], ["expected_answer", "dataset"], F.col("status") == "ok", F.col("outcome"))


@query("agg_12_error_stats", f"SELECT model, count(est_count) AS n, {r('avg(abs(est_count - true_count))', 'mean_absolute')}, {r('median(abs(est_count - true_count))', 'median_absolute')}, {r('avg(est_count - true_count)', 'bias')} FROM scored GROUP BY model")
def _(v):
    return agg.error_stats(v.scored, ["model"], F.col("est_count") - F.col("true_count"))


@query("agg_13_confusion", "SELECT m.model, c.expected_answer, " + ", ".join(f"count_if(s.answer = '{a}') AS {a}" for a in ANSWERS) + f" FROM (SELECT DISTINCT model FROM scored) m CROSS JOIN (SELECT unnest({ANSWERS}) AS expected_answer) c LEFT JOIN scored s ON s.model = m.model AND s.expected_answer = c.expected_answer GROUP BY 1, 2")
def _(v):
    return agg.confusion(v.scored, ["model"], "expected_answer", "answer", ANSWERS)


@query("agg_14_localisation_block", f"""SELECT model, count(matched_iou) AS n_scored, count_if(status = 'ok' AND matched_iou IS NULL) AS n_invalid, {r('avg(matched_iou)', 'mean_score')}, {r('median(matched_iou)', 'median_score')},
 {r('sum(matched_iou) / count(*)', 'mean_score_all')}, {r('avg(matched_iou)', 'mean_iou')}, {r('avg((est_count = true_count)::INT)', 'count_exact_rate')}, {r('avg(abs(est_count - true_count))', 'count_mae')}, {r('avg(est_count - true_count)', 'count_bias')} FROM scored GROUP BY model""")
def _(v):
    iou = F.col("matched_iou").cast("double")
    return agg.localisation_block(v.scored, ["model"], iou, iou, F.col("est_count") - F.col("true_count"), F.col("status") == "ok")


@query("agg_15_macro_f1", f"""WITH t AS (SELECT model, expected_answer AS c, count(*) AS t, count_if(answer = expected_answer) AS tp FROM scored WHERE status = 'ok' GROUP BY ALL), g AS (SELECT model, answer AS c, count(*) AS g FROM scored WHERE status = 'ok' GROUP BY ALL)
SELECT t.model, {r('avg(2.0 * tp / (t + coalesce(g, 0)))', 'macro_f1')}, count(*) AS n_classes FROM t LEFT JOIN g ON g.model = t.model AND g.c = t.c GROUP BY t.model""")
def _(v):
    return agg.macro_f1(v.scored.where("status = 'ok'"), ["model"], "expected_answer", "answer")


@query("agg_16_usage_block", f"SELECT model, count(*) AS requests, count_if(status = 'failed') AS failed, {r('sum(cost)', 'total_cost')}, {r('avg(cost)', 'mean_cost')}, {r('avg(tokens)', 'mean_tokens')}, {r('avg(latency) FILTER (status = $$ok$$)', 'mean_latency')}, count_if(retries > 0) AS retried FROM responses GROUP BY model")
def _(v):
    return agg.usage_block(v.responses, ["model"], F.col("status") == "failed", F.col("cost"), F.col("tokens"), F.col("latency"), F.col("retries"))


@query("agg_17_paired_accuracy", f"SELECT model, annotated, count(*) AS n, {r('avg(choice_ok::INT)', 'choice')}, {r('avg(open_ok::INT)', 'open')} FROM {PAIRED} GROUP BY ALL")
def _(v):
    return paired(v).groupBy("model", "annotated").agg(F.count("*").alias("n"), F.avg(F.col("choice_ok").cast("int")).alias("choice"), F.avg(F.col("open_ok").cast("int")).alias("open"))


@query("agg_18_agreement_counts", f"SELECT model, CASE WHEN open_ok IS NULL OR choice_ok IS NULL THEN 'incomplete' WHEN open_ok AND choice_ok THEN 'both' WHEN choice_ok THEN 'choice_only' WHEN open_ok THEN 'open_only' ELSE 'neither' END AS category, count(*) AS n FROM {PAIRED} GROUP BY ALL")
def _(v):
    return agg.value_counts(paired(v).select("model", cas.pair_agreement(F.col("choice_ok"), F.col("open_ok")).alias("category")), ["model", "category"])


@query("agg_19_problem_groups", r"SELECT model, error_kind AS kind, trim(regexp_replace(regexp_replace(error_message, '\s*\(retry in [^)]*\)', '', 'g'), '\s+', ' ', 'g')) AS message, count(*) AS n, min(retries) AS code FROM responses WHERE status = 'failed' GROUP BY ALL")
def _(v):
    from plumbline.functions.text import tidy_message

    problem = F.struct(F.col("error_kind").alias("kind"), tidy_message(F.col("error_message")).alias("message"), F.col("retries").alias("code"))
    return agg.problem_groups(v.responses, ["model"], F.when(F.col("status") == "failed", F.array(problem)))


@query("agg_20_failure_stats", f"SELECT model, count(*) AS n, count_if(status = 'failed') AS failed, {r('avg((status = $$failed$$)::INT)', 'failure_rate')}, count_if(status = 'ok' AND retries > 0) AS recovered FROM responses GROUP BY model")
def _(v):
    failed = F.col("status") == "failed"
    return v.responses.groupBy("model").agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"), F.avg(failed.cast("int")).alias("failure_rate"), F.count_if(~failed & (F.col("retries") > 0)).alias("recovered"))


@query("agg_21_run_summary", f"SELECT run, array_to_string(list_sort(list(DISTINCT model)), ',') AS models, count_if(status = 'ok') AS answered, count_if(status = 'failed') AS failed, {r('sum(cost)', 'cost')}, epoch_us(max(created_at)) AS updated FROM responses GROUP BY run")
def _(v):
    return v.responses.groupBy("run").agg(F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), F.count_if(F.col("status") == "ok").alias("answered"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("cost").alias("cost"), F.unix_micros(F.max("created_at").cast("timestamp")).alias("updated")).orderBy(F.desc("updated"))


@query("agg_22_progress", f"SELECT model, count(DISTINCT question_id) AS done, (SELECT count(*) FROM questions) - count(DISTINCT question_id) AS remaining, {r('count(DISTINCT question_id) / (SELECT count(*) FROM questions)', 'share')} FROM responses WHERE status = 'ok' GROUP BY model")
def _(v):
    total = v.questions.agg(F.count("*").alias("total"))
    done = v.responses.where("status = 'ok'").groupBy("model").agg(F.count_distinct("question_id").alias("done"))
    return done.crossJoin(F.broadcast(total)).select("model", "done", (F.col("total") - F.col("done")).alias("remaining"), (F.col("done") / F.col("total")).alias("share"))


@query("agg_23_composition", """WITH c AS (SELECT task, expected_answer, annotated, count(*) AS n FROM questions GROUP BY ALL), q AS (SELECT task, count(DISTINCT expected_answer) AS classes, CASE WHEN task <> 'grounded' THEN min(n) END AS quota, count(DISTINCT annotated) AS variants FROM c GROUP BY task),
n AS (SELECT task, classes * quota * variants AS questions FROM q), a AS (SELECT task, questions, CASE WHEN task = 'species' THEN round_even(questions * 0.2, 0)::BIGINT END AS ablations FROM n)
SELECT task, questions, ablations, questions + coalesce(ablations, 0) AS total, questions IS NOT NULL AS exact FROM a""")
def _(v):
    """What a benchmark would hold that takes as many of each class as the scarcest has; one task's quota is left open."""
    counts = v.questions.groupBy("task", "expected_answer", "annotated").agg(F.count("*").alias("n"))
    quotas = counts.groupBy("task").agg(F.count_distinct("expected_answer").alias("classes"), F.min("n").alias("least"), F.count_distinct("annotated").alias("variants"))
    return agg.composition(quotas.select("task", "classes", F.when(F.col("task") != "grounded", F.col("least")).alias("quota"), "variants", F.when(F.col("task") == "species", 0.2).alias("ablated_share")))


@query("agg_24_judge_means", f"SELECT task, {r('avg((interpretation1 + interpretation2) / 2)', 'interpretation')}, {r('avg((visual1 + visual2) / 2)', 'visual')}, {r('(avg((interpretation1 + interpretation2) / 2) + avg((visual1 + visual2) / 2)) / 2', 'overall')} FROM judges GROUP BY task")
def _(v):
    from plumbline.functions.stats import row_mean

    both = lambda c: F.avg((F.col(f"{c}1") + F.col(f"{c}2")) / 2).alias(c)
    return v.judges.groupBy("task").agg(both("interpretation"), both("visual")).withColumn("overall", row_mean(F.col("interpretation"), F.col("visual")))


@query("agg_26_ordered_lists", "SELECT image_id, array_to_string(list(species ORDER BY ord), ',') AS species FROM annotations GROUP BY image_id")
def _(v):
    lists = reshape.collect_ordered(v.annotations, ["image_id"], "ord", ["species"], "s")
    return lists.select("image_id", F.array_join(F.transform("s", lambda x: x["species"]), ",").alias("species"))


@query("agg_27_top_errors", "SELECT error_message, count(*) AS n FROM responses WHERE status = 'failed' GROUP BY 1 ORDER BY n DESC, error_message LIMIT 5")
def _(v):
    return agg.top_counts(v.responses.where("status = 'failed'"), ["error_message"], 5)


@query("agg_28_any", "SELECT model, bool_or(retries = 3 AND status = 'failed') AS stopped FROM responses GROUP BY model")
def _(v):
    return v.responses.groupBy("model").agg(F.bool_or((F.col("retries") == 3) & (F.col("status") == "failed")).alias("stopped"))


@query("agg_29_nulls", "SELECT task, count_if(visual1 IS NULL) AS n_null, count(visual1) > 0 AS applies FROM judges GROUP BY task")
def _(v):
    return v.judges.groupBy("task").agg(F.count_if(F.col("visual1").isNull()).alias("n_null"), (F.count("visual1") > 0).alias("applies"))


@query("agg_30_group_by_all", f"SELECT model, task, {r('avg(correct::INT)', 'accuracy')} FROM scored GROUP BY ALL")
def _(v):
    return v.spark.sql("SELECT model, task, avg(CAST(correct AS INT)) AS accuracy FROM {s} GROUP BY ALL", s=v.scored)


@query("agg_31_histogram", "SELECT model, least(floor(latency / 25) + 1, 20)::BIGINT AS bin, count(*) AS n FROM responses WHERE latency BETWEEN 0 AND 500 GROUP BY ALL")
def _(v):
    return agg.histogram(v.responses, ["model"], F.col("latency"), 0, 500, 20)


@query("agg_32_images_per_species", "SELECT species, role, count(DISTINCT image_id) AS n FROM annotations GROUP BY ALL")
def _(v):
    return v.annotations.groupBy("species", "role").agg(F.count_distinct("image_id").alias("n"))


@query("agg_33_queue_progress", f"SELECT d.source, count(*) AS n, count(l.doc_id) AS reviewed, count_if(l.toxic = 1) AS flagged, {r('100.0 * count(l.doc_id) / count(*)', 'percent')} FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def _(v):
    rows = v.documents.select("doc_id", "source").join(v.labels, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("reviewed"), F.count_if(F.col("toxic") == 1).alias("flagged"), (100 * F.count("quality") / F.count("*")).alias("percent"))


@query("agg_34_class_tally", "SELECT class, ord::BIGINT AS ord, n, n < 330 AND class <> 'SMALL' AS scarce FROM (SELECT c.class, c.ord, count(p.p_type) AS n FROM (VALUES ('SMALL', 0), ('MEDIUM', 1), ('LARGE', 2), ('HUGE', 3)) c(class, ord) LEFT JOIN part p ON p.p_type = c.class GROUP BY c.class, c.ord)")
def _(v):
    return agg.class_tally(v.part, "p_type", ["SMALL", "MEDIUM", "LARGE", "HUGE"], 330, ["SMALL"])


# -- windows


@query("win_01_position", "SELECT question_id, row_number() OVER (PARTITION BY task ORDER BY question_id) - 1 AS position FROM questions")
def _(v):
    return windows.position_within(v.questions, ["task"], ["question_id"]).select("question_id", "position")


@query("win_02_share_within", f"SELECT model, outcome, n, {r('n / sum(n) OVER (PARTITION BY model)', 'share')} FROM (SELECT model, outcome, count(*) AS n FROM scored GROUP BY ALL)")
def _(v):
    return windows.share_within(agg.value_counts(v.scored, ["model", "outcome"]), ["model"])


@query("win_03_share_of_all", f"SELECT outcome, n, {r('n / sum(n) OVER ()', 'share')} FROM (SELECT outcome, count(*) AS n FROM scored GROUP BY ALL)")
def _(v):
    return agg.value_counts(v.scored, ["outcome"], "share")


@query("win_04_latest", f"SELECT model, question_id, id FROM {LATEST}")
def _(v):
    return latest(v).select("model", "question_id", "id")


@query("win_05_keep_last", "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def _(v):
    return windows.latest(v.events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("win_06_keep_first", "SELECT model, question_id, min_by(id, (created_at, id)) AS id FROM responses GROUP BY ALL")
def _(v):
    return windows.earliest(v.responses, ["model", "question_id"], ["created_at", "id"]).select("model", "question_id", "id")


@query("win_07_drop_duplicates", "SELECT DISTINCT question_id, expected_answer FROM scored")
def _(v):
    return v.scored.select("question_id", "expected_answer").dropDuplicates(["question_id"])


@query("win_08_species_number", "SELECT image_id, ord::BIGINT AS ord, dense_rank() OVER (PARTITION BY image_id ORDER BY md5('7:' || image_id || ':' || species), species) AS number FROM annotations")
def _(v):
    from plumbline.functions.hashing import draw_key

    return windows.number_groups(v.annotations, ["image_id"], [draw_key(7, F.col("image_id"), F.col("species")), "species"]).select("image_id", "ord", "number")


@query("win_09_first_per_image", "SELECT image_id, ord::BIGINT AS ord FROM annotations QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY md5('3:' || image_id || ':' || ord), ord) <= 2")
def _(v):
    from plumbline.functions.hashing import draw_key

    return windows.first_per(v.annotations, ["image_id"], [draw_key(3, F.col("image_id"), F.col("ord")), "ord"], 2).select("image_id", "ord")


@query("win_10_terciles", "WITH e AS (SELECT quantile_cont(latency, 1.0 / 3) AS a, quantile_cont(latency, 2.0 / 3) AS b FROM responses) SELECT id, CASE WHEN latency <= a THEN 'low' WHEN latency <= b THEN 'medium' ELSE 'high' END AS quality FROM responses, e")
def _(v):
    return windows.tercile_bins(v.responses, "latency").select("id", "quality")


@query("win_11_fixed_bins", "SELECT id, (latency > 10)::BIGINT + (latency > 50)::BIGINT + (latency > 100)::BIGINT AS bin, (tokens >= 70)::BIGINT + (tokens >= 350)::BIGINT AS left_bin FROM responses")
def _(v):
    return v.responses.select("id", windows.fixed_bins(F.col("latency"), [10, 50, 100]).alias("bin"), windows.fixed_bins(F.col("tokens"), [70, 350], left_closed=True).alias("left_bin"))


STREAKS = "(SELECT *, sum(bad) OVER (PARTITION BY model, island ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM (SELECT *, (status = 'failed')::INT AS bad, sum((status = 'ok')::INT) OVER (PARTITION BY model ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS island FROM responses))"


@query("win_12_failure_streak", f"SELECT model, min_by(id, (created_at, id)) AS tripped_at FROM {STREAKS} WHERE streak >= 4 GROUP BY model")
def _(v):
    return windows.first_trip(v.responses, ["model"], ["created_at", "id"], F.col("status") == "failed", 4).select("model", F.col("id").alias("tripped_at"))


@query("win_13_rolling_rate", "SELECT id, count(*) OVER (PARTITION BY model ORDER BY created_at RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS recent FROM responses")
def _(v):
    return windows.rolling_count(v.responses, ["model"], "created_at", 3600).select("id", "recent")


@query("win_14_row_shares", f"SELECT model, expected_answer, answer, {r('n / sum(n) OVER (PARTITION BY model, expected_answer)', 'share')} FROM (SELECT model, expected_answer, answer, count(*) AS n FROM scored WHERE status = 'ok' GROUP BY ALL)")
def _(v):
    counts = agg.value_counts(v.scored.where("status = 'ok'"), ["model", "expected_answer", "answer"])
    return windows.share_within(counts, ["model", "expected_answer"]).drop("n")


# -- sets and reshaping


@query("set_01_concat", "SELECT id, model FROM responses WHERE run = 'run0' UNION ALL SELECT id, model FROM responses WHERE run = 'run1'")
def _(v):
    return reshape.concat_frames([v.responses.where(F.col("run") == k).select("id", "model") for k in ("run0", "run1")])


@query("set_02_relaxed_concat", "SELECT id, latency, NULL::BIGINT AS tokens FROM responses WHERE run = 'run0' UNION ALL SELECT id, tokens::DOUBLE, tokens FROM responses WHERE run = 'run1'")
def _(v):
    return reshape.concat_frames([v.responses.where("run = 'run0'").select("id", "latency"), v.responses.where("run = 'run1'").select("id", F.col("tokens").alias("latency"), "tokens")], relaxed=True)


@query("set_03_in_both", "SELECT id, 'both' AS kind FROM (SELECT doc_id AS id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 0) UNION ALL SELECT id, 'left' FROM ((SELECT doc_id AS id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 0) EXCEPT (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 0))")
def _(v):
    sides = [v.labels.where(c).select(F.col("doc_id").alias("id")) for c in ("quality = 1", "toxic = 0")]
    return reshape.in_all(sides).withColumn("kind", F.lit("both")).union(reshape.in_some_not_all(sides).withColumn("kind", F.lit("left")))


@query("set_04_agreed_flags", f"SELECT response_id, array_to_string(list_filter(flags1, lambda x: list_contains(flags2, x)), '+') AS agreed FROM {FLAGGED}")
def _(v):
    return flagged(v).select("response_id", F.array_join(F.array_intersect("flags1", "flags2"), "+").alias("agreed"))


@query("set_05_distinct", "SELECT DISTINCT model, run FROM responses")
def _(v):
    return v.responses.select("model", "run").distinct()


@query("rsh_01_pivot_first", "SELECT question_id, " + ", ".join(f"min_by(answer, id) FILTER (model = '{m}' AND answer IS NOT NULL) AS {m}" for m in MODELS) + " FROM (SELECT * FROM responses QUALIFY row_number() OVER (PARTITION BY model, question_id ORDER BY created_at DESC, id DESC) = 1) GROUP BY question_id")
def _(v):
    return reshape.pivot_first(latest(v), ["question_id"], "model", "answer", MODELS)


@query("rsh_02_pivot_counts", "SELECT model, " + ", ".join(f"count_if(outcome = '{o}') AS {o}" for o in ("correct", "incorrect", "unsure")) + ", count_if(outcome IN ('correct', 'incorrect', 'unsure')) AS total FROM scored GROUP BY model")
def _(v):
    return reshape.pivot_counts(v.scored, ["model"], "outcome", ["correct", "incorrect", "unsure"], "total")


@query("rsh_03_unstack", f"SELECT model, {r('avg(correct::INT) FILTER (annotated)', 'boxed')}, {r('avg(correct::INT) FILTER (NOT annotated)', 'plain')} FROM scored GROUP BY model")
def _(v):
    rates = agg.rate(v.scored, ["model", "annotated"], F.col("correct"))
    return rates.groupBy("model").pivot("annotated", [True, False]).agg(F.first("rate")).toDF("model", "boxed", "plain")


@query("rsh_04_melt_map", "SELECT response_id, 'i' AS key, interpretation1::BIGINT AS value FROM judges UNION ALL SELECT response_id, 'v', visual1 FROM judges WHERE visual1 IS NOT NULL")
def _(v):
    maps = v.judges.select("response_id", F.create_map(F.lit("i"), F.col("interpretation1"), F.lit("v"), F.col("visual1")).alias("scores"))
    return reshape.melt_map(maps, "scores")


@query("rsh_05_missing_columns", "SELECT response_id, task, NULL::BIGINT AS textual_model, interpretation1::BIGINT AS interpretation1 FROM judges")
def _(v):
    return reshape.ensure_columns(v.judges.select("response_id", "task", "interpretation1"), {"textual_model": "long", "interpretation1": "int"})


@query("rsh_06_prefixed", "SELECT response_id, interpretation1::BIGINT AS judge1_reading, visual1::BIGINT AS judge1_visual1 FROM judges")
def _(v):
    return reshape.prefixed(v.judges.select("response_id", "interpretation1", "visual1"), "judge1_", ["response_id"], {"interpretation1": "reading"})


@query("rsh_07_explode", "SELECT image_id, (ord - 1)::BIGINT AS pos, x, y FROM annotations")
def _(v):
    return v.boxes.select("image_id", F.posexplode("boxes").alias("pos", "b")).select("image_id", "pos", "b.x", "b.y")


@query("rsh_08_variants", "SELECT image_id, a.annotated FROM images CROSS JOIN (VALUES (true), (false)) a(annotated)")
def _(v):
    return reshape.duplicate_variants(v.images.select("image_id"), "annotated", [True, False])


@query("rsh_10_list_statistics", f"SELECT image_id, {r('avg(w * h / (width * height))', 'mean')}, {r('min(w * h / (width * height))', 'least')}, {r('max(w * h / (width * height))', 'most')} FROM annotations WHERE width * height > 0 GROUP BY image_id")
def _(v):
    share = F.transform("boxes", lambda b: b["w"] * b["h"] / (F.col("width") * F.col("height")))
    lists = v.boxes.where("width * height > 0").select("image_id", share.alias("s"))
    return lists.select("image_id", (F.aggregate("s", F.lit(0.0), lambda a, b: a + b) / F.size("s")).alias("mean"), F.array_min("s").alias("least"), F.array_max("s").alias("most"))


@query("rsh_11_row_index", "SELECT id, row_number() OVER (ORDER BY created_at, id) - 1 AS row_index FROM responses")
def _(v):
    return reshape.with_row_index(v.responses.select("id", "created_at"), ["created_at", "id"]).select("id", "row_index")
