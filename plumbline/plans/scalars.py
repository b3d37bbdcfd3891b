"""Projections, predicates, classifiers and scalar functions on the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import boxes as bx
from plumbline.functions import density as den
from plumbline.functions import geometry as geo
from plumbline.functions import hashing, jsonx, stats, text
from plumbline.operators import classify as cas
from plumbline.operators import generate, reshape
from plumbline.plans.registry import query
from plumbline.plans.relational import FLAGGED, flagged, latest, paired, PAIRED, r

A = "images"

# -- predicates and projections


@query("prj_01_role", "SELECT image_id, ord::BIGINT AS ord FROM annotations WHERE role = 'weed'")
def _(v):
    return v.annotations.where(F.col("role") == "weed").select("image_id", "ord")


@query("prj_02_status", "SELECT id FROM responses WHERE status = 'ok'")
def _(v):
    return v.responses.where("status = 'ok'").select("id")


@query("prj_03_isin", "SELECT id, run FROM responses WHERE run IN ('run0', 'run2') AND model IN ('m1', 'm3')")
def _(v):
    return v.responses.where(F.col("run").isin("run0", "run2") & F.col("model").isin("m1", "m3")).select("id", "run")


@query("prj_04_non_blank", "SELECT id FROM responses WHERE trim(coalesce(answer, '')) <> ''")
def _(v):
    return v.responses.where(text.non_blank(F.col("answer"))).select("id")


@query("prj_05_area_guard", "SELECT image_id FROM images WHERE width * height > 0")
def _(v):
    return generate.usable(v.images).select("image_id")


@query("prj_06_large_enough", f"SELECT image_id, species, {r('sum(w * h)', 'area')}, {r('max(w * h)', 'largest')}, count(*) AS n_boxes FROM annotations WHERE width * height > 0 GROUP BY image_id, species, width, height HAVING sum(w * h) / (width * height) >= 0.02 AND max(w * h) / (width * height) >= 0.015")
def _(v):
    return generate.large_enough(v.annotations, 0.02, 0.015).select("image_id", "species", "area", "largest", "n_boxes")


PAIRS = """(SELECT *, CASE WHEN a_area + b_area > 0 THEN (xm - width / 2.0) / (width / 2.0) END AS nx, (ym - height / 2.0) / (height / 2.0) AS ny FROM (
  SELECT a.image_id, a.dataset, a.ord AS ord_a, b.ord AS ord_b, a.species AS species_a, b.species AS species_b, a.species = b.species AS same, a.width, a.height, a.w * a.h AS a_area, b.w * b.h AS b_area,
  ((a.x + a.w / 2) * a.w * a.h + (b.x + b.w / 2) * b.w * b.h) / (a.w * a.h + b.w * b.h) AS xm, ((a.y + a.h / 2) * a.w * a.h + (b.y + b.h / 2) * b.w * b.h) / (a.w * a.h + b.w * b.h) AS ym
  FROM annotations a JOIN annotations b ON a.image_id = b.image_id AND (a.species < b.species OR (a.species = b.species AND a.ord < b.ord)) WHERE a.role = 'weed' AND b.role = 'weed' AND a.width * a.height > 0))"""
PAIR_RULE = "(a_area + b_area) / (width * height) >= 0.02 AND greatest(a_area, b_area) / (width * height) >= 0.01 AND sqrt(nx * nx + ny * ny) / sqrt(2.0) <= 0.7 AND least(a_area, b_area) / greatest(a_area, b_area) >= 0.5"


@query("prj_07_pair_predicate", f"SELECT image_id, ord_a::BIGINT AS ord_a, ord_b::BIGINT AS ord_b, same FROM {PAIRS} WHERE {PAIR_RULE}")
def _(v):
    return generate.pair_candidates(v.annotations).select("image_id", "ord_a", "ord_b", "same")


@query("prj_08_similar_by_either", f"SELECT image_id, ord_a::BIGINT AS ord_a, ord_b::BIGINT AS ord_b FROM {PAIRS} WHERE {PAIR_RULE.replace('>= 0.5', '>= 0.9').replace('least(a_area', '(least(a_area')} OR (ord_a + ord_b) % 3 = 0)")
def _(v):
    alike = (F.col("ord_a") + F.col("ord_b")) % 3 == 0
    return generate.pair_candidates(v.annotations, ratio=0.9, colour=alike).select("image_id", "ord_a", "ord_b")


@query("prj_10_busy_scene", "SELECT image_id, count(*) AS n, count(DISTINCT species) AS species FROM annotations GROUP BY image_id HAVING count(*) >= 3 AND count(DISTINCT species) - 1 >= 1")
def _(v):
    return v.annotations.groupBy("image_id").agg(F.count("*").alias("n"), F.count_distinct("species").alias("species")).where("n >= 3 and species - 1 >= 1")


@query("prj_11_all_boxes", "SELECT image_id, species FROM annotations WHERE width * height > 0 GROUP BY image_id, species HAVING count(*) <= 2 AND bool_and(w * h / (width * height) >= 0.005)")
def _(v):
    g = generate.usable(v.annotations).groupBy("image_id", "species").agg(F.count("*").alias("n"), F.bool_and(F.col("w") * F.col("h") / (F.col("width") * F.col("height")) >= 0.005).alias("large"))
    return g.where("n <= 2 and large").select("image_id", "species")


@query("prj_12_single_species", "SELECT image_id, min(species) AS species FROM annotations WHERE role = 'weed' GROUP BY image_id HAVING count(DISTINCT species) = 1")
def _(v):
    return v.annotations.where("role = 'weed'").groupBy("image_id").agg(F.min("species").alias("species"), F.count_distinct("species").alias("n")).where("n = 1").drop("n")


@query("prj_13_largest_box_gate", "SELECT i.image_id FROM images i LEFT JOIN annotations a ON a.image_id = i.image_id AND a.role = 'weed' WHERE i.width * i.height > 0 GROUP BY i.image_id, i.width, i.height HAVING count(a.ord) = 0 OR max(a.w * a.h) / (i.width * i.height) >= 0.02")
def _(v):
    return generate.scene_features(v.images, v.annotations).where("count = 0 or largest >= 0.02").select("image_id")


@query("prj_14_many_predicates", "SELECT id FROM scored WHERE model = 'm1' AND outcome IN ('incorrect', 'unsure') AND dataset = 'd2' AND contains(lower(concat_ws(chr(10), answer, expected_answer)), 'si')")
def _(v):
    return v.scored.where((F.col("model") == "m1") & F.col("outcome").isin("incorrect", "unsure") & (F.col("dataset") == "d2") & text.haystack_contains("SI", F.col("answer"), F.col("expected_answer"))).select("id")


@query("prj_15_review_queue", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.source = 'src1' AND (l.doc_id IS NULL OR l.toxic = 1)")
def _(v):
    return v.documents.where("source = 'src1'").select("doc_id").join(v.labels, "doc_id", "left").where("quality is null or toxic = 1").select("doc_id")


@query("prj_16_not_containing", "SELECT question_id FROM questions WHERE NOT contains(image_path, '/1')")
def _(v):
    return v.questions.where(~F.col("image_path").contains("/1")).select("question_id")


@query("prj_17_rename_and_assign", "SELECT id AS response_id, upper(model) AS model, round(latency * 1000, 9) + 0.0 AS latency_ms FROM responses")
def _(v):
    return v.responses.withColumnsRenamed({"id": "response_id"}).withColumns({"model": F.upper("model"), "latency_ms": F.col("latency") * 1000}).select("response_id", "model", "latency_ms")


@query("prj_18_reindex", "SELECT id, latency + 0.0 AS latency, NULL::VARCHAR AS notes FROM responses")
def _(v):
    return reshape.reindex(v.responses.select("id", "latency", "run"), {"id": "long", "latency": "double", "notes": "string"})


@query("prj_20_log_level", "SELECT event_id FROM events WHERE (CASE event_type WHEN 'error' THEN 4 WHEN 'view' THEN 3 WHEN 'click' THEN 2 ELSE 1 END) >= 3")
def _(v):
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "WARNING").when(F.col("event_type") == "click", "INFO").otherwise("DEBUG")
    return v.events.where(cas.level_at_least(F.concat(F.lit("12:00 "), level, F.lit(" x")), "WARNING")).select("event_id")


@query("prj_22_disagreement", "SELECT response_id FROM judges WHERE interpretation1 <> interpretation2")
def _(v):
    return v.judges.where("interpretation1 <> interpretation2").select("response_id")


@query("prj_23_candidates", "SELECT image_id FROM images WHERE dataset IN ('1-URGENT', '5-LOW') AND image_id IN (SELECT image_id FROM annotations WHERE role = 'weed') AND image_id NOT IN (SELECT doc_id FROM labels)")
def _(v):
    some = v.images.where(F.col("dataset").isin("1-URGENT", "5-LOW")).join(v.annotations.where("role = 'weed'"), "image_id", "left_semi")
    return some.join(v.labels.select(F.col("doc_id").alias("image_id")), "image_id", "left_anti").select("image_id")


# -- classifiers


@query("cas_01_localisation_outcome", "SELECT id, CASE WHEN matched_iou IS NULL THEN 'miss' WHEN matched_iou < 0.5 THEN 'poor_placement' WHEN est_count > true_count THEN 'over_detect' WHEN est_count < true_count THEN 'under_detect' ELSE 'correct' END AS kind FROM scored")
def _(v):
    return v.scored.select("id", cas.localisation_outcome(F.col("matched_iou"), F.col("est_count"), F.col("true_count")).alias("kind"))


@query("cas_02_estimate_outcomes", "SELECT id, CASE WHEN est_count = true_count THEN 'correct' WHEN est_count > true_count THEN 'over_estimated' ELSE 'under_estimated' END AS counted, CASE WHEN abs(latency - 50) < 3 THEN 'correct' WHEN latency - 50 > 0 THEN 'over_estimated' ELSE 'under_estimated' END AS covered FROM scored")
def _(v):
    return v.scored.select("id", cas.count_outcome(F.col("est_count"), F.col("true_count")).alias("counted"), cas.coverage_outcome(F.col("latency") - 50).alias("covered"))


@query("cas_03_answer_outcomes", "SELECT id, CASE WHEN correct THEN 'correct' WHEN a = 'Unsure' THEN 'unsure' ELSE 'incorrect' END AS exact, CASE WHEN lower(a) = 'unsure' THEN 'unsure' WHEN correct THEN 'correct' ELSE 'incorrect' END AS lower_first, CASE WHEN correct THEN 'correct' WHEN lower(trim(a)) = 'unsure' THEN 'unsure' ELSE 'incorrect' END AS trimmed FROM (SELECT id, correct, CASE id % 7 WHEN 0 THEN 'Unsure' WHEN 1 THEN ' unsure ' WHEN 2 THEN 'UNSURE' ELSE answer END AS a FROM scored)")
def _(v):
    k = F.col("id") % 7
    a = F.when(k == 0, "Unsure").when(k == 1, " unsure ").when(k == 2, "UNSURE").otherwise(F.col("answer"))
    return v.scored.select("id", *[cas.answer_outcome(a, F.col("correct"), m).alias(m) for m in ("exact", "lower_first", "trimmed")])


@query("cas_04_choice_outcome", "SELECT id, CASE WHEN status <> 'ok' THEN NULL WHEN correct THEN 'correct' WHEN NOT list_contains(CAST(choices AS VARCHAR[]), answer) THEN 'invalid' ELSE 'incorrect' END AS kind FROM (SELECT * REPLACE (replace(replace(choices, '\"', ''), ' ', '') AS choices) FROM scored)")
def _(v):
    return v.scored.select("id", cas.choice_outcome(F.col("answer"), F.col("correct"), jsonx.decode_array(F.col("choices")), F.col("status") == "ok").alias("kind"))


@query("cas_05_suite", "SELECT question_id, CASE question_type WHEN 'multiple_choice' THEN 'species/multiple_choice/' || s WHEN 'open_ended' THEN 'species/open_ended/' || s WHEN 'density' THEN 'density/' || s ELSE question_type END AS suite FROM (SELECT *, CASE WHEN annotated THEN 'boxed' ELSE 'unannotated' END AS s FROM questions)")
def _(v):
    return v.questions.select("question_id", cas.suite(F.col("question_type"), F.col("annotated")).alias("suite"))


LOG_SCALE = "CASE WHEN {v} <= {lo} THEN 0.0 ELSE least(1.0, ln({v}::DOUBLE / {lo}) / ln({hi}::DOUBLE / {lo})) END"
SCORE = f"(({LOG_SCALE.format(v='n', lo='1', hi='40')}) + ({LOG_SCALE.format(v='c', lo='0.01', hi='0.4')})) / 2"
COUNTED = "(SELECT image_id, count(*) AS n, sum(w * h) / 480000 AS c FROM annotations GROUP BY image_id)"


@query("cas_06_density_class", f"SELECT image_id, CASE WHEN n = 0 THEN 'none' WHEN {SCORE} >= 0.6 AND n >= 5 THEN 'high' WHEN {SCORE} >= 0.3 AND n >= 2 THEN 'medium' ELSE 'low' END AS class FROM {COUNTED}")
def _(v):
    g = v.annotations.groupBy("image_id").agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("h")) / 480000).alias("c"))
    return g.select("image_id", den.level_name(den.density_level(F.col("n"), F.col("c"))).alias("class"))


@query("cas_07_error_flags", f"SELECT response_id, array_to_string(flags1, '+') AS flags1, array_to_string(flags2, '+') AS flags2 FROM {FLAGGED}")
def _(v):
    return flagged(v).select("response_id", *[F.array_join(c, "+").alias(c) for c in ("flags1", "flags2")])


@query("cas_08_failure_kind", "SELECT id, CASE WHEN s IN (401, 402) THEN 'fatal' WHEN s = 408 OR s = 429 OR s > 499 THEN 'transient' ELSE 'request' END AS kind FROM (SELECT id, 400 + id % 130 AS s FROM responses)")
def _(v):
    return v.responses.select("id", cas.failure_kind(400 + F.col("id") % 130).alias("kind"))


@query("cas_09_pair_agreement", f"SELECT model, question_id, CASE WHEN open_ok AND choice_ok THEN 'both' WHEN choice_ok THEN 'choice_only' WHEN open_ok THEN 'open_only' ELSE 'neither' END AS category FROM {PAIRED}")
def _(v):
    return paired(v).select("model", "question_id", cas.pair_agreement(F.col("choice_ok"), F.col("open_ok")).alias("category"))


@query("cas_10_relabel", "SELECT question_id, CASE question_type WHEN 'multiple_choice' THEN 'MCQ' WHEN 'open_ended' THEN 'OEQ' ELSE question_type END AS label FROM questions")
def _(v):
    return v.questions.select("question_id", cas.relabel(F.col("question_type"), {"multiple_choice": "MCQ", "open_ended": "OEQ"}).alias("label"))


@query("cas_11_run_state", "SELECT run, CASE WHEN run = 'run2' THEN 'stopped' WHEN count_if(status = 'failed') = 0 THEN 'finished' ELSE 'interrupted' END AS state FROM responses GROUP BY run")
def _(v):
    return v.responses.groupBy("run").agg(F.count_if(F.col("status") == "failed").alias("p")).select("run", cas.run_state(F.col("p"), F.col("run") == "run2", F.lit(False)).alias("state"))


TREE = {"feature": "n", "threshold": 3, "below": {"label": 1}, "above": {"feature": "c", "threshold": 0.05, "below": {"label": 2}, "above": {"label": 3}}}


@query("cas_13_tree", f"SELECT image_id, CASE WHEN n < 3 THEN 1 WHEN c < 0.05 THEN 2 ELSE 3 END::BIGINT AS level FROM {COUNTED}")
def _(v):
    g = v.annotations.groupBy("image_id").agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("h")) / 480000).alias("c"))
    return g.select("image_id", den.tree_column(TREE).alias("level"))


# -- strings and JSON


@query("str_01_species", r"SELECT p_partkey, r AS role, trim(n) AS name, nullif(q, '') AS qualifier FROM (SELECT p_partkey, regexp_extract(c, '^(crop|weed):\s*([^(]+?)\s*(?:\(([^)]+)\))?$', 1) AS r, regexp_extract(c, '^(crop|weed):\s*([^(]+?)\s*(?:\(([^)]+)\))?$', 2) AS n, regexp_extract(c, '^(crop|weed):\s*([^(]+?)\s*(?:\(([^)]+)\))?$', 3) AS q FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'weed: ' || p_type || ' (' || p_brand || ')' WHEN 1 THEN ' crop:  ' || p_name WHEN 2 THEN 'weed: ' || p_type || ' (a) ' || p_brand WHEN 3 THEN 'weed: ' || p_type || ' ()' ELSE 'other' END AS c0, trim(c0) AS c FROM part)) WHERE r <> ''")
def _(v):
    c = F.expr("CASE p_size % 5 WHEN 0 THEN 'weed: ' || p_type || ' (' || p_brand || ')' WHEN 1 THEN ' crop:  ' || p_name WHEN 2 THEN 'weed: ' || p_type || ' (a) ' || p_brand WHEN 3 THEN 'weed: ' || p_type || ' ()' ELSE 'other' END")
    return v.part.select("p_partkey", text.species(c).alias("s")).where("s is not null").select("p_partkey", "s.role", "s.name", "s.qualifier")


@query("str_02_display_name", "SELECT doc_id, upper(substr(text, 1, 1)) || substr(text, 2) AS name FROM documents")
def _(v):
    return v.documents.select("doc_id", text.display_name(F.col("text")).alias("name"))


@query("str_03_light", r"""SELECT conv_id, turn, replace(lower(regexp_replace(trim(trim(trim(text, E' \n\t\r'), '"''`.'), E' \n\t\r'), '\s+', ' ', 'g')), 'ß', 'ss') AS light FROM conversations""")
def _(v):
    return v.conversations.select("conv_id", "turn", text.light(F.col("text")).alias("light"))


@query("str_04_open_ended_match", r"""SELECT id, coalesce(a = e OR a LIKE '%(' || e || ')%' OR (k = 4), false) AS match FROM (SELECT id, expected_answer AS e, id % 5 AS k, CASE id % 5 WHEN 0 THEN expected_answer WHEN 1 THEN 'thing (' || expected_answer || ')' WHEN 2 THEN expected_answer || 's' WHEN 3 THEN expected_answer || ' or other' ELSE 'the ' || expected_answer || ' here' END AS a FROM scored)""")
def _(v):
    e, k = F.col("expected_answer"), F.col("id") % 5
    a = F.when(k == 0, e).when(k == 1, F.concat(F.lit("Thing ("), F.upper(e), F.lit(")"))).when(k == 2, F.concat(e, F.lit("s"))).when(k == 3, F.concat(e, F.lit(" or other"))).otherwise(F.concat(F.lit("the "), e, F.lit(" here.")))
    return v.scored.select("id", text.open_ended_match(a, F.array(e)).alias("match"))


@query("str_05_extract", r"""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(url, 'page=(\d+)', 1), '') AS page FROM pages""")
def _(v):
    return v.pages.select("page_id", text.extract(F.col("html"), "<title>([^<]*)</title>").alias("title"), text.extract(F.col("url"), r"page=(\d+)").alias("page"))


@query("str_06_box_label", "SELECT event_id, CASE event_id % 5 WHEN 3 THEN event_id % 40 || '.5' WHEN 4 THEN lower(event_type) || ' ' || event_id % 40 || ' of 5' ELSE (event_id % 40)::VARCHAR END AS label FROM events")
def _(v):
    reply = F.expr("CASE event_id % 5 WHEN 0 THEN ' Box ' || event_id % 40 || '.' WHEN 1 THEN '\"# ' || event_id % 40 || '\"' WHEN 2 THEN event_id % 40 || '.0' WHEN 3 THEN event_id % 40 || '.5' ELSE upper(event_type) || '  ' || event_id % 40 || ' of 5' END")
    return v.events.select("event_id", text.box_label(reply).alias("label"))


@query("str_07_tidy_message", r"SELECT id, trim(regexp_replace(regexp_replace(error_message, '\s*\(retry in [^)]*\)', '', 'g'), '\s+', ' ', 'g')) AS message FROM responses WHERE error_message IS NOT NULL")
def _(v):
    return v.responses.where("error_message is not null").select("id", text.tidy_message(F.col("error_message")).alias("message"))


@query("str_08_truncate", "SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS head FROM documents")
def _(v):
    return v.documents.select("doc_id", text.truncate(F.col("text"), 40).alias("head"))


@query("str_09_question_id", "SELECT image_id, dataset || ':' || image_id || ':density' AS id FROM images")
def _(v):
    return v.images.select("image_id", text.question_id(F.col("dataset"), F.col("image_id"), F.lit("density")).alias("id"))


@query("str_10_slug_path", "SELECT image_id, 'out/img_' || image_id || '_boxed_view.jpg' AS path FROM images")
def _(v):
    return v.images.select("image_id", text.slug_path(F.concat(F.lit("in/"), "file_name"), F.lit("boxed view"), "out").alias("path"))


@query("str_11_open_ended_question", "SELECT question_id, 'Which ' || expected_answer || '? Say.' AS q FROM questions")
def _(v):
    return v.questions.select("question_id", text.open_ended_question(F.concat(F.lit("Which "), "expected_answer", F.lit("??")), " Say.").alias("q"))


@query("str_12_lower_equal", "SELECT id, lower(trim(upper(answer))) = lower(expected_answer) AS same FROM scored WHERE answer IS NOT NULL")
def _(v):
    return v.scored.where("answer is not null").select("id", (F.lower(F.trim(F.upper("answer"))) == F.lower("expected_answer")).alias("same"))


@query("str_13_duration", "SELECT event_id, CASE WHEN s >= 3600 THEN format('{:d}h {:02d}m', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN format('{:d}m {:02d}s', s // 60, s % 60) ELSE format('{:d}s', s) END AS t FROM (SELECT event_id, floor(value * 40)::BIGINT AS s FROM events)")
def _(v):
    return v.events.select("event_id", text.duration(F.col("value") * 40).alias("t"))


@query("str_18_haystack", "SELECT question_id FROM questions WHERE contains(lower(concat_ws(chr(10), dataset, image_path, expected_answer)), 'click')")
def _(v):
    return v.questions.where(text.haystack_contains("Click", F.col("dataset"), F.col("image_path"), F.col("expected_answer"))).select("question_id")


@query("jsn_02_missing_fields", "SELECT event_id, CASE WHEN props LIKE '%\"k\"%' THEN '' ELSE 'k,' END || 'reasoning' AS missing FROM events")
def _(v):
    return v.events.select("event_id", F.array_join(jsonx.missing_fields(F.col("props"), ["k", "reasoning"]), ",").alias("missing"))


@query("jsn_05_encode", "SELECT image_id, '[' || string_agg('\"' || species || '\"', ',' ORDER BY ord) || ']' AS j FROM annotations GROUP BY image_id")
def _(v):
    return reshape.collect_ordered(v.annotations, ["image_id"], "ord", ["species"], "s").select("image_id", F.to_json(F.transform("s", lambda x: x["species"])).alias("j"))


@query("jsn_06_decode", "SELECT question_id, json_array_length(choices)::BIGINT AS n, choices->>0 AS first FROM questions")
def _(v):
    c = jsonx.decode_array(F.col("choices"))
    return v.questions.select("question_id", F.size(c).alias("n"), F.get(c, 0).alias("first"))


@query("jsn_07_field", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _(v):
    return v.events.select("event_id", jsonx.field(F.col("props"), "k").cast("long").alias("k"))


@query("jsn_04_judge_score", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 4 END::BIGINT AS score FROM events")
def _(v):
    k = F.col("event_id") % 5
    body = F.when(k == 0, '{"x": 3}').when(k == 1, '{"x": "2"}').when(k == 2, '{"x": 4.0}').when(k == 3, '{"x": true}').otherwise('{"x": 9}')
    return v.events.select("event_id", jsonx.judge_score(body, "x").alias("score"))


# -- geometry, mathematics and hashes

CELL_AREA = """(WITH e AS (SELECT image_id, x AS p, 0 AS d FROM annotations UNION SELECT image_id, x + w, 0 FROM annotations), xs AS (SELECT image_id, p AS lo, lead(p) OVER (PARTITION BY image_id ORDER BY p) AS hi FROM (SELECT DISTINCT image_id, p FROM e)),
 f AS (SELECT DISTINCT image_id, y AS p FROM annotations UNION SELECT image_id, y + h FROM annotations), ys AS (SELECT image_id, p AS lo, lead(p) OVER (PARTITION BY image_id ORDER BY p) AS hi FROM f)
 SELECT xs.image_id, sum((xs.hi - xs.lo) * (ys.hi - ys.lo)) AS area FROM xs JOIN ys ON ys.image_id = xs.image_id WHERE xs.hi IS NOT NULL AND ys.hi IS NOT NULL AND EXISTS (SELECT 1 FROM annotations a WHERE a.image_id = xs.image_id AND a.x <= xs.lo AND a.x + a.w >= xs.hi AND a.y <= ys.lo AND a.y + a.h >= ys.hi) GROUP BY xs.image_id)"""


@query("geo_01_union_area", f"SELECT image_id, {r('area', 'area')} FROM {CELL_AREA}")
def _(v):
    return v.boxes.select("image_id", geo.union_area(F.col("boxes")).alias("area"))


@query("geo_02_centre_of_mass", f"SELECT image_id, {r('sum((x + w / 2) * w * h) / sum(w * h)', 'x')}, {r('sum((y + h / 2) * w * h) / sum(w * h)', 'y')} FROM annotations GROUP BY image_id")
def _(v):
    return v.boxes.select("image_id", geo.centre_of_mass(F.col("boxes")).alias("c")).select("image_id", "c.x", "c.y")


@query("geo_03_centre_offset", f"SELECT image_id, ord::BIGINT AS ord, CASE WHEN height = 0 THEN 0 ELSE {r('sqrt(power((x - width / 2.0) / (width / 2.0), 2) + power((y - height / 2.0) / (height / 2.0), 2)) / sqrt(2.0)', 'o').removesuffix(' AS o')} END AS o FROM annotations")
def _(v):
    return v.annotations.select("image_id", "ord", geo.centre_offset(F.col("x"), F.col("y"), F.col("width"), F.col("height")).alias("o"))


@query("geo_04_areas", f"SELECT image_id, ord::BIGINT AS ord, {r('w * h', 'area')}, CASE WHEN width * height > 0 THEN {r('w * h / (width * height)', 'f').removesuffix(' AS f')} END AS fraction FROM annotations")
def _(v):
    b = F.struct("x", "y", "w", "h")
    return v.annotations.select("image_id", "ord", geo.area(b).alias("area"), geo.area_fraction(b, F.col("width"), F.col("height")).alias("fraction"))


@query("geo_05_spread", f"WITH c AS (SELECT DISTINCT image_id, r, c FROM (SELECT image_id, unnest(range(least(greatest(floor(y / 150)::INT, 0), 3), least(greatest(ceil((y + h) / 150)::INT - 1, 0), 3) + 1)) AS r, x, w, width FROM annotations WHERE height > 0), LATERAL (SELECT unnest(range(least(greatest(floor(x / (width / 4.0))::INT, 0), 3), least(greatest(ceil((x + w) / (width / 4.0))::INT - 1, 0), 3) + 1)) AS c)) SELECT image_id, {r('count(*) / 16', 'spread')} FROM c GROUP BY image_id")
def _(v):
    return v.boxes.where("height > 0").select("image_id", geo.spread(F.col("boxes"), F.col("width"), F.col("height")).alias("spread"))


@query("geo_06_corners", "SELECT image_id, ord::BIGINT AS ord, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM annotations")
def _(v):
    return v.annotations.select("image_id", "ord", geo.corners(F.struct("x", "y", "w", "h")).alias("c")).select("image_id", "ord", "c.*")


IOU = "CASE WHEN least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y) THEN i / (a.w * a.h + b.w * b.h - i) ELSE 0 END"


@query("geo_07_iou", "SELECT image_id, oa::BIGINT AS oa, ob::BIGINT AS ob, round(CASE WHEN iw > 0 AND ih > 0 THEN iw * ih / (sa + sb - iw * ih) ELSE 0 END, 9) + 0.0 AS iou FROM (SELECT a.image_id, a.ord AS oa, b.ord AS ob, a.w * a.h AS sa, b.w * b.h AS sb, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS iw, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS ih FROM annotations a JOIN annotations b ON a.image_id = b.image_id AND a.ord < b.ord)")
def _(v):
    from plumbline.operators.joins import pairs_within

    p = pairs_within(v.annotations, ["image_id"], "ord", ["ord", "x", "y", "w", "h"])
    box = lambda s: geo.corners(F.struct(*[F.col(f"{c}_{s}").alias(c) for c in "xywh"]))
    return p.select("image_id", F.col("ord_a").alias("oa"), F.col("ord_b").alias("ob"), geo.iou(box("a"), box("b")).alias("iou"))


def greedy_ctes(truth: str, found: str) -> str:
    """Greedy matching of corner boxes (image_id, i, x1 .. y2) and (image_id, j, ...): pairs are taken by rank, one
    a round.  e has each image's number of pairs and their summed overlap."""
    side = "(t.x2 - t.x1) * (t.y2 - t.y1) + (f.x2 - f.x1) * (f.y2 - f.y1)"
    return f"""WITH RECURSIVE t AS MATERIALIZED ({truth}), f AS MATERIALIZED ({found}), p AS MATERIALIZED (
      SELECT image_id, i, j, iou, row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, i DESC, j DESC) AS k
      FROM (SELECT image_id, i, j, ow * oh / (side - ow * oh) AS iou FROM (SELECT t.image_id, i, j, {side} AS side,
        least(t.x2, f.x2) - greatest(t.x1, f.x1) AS ow, least(t.y2, f.y2) - greatest(t.y1, f.y1) AS oh FROM t JOIN f ON t.image_id = f.image_id) WHERE ow > 0 AND oh > 0) WHERE iou > 0
    ), s AS (
      SELECT DISTINCT image_id, 0::BIGINT AS k, []::BIGINT[] AS ti, []::BIGINT[] AS fj, 0.0::DOUBLE AS total, 0::BIGINT AS n FROM t
      UNION ALL
      SELECT image_id, k, CASE WHEN free THEN list_append(ti, i) ELSE ti END, CASE WHEN free THEN list_append(fj, j) ELSE fj END, CASE WHEN free THEN total + iou ELSE total END, CASE WHEN free THEN n + 1 ELSE n END
      FROM (SELECT p.image_id, p.k, p.i, p.j, p.iou, s.ti, s.fj, s.total, s.n, NOT list_contains(s.ti, p.i) AND NOT list_contains(s.fj, p.j) AS free FROM s JOIN p ON p.image_id = s.image_id AND p.k = s.k + 1)
    ), e AS (SELECT image_id, max_by(total, k) AS total, max_by(n, k) AS n FROM s GROUP BY image_id)"""


def greedy_sql(truth: str, found: str, columns: str) -> str:
    """The scores of a greedy matching."""
    return f"""{greedy_ctes(truth, found)},
    c AS (SELECT image_id, count(*) AS true_box_count FROM t GROUP BY image_id), d AS (SELECT image_id, count(*) AS pred_box_count FROM f GROUP BY image_id)
    SELECT image_id, true_box_count, pred_box_count, {columns}{r('total / nullif(n, 0)', 'matched_iou')}, {r('total / greatest(true_box_count, pred_box_count)', 'localisation_score')}
    FROM c JOIN d USING (image_id) JOIN e USING (image_id)"""


TRUTH_BOXES = "SELECT image_id, ord - 1 AS i, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM annotations"
MOVED_BOXES = "SELECT image_id, j, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM (SELECT image_id, ord - 1 AS j, x + (ord - 1) * 7 % 11 AS x, y + 3 AS y, w, h FROM annotations WHERE ord <= 4)"


@query("geo_09_box_scores", greedy_sql(TRUTH_BOXES, MOVED_BOXES, "pred_box_count - true_box_count AS box_count_error, "))
def _(v):
    """Each image's boxes against the first of themselves moved by a few pixels."""
    moved = F.transform("boxes", lambda b, i: F.struct((b["x"] + i * 7 % 11).alias("x"), (b["y"] + 3).alias("y"), b["w"].alias("w"), b["h"].alias("h")))
    scores = geo.box_scores(geo.all_corners(F.col("boxes")), geo.all_corners(F.slice(moved, 1, 4)))
    return v.boxes.select("image_id", scores.alias("s")).select("image_id", "s.*")


@query("geo_11_box_formats", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'yxyx' WHEN 1 THEN 'xyxy' WHEN 2 THEN 'cxcywh' ELSE 'xywh' END AS ord, CASE event_id % 3 WHEN 0 THEN 1000.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE END AS scale, true AS known FROM events")
def _(v):
    k, m = F.col("event_id") % 4, F.col("event_id") % 3
    order = F.when(k == 0, "[ymin, xmin, ymax, xmax]").when(k == 1, "[x1, y1, x2, y2]").when(k == 2, "(cx, cy, w, h)").otherwise("[x, y, w, h]")
    scale = F.when(m == 0, "scaled to 1000").when(m == 1, "normalised").otherwise("in pixels")
    return v.events.select("event_id", bx.infer_format(F.concat_ws(" ", order, scale)).alias("f")).select("event_id", "f.ord", "f.scale", "f.known")


@query("geo_13_pixel_boxes", f"SELECT image_id, ord::BIGINT AS ord, {r('greatest(least(x, width), 0)', 'x1')}, {r('greatest(least(y, height), 0)', 'y1')}, {r('greatest(least(x + w, width), 0)', 'x2')}, {r('greatest(least(y + h, height), 0)', 'y2')} FROM annotations")
def _(v):
    raw = F.array(F.struct(F.lit("xywh").alias("ord"), F.col("x").alias("a"), F.col("y").alias("b"), F.col("w").alias("c"), F.col("h").alias("d")))
    px = bx.to_pixels(raw, F.lit(None).cast("double"), F.lit(True), F.col("width"), F.col("height"))
    return v.annotations.select("image_id", "ord", px[0].alias("p")).select("image_id", "ord", "p.*")


@query("geo_14_render_numbers", f"SELECT image_id, ord::BIGINT AS ord, {r('greatest(least(x, width - 20.0), 0)', 'tag_x')}, {r('CASE WHEN y - 12 >= 0 THEN y - 12 WHEN y + h + 12 <= height THEN y + h ELSE greatest(y, 0) END', 'tag_y')}, greatest(least(width, height) // 200, 3)::BIGINT AS line FROM annotations")
def _(v):
    t = geo.tag_position(F.struct("x", "y", "w", "h"), F.lit(20.0), F.lit(12.0), F.col("width"), F.col("height"))
    return v.annotations.select("image_id", "ord", t["x"].alias("tag_x"), t["y"].alias("tag_y"), geo.line_width(F.col("width"), F.col("height")).alias("line"))


@query("col_02_colour_similarity", f"SELECT p_partkey, {r('1 - sqrt(power(p_size - 10, 2) + power(p_size * 3 % 256 - 20, 2) + power(p_size * 7 % 256 - 30, 2)) / sqrt(3.0 * 255 * 255)', 's')} FROM part")
def _(v):
    rgb = F.array(F.col("p_size").cast("double"), (F.col("p_size") * 3 % 256).cast("double"), (F.col("p_size") * 7 % 256).cast("double"))
    return v.part.select("p_partkey", geo.colour_similarity(rgb, F.array(F.lit(10.0), F.lit(20.0), F.lit(30.0))).alias("s"))


@query("math_01_log_scale", f"SELECT event_id, {r(LOG_SCALE.format(v='value', lo='1', hi='40'), 's')} FROM events")
def _(v):
    return v.events.select("event_id", den.log_scale(F.col("value"), 1, 40).alias("s"))


@query("math_02_density_score", f"SELECT image_id, {r(SCORE, 's')} FROM {COUNTED}")
def _(v):
    g = v.annotations.groupBy("image_id").agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("h")) / 480000).alias("c"))
    return g.select("image_id", den.density_score(F.col("n"), F.col("c")).alias("s"))


@query("math_03_rounding", "SELECT event_id, round_even(event_id / 4.0, 0) + 0.0 AS half_even, floor(event_id / 4.0 + 0.5)::BIGINT AS half_up FROM events")
def _(v):
    x = F.col("event_id") / 4
    return v.events.select("event_id", stats.round_half_even(x).alias("half_even"), stats.round_half_up(x).alias("half_up"))


@query("math_04_backoff", "SELECT id, greatest(least(60.0, 2.0 * power(2.0, retries)), CASE WHEN id % 9 = 0 THEN 45.0 ELSE 0 END) + 0.0 AS wait FROM responses")
def _(v):
    return v.responses.select("id", stats.backoff(F.col("retries") + 1, 2.0, 60.0, F.when(F.col("id") % 9 == 0, 45.0)).alias("wait"))


@query("math_05_row_mean", f"SELECT response_id, (coalesce(visual1, 0) + coalesce(visual2, 0))::BIGINT AS total, {r('(coalesce(visual1, 0) + coalesce(visual2, 0)) / ((visual1 IS NOT NULL)::INT + (visual2 IS NOT NULL)::INT)', 'mean')} FROM judges")
def _(v):
    c = [F.col("visual1"), F.col("visual2")]
    return v.judges.select("response_id", stats.row_sum(*c).alias("total"), stats.row_mean(*c).alias("mean"))


@query("math_06_rank_distance", "SELECT event_id, abs(event_id % 4 - event_id % 3)::BIGINT AS d FROM events")
def _(v):
    return v.events.select("event_id", den.rank_distance(den.level_name((F.col("event_id") % 4).cast("int")), den.level_name((F.col("event_id") % 3).cast("int"))).alias("d"))


@query("hash_01_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(v):
    return v.documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("hash_02_response_id", "SELECT id, (('0x' || sha256(run || chr(31) || model || chr(31) || question_id)[1:16])::UBIGINT >> 2)::BIGINT AS h FROM responses")
def _(v):
    return v.responses.select("id", hashing.response_id(F.col("run"), F.col("model"), F.col("question_id")).alias("h"))


@query("fn_01_arrays", "SELECT question_id, json_array_length(choices)::BIGINT AS n, contains(choices, '\"purchase\"') AS offered FROM questions")
def _(v):
    c = jsonx.decode_array(F.col("choices"))
    return v.questions.select("question_id", F.size(c).alias("n"), F.array_contains(c, "purchase").alias("offered"))


@query("fn_02_latest_time", "SELECT model, strftime(max(created_at), '%Y-%m-%dT%H:%M:%S') AS last FROM responses GROUP BY model")
def _(v):
    return latest(v).groupBy("model").agg(F.date_format(F.max("created_at"), "yyyy-MM-dd'T'HH:mm:ss").alias("last"))
