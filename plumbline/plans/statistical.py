"""Statistics, selections, generators and scoring on the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import jsonx
from plumbline.functions.hashing import draw_key
from plumbline.functions.stats import joint_failures
from plumbline.operators import aggregates as agg
from plumbline.operators import checks, fitting, generate, ranges, scoring, selection, statistics, windows
from plumbline.operators import classify as cas
from plumbline.plans.registry import query
from plumbline.plans.relational import FLAGGED, LATEST, MODELS, flagged, latest, r, wilson_sql
from plumbline.operators.reshape import with_row_index
from plumbline.plans.scalars import CELL_AREA, COUNTED, PAIR_RULE, PAIRS, SCORE, TRUTH_BOXES, greedy_sql

FLAGS = ["perception", "knowledge", "evaluation", "unsure"]


def wilson_cols(k: str, n: str) -> str:
    return f"{r(wilson_sql(k, n, '-'), 'lo')}, {r(wilson_sql(k, n, '+'), 'hi')}"


@query("stat_01_wilson", f"SELECT event_id, {r(wilson_sql('(event_id % 7)', '(event_id % 7 + event_id % 5)', '-'), 'lo')}, {r(wilson_sql('(event_id % 7)', '(event_id % 7 + event_id % 5)', '+'), 'hi')} FROM events")
def _(v):
    from plumbline.functions.stats import wilson

    lo, hi = wilson(F.col("event_id") % 7, F.col("event_id") % 7 + F.col("event_id") % 5)
    return v.events.select("event_id", lo.alias("lo"), hi.alias("hi"))


@query("stat_02_wilson_table", f"SELECT model, task, count(correct) AS n, count_if(correct) AS k, {r('count_if(correct) / count(correct)', 'rate')}, {wilson_cols('count_if(correct)', 'count(correct)')} FROM scored GROUP BY model, task")
def _(v):
    """Accuracy with 95 % intervals by model and task."""
    return statistics.wilson_table(v.scored, ["model", "task"], F.col("correct"))


def replicates_sql(clusters: str, n_boot: int, alpha: float = 0.05) -> str:
    """n, estimate, lo and hi by model over clusters (model, code, o, u), in the hash arithmetic of the operator."""
    weight = " + ".join(f"(xor(y, y >> 16) / 4294967296.0E0 >= {c!r}E0)::INT" for c in statistics.POISSON)
    return f"""WITH c AS ({clusters}), b AS (SELECT unnest(range(1, {n_boot + 1})) AS b),
    x0 AS (SELECT model, o, u, b, xor(code, (b * {0x9E3779B1} + {statistics.SEED}) & 4294967295) AS x FROM c, b), x1 AS (SELECT model, o, u, b, (xor(x, x >> 16) * {0x45D9F3B}) & 4294967295 AS x FROM x0),
    y AS (SELECT model, o, u, b, (xor(x, x >> 16) * {0x45D9F3B}) & 4294967295 AS y FROM x1), w AS (SELECT model, o, u, b, {weight} AS w FROM y),
    q AS (SELECT model, b, sum(w * o) / nullif(sum(w * u), 0) AS q FROM w GROUP BY model, b), e AS (SELECT model, count(*) AS n, sum(o) / sum(u) AS estimate FROM c GROUP BY model)
    SELECT model, e.n, {r('e.estimate', 'estimate')}, {r(f'quantile_cont(q, {alpha / 2})', 'lo')}, {r(f'quantile_cont(q, {1 - alpha / 2})', 'hi')} FROM q JOIN e USING (model) GROUP BY model, e.n, e.estimate"""


@query("stat_03_bootstrap_clusters", replicates_sql("SELECT model, question_id AS code, sum(correct::INT)::DOUBLE AS o, count(correct)::DOUBLE AS u FROM scored WHERE status = 'ok' GROUP BY model, question_id", 200))
def _(v):
    """Accuracy, resampled over questions with all their responses."""
    rows = v.scored.where("status = 'ok'")
    return statistics.bootstrap_ratio(rows, ["model"], F.col("correct").cast("int"), F.col("correct").isNotNull().cast("int"), ["question_id"], n_boot=200)


def _mean_c(part):
    return part["c"].mean()


@query("stat_04_bootstrap_means", replicates_sql("SELECT model, id AS code, correct::INT::DOUBLE AS o, 1.0E0 AS u FROM scored WHERE status = 'ok' AND correct IS NOT NULL", 200))
def _(v):
    """The same for means over responses."""
    rows = v.scored.where("status = 'ok'").withColumn("c", F.col("correct").cast("double"))
    return statistics.bootstrap_mean(rows, ["model"], "c", ["id"], n_boot=200)


ESTIMATES = f"SELECT model, count(*) AS n, {r('avg(correct::INT)', 'estimate')}, true AS inside FROM scored WHERE status = 'ok' GROUP BY model"


@query("stat_03_cluster_estimates", ESTIMATES)
def _(v):
    """Estimates of the cluster bootstrap, which its interval must hold."""
    rows = v.scored.where("status = 'ok'").select("model", "question_id", "id", F.col("correct").cast("double").alias("c"))
    got = statistics.bootstrap_by(rows, ["model"], _mean_c, ["id"], "question_id", n_boot=100)
    return got.select("model", "n", "estimate", F.col("estimate").between(F.col("lo"), F.col("hi")).alias("inside"))


@query("stat_04_mean_estimates", ESTIMATES)
def _(v):
    rows = v.scored.where("status = 'ok'").withColumn("c", F.col("correct").cast("double"))
    got = statistics.bootstrap_mean(rows, ["model"], "c", ["id"], n_boot=100)
    return got.select("model", "n", "estimate", F.col("estimate").between(F.col("lo"), F.col("hi")).alias("inside"))


FIRST = "(SELECT question_id, min_by(correct::INT, id) FILTER (model = 'm0' AND correct IS NOT NULL) AS a, min_by(correct::INT, id) FILTER (model = 'm1' AND correct IS NOT NULL) AS b FROM scored GROUP BY question_id)"


@query("stat_05_paired_difference", f"SELECT count(*) AS n, {r('avg(a - b)', 'mean')} FROM {FIRST.replace('min_by(correct::INT, id)', 'max(correct::INT)')} WHERE a IS NOT NULL AND b IS NOT NULL")
def _(v):
    best = v.scored.groupBy("question_id", "model").agg(F.max(F.col("correct").cast("int")).alias("c")).where("c is not null")
    diffs = statistics.paired_differences(best, "model", "m0", "m1", "c", "question_id")
    return diffs.agg(F.count("*").alias("n"), F.avg("difference").alias("mean"))


@query("stat_06_quantiles", f"SELECT model, {r('quantile_cont(latency, 0.025)', 'lo')}, {r('quantile_cont(latency, 0.5)', 'mid')}, {r('quantile_cont(latency, 0.975)', 'hi')} FROM responses GROUP BY model")
def _(v):
    return ranges.group_quantiles(v.responses, ["model"], F.col("latency"), [0.025, 0.5, 0.975], ["lo", "mid", "hi"])


def kappa_sql(gap: str, by: str = "task") -> str:
    return f"""WITH c AS (SELECT {by}, interpretation1 AS a, interpretation2 AS b, count(*)::DOUBLE AS n FROM judges GROUP BY ALL), ra AS (SELECT {by}, a, sum(n) AS n FROM c GROUP BY ALL), rb AS (SELECT {by}, b, sum(n) AS n FROM c GROUP BY ALL),
    o AS (SELECT {by}, sum(n * {gap}) AS o, sum(n) AS t FROM c GROUP BY {by}), e AS (SELECT ra.{by}, sum(ra.n * rb.n * {gap}) AS e FROM ra JOIN rb ON rb.{by} = ra.{by} GROUP BY ra.{by})
    SELECT o.{by}, t::BIGINT AS n, CASE WHEN e > 0 THEN round(1 - o * t / e, 9) + 0.0 END AS kappa FROM o JOIN e ON e.{by} = o.{by}"""


for _name, _weights, _gap in (("unweighted", None, "(a <> b)::INT"), ("linear", "linear", "abs(a - b)"), ("quadratic", "quadratic", "power(a - b, 2)")):
    query(f"stat_07_kappa_{_name}", kappa_sql(_gap))(lambda v, w=_weights: statistics.kappa(v.judges, ["task"], "interpretation1", "interpretation2", w))


@query("stat_08_degenerate_kappa", "SELECT task, count(*) AS n, NULL::DOUBLE AS kappa FROM judges GROUP BY task")
def _(v):
    return statistics.kappa(v.judges.withColumns({"a": F.lit(1), "b": F.lit(1)}), ["task"], "a", "b")


@query("stat_09_agreement", f"SELECT task, {r('avg((visual1 = visual2)::INT)', 'exact')}, {r('avg((abs(visual1 - visual2) <= 1)::INT)', 'within_one')}, {r('avg((visual1 > visual2)::INT)', 'a_higher')}, {r('avg((visual1 < visual2)::INT)', 'b_higher')}, {r('avg(visual1 - visual2)', 'mean_difference')} FROM judges GROUP BY task")
def _(v):
    return statistics.agreement(v.judges, ["task"], "visual1", "visual2")


@query("stat_10_spearman", "WITH k AS (SELECT task, rank() OVER (PARTITION BY task ORDER BY interpretation1) + (count(*) OVER (PARTITION BY task, interpretation1) - 1) / 2 AS a, rank() OVER (PARTITION BY task ORDER BY knowledge2) + (count(*) OVER (PARTITION BY task, knowledge2) - 1) / 2 AS b FROM judges) SELECT task, round(corr(a, b), 9) + 0.0 AS spearman, count(*) AS n FROM k GROUP BY task")
def _(v):
    return statistics.spearman(v.judges, ["task"], "interpretation1", "knowledge2")


FLAG_ROWS = f"(SELECT task, flag, list_contains(flags1, flag)::INT AS a, list_contains(flags2, flag)::INT AS b FROM {FLAGGED}, (SELECT unnest({FLAGS}) AS flag))"


@query("stat_11_flag_kappa", f"SELECT task, flag, count(*) AS n, CASE WHEN (sum(a) * sum(1 - b) + sum(1 - a) * sum(b)) > 0 THEN round(1 - sum((a <> b)::INT)::DOUBLE * count(*) / (sum(a)::DOUBLE * sum(1 - b) + sum(1 - a)::DOUBLE * sum(b)), 9) + 0.0 END AS kappa FROM {FLAG_ROWS} GROUP BY task, flag")
def _(v):
    return statistics.flag_kappa(flagged(v), ["task"], FLAGS, "flags1", "flags2")


@query("stat_12_prevalence", f"SELECT task, flag, count(*) AS n, count_if(a = 1 AND b = 1) AS k, {r('count_if(a = 1 AND b = 1) / count(*)', 'rate')}, {wilson_cols('count_if(a = 1 AND b = 1)', 'count(*)')} FROM {FLAG_ROWS} GROUP BY task, flag")
def _(v):
    return statistics.prevalence(flagged(v), ["task"], FLAGS, "flags1", "flags2", strict=True)


@query("stat_13_expected_overlap", "WITH p AS (SELECT max(f) FILTER (model = 'm0') AS a, max(f) FILTER (model = 'm1') AS b FROM (SELECT model, avg((status = 'failed')::INT) AS f FROM responses GROUP BY model)) SELECT 0::BIGINT AS failures, round((1 - a) * (1 - b), 9) + 0.0 AS probability FROM p UNION ALL SELECT 1, round(a * (1 - b) + b * (1 - a), 9) FROM p UNION ALL SELECT 2, round(a * b, 9) FROM p")
def _(v):
    rates = agg.rate(v.responses.where("model in ('m0', 'm1')"), ["model"], F.col("status") == "failed")
    return statistics.expected_overlap(rates)


@query("stat_14_observed_overlap", f"SELECT failures, count(*) AS n FROM (SELECT question_id, count_if(status = 'failed') AS failures FROM {LATEST} GROUP BY question_id) GROUP BY failures")
def _(v):
    return statistics.observed_overlap(latest(v), "question_id", F.col("status") == "failed")


@query("stat_15_co_abstention", f"WITH w AS (SELECT question_id, model, max((status = 'failed')::INT) AS x FROM {LATEST} GROUP BY ALL) SELECT p.model AS a, q.model AS b, {r('avg(p.x * q.x)', 'observed')}, {r('avg(p.x) * avg(q.x)', 'expected')}, count(*) AS n FROM w p JOIN w q ON q.question_id = p.question_id AND p.model < q.model GROUP BY ALL")
def _(v):
    rows = latest(v).withColumn("x", F.col("status") == "failed")
    return statistics.co_abstention(rows, "question_id", "model", "x", MODELS)


@query("stat_16_others_given", f"WITH s AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY model, question_id ORDER BY id) = 1) SELECT a.model AS given, a.status = 'failed' AS abstained, {r('avg(b.correct::INT)', 'accuracy')}, count(b.correct) AS n FROM s a JOIN s b ON b.question_id = a.question_id AND b.model <> a.model GROUP BY ALL")
def _(v):
    rows = windows.earliest(v.scored.select("model", "question_id", "id", "status", "correct"), ["model", "question_id"], ["id"])
    return statistics.others_given(rows, "question_id", "model", F.col("status") == "failed", F.col("correct"))


@query("stat_17_chance", f"SELECT task, {r('avg(1.0 / json_array_length(choices))', 'chance')} FROM questions GROUP BY task")
def _(v):
    return statistics.chance_level(v.questions, ["task"], jsonx.decode_array(F.col("choices")))


@query("stat_18_rule_agreement", f"SELECT count(*) AS n, {r('avg((interpretation1 = knowledge1)::INT)', 'exact')}, {r('avg((abs(interpretation1 - knowledge1) <= 1)::INT)', 'within_one')}, {r('avg(abs(interpretation1 - knowledge1))', 'mean_error')} FROM judges")
def _(v):
    return fitting.measure(v.judges, "interpretation1", F.col("knowledge1"))


# -- selections: draws sort by md5 of the seed and the key, which every engine has


def rank(by: str, key: str, seed: int = 0, first: str = "") -> str:
    over = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({over}ORDER BY {first}md5('{seed}:' || {key}), {key})"


@query("sel_01_quota_fixed_classes", f"SELECT question_id, expected_answer FROM questions QUALIFY {rank('expected_answer', 'question_id')} <= 20")
def _(v):
    return selection.quota(v.questions, "expected_answer", ["question_id"], per_class=20).select("question_id", "expected_answer")


@query("sel_01_quota_chosen_classes", f"WITH c AS (SELECT p_type FROM part GROUP BY p_type ORDER BY md5('5:' || p_type), p_type LIMIT 3) SELECT p_partkey, p_type FROM part WHERE p_type IN (SELECT p_type FROM c) QUALIFY {rank('p_type', 'p_partkey', 5)} <= 10")
def _(v):
    return selection.quota(v.part, "p_type", ["p_partkey"], per_class=10, classes=3, seed=5).select("p_partkey", "p_type")


@query(
    "sel_02_coupled_quota",
    f"""WITH weeds AS (SELECT * FROM annotations WHERE role = 'weed' AND ord <= 3), p AS (SELECT species FROM weeds GROUP BY species HAVING count(*) >= 10),
    b AS (SELECT species, species IN (SELECT species FROM p) AS able FROM annotations GROUP BY species HAVING count(*) >= 10),
    k AS (SELECT *, row_number() OVER (ORDER BY NOT able, md5('2:' || species), species) AS place FROM b),
    x AS (SELECT *, {rank('species', "image_id || ':' || ord", 2)} AS n FROM annotations), y AS (SELECT *, {rank('species', "image_id || ':' || ord", 2)} AS n FROM weeds)
    SELECT image_id, ord::BIGINT AS ord, species, true AS boxed FROM x WHERE n <= 10 AND species IN (SELECT species FROM k WHERE place <= 4)
    UNION ALL SELECT image_id, ord::BIGINT, species, false FROM y WHERE n <= 10 AND species IN (SELECT species FROM k WHERE able AND place <= 2)""",
)
def _(v):
    boxed, plain = selection.coupled_quota(v.annotations, v.annotations.where("role = 'weed' and ord <= 3"), "species", ["image_id", "ord"], 4, 2, 10, seed=2)
    return boxed.select("image_id", "ord", "species", F.lit(True).alias("boxed")).unionByName(plain.select("image_id", "ord", "species", F.lit(False).alias("boxed")))


@query("sel_03_density_pair", f"WITH b AS (SELECT * FROM images QUALIFY {rank('dataset', 'image_id', 1)} <= 40) SELECT image_id, true AS boxed FROM b UNION ALL SELECT image_id, false FROM (SELECT * FROM b QUALIFY {rank('dataset', 'image_id', 2)} <= 15)")
def _(v):
    boxed = selection.quota(v.images, "dataset", ["image_id"], per_class=40, seed=1)
    plain = selection.quota(v.images.join(boxed.select("image_id"), "image_id", "left_semi"), "dataset", ["image_id"], per_class=15, seed=2)
    return boxed.select("image_id", F.lit(True).alias("boxed")).unionByName(plain.select("image_id", F.lit(False).alias("boxed")))


@query("sel_04_random_share", f"SELECT question_id FROM questions QUALIFY {rank('', 'question_id', 4)} <= round_even(count(*) OVER () * 0.2, 0)")
def _(v):
    return selection.fraction(v.questions, [], ["question_id"], 0.2, seed=4).select("question_id")


STRATUM = "question_type, annotated, expected_answer"


@query("sel_05_stratified_subset", f"""WITH o AS (SELECT question_id, ablation_of FROM questions WHERE question_type = 'open_ended' QUALIFY {rank(STRATUM, 'question_id', 9)} <= greatest(1, floor(count(*) OVER (PARTITION BY {STRATUM}) * 0.3 + 0.5)))
SELECT question_id FROM o UNION ALL SELECT question_id FROM questions q WHERE question_type <> 'open_ended' QUALIFY {rank(STRATUM, 'question_id', 9, '(question_id IN (SELECT ablation_of FROM o)) DESC, ')} <= greatest(1, floor(count(*) OVER (PARTITION BY {STRATUM}) * 0.3 + 0.5))""")
def _(v):
    return selection.stratified(v.questions, ["question_type", "annotated", "expected_answer"], "question_id", 0.3, F.col("question_type") == "open_ended", "ablation_of", seed=9).select("question_id")


@query("sel_06_k_per_task", f"SELECT question_id FROM questions QUALIFY {rank('task', 'question_id', 6)} <= 7 ORDER BY question_id")
def _(v):
    return selection.sample_n(v.questions, ["task"], ["question_id"], 7, seed=6).orderBy("question_id").select("question_id")


@query("sel_07_right_and_wrong", f"SELECT id FROM scored WHERE correct QUALIFY {rank('run', 'id', 7)} <= round_even(count(*) OVER (PARTITION BY run) * 0.1, 0) UNION ALL SELECT id FROM scored WHERE NOT correct QUALIFY {rank('run', 'id', 7)} <= 30")
def _(v):
    return selection.right_and_wrong(v.scored.where("correct is not null"), ["run"], ["id"], F.col("correct"), 0.1, 30, seed=7).select("id")


@query("sel_08_tercile_sample", f"WITH e AS (SELECT quantile_cont(latency, 1.0 / 3) AS a, quantile_cont(latency, 2.0 / 3) AS b FROM responses), t AS (SELECT id, run, CASE WHEN latency <= a THEN 'low' WHEN latency <= b THEN 'medium' ELSE 'high' END AS quality FROM responses, e) SELECT id, quality FROM t QUALIFY {rank('run, quality', 'id', 8)} <= 12")
def _(v):
    return selection.sample_n(windows.tercile_bins(v.responses, "latency"), ["run", "quality"], ["id"], 12, seed=8).select("id", "quality")


@query("sel_10_round_robin", f"SELECT id FROM (SELECT *, {rank('task, question_type', 'id', 0)} AS k FROM scored) ORDER BY k, task, question_type, id LIMIT 60")
def _(v):
    return selection.spread(v.scored, ["task", "question_type"], ["id"], 60).select("id")


@query("sel_11_cells", "WITH a AS (SELECT id, expected_answer, annotated, dataset, row_number() OVER (PARTITION BY expected_answer, annotated, dataset ORDER BY md5('0:' || id), id) AS i FROM scored), b AS (SELECT *, row_number() OVER (PARTITION BY expected_answer, annotated ORDER BY i, md5('0:' || dataset), dataset) AS k FROM a) SELECT id FROM b ORDER BY k, md5('0:' || expected_answer || ':' || annotated), expected_answer, annotated LIMIT 50")
def _(v):
    return selection.cell_spread(v.scored, ["expected_answer", "annotated"], "dataset", ["id"], 50).select("id")


@query("sel_12_per_species_review", f"SELECT DISTINCT image_id FROM (SELECT image_id FROM (SELECT DISTINCT image_id, species FROM annotations) QUALIFY {rank('species', 'image_id', 12)} <= 10)")
def _(v):
    return selection.sample_n(v.annotations.select("image_id", "species").distinct(), ["species"], ["image_id"], 10, seed=12).select("image_id").distinct()


POOL = "['economy', 'large', 'medium', 'promo', 'small', 'standard']"


@query("sel_13_distractors", f"""WITH p AS (SELECT p_partkey AS k, lower(p_type) AS t FROM part), o AS (SELECT k, t, unnest({POOL}) AS s FROM p), d AS (SELECT k, s FROM o WHERE s <> t QUALIFY row_number() OVER (PARTITION BY k ORDER BY md5('0:pick:' || k || ':' || s), s) <= 3),
m AS (SELECT k, s FROM d UNION ALL SELECT k, t FROM p) SELECT p.k AS p_partkey, string_agg(m.s, ',' ORDER BY md5('0:order:' || m.k || ':' || m.s), m.s) AS choices, (list_position(list(m.s ORDER BY md5('0:order:' || m.k || ':' || m.s), m.s), any_value(p.t)) - 1)::BIGINT AS answer_index FROM m JOIN p ON p.k = m.k GROUP BY p.k""")
def _(v):
    pool = F.array(*[F.lit(s) for s in ("economy", "large", "medium", "promo", "small", "standard")])
    q = selection.distractors(v.part, pool, F.lower("p_type"), F.col("p_partkey").cast("string"), 4)
    return q.select("p_partkey", F.array_join("choices", ",").alias("choices"), "answer_index")


@query("sel_14_sorted_worst_first", "SELECT question_id, n, row_number() OVER (ORDER BY n, question_id) - 1 AS position FROM (SELECT question_id, min(n) AS n FROM (SELECT question_id, model, count_if(correct) AS n FROM scored GROUP BY ALL) GROUP BY question_id)")
def _(v):
    per = v.scored.groupBy("question_id", "model").agg(F.count_if(F.col("correct")).alias("n"))
    return with_row_index(per.groupBy("question_id").agg(F.min("n").alias("n")), ["n", "question_id"], "position")


@query("sel_15_example_per_group", "SELECT task, question_id FROM questions QUALIFY row_number() OVER (PARTITION BY task ORDER BY question_id) = 3")
def _(v):
    return selection.example_of(v.questions, ["task"], ["question_id"], 2).select("task", "question_id")


@query("sel_16_folds", f"SELECT question_id, (({rank('', 'question_id', 3)} - 1) % 5)::BIGINT AS fold FROM questions")
def _(v):
    return selection.folds(v.questions, ["question_id"], 5, seed=3).select("question_id", "fold")


@query("sel_17_question_major", "SELECT question_id, model, row_number() OVER (ORDER BY question_id, model) - 1 AS position FROM (SELECT DISTINCT question_id FROM questions) CROSS JOIN (SELECT DISTINCT model FROM responses)")
def _(v):
    jobs = v.questions.select("question_id").withColumn("model", F.explode(F.array(*map(F.lit, MODELS))))
    return with_row_index(jobs, ["question_id", "model"], "position")


@query("sel_18_shuffled_head", "SELECT question_id, row_number() OVER (ORDER BY md5('18:' || question_id), question_id) - 1 AS position FROM questions")
def _(v):
    return with_row_index(v.questions.select("question_id"), [draw_key(18, F.col("question_id")), "question_id"], "position")


# -- generators, scoring and checks

WEED_POOL = "(SELECT dataset, list_sort(list(DISTINCT species)) AS pool FROM annotations WHERE role = 'weed' GROUP BY dataset)"


@query("gen_01_boxed_species", f"SELECT dataset || ':' || image_id || ':' || species || ':species_mc' AS id, species, count(*) AS n_boxes FROM annotations WHERE role = 'weed' AND width * height > 0 GROUP BY dataset, image_id, species, width, height HAVING sum(w * h) / (width * height) >= 0.02")
def _(v):
    return generate.species_questions(v.annotations, share=0.02).select("id", "species", "n_boxes")


@query("gen_02_plain_species", "WITH s AS (SELECT image_id, min(species) AS species FROM annotations WHERE role = 'weed' GROUP BY image_id HAVING count(DISTINCT species) = 1) SELECT a.dataset || ':' || a.image_id || ':' || a.species || ':species_mc:unannotated' AS id, count(*) AS n_boxes FROM annotations a JOIN s ON s.image_id = a.image_id AND s.species = a.species WHERE width * height > 0 GROUP BY a.dataset, a.image_id, a.species, a.width, a.height HAVING sum(w * h) / (a.width * a.height) >= 0.02")
def _(v):
    return generate.plain_species_questions(v.annotations, share=0.02).select("id", "n_boxes")


@query("gen_03_open_ended", f"WITH q AS (SELECT dataset || ':' || image_id || ':' || species || ':species_mc' AS id FROM annotations WHERE role = 'weed' AND width * height > 0 GROUP BY dataset, image_id, species, width, height HAVING sum(w * h) / (width * height) >= 0.02) SELECT id || ':open_ended' AS id, id AS ablation_of FROM q QUALIFY {rank('', 'id', 0)} <= round_even(count(*) OVER () * 0.2, 0)")
def _(v):
    return generate.open_ended(generate.species_questions(v.annotations, share=0.02)).select("id", "ablation_of")


@query("gen_04_fine_grained", f"SELECT dataset || ':' || image_id || ':' || ord_a || '-' || ord_b || ':fine_grained' AS id, species_a, species_b FROM {PAIRS} WHERE {PAIR_RULE} QUALIFY row_number() OVER (PARTITION BY dataset, image_id ORDER BY md5('0:' || image_id || ':' || ord_a || ':' || ord_b), ord_a, ord_b) <= 2")
def _(v):
    return generate.fine_grained_questions(v.annotations, most=2).select("id", "species_a", "species_b")


WEED_AREA = CELL_AREA.replace("FROM annotations", "FROM weeds")


DENSITY_SQL = f"""WITH weeds AS (SELECT * FROM annotations WHERE role = 'weed'), f AS (SELECT i.dataset, i.image_id, count(a.ord) AS n, coalesce(any_value(u.area), 0) / (i.width * i.height) AS c FROM images i LEFT JOIN weeds a ON a.image_id = i.image_id LEFT JOIN {WEED_AREA} u ON u.image_id = i.image_id WHERE i.width * i.height > 0 GROUP BY i.dataset, i.image_id, i.width, i.height)
SELECT dataset || ':' || image_id || ':density:' || k AS id, CASE WHEN n = 0 THEN 'none' WHEN {SCORE} >= 0.6 AND n >= 5 THEN 'high' WHEN {SCORE} >= 0.3 AND n >= 2 THEN 'medium' ELSE 'low' END AS benchmark_class, n AS true_count, {r('c', 'true_coverage')} FROM f, (SELECT unnest(['boxed', 'unannotated']) AS k)"""


@query("gen_05_density", DENSITY_SQL)
def _(v):
    return generate.density_questions(v.images, v.annotations).select("id", "benchmark_class", "true_count", "true_coverage")


GROUNDED_SQL = f"""WITH u AS (SELECT * FROM {CELL_AREA}), g AS (SELECT image_id FROM annotations JOIN u USING (image_id) WHERE width * height > 0 GROUP BY image_id, width, height
    HAVING any_value(area) / (width * height) >= 0.05 AND count(DISTINCT species) FILTER (WHERE role = 'weed') >= 1
    AND sqrt(power((sum((x + w / 2) * w * h) / sum(w * h) - width / 2.0) / (width / 2.0), 2) + power((sum((y + h / 2) * w * h) / sum(w * h) - height / 2.0) / (height / 2.0), 2)) / sqrt(2.0) <= 0.7),
    n AS (SELECT dataset, image_id, species, bool_or(role = 'weed') AS target, count(*) AS n_boxes FROM annotations JOIN g USING (image_id) GROUP BY dataset, image_id, species),
    m AS (SELECT *, dense_rank() OVER (PARTITION BY dataset, image_id ORDER BY md5('0:' || image_id || ':' || species), species) AS number FROM n)
    SELECT dataset || ':' || image_id || ':' || species || ':grounded' AS id, dataset, image_id, species, number, n_boxes FROM m WHERE target"""


@query("gen_06_grounded", GROUNDED_SQL)
def _(v):
    return generate.grounded_questions(v.annotations)


@query("gen_07_localisation", "WITH busy AS (SELECT image_id FROM annotations WHERE width * height > 0 GROUP BY image_id HAVING count(*) >= 3 AND count(DISTINCT species) >= 2) SELECT dataset || ':' || image_id || ':' || species || ':localisation' AS id, count(*) AS n_boxes FROM annotations WHERE image_id IN (SELECT image_id FROM busy) GROUP BY dataset, image_id, species HAVING count(*) <= 5 AND min(w * h / (width * height)) >= 0.005")
def _(v):
    return generate.localisation_questions(v.annotations).select("id", F.size("boxes").alias("n_boxes"))


@query("gen_08_render_plan", "SELECT dataset || '/' || image_id AS source, 'out/' || replace(dataset, ' ', '_') || '_' || image_id || '_boxed.jpg' AS out_path, count(*) AS n FROM annotations GROUP BY dataset, image_id")
def _(v):
    return generate.render_plan(v.boxes, "boxes", "out", "boxed").select("source", "out_path", F.size("labelled_boxes").alias("n"))


@query("agg_25_scene_features", f"WITH weeds AS (SELECT * FROM annotations WHERE role = 'weed') SELECT i.image_id, count(a.ord) AS n, {r('coalesce(any_value(u.area), 0) / (i.width * i.height)', 'coverage')}, {r('coalesce(median(a.w * a.h), 0) / (i.width * i.height)', 'typical_size')} FROM images i LEFT JOIN weeds a ON a.image_id = i.image_id LEFT JOIN {WEED_AREA} u ON u.image_id = i.image_id WHERE i.width * i.height > 0 GROUP BY i.image_id, i.width, i.height")
def _(v):
    return generate.scene_features(v.images, v.annotations).select("image_id", F.col("count").alias("n"), "coverage", "typical_size")


@query("sco_01_species_match", "SELECT id, coalesce(answer = expected_answer OR (expected_answer = 'purchase' AND answer = 'signup'), false) AS match FROM scored")
def _(v):
    return scoring.species_match(v.scored, {"purchase": ["Signup."]}).select("id", "match")


@query("sco_02_task_match", "SELECT id, answer = expected_answer AS match FROM scored")
def _(v):
    return v.scored.select("id", scoring.task_match(F.col("answer"), F.col("expected_answer"), F.col("question_type")).alias("match"))


REPLIED_BOXES = "SELECT image_id, j, least(greatest(least(a, c), 0.0), width) AS x1, least(greatest(least(b, d), 0.0), height) AS y1, least(greatest(greatest(a, c), 0.0), width) AS x2, least(greatest(greatest(b, d), 0.0), height) AS y2 FROM (SELECT image_id, ord - 1 AS j, width::DOUBLE AS width, height::DOUBLE AS height, x * 1000 / width * (width / 1000.0::DOUBLE) AS a, y * 1000 / 600 * (height / 1000.0::DOUBLE) AS b, (x + w) * 1000 / width * (width / 1000.0::DOUBLE) AS c, (y + h) * 1000 / 600 * (height / 1000.0::DOUBLE) AS d FROM annotations WHERE height > 0)"


@query("sco_03_localisation", greedy_sql(TRUTH_BOXES, REPLIED_BOXES, ""))
def _(v):
    """Each image's boxes answered in JSON on the 0-1000 scale, read back and scored."""
    reply = F.to_json(F.transform("boxes", lambda b: F.array(b["y"] * 1000 / 600, b["x"] * 1000 / F.col("width"), (b["y"] + b["h"]) * 1000 / 600, (b["x"] + b["w"]) * 1000 / F.col("width"))))
    rows = v.boxes.where("height > 0").withColumns({"reply": reply, "said": F.lit("[ymin, xmin, ymax, xmax] normalised to 1000")})
    return scoring.localisation_scores(rows, "reply", "said", "boxes").select("image_id", "true_box_count", "pred_box_count", "matched_iou", "localisation_score")


@query("sco_04_density_errors", f"SELECT id, est_count - true_count AS count_error, abs(est_count - true_count) AS abs_count_error, {r('latency - 100 * cost', 'coverage_error_pp')}, {r('abs(latency - 100 * cost)', 'abs_coverage_error_pp')} FROM scored")
def _(v):
    return scoring.density_errors(v.scored, "est_count", "true_count", "latency", "cost").select("id", "count_error", "abs_count_error", "coverage_error_pp", "abs_coverage_error_pp")


@query("sco_06_judge_scores", "WITH j AS (SELECT user_id AS response_id, CASE event_id % 2 WHEN 0 THEN 'textual' ELSE 'visual' END AS kind, event_id % 5 AS x, ts, event_id FROM events WHERE event_type <> 'error'), l AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY response_id, kind ORDER BY ts DESC) = 1) SELECT response_id, max(x) FILTER (kind = 'textual') AS j_knowledge, max(x) FILTER (kind = 'visual') AS j_visual FROM l GROUP BY response_id")
def _(v):
    textual = F.col("event_id") % 2 == 0
    scores = F.create_map(F.when(textual, "knowledge").otherwise("visual"), (F.col("event_id") % 5).cast("int"))
    j = v.events.select(F.col("user_id").alias("response_id"), F.when(textual, "textual").otherwise("visual").alias("kind"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), scores.alias("scores"), F.lit("judge").alias("judge_model"), F.col("ts").alias("judged_at"))
    return scoring.judge_scores(j, "j_", ["knowledge", "visual"]).select("response_id", "j_knowledge", "j_visual")


@query("sco_07_complete_judges", "SELECT r.id, a.visual1 IS NOT NULL AND b.visual2 IS NOT NULL AS evaluated FROM responses r LEFT JOIN judges a ON a.response_id = r.id LEFT JOIN judges b ON b.response_id = r.id")
def _(v):
    one, two = (v.judges.select("response_id", F.col(f"visual{k}").alias(f"judge{k}_visual")) for k in (1, 2))
    merged = scoring.merge_judges(v.responses.select("id").withColumn("judge1_old", F.lit(1)), [one, two], ["judge1_", "judge2_"], ["visual"])
    return merged.select("id", "evaluated")


@query("sco_08_taxonomy", f"SELECT model, flag, count(*) AS n FROM (SELECT model, unnest(list_filter(flags1, lambda x: list_contains(flags2, x))) AS flag FROM {FLAGGED}) GROUP BY ALL")
def _(v):
    return flagged(v).select("model", F.explode(F.array_intersect("flags1", "flags2")).alias("flag")).groupBy("model", "flag").agg(F.count("*").alias("n"))


@query("sco_05_metrics", f"SELECT model, CASE WHEN question_type IN ('multiple_choice', 'open_ended') THEN 'species/' || question_type || '/' || s WHEN question_type = 'density' THEN 'density/' || s ELSE question_type END AS suite, count(*) AS n, {r('count_if(outcome = $$correct$$) / count_if(status = $$ok$$)', 'accuracy')} FROM (SELECT *, CASE WHEN annotated THEN 'boxed' ELSE 'unannotated' END AS s FROM scored) GROUP BY ALL")
def _(v):
    rows = v.scored.withColumn("suite", cas.suite(F.col("question_type"), F.col("annotated")))
    return agg.accuracy_block(rows, ["model", "suite"], F.col("status") == "ok", F.col("outcome")).select("model", "suite", F.col("n_total").alias("n"), "accuracy")


def labelled_counts(v):
    """Images with their number of annotations, what these cover, and a class that a planted rule gives."""
    g = v.annotations.groupBy("image_id").agg(F.count("*").alias("count"), (F.sum(F.col("w") * F.col("h")) / 480000).alias("coverage"))
    return g.withColumns({"typical_size": F.lit(0.0), "spread": F.lit(0.0), "label": F.when(F.col("count") >= 6, 3).when(F.col("count") >= 3, 2).otherwise(1)})


@query("fit_01_refit", f"SELECT count(*) AS n, sum(abs((CASE WHEN {SCORE} >= 0.6 AND n >= 5 THEN 3 WHEN {SCORE} >= 0.3 AND n >= 2 THEN 2 ELSE 1 END) - (CASE WHEN n >= 6 THEN 3 WHEN n >= 3 THEN 2 ELSE 1 END)))::BIGINT AS before, true AS better FROM {COUNTED}")
def _(v):
    """The loss of the rule in use on all images, and that a refitted rule at least halves it."""
    from plumbline.functions.density import ScoreRule, density_level

    rows = labelled_counts(v)
    refit = fitting.fit_rule(rows, "label", ScoreRule(), steps=8, rounds=2)
    off = lambda rule: F.sum(F.abs(density_level(F.col("count"), F.col("coverage"), rule) - F.col("label")))
    return rows.agg(F.count("*").alias("n"), off(ScoreRule()).alias("before"), off(refit).alias("after")).select("n", "before", (2 * F.col("after") <= F.col("before")).alias("better"))


@query("fit_03_cross_validation", f"SELECT rule, fold, count(*) AS n, true AS good FROM (SELECT image_id, (({rank('', 'image_id', 0)} - 1) % 5)::BIGINT AS fold FROM (SELECT DISTINCT image_id FROM annotations)), (SELECT unnest(['refit', 'tree']) AS rule) GROUP BY rule, fold")
def _(v):
    """Five folds side by side: a tree finds the planted rule on every fold that it has not seen, a refitted rule comes near it."""
    from plumbline.functions.density import ScoreRule

    got = fitting.cross_validated(labelled_counts(v), "label", ["image_id"], ScoreRule(), steps=6, rounds=1)
    return got.select("rule", "fold", "n", (F.col("mean_error") <= F.when(F.col("rule") == "tree", 0.0).otherwise(0.25)).alias("good"))


@query("chk_01_integrity", "SELECT 'duplicate' AS problem, question_id AS key FROM responses WHERE model = 'm1' GROUP BY question_id HAVING count(*) > 1 UNION ALL SELECT 'dangling', question_id FROM questions WHERE ablation_of IS NOT NULL AND ablation_of + 396 NOT IN (SELECT question_id FROM questions)")
def _(v):
    twice = checks.duplicates(v.responses.where("model = 'm1'"), ["question_id"]).select(F.lit("duplicate").alias("problem"), F.col("question_id").alias("key"))
    q = v.questions.select("question_id", (F.col("ablation_of") + 396).alias("ablation_of"))
    return twice.unionByName(checks.dangling(q, "ablation_of", "question_id").select(F.lit("dangling").alias("problem"), F.col("question_id").alias("key")))


@query("chk_02_empty_tasks", "SELECT 'growth' AS task")
def _(v):
    return checks.empty_tasks(v.questions, ["species", "density", "growth"])


@query("fit_01_candidate_losses", f"SELECT {r('sum(abs((CASE WHEN {s} >= 0.6 AND n >= 5 THEN 3 WHEN {s} >= 0.3 AND n >= 2 THEN 2 ELSE 1 END) - least(n, 3)))::DOUBLE'.format(s=SCORE), 'loss')} FROM {COUNTED}")
def _(v):
    from plumbline.functions.density import density_level

    g = v.annotations.groupBy("image_id").agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("h")) / 480000).alias("c"))
    return g.agg(F.sum(F.abs(density_level(F.col("n"), F.col("c")) - F.least("n", F.lit(3)))).cast("double").alias("loss"))


@query("stm_07_retry_replay", "SELECT user_id, CASE WHEN n_bad > 3 THEN 'failed' WHEN n_ok > 0 THEN 'ok' ELSE 'open' END AS state FROM (SELECT user_id, count_if(event_type = 'error' AND k <= f) AS n_bad, count_if(event_type = 'purchase') AS n_ok FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, coalesce(min(CASE WHEN event_type = 'purchase' THEN rn END) OVER (PARTITION BY user_id), 1000000) AS f FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('error', 'purchase'))) GROUP BY user_id)")
def _(v):
    from plumbline.operators.reshape import collect_ordered
    from plumbline.streaming.log import replay_attempts

    rows = v.events.where("event_type in ('error', 'purchase')").withColumn("ord", F.struct("ts", "event_id")).withColumn("o", F.when(F.col("event_type") == "error", "transient").otherwise("ok"))
    lists = collect_ordered(rows, ["user_id"], "ord", ["o"], "s").select("user_id", F.transform("s", lambda x: x["o"]).alias("outcomes"))
    return replay_attempts(lists, ["user_id"], transient=3, parse=1).select("user_id", "state")


@query("stat_13_convolution", "SELECT event_id, round((1 - a) * (1 - b), 9) + 0.0 AS p0, round(a * (1 - b) + b * (1 - a), 9) + 0.0 AS p1, round(a * b, 9) + 0.0 AS p2 FROM (SELECT event_id, (event_id % 10) / 10.0::DOUBLE AS a, (event_id % 7) / 7.0::DOUBLE AS b FROM events)")
def _(v):
    p = joint_failures(F.array(F.col("event_id") % 10 / 10, F.col("event_id") % 7 / 7))
    return v.events.select("event_id", *[F.get(p, k).alias(f"p{k}") for k in range(3)])


def digit(k: int, top: int, key: str) -> str:
    return f"('0x' || substr(md5('5:{k}:' || {key}), 1, 6))::BIGINT % {top}"


@query("src_25_fixture", f"""WITH c AS (SELECT image_id, category, unnest(range(0, 1 + {digit(0, 2, "image_id || ':' || category")})) AS ord FROM (SELECT image_id, unnest([0, 1, 2]) AS category FROM images))
SELECT image_id, 'species ' || category AS species, ord::BIGINT AS ord, {', '.join(f'({digit(k, top, "image_id || chr(58) || category || chr(58) || ord")} + {more})::DOUBLE AS {n}' for k, top, more, n in ((1, 200, 0, 'x'), (2, 150, 0, 'y'), (3, 90, 20, 'w'), (4, 60, 20, 'h')))} FROM c""")
def _(v):
    """Made-up annotations of all images."""
    from plumbline.sources.tables import fixture

    return fixture(v.images, seed=5).select("image_id", "species", "ord", "x", "y", "w", "h")


@query("src_20_page_metadata", """SELECT page_id, trim(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;', '&')) AS title, '{"url": "' || url || '"}' AS ld, [[page_id::VARCHAR, 'a & b', '', 'x']] AS rows, length(html) AS size FROM pages""")
def _(v):
    """Every page with some JSON-LD, a table and a card of its own put behind it."""
    from plumbline.sources.tables import page_metadata

    ld = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct("url")), F.lit("</script>"))
    table = F.concat(F.lit("<table><tr><td>too</td><td>few</td></tr><tr><td>"), "page_id", F.lit("</td><td> a &amp; b</td><td></td><td><i>x</i></td></tr></table>"))
    card = F.concat(F.lit("<dl><dt>size</dt><dd>"), F.length("html"), F.lit("</dd></dl>"))
    found = page_metadata(v.pages.withColumn("html", F.concat("html", ld, table, card)), "html", "page_id")
    return found.select("page_id", "title", "ld", "rows", F.col("cards")["size"].cast("long").alias("size"))


@query("draw_01_key", "SELECT question_id, md5('1:' || question_id) AS k FROM questions")
def _(v):
    return v.questions.select("question_id", draw_key(1, F.col("question_id")).alias("k"))
