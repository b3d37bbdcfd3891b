import pytest
from pyspark.sql import functions as F

from plumbline.operators import aggregates, checks, classify, generate, joins, reshape, scoring, selection, statistics, windows


def frame(spark, n=60):
    return spark.range(n).select(F.col("id"), (F.col("id") % 4).cast("string").alias("cls"), (F.col("id") % 7).alias("v"))


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_quota_is_exact_and_independent_of_partitions(spark):
    df = frame(spark)
    a = selection.quota(df, "cls", ["id"], per_class=5, seed=3)
    b = selection.quota(df.repartition(7, "v"), "cls", ["id"], per_class=5, seed=3)
    assert ids(a) == ids(b) and {r["n"] for r in a.groupBy("cls").agg(F.count("*").alias("n")).collect()} == {5}
    assert ids(a) != ids(selection.quota(df, "cls", ["id"], per_class=5, seed=4))
    assert selection.quota(df, "cls", ["id"], per_class=5, classes=2).select("cls").distinct().count() == 2
    with pytest.raises(selection.Shortfall, match="too few"):
        selection.quota(df, "cls", ["id"], per_class=16)
    with pytest.raises(selection.Shortfall):
        selection.quota(df, "cls", ["id"], per_class=5, classes=9)
    assert selection.quota(df, "cls", ["id"]) is df


def test_coupled_quota(spark):
    df = frame(spark)
    boxed, plain = selection.coupled_quota(df, df.where("cls in ('1', '3')"), "cls", ["id"], 3, 2, 4)
    names = lambda d: {r.cls for r in d.select("cls").distinct().collect()}
    assert len(names(boxed)) == 3 and names(plain) == {"1", "3"} and names(plain) <= names(boxed)
    with pytest.raises(selection.Shortfall):
        selection.coupled_quota(df, df.where("cls = '1'"), "cls", ["id"], 3, 2, 4)


def test_stratified_keeps_variants_with_their_originals(spark):
    rows = [(f"m{i}", "mc", None) for i in range(7)] + [(f"o{i}", "oe", f"m{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "id string, kind string, of string")
    kept = {}
    for share in (0.2, 0.5, 0.6, 0.625, 1.0):
        got = {r.id: r.of for r in selection.stratified(df, ["kind"], "id", share, F.col("kind") == "oe", "of").collect()}
        assert sum(k[0] == "m" for k in got) == max(1, int(7 * share + 0.5)) and sum(k[0] == "o" for k in got) == max(1, int(4 * share + 0.5))
        assert all(of in got for of in got.values() if of)
        kept[share] = {k for k in got if k[0] == "o"}
    assert kept[0.2] <= kept[0.5] <= kept[0.6] <= kept[1.0]


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a", "x") for i in range(20)], "id int, g string, kind string")
    assert {r.g: r.n for r in selection.fraction(df, ["g"], ["id"], 0.3).groupBy("g").agg(F.count("*").alias("n")).collect()} == {None: 3, "a": 3}
    got = selection.stratified(df, ["g"], "id", 0.5, F.lit(False), "id")
    assert {r.g: r.n for r in got.groupBy("g").agg(F.count("*").alias("n")).collect()} == {None: 5, "a": 5}


def test_folds_and_distractors(spark):
    sizes = {r["n"] for r in selection.folds(frame(spark, 52), ["id"]).groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert sizes == {10, 11}
    df = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "z")], "id string, t string")
    for r in selection.distractors(df, F.array(*map(F.lit, "abc")), F.col("t"), F.col("id"), 4).collect():
        assert r.choices[r.answer_index] == r.t and len(set(r.choices)) == len(r.choices) == (4 if r.t == "z" else 3)


def test_wrong_numbers():
    assert selection.resolve_wrong(3, ["a", "b"]) == {"a": 3, "b": 3}
    with pytest.raises(ValueError, match="missing"):
        selection.resolve_wrong({"a": 1}, ["a", "b"])


def test_bins_keep_ties_together(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 1.0, 1.0, 1.0, 2.0, 3.0, None])], "i int, v double")
    got = {r.i: r.quality for r in windows.tercile_bins(df, "v").collect()}
    assert len({got[i] for i in range(4)}) == 1 and got[6] is None and got[5] == "high"


def test_streaks(spark):
    rows = [("a", i, s) for i, s in enumerate("fffoffff")] + [("b", i, "o") for i in range(3)]
    df = spark.createDataFrame(rows, "m string, t int, s string")
    got = [r.streak for r in windows.failure_streaks(df, ["m"], ["t"], F.col("s") == "f").where("m = 'a'").orderBy("t").collect()]
    assert got == [1, 2, 3, 0, 1, 2, 3, 4]
    assert [(r.m, r.t) for r in windows.first_trip(df, ["m"], ["t"], F.col("s") == "f", 4).collect()] == [("a", 7)]
    assert windows.first_trip(df, ["m"], ["t"], F.col("s") == "f", 0).count() == 0


def test_row_index_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(9)
    assert all(r.k == r.row_index for r in reshape.with_row_index(df, ["k"]).collect())


def test_joins_check_what_they_promise(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id int, w string")
    with pytest.raises(Exception, match="twice"):
        joins.attach_one(left, twice, ["id"]).collect()
    assert sorted(joins.attach(left, left, ["id"]).columns) == ["id", "v_left", "v_right"]
    fresh = joins.fresh_scores(spark.createDataFrame([(1, "t1"), (2, "t2"), (3, "t3")], "id int, created_at string"), spark.createDataFrame([(1, "t1", 5), (2, "old", 6)], "id int, created_at string, score int"), ["id"])
    assert sorted(map(tuple, fresh.select("id", "score", "stale").collect())) == [(1, 5, False), (2, None, True), (3, None, False)]
    with pytest.raises(Exception, match="no description"):
        joins.text_lookup(left, "v", spark.createDataFrame([("x", "d")], "s string, d string"), "s", "d").collect()


def test_kappa(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (2, 2), (0, 2), (None, 1)], "a int, b int")
    got = [statistics.kappa(df, [], "a", "b", w).first().kappa for w in (None, "linear", "quadratic")]
    flipped = [statistics.kappa(df, [], "b", "a", w).first().kappa for w in (None, "linear", "quadratic")]
    assert got == pytest.approx(flipped) and got[0] == pytest.approx(1 - (2 / 5) / (1 - (2 * 1 + 1 * 2 + 2 * 2) / 25))
    same = spark.createDataFrame([(1, 1)] * 3, "a int, b int")
    assert statistics.kappa(same, [], "a", "b").first().kappa is None


def test_bootstrap(spark):
    df = spark.createDataFrame([("g", i, i // 4, float(i % 10)) for i in range(200)], "g string, id int, c int, v double")
    stat = lambda d: d["v"].mean()
    a, b = (statistics.bootstrap_by(d, ["g"], stat, ["id"], "c", n_boot=200).first() for d in (df, df.repartition(5)))
    assert a == b and a.lo < a.estimate < a.hi and a.n == 200
    m = statistics.bootstrap_mean(df, ["g"], "v", ["id"], n_boot=300).first()
    assert m.estimate == pytest.approx(4.5) and m.hi - m.lo == pytest.approx(4 * 2.87 / 200**0.5, rel=0.25)
    never = lambda d: None
    assert statistics.bootstrap_by(df, ["g"], never, ["id"], n_boot=20).first().lo is None


def test_paired_difference(spark):
    rows = [("a", q, float(q % 2)) for q in range(10)] + [("b", q, 0.0) for q in range(8)]
    got = statistics.paired_diff_ci(spark.createDataFrame(rows, "m string, q int, v double"), "m", "a", "b", "v", "q", n_boot=200).first()
    assert got.n == 8 and got.estimate == 0.5 and got.lo < 0.5 < got.hi


def test_macro_f1_counts_missed_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("a", "c")], "t string, g string")
    assert aggregates.macro_f1(df, [], "t", "g").first().macro_f1 == pytest.approx((2 / 4 + 0) / 2)


def test_outcome_modes(spark):
    df = spark.createDataFrame([("Unsure", True), (" not sure.", False), ("x", None), ("x", True)], "a string, ok boolean")
    got = {m: [r[0] for r in df.select(classify.answer_outcome(F.col("a"), F.col("ok"), m)).collect()] for m in ("exact", "lower_first", "synonyms", "match_first")}
    assert got == {
        "exact": ["correct", "incorrect", "incorrect", "correct"], "lower_first": ["unsure", "incorrect", "incorrect", "correct"],
        "synonyms": ["unsure", "unsure", "incorrect", "correct"], "match_first": ["correct", "unsure", "incorrect", "correct"],
    }


IMAGES = "dataset string, image_id long, width int, height int, file_name string"
BOXES = IMAGES + ", species string, role string, ord int, x double, y double, w double, h double"


def test_generators_on_hand_made_images(spark):
    images = spark.createDataFrame([("d", 1, 100, 100, "a"), ("d", 2, 100, 100, "b"), ("d", 3, 0, 100, "c")], IMAGES)
    boxes = spark.createDataFrame(
        [("d", 1, 100, 100, "a", s, r, k, x, 40.0, 20.0, 20.0) for k, (s, r, x) in enumerate([("p", "weed", 30.0), ("p", "weed", 40.0), ("q", "weed", 50.0), ("p", "crop", 0.0)])] + [("d", 3, 0, 100, "c", "p", "weed", 0, 0.0, 0.0, 9.0, 9.0)], BOXES
    )
    q = {r.species: r for r in generate.species_questions(boxes, choices=2).collect()}
    assert set(q) == {"p", "q"} and all(sorted(r.choices) == ["p", "q"] and r.choices[r.answer_index] == s for s, r in q.items())
    assert generate.plain_species_questions(boxes).count() == 0
    pairs = {(r.ord_a, r.ord_b, r.same) for r in generate.pair_candidates(boxes).collect()}
    assert pairs == {(0, 1, True), (0, 2, False), (1, 2, False)}
    assert generate.fine_grained_questions(boxes, most=2).count() == 2
    density = {(r.image_id, r.annotated): r for r in generate.density_questions(images, boxes).collect()}
    assert set(density) == {(1, True), (1, False), (2, True), (2, False)} and density[2, True].benchmark_class == "none"
    assert density[1, True].true_coverage == pytest.approx(0.08) and density[1, True].true_count == 3
    assert {r.number for r in generate.grounded_questions(boxes, coverage=0.01).collect()} == {1, 2}
    assert {r.species for r in generate.localisation_questions(boxes).collect()} == {"p", "q"}


def test_localisation_scores(spark):
    df = spark.createDataFrame([(1, "[[0, 0, 10, 10]]", "xyxy pixels", [(0.0, 0.0, 10.0, 10.0)], 20, 20), (2, "nonsense", "", [(0.0, 0.0, 1.0, 1.0)], 20, 20)], "id int, r string, d string, t array<struct<x: double, y: double, w: double, h: double>>, width int, height int")
    got = {r.id: r for r in scoring.localisation_scores(df, "r", "d", "t").collect()}
    assert got[1].localisation_score == 1.0 and got[2].localisation_score == 0.0 and got[2].pred_boxes is None


def test_checks(spark):
    good = spark.createDataFrame([("a", None), ("b", "a")], "id string, ablation_of string")
    checks.check_questions(good)
    with pytest.raises(ValueError, match="more than once"):
        checks.check_questions(good.union(good))
    with pytest.raises(ValueError, match="no question"):
        checks.check_questions(spark.createDataFrame([("b", "z")], good.schema))
    with pytest.raises(ValueError, match="seed"):
        checks.same_settings({"seed": 1}, {"seed": 2})
    with pytest.raises(ValueError):
        checks.same_counts(good, good.limit(1), "rows")


def test_annotations_with_tables_too_large_to_broadcast(spark, monkeypatch):
    from plumbline.operators import joins
    from plumbline.plans import views

    folder = "/root/testdata/sf0.001"
    plain = views.Views(spark, folder)
    want = spark.sql(views.VIEWS["annotations"], lineitem=plain.lineitem, images=plain.images, part=plain.part)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(views, "ANNOTATIONS_A_TASK", 500)
    got = views.Views(spark, folder).annotations
    assert got.dtypes == want.dtypes
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("Exchange") == 4
    rows = plain.lineitem.count()
    assert got.rdd.getNumPartitions() == -(-rows // 500) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    # what groups by image finds the rows as they lie
    assert got.groupBy("dataset", "image_id").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 4


def test_dashes_as_rows(spark):
    from plumbline.functions import geometry as geo
    from plumbline.operators import generate

    boxes = spark.createDataFrame([(i, 800, 600, 10.0 * i, 5.0, 7.0 * i, 61.5) for i in range(5)], "image_id int, width int, height int, x double, y double, w double, h double")
    one = boxes.withColumn("c", geo.corners(F.struct("x", "y", "w", "h")))
    drawn = generate.overlay_dashes(one, "c", ["image_id"])
    whole = generate.overlay_plan(one.withColumn("c", F.array("c")), "c", "c").select("image_id", F.explode("dashes").alias("d")).select("image_id", "d.*")
    assert sorted(drawn.collect()) == sorted(whole.collect()) and drawn.where("image_id = 0").count() > 0
    assert "lambdafunction" not in drawn._jdf.queryExecution().optimizedPlan().toString()


def test_the_benchmark_works_its_annotations_out_once(spark):
    from plumbline.operators import build

    images = spark.createDataFrame([(d, k, 100, 100, "a") for d in "de" for k in range(6)], IMAGES)
    plants = [("p", "weed", 30.0), ("p", "weed", 40.0), ("q", "weed", 50.0), ("r", "crop", 0.0)]
    rows = spark.createDataFrame([(d, k, 100, 100, "a", s, r, o, x, 40.0, 20.0, 20.0) for d in "de" for k in range(6) for o, (s, r, x) in enumerate(plants)], BOXES)
    seen = spark.sparkContext.accumulator(0)

    def marked(ord: int) -> int:
        seen.add(1)
        return ord

    counted = rows.withColumn("ord", F.udf(marked, "int")("ord"))
    settings = {"species": {"per_class": 2}, "open_ended": {"share": 0.5}, "fine_grained": {"per_class": 2}, "density": {}, "grounded": {"coverage": 0.01}, "localisation": {"per_class": 3}}
    got = build.build(images, counted, settings).collect()
    assert seen.value == len(plants) * 12
    assert {t: sum(r.task == t for r in got) for t in settings} == {"species": 4, "open_ended": 2, "fine_grained": 4, "density": 24, "grounded": 24, "localisation": 9}


def test_generators_shuffle_nothing_of_a_table_by_image(spark):
    from plumbline.store import written_by

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([("d", k, 100, 100, "a", s, "weed", o, 10.0 * o, 40.0, 20.0, 20.0) for k in range(5) for o, s in enumerate("ppq")], BOXES)
        table = written_by(rows, generate.KEY, 3)
        assert sorted(table.collect()) == sorted(rows.collect())
        for made in (generate.fine_grained_questions, generate.grounded_questions, generate.localisation_questions):
            assert "Exchange" not in made(table)._jdf.queryExecution().executedPlan().toString(), made
            assert sorted(r.id for r in made(table).collect()) == sorted(r.id for r in made(rows).collect())
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("plumbline_")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_ranked(spark, monkeypatch):
    rows = [(1, "p", 0), (1, "p", 1), (1, "q", 0), (1, None, 2), (1, "q", None), (2, "p", 0), (None, "p", 0), (None, "q", 1)]
    df = spark.createDataFrame(rows, "k int, s string, o int")
    want = [("p", 0, "p", 1), ("p", 0, "q", 0), ("p", 0, "q", None), ("p", 1, "q", 0), ("p", 1, "q", None)]
    for block in (1024, 2):
        monkeypatch.setattr(joins, "BLOCK", block)
        got = joins.pairs_ranked(df, ["k"], ["s", "o"], ["s", "o"]).select("s_a", "o_a", "s_b", "o_b").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_tasks_of_a_growing_join_are_not_put_together(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    left, right = spark.range(1000).withColumnRenamed("id", "k"), spark.range(500).withColumnRenamed("id", "k")
    several = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for tasks in (1, several + 3):
        got = joins.growing(left, right, "k", tasks)
        assert got.rdd.getNumPartitions() == max(tasks, several) and got.count() == 500
