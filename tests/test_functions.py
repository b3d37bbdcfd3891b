import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import boxes as bx
from plumbline.functions import density as den
from plumbline.functions import geometry as geo
from plumbline.functions import jsonx, stats, text
from plumbline.operators import fitting, selection

BOX = "array<struct<x: double, y: double, w: double, h: double>>"
QUIET = dict(deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "z int"
    return spark.createDataFrame([tuple(v for _, v in values.values()) or (0,)], schema).select(column.alias("r")).first()["r"]


def column(spark, expression, name, kind, rows):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} {kind}")
    return [r["r"] for r in frame.select("i", expression.alias("r")).orderBy("i").collect()]


UNION = [([], 0), ([(0, 0, 10, 10)], 100), ([(0, 0, 10, 10), (5, 5, 10, 10)], 175), ([(0, 0, 10, 10), (2, 2, 3, 3)], 100), ([(0, 0, 10, 10), (20, 0, 10, 10)], 200)]


def test_union_area_examples(spark):
    assert column(spark, geo.union_area(F.col("b")), "b", BOX, [[tuple(map(float, x)) for x in b] for b, _ in UNION]) == [a for _, a in UNION]


def test_union_area_counts_pixels(spark):
    rng = random.Random(0)
    cases = [[(float(rng.randint(0, 9)), float(rng.randint(0, 9)), float(rng.randint(0, 6)), float(rng.randint(0, 6))) for _ in range(rng.randint(0, 6))] for _ in range(80)]
    want = [len({(i, j) for x, y, w, h in c for i in range(int(x), int(x + w)) for j in range(int(y), int(y + h))}) for c in cases]
    assert column(spark, geo.union_area(F.col("b")), "b", BOX, cases) == want


def test_spread_and_centre(spark):
    cases = [([(0, 0, 100, 100)], 1 / 16), ([(0, 0, 100, 101)], 2 / 16), ([(0, 0, 400, 400)], 1), ([(0, 0, 10, 10), (390, 390, 10, 10)], 2 / 16)]
    got = column(spark, geo.spread(F.col("b"), F.lit(400), F.lit(400)), "b", BOX, [[tuple(map(float, b)) for b in c] for c, _ in cases])
    assert got == [w for _, w in cases]
    assert one(spark, geo.centre_offset(F.lit(0.0), F.lit(0.0), F.lit(10), F.lit(10))) == pytest.approx(1)
    assert one(spark, geo.centre_offset(F.lit(5.0), F.lit(5.0), F.lit(0), F.lit(10))) == 0


def matched(truth, found):
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h) if w > 0 and h > 0 else 0

    free = [(iou(t, p), i, j) for i, t in enumerate(truth) for j, p in enumerate(found)]
    out = []
    while free and max(free)[0] > 0:
        best = max(free)
        out.append(best[0])
        free = [f for f in free if f[1] != best[1] and f[2] != best[2]]
    return out


def test_greedy_matching(spark):
    rng = random.Random(1)
    box = lambda: (lambda x, y: (x, y, x + rng.randint(1, 8), y + rng.randint(1, 8)))(rng.randint(0, 8), rng.randint(0, 8))
    cases = [([tuple(map(float, box())) for _ in range(rng.randint(0, 4))], [tuple(map(float, box())) for _ in range(rng.randint(0, 4))]) for _ in range(60)]
    kind = "struct<t: array<struct<x1: double, y1: double, x2: double, y2: double>>, p: array<struct<x1: double, y1: double, x2: double, y2: double>>>"
    got = column(spark, geo.match_boxes(F.col("c.t"), F.col("c.p")), "c", kind, cases)
    for g, (t, p) in zip(got, cases):
        assert g == pytest.approx(matched(t, p))


def test_scores_of_nothing(spark):
    c = F.array().cast("array<struct<x1: double, y1: double, x2: double, y2: double>>")
    assert one(spark, geo.box_scores(c, c)["localisation_score"]) is None


REPLIES = [
    ("[[10, 20, 30, 40]]", "yxyx in pixels", [(20, 10, 40, 30)]),
    ('[{"xmin": 1, "ymin": 2, "xmax": 3, "ymax": 4}]', "", [(1, 2, 3, 4)]),
    ('[{"box_2d": [100, 200, 300, 400], "label": "a"}]', "box_2d", [(20, 10, 40, 30)]),
    ("[[0.1, 0.2, 0.3, 0.4]]", "xyxy", [(10, 20, 30, 40)]),
    ("[0.1, 0.2, 0.2, 0.2]", "xywh, normalised", [(10, 20, 30, 40)]),
    ("[[100, 200, 300, 400]]", "xyxy normalized", [(10, 20, 30, 40)]),
    ("[[[1, 2], [3, 4]]]", "x1, y1, x2, y2 pixels", [(1, 2, 3, 4)]),
    ("[[50, 50, 20, 10]]", "cx, cy, w, h in percent", [(40, 45, 60, 55)]),
    ("[[90, 90, 500, -5]]", "xyxy pixels", [(90, 0, 100, 90)]),
    ("[[1, 2, 3, 4]]", "no order given", None),
    ("[[true, 1, 2, 3]]", "xyxy", None),
    ('[{"position": {"bbox": {"Box-2D": [[1, 2], [3, 4]]}}}]', "xyxy pixels", None),
    ('[{"bbox": {"coordinates": {"X min": 1, "Y min": 2, "x_max": 3, "y_max": 4.5}}}]', "", [(1, 2, 3, 4.5)]),
    ('[{"bounds": [1, 2, 3, 4], "box_2d": [[20, 10], [40, 30]]}]', "yxyx pixels", [(10, 20, 30, 40)]),
    ('[[1, 2, 3, "4"]]', "xyxy pixels", None),
    ('[[1, 2, 3], [1, 2, 3, 4]]', "xyxy pixels", None),
    ('[[1, 2, 3, 4], {"x": 1}]', "xyxy pixels", None),
    ('{"x": 1}', "xyxy pixels", None),
    ("not json", "xyxy", None),
    ("[]", "xyxy", []),
]


def test_box_replies(spark):
    frame = spark.createDataFrame([(i, r, d) for i, (r, d, _) in enumerate(REPLIES)], "i int, r string, d string")
    f = bx.infer_format(F.col("d"))
    out = frame.withColumn("f", f).withColumn("raw", bx.read_boxes(F.col("r"), F.col("f.ord")))
    got = [x.p for x in out.select("i", bx.to_pixels(F.col("raw"), F.col("f.scale"), F.col("f.known"), F.lit(100), F.lit(100)).alias("p")).orderBy("i").collect()]
    for g, (reply, _, want) in zip(got, REPLIES):
        assert (g is None) == (want is None), reply
        assert want is None or [tuple(b) for b in g] == [pytest.approx(w) for w in want], reply


def test_configured_formats():
    assert bx.parse_format(" YXYX_1000 ") == ("yxyx", 1000.0) and bx.parse_format("xyxy_pixel") == ("xyxy", None)
    with pytest.raises(ValueError):
        bx.parse_format("xy_1000")


ANSWERS = [
    ("Common purslane (Portulaca oleracea)", True), ("portulaca  OLERACEA.", True), ("A or Portulaca oleracea", False), ("A/Portulaca oleracea", False), ("it is Portulaca oleracea, I think", True),
    ("the Portulaca oleracea plant", True), ("Portulaca", False), ("Portulaca oleraceae", False), ("Portulaca oleracea (A or B)", True), (None, False), ("pigweed", True), ("xpigweed", False), ("'Pigweed'", True),
]


def test_open_ended_match(spark):
    accepted = F.array(F.lit("portulaca oleracea"), F.lit("pigweed"))
    assert column(spark, text.open_ended_match(F.col("a"), accepted), "a", "string", [a for a, _ in ANSWERS]) == [w for _, w in ANSWERS]


def test_names(spark):
    got = column(spark, text.species(F.col("c")), "c", "string", ["weed: a b (c)", "crop:x", "other: y", None])
    assert [tuple(g) if g else None for g in got] == [("weed", "a b", "c"), ("crop", "x", None), None, None]
    with pytest.raises(Exception, match="not a category"):
        one(spark, text.required_species(F.lit("thing: y")))
    assert one(spark, text.display_name(F.lit("éa Bc"))) == "Éa Bc"


def test_the_first_letter_of_a_name_stays_one_letter(spark):
    names = {"ßa": "ẞa", "ﬁn": "ﬁn", "ᾳb": "ᾼb", "ᾼb": "ᾼb", "ŉ": "ŉ", "ǆa": "Ǆa", "": "", "ab": "Ab"}
    for given, want in names.items():
        assert one(spark, text.display_name(F.lit(given))) == want


def pairs(spark, make, cases):
    """make(column) of each text, beside what it should be."""
    assert column(spark, make(F.col("t")), "t", "string", [t for t, _ in cases]) == [w for _, w in cases]


def test_categories_as_they_are_named(spark):
    parts = lambda c: F.to_json(text.species(c))
    good = {"weed: bassia scoparia": ("weed", "bassia scoparia", None), "crop: maize (four-leaf stage)": ("crop", "maize", "four-leaf stage"), " weed:hedge mustard (80) ": ("weed", "hedge mustard", "80")}
    pairs(spark, parts, [(t, json.dumps({k: v for k, v in zip(("role", "name", "qualifier"), w) if v}, separators=(",", ":"))) for t, w in good.items()])
    pairs(spark, parts, [("weed: a (b) c", None), ("weed: x ()", None), ("Weed: x", None), ("weed:", None), ("weed: a (b", None)])


def test_box_labels(spark):
    same = [("2", "2"), ("Box 2", "2"), ("#2", "2"), ("2.0", "2"), ("Bounding  box #12.", "12"), ('"label 3"', "3"), ("number 4.00", "4"), ("NUMBER5", "5")]
    pairs(spark, text.box_label, [*same, ("2.5", "2.5"), ("weed 3 of 5", "weed 3 of 5"), (" The  Second ", "the second"), (None, None)])


def test_light_text(spark):
    pairs(spark, text.light, [("  'A\u00a0 B.' ", "a b"), ("\u2003Straße`", "strasse"), ("ΛΌΓΟΣ", "λόγοσ"), ("...", ""), (None, None)])


def test_failure_classes(spark):
    from plumbline.operators.classify import failure_kind

    want = {401: "fatal", 402: "fatal", 403: "request", 404: "request", 408: "transient", 409: "request", 425: "request", 429: "transient", 500: "transient", 503: "transient", 400: "request"}
    assert column(spark, failure_kind(F.col("s")), "s", "int", list(want)) == list(want.values())


def test_reply_contents(spark):
    body = lambda content: json.dumps({"choices": [{"message": {"content": content}}]})
    texts = ["hi", "", "[[1,2,3,4]]", '[{"box_2d":[1,2,3,4]}]', "[unclosed", '{"a": 1}', "12"]
    pairs(spark, jsonx.content, [(body(t), t) for t in texts])
    parts = [{"type": "text", "text": "a"}, {"type": "image"}, "loose", {"text": "b"}]
    pairs(spark, jsonx.content, [(body(parts), "ab"), (body([]), ""), (body(None), ""), (body({"text": "x"}), ""), (json.dumps({"error": {"message": "no"}}), None), ("torn {", None), (None, None)])


def test_render_numbers(spark):
    box = "struct<x: double, y: double, w: double, h: double>"
    place = geo.tag_position(F.col("b"), F.lit(20.0), F.lit(12.0), F.lit(100), F.lit(200))
    cases = {(5.0, 50.0, 10.0, 10.0): (5, 38), (5.0, 3.0, 10.0, 10.0): (5, 13), (5.0, 3.0, 10.0, 195.0): (5, 3), (95.0, 12.0, 3.0, 3.0): (80, 0), (-4.0, -2.0, 10.0, 200.0): (0, 0)}
    assert [tuple(g) for g in column(spark, place, "b", box, list(cases))] == list(cases.values())
    sizes = {(100, 5000): 3, (800, 600): 3, (1200, 1000): 5, (4000, 3999): 19}
    assert column(spark, geo.line_width(F.col("s.w"), F.col("s.h")), "s", "struct<w: int, h: int>", list(sizes)) == list(sizes.values())


def test_union_area_of_a_crowded_scene(spark):
    """5,000 boxes against a grid of pixels."""
    import numpy as np

    rng = random.Random(3)
    boxes = [(float(rng.randrange(2000)), float(rng.randrange(1500)), float(rng.randrange(1, 60)), float(rng.randrange(1, 60))) for _ in range(5000)]
    grid = np.zeros((1600, 2100), bool)
    for x, y, w, h in boxes:
        grid[int(y) : int(y + h), int(x) : int(x + w)] = True
    assert column(spark, geo.union_area(F.col("b")), "b", BOX, [boxes]) == [grid.sum()]


OBJECTS = [
    ('{"a": 1}', {"a": 1}), ('```json\n{"a": 1}\n```', {"a": 1}), ('Sure: {"a": {"b": 2}} and {"c": 3}', {"a": {"b": 2}}), ('[1, 2] {"a": 1}', {"a": 1}), ('{"a": ', None), ("none", None), (None, None),
    ('{bad} {"a": "}"}', {"a": "}"}), ('[{"a": 1}]', {"a": 1}), ('say "{" then { "a" : "{\\"b\\"}" } {"c": 1}', {"a": '{"b"}'}), ("{{}} x", {}), ('{"a": 1, } {"b": [{"c": "}"}]}', {"b": [{"c": "}"}]}),
]


def test_json_in_prose(spark):
    got = column(spark, jsonx.json_object(F.col("t")), "t", "string", [t for t, _ in OBJECTS])
    assert [json.loads(g) if g else None for g in got] == [w for _, w in OBJECTS]


@settings(max_examples=8, **QUIET)
@given(st.lists(st.tuples(st.text(max_size=8).filter(lambda s: "{" not in s), st.dictionaries(st.text(max_size=3), st.integers() | st.text(max_size=4), max_size=3)), min_size=1, max_size=5))
def test_any_object_is_found(spark, cases):
    got = column(spark, jsonx.json_object(F.col("t")), "t", "string", [f"{p} {json.dumps(d)} tail" for p, d in cases])
    assert [json.loads(g) for g in got] == [d for _, d in cases]


def test_replies(spark):
    rows = [("", "stop"), ("x", "length"), ("x", "stop"), ('{"answer": "a"}', "stop"), ('{"answer": "a", "why": "b"}', "stop"), ('{"why": "b"}', "stop")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, f string")
    got = [r.r for r in frame.select("i", jsonx.interpret(F.col("t"), F.col("f"), ["answer", "why"]).alias("r")).orderBy("i").collect()]
    assert got == ["empty", "truncated", "no_json", "warnings", "ok", "missing_answer"]


def test_density_examples(spark):
    cases = [(0, 0.0, 0), (1, 1.0, 1), (3, 0.3, 2), (15, 0.03, 2), (10, 0.25, 3), (30, 0.03, 3)]
    got = column(spark, den.density_level(F.col("c.n"), F.col("c.v")), "c", "struct<n: int, v: double>", [(n, v) for n, v, _ in cases])
    assert got == [w for *_, w in cases]
    with pytest.raises(ValueError):
        den.ScoreRule(medium_score=0.7).checked()


@settings(max_examples=10, **QUIET)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), min_size=1, max_size=20))
def test_wilson_bounds(spark, cases):
    lo, hi = stats.wilson(F.col("c.k"), F.col("c.n"))
    got = column(spark, F.array(lo, hi), "c", "struct<k: int, n: int>", [(min(k, n), n) for k, n in cases])
    for (k, n), (a, b) in zip(cases, got):
        assert (a is None) == (n == 0)
        if n:
            assert 0 <= a <= min(k, n) / n + 1e-12 and min(k, n) / n - 1e-12 <= b <= 1


def test_joint_failures_sum_to_one(spark):
    got = one(spark, stats.joint_failures(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))))
    assert sum(got) == pytest.approx(1) and got[0] == pytest.approx(0.1 * 0.5 * 0.9)


def labelled(spark, n=200):
    rows = [(i, 1 + 7 * i % 30, 0.002 * (1 + 13 * i % 90), 0.01, 0.5) for i in range(n)]
    return spark.createDataFrame([(*r, 3 if r[1] >= 12 else 2 if r[1] >= 4 else 1) for r in rows], "id long, count long, coverage double, typical_size double, spread double, label int")


def test_tree_recovers_a_rule(spark):
    df = labelled(spark)
    tree = fitting.fit_tree(df, "label", depth=2)
    assert fitting.measure(df, "label", den.tree_column(tree)).first().exact == 1.0
    assert "if count < 4" in den.tree_text(tree) or "if count < 12" in den.tree_text(tree)


def test_tree_equals_a_plain_search(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 9), rng.choice([0.1, 0.2, 0.3, 0.7]), rng.choice([0, 1, 2, 3])) for _ in range(150)]
    df = spark.createDataFrame(rows, "count long, coverage double, label int")

    def impurity(part):
        return len(part) * (1 - sum((sum(r[2] == k for r in part) / len(part)) ** 2 for k in range(4)))

    best = min(
        ((round(impurity([r for r in rows if r[f] < cut]) + impurity([r for r in rows if r[f] >= cut]), 6), f, cut) for f in (0, 1) for cut in sorted({r[f] for r in rows}) if 5 <= sum(r[f] < cut for r in rows) <= 145),
    )
    tree = fitting.fit_tree(df, "label", depth=1, least=5, features=("count", "coverage"))
    assert "label" in tree or (tree["feature"], tree["threshold"]) == (("count", "coverage")[best[1]], best[2])
    guess = fitting.fit_tree(df, "label", depth=4, least=3, features=("count", "coverage"))
    sizes = lambda n: sum(n["counts"]) if "label" in n else sizes(n["below"]) + sizes(n["above"])
    assert sizes(guess) == 150


def test_folds_side_by_side_equal_folds_one_by_one(spark):
    df = selection.folds(labelled(spark, 90).withColumn("coverage", F.when(F.col("id") % 11 != 0, F.col("coverage"))), ["id"], 3).cache()
    start = den.ScoreRule()
    rules, trees = fitting.fit_rules(df, "label", start, 3, steps=6, rounds=1), fitting.fit_trees(df, "label", 3, depth=2)
    for i in range(3):
        train = df.where(F.col("fold") != i).drop("fold")
        assert rules[i] == fitting.fit_rule(train, "label", start, steps=6, rounds=1) and trees[i] == fitting.fit_tree(train, "label", depth=2)
    df.unpersist()


def test_jobs_do_not_grow_with_the_folds(spark):
    sc, df = spark.sparkContext, labelled(spark, 60)
    jobs = []
    for k in (2, 5):
        sc.setJobGroup(f"folds{k}", "")
        got = fitting.cross_validate(df, "label", ["id"], den.ScoreRule(), k, steps=4, rounds=1)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"folds{k}")))
        assert [(r, f) for r, f, _ in got] == [(r, f) for r in ("refit", "tree") for f in range(k)]
    sc.setJobGroup("rest", "")
    assert abs(jobs[0] - jobs[1]) <= 4


def test_a_missing_feature_lies_above_every_cut(spark):
    rows = [(k, None if k % 2 else float(k), 3 if k % 2 or k >= 20 else 1) for k in range(40)]
    df = spark.createDataFrame(rows, "id int, coverage double, label int")
    tree = fitting.fit_tree(df, "label", depth=1, least=1, features=("coverage",))
    assert tree["threshold"] == 20.0 and fitting.measure(df, "label", den.tree_column(tree)).first().exact == 1.0


def test_tree_of_nothing(spark):
    empty = spark.createDataFrame([], "count long, coverage double, typical_size double, spread double, label int")
    assert fitting.fit_tree(empty, "label") == {"label": 0, "counts": [0, 0, 0, 0]}


def test_refit_comes_near_a_planted_rule(spark):
    df, start = labelled(spark, 60), den.ScoreRule()
    truth = den.ScoreRule((1, 20), (0.05, 0.5), 0.35, 0.55, 2, 4)
    made = df.withColumn("label", den.density_level(F.col("count"), F.col("coverage"), truth))
    a, b = fitting.losses(made, "label", [start, fitting.fit_rule(made, "label", start, steps=12, rounds=1)])
    assert 2 * b <= a


def test_measure(spark):
    df = spark.createDataFrame(list(zip([1, 2, 3, 1], [1, 3, 1, 1])), "label int, guess int")
    assert tuple(fitting.measure(df, "label", F.col("guess")).first())[1:] == (0.5, 0.75, 0.75)


def test_dashes_around_a_box(spark):
    box = spark.sql("select named_struct('x1', 0.0D, 'y1', 0.0D, 'x2', 20.0D, 'y2', 0.0D) as c")
    got = [tuple(d) for d in box.select(geo.dashes(F.col("c"), F.lit(2)).alias("d")).first().d]
    # the upper side from the left, the lower one from the right; sides without length have none
    assert got == [(0, 0, 10, 0), (16, 0, 20, 0), (20, 0, 10, 0), (4, 0, 0, 0)]


def test_candidates_are_scored_once_for_rows_that_are_alike(spark, monkeypatch):
    from plumbline.functions.density import ScoreRule
    from plumbline.operators import fitting

    each = [(i % 7, (i % 5) / 50, 0.0, None if i % 3 else 0.5, 3 if i % 7 >= 6 else 2 if i % 7 >= 3 else 1, i % 2) for i in range(210)]
    kind = "count long, coverage double, typical_size double, spread double, label int, fold int"
    df = spark.createDataFrame(each, kind)
    seen, scored = [], fitting._losses
    monkeypatch.setattr(fitting, "_losses", lambda rows, label, tries: seen.append(rows.count()) or scored(rows, label, tries))
    rules, trees = fitting.fit_rules(df, "label", ScoreRule(), 2, steps=4, rounds=1), fitting.fit_trees(df, "label", 2, depth=2)
    assert set(seen) == {70}
    monkeypatch.setattr(fitting, "_alike", lambda rows: rows.withColumn("_n", F.lit(1)))
    assert rules == fitting.fit_rules(df, "label", ScoreRule(), 2, steps=4, rounds=1) and trees == fitting.fit_trees(df, "label", 2, depth=2)
    assert set(seen) == {70, 210}
