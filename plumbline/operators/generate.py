"""Candidate questions from annotated images, one function per task.

Images: dataset, image_id, width, height, file_name.  Annotations: the same and species,
role, x, y, w, h and ord.  Every generator is one plan; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.functions.density import ScoreRule, density_level, level_name
from plumbline.functions.hashing import draw_key
from plumbline.operators.joins import pairs_ranked
from plumbline.operators.reshape import duplicate_variants
from plumbline.operators.selection import distractors, fraction
from plumbline.operators.windows import first_per, number_groups
from plumbline.store import written

KEY = ["dataset", "image_id"]
BOX = ["x", "y", "w", "h"]


def usable(annotations: DataFrame) -> DataFrame:
    """Annotations of images that have an area."""
    return annotations.where(F.col("width") * F.col("height") > 0)


def large_enough(annotations: DataFrame, share: float, largest: float) -> DataFrame:
    """(image, species) whose boxes cover enough in sum, and the largest alone."""
    whole = F.col("width") * F.col("height")
    g = usable(annotations).groupBy(*KEY, "width", "height", "species").agg(F.sum(F.col("w") * F.col("h")).alias("area"), F.max(F.col("w") * F.col("h")).alias("largest"), F.count("*").alias("n_boxes"))
    return g.where((F.col("area") / whole >= share) & (F.col("largest") / whole >= largest))


def _pool(annotations: DataFrame) -> DataFrame:
    """A row per dataset, written so that its size is known before a join deals candidates by the few datasets."""
    return written(annotations.groupBy("dataset").agg(F.array_sort(F.collect_set("species")).alias("_pool")))


def species_questions(annotations: DataFrame, role: str = "weed", choices: int = 4, share: float = 0.01, largest: float = 0.0, seed: int = 0) -> DataFrame:
    """Boxed multiple choice: one question per image and species that is large enough."""
    rows = annotations.where(F.col("role") == role)
    q = large_enough(rows, share, largest).join(_pool(rows), "dataset")
    q = q.withColumn("id", F.concat_ws(":", "dataset", "image_id", "species", F.lit("species_mc")))
    return distractors(q, F.col("_pool"), F.col("species"), F.col("id"), choices, seed).drop("_pool", "width", "height")


def plain_species_questions(annotations: DataFrame, role: str = "weed", choices: int = 4, share: float = 0.01, largest: float = 0.0, seed: int = 0) -> DataFrame:
    """Without boxes: images with one species of the role.  Boxes of that name count whatever their role."""
    only = annotations.where(F.col("role") == role).groupBy(*KEY).agg(F.min("species").alias("species"), F.count_distinct("species").alias("_n")).where("_n = 1").drop("_n")
    q = large_enough(annotations.join(only, [*KEY, "species"], "left_semi"), share, largest).join(_pool(annotations.where(F.col("role") == role)), "dataset")
    q = q.withColumn("id", F.concat_ws(":", "dataset", "image_id", "species", F.lit("species_mc"), F.lit("unannotated")))
    return distractors(q, F.col("_pool"), F.col("species"), F.col("id"), choices, seed).drop("_pool", "width", "height")


def open_ended(questions: DataFrame, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Open-ended twins of round(n * share) multiple-choice questions."""
    some = fraction(questions, [], ["id"], share, seed)
    return some.withColumns({"ablation_of": F.col("id"), "id": F.concat("id", F.lit(":open_ended"))}).drop("choices", "answer_index")


def pair_candidates(annotations: DataFrame, role: str = "weed", total: float = 0.02, largest: float = 0.01, offset: float = 0.7, ratio: float = 0.5, colour: Column | None = None) -> DataFrame:
    """Pairs of boxes of an image that are large, central and look alike: of one species, or of two."""
    rows = usable(annotations.where(F.col("role") == role))
    columns = ["species", "ord", *BOX, "width", "height"]
    both = pairs_ranked(rows, KEY, ["species", "ord"], columns).withColumn("same", F.col("species_a") == F.col("species_b"))
    box = lambda s: F.struct(*[F.col(f"{c}_{s}").alias(c) for c in BOX])
    whole = F.col("width_a") * F.col("height_a")
    a, b = geo.area(box("a")), geo.area(box("b"))
    weight = lambda c, size: (F.col(f"{c}_a") + F.col(f"{size}_a") / 2) * a + (F.col(f"{c}_b") + F.col(f"{size}_b") / 2) * b
    off = geo.centre_offset(F.try_divide(weight("x", "w"), a + b), F.try_divide(weight("y", "h"), a + b), F.col("width_a"), F.col("height_a"))
    alike = F.coalesce(geo.area_ratio(box("a"), box("b")) >= ratio, F.lit(False))
    if colour is not None:
        alike = alike | colour
    return both.where(((a + b) / whole >= total) & (F.greatest(a, b) / whole >= largest) & (F.coalesce(off, F.lit(0.0)) <= offset) & alike)


def fine_grained_questions(annotations: DataFrame, most: int = 6, seed: int = 0, **rules) -> DataFrame:
    """At most ``most`` pairs of each image."""
    pairs = pair_candidates(annotations, **rules)
    drawn = first_per(pairs, KEY, [draw_key(seed, F.col("image_id"), F.col("ord_a"), F.col("ord_b")), "ord_a", "ord_b"], most)
    return drawn.withColumn("id", F.concat_ws(":", "dataset", "image_id", F.concat_ws("-", "ord_a", "ord_b"), F.lit("fine_grained"))).select(*KEY, "id", "ord_a", "ord_b", "species_a", "species_b", "same")


def scene_features(images: DataFrame, annotations: DataFrame, role: str = "weed") -> DataFrame:
    """count, coverage, typical_size, spread and largest box of every image with an area; 0 without boxes."""
    packed = F.array_sort(F.collect_list(F.struct("ord", *BOX)))
    boxes = annotations.where(F.col("role") == role).groupBy(*KEY).agg(F.transform(packed, lambda s: F.struct(*[s[c].alias(c) for c in BOX])).alias("boxes"))
    out = images.where(F.col("width") * F.col("height") > 0).join(boxes, KEY, "left")
    b = F.coalesce("boxes", F.array().cast("array<struct<x:double,y:double,w:double,h:double>>"))
    whole = F.col("width") * F.col("height")
    sizes = F.array_sort(F.transform(b, geo.area))
    n = F.size(b)
    middle = (F.get(sizes, F.floor((n - 1) / 2).cast("int")) + F.get(sizes, F.floor(n / 2).cast("int"))) / 2
    return out.select(
        *images.columns, b.alias("boxes"), n.cast("long").alias("count"), (geo.union_area(b) / whole).alias("coverage"), F.coalesce(middle / whole, F.lit(0.0)).alias("typical_size"),
        geo.spread(b, F.col("width"), F.col("height")).alias("spread"), F.coalesce(F.array_max(F.transform(b, geo.area)) / whole, F.lit(0.0)).alias("largest"),
    )


def density_questions(images: DataFrame, annotations: DataFrame, role: str = "weed", largest: float = 0.0, rule: ScoreRule = ScoreRule()) -> DataFrame:
    """Two questions, boxed and plain, of every image without boxes or with one that is large enough."""
    f = scene_features(images, annotations, role).where((F.col("count") == 0) | (F.col("largest") >= largest))
    f = f.withColumn("benchmark_class", level_name(density_level(F.col("count"), F.col("coverage"), rule)))
    both = duplicate_variants(f, "annotated", [True, False])
    kind = F.when(F.col("annotated"), "boxed").otherwise("unannotated")
    return both.select(F.concat_ws(":", "dataset", "image_id", F.lit("density"), kind).alias("id"), *KEY, "annotated", "benchmark_class", F.col("count").alias("true_count"), F.col("coverage").alias("true_coverage"))


def grounded_questions(annotations: DataFrame, role: str = "weed", coverage: float = 0.05, offset: float = 0.7, least_targets: int = 1, seed: int = 0) -> DataFrame:
    """One question per target species of an image whose boxes are large and central together;
    species are numbered in a drawn order."""
    rows = usable(annotations)
    packed = F.collect_list(F.struct(*BOX))
    scene = rows.groupBy(*KEY, "width", "height").agg(packed.alias("b"), F.count_distinct(F.when(F.col("role") == role, F.col("species"))).alias("targets"))
    whole, mass = F.col("width") * F.col("height"), geo.centre_of_mass(F.col("b"))
    good = scene.where((F.col("targets") >= least_targets) & (geo.union_area(F.col("b")) / whole >= coverage) & (geo.centre_offset(mass["x"], mass["y"], F.col("width"), F.col("height")) <= offset))
    named = rows.join(good.select(*KEY), KEY, "left_semi").groupBy(*KEY, "species").agg(F.bool_or(F.col("role") == role).alias("target"), F.count("*").alias("n_boxes"))
    numbered = number_groups(named, KEY, [draw_key(seed, F.col("image_id"), F.col("species")), "species"])
    return numbered.where("target").select(F.concat_ws(":", "dataset", "image_id", "species", F.lit("grounded")).alias("id"), *KEY, "species", "number", "n_boxes")


def localisation_questions(annotations: DataFrame, least_plants: int = 3, least_others: int = 1, most_boxes: int = 5, least_area: float = 0.005) -> DataFrame:
    """One question per species of a busy image, all of whose boxes are large enough and few."""
    rows = usable(annotations)
    busy = rows.groupBy(*KEY).agg(F.count("*").alias("_n"), F.count_distinct("species").alias("_s")).where((F.col("_n") >= least_plants) & (F.col("_s") - 1 >= least_others)).select(*KEY)
    packed = F.array_sort(F.collect_list(F.struct("ord", *BOX)))
    per = rows.join(busy, KEY, "left_semi").groupBy(*KEY, "width", "height", "species").agg(packed.alias("_b"), F.min(F.col("w") * F.col("h") / (F.col("width") * F.col("height"))).alias("smallest"))
    ok = per.where((F.size("_b") <= most_boxes) & (F.col("smallest") >= least_area))
    return ok.select(F.concat_ws(":", "dataset", "image_id", "species", F.lit("localisation")).alias("id"), *KEY, "species", F.transform("_b", lambda s: F.struct(*[s[c].alias(c) for c in BOX])).alias("boxes"))


def render_plan(questions: DataFrame, boxes: str, folder: str, slug: str) -> DataFrame:
    """What would be drawn for each question, once per output path: (source, out, labelled boxes, line width)."""
    out = F.concat(F.lit(f"{folder}/"), F.translate(F.concat_ws("_", "dataset", "image_id", F.lit(slug)), " ", "_"), F.lit(".jpg"))
    labelled = F.transform(F.col(boxes), lambda b, i: F.struct((i + 1).alias("label"), b.alias("box")))
    return questions.select(F.concat_ws("/", "dataset", "image_id").alias("source"), out.alias("out_path"), labelled.alias("labelled_boxes")).dropDuplicates(["out_path"])


def _overlay_sizes(rows: DataFrame) -> DataFrame:
    font = F.greatest(F.lit(14), F.bround(F.col("height") / 40).cast("int"))
    return rows.withColumns({"line": geo.overlay_line(F.col("width"), F.col("height")), "font": font, "strip": font * 2})


def _below_strip(b: Column) -> Column:
    return F.struct(b["x1"].alias("x1"), (b["y1"] + F.col("strip")).alias("y1"), b["x2"].alias("x2"), (b["y2"] + F.col("strip")).alias("y2"))


def overlay_dashes(rows: DataFrame, box: str, keys: Sequence[str]) -> DataFrame:
    """The ``dashes`` of :func:`overlay_plan` as rows (keys, x1, y1, x2, y2), for rows that hold one replied box of corners each."""
    side, line = F.col("_side"), F.col("line")
    sides = _overlay_sizes(rows).select(*keys, "line", F.explode(geo.box_sides(_below_strip(F.col(box)))).alias("_side")).where(side["size"] > 0)
    each = sides.select(*keys, "line", "_side", F.explode(geo.dash_numbers(side, line)).alias("_k"))
    return each.select(*keys, geo.dash(side, F.col("_k"), line).alias("_d")).select(*keys, "_d.*")


def overlay_plan(rows: DataFrame, truth: str, replied: str) -> DataFrame:
    """What would be drawn to judge a localisation reply: true boxes in ``solid`` lines, replied ones as ``dashes``.

    Boxes are arrays of corners.  ``strip`` pixels for a legend stand above the image, in
    letters of ``font`` pixels; all places are those of the finished picture."""
    out = _overlay_sizes(rows)
    lower = lambda c: F.transform(c, _below_strip)
    drawn = F.flatten(F.transform(lower(F.col(replied)), lambda b: geo.dashes(b, F.col("line"))))
    return out.withColumns({"solid": lower(F.col(truth)), "dashes": drawn})


def pool_counts(df: DataFrame, cls: str) -> DataFrame:
    return df.groupBy(cls).agg(F.count("*").alias("n"), F.rank().over(Window.orderBy(F.desc(F.count("*")))).alias("place"))
