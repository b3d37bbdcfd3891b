"""The whole benchmark from images and annotations: candidates, selection, one table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.density import ScoreRule
from plumbline.operators import generate, selection
from plumbline.store import written_by

TASKS = ("species", "open_ended", "fine_grained", "density", "grounded", "localisation")


def build(images: DataFrame, annotations: DataFrame, tasks: dict[str, dict[str, Any]] | None = None, seed: int = 0, parts: int | None = None) -> DataFrame:
    """(id, task, dataset, image_id, benchmark_class, ablation_of) of the enabled tasks.

    Each task's settings may hold per_class (an exact quota), classes, and the thresholds of
    its generator.  A draw depends on the seed and its own task only.

    Annotations are worked out once and written by image in ``parts`` buckets (spark.sql.shuffle.partitions if not given), where
    every generator finds an image's boxes together: their own groups and joins shuffle nothing."""
    parts = parts or int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    images, annotations = images.repartition(parts, *generate.KEY), written_by(annotations, generate.KEY, parts)
    tasks = {t: {} for t in TASKS} if tasks is None else tasks
    unknown = set(tasks) - set(TASKS)
    if unknown:
        raise ValueError(f"unknown tasks {sorted(unknown)}")
    made: dict[str, DataFrame] = {}

    def select(df: DataFrame, cls: str, task: str, s: dict[str, Any]) -> DataFrame:
        # what else a question holds is not worked out for candidates
        return selection.quota(df.select("id", *generate.KEY, cls), cls, ["id"], s.get("per_class"), s.get("classes"), seed)

    rest = lambda s: {k: v for k, v in s.items() if k not in ("per_class", "classes")}
    for task, s in tasks.items():
        if task == "species":
            made[task] = select(generate.species_questions(annotations, seed=seed, **rest(s)), "species", task, s).withColumn("benchmark_class", F.col("species"))
        elif task == "fine_grained":
            q = generate.fine_grained_questions(annotations, seed=seed, **rest(s))
            made[task] = select(q.withColumn("benchmark_class", F.when(F.col("same"), "same").otherwise("different")), "benchmark_class", task, s)
        elif task == "density":
            q = generate.density_questions(images, annotations, **({"rule": ScoreRule()} | rest(s)))
            if s.get("per_class") is None and s.get("classes") is None:  # every image has both variants
                made[task] = q
                continue
            boxed = select(q.where("annotated"), "benchmark_class", task, s)
            plain = select(q.where("not annotated").join(boxed.select("dataset", "image_id"), ["dataset", "image_id"], "left_semi"), "benchmark_class", task, s)
            made[task] = boxed.unionByName(plain)
        elif task == "grounded":
            made[task] = select(generate.grounded_questions(annotations, seed=seed, **rest(s)), "species", task, s).withColumn("benchmark_class", F.col("species"))
        elif task == "localisation":
            made[task] = select(generate.localisation_questions(annotations, **rest(s)), "species", task, s).withColumn("benchmark_class", F.col("species"))
    if "open_ended" in tasks:
        base = made.get("species", generate.species_questions(annotations, seed=seed).withColumn("benchmark_class", F.col("species")))
        made["open_ended"] = generate.open_ended(base, tasks["open_ended"].get("share", 0.2), seed)
    out = None
    for task, q in made.items():
        ablation = F.col("ablation_of") if "ablation_of" in q.columns else F.lit(None).cast("string")
        rows = q.select("id", F.lit(task).alias("task"), "dataset", "image_id", "benchmark_class", ablation.alias("ablation_of"))
        out = rows if out is None else out.unionByName(rows)
    return out
