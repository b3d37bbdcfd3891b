"""Views of the supplied tables in the shapes that the operators work on.

Every view is one SELECT in the SQL that Spark and DuckDB share, so that both sides of a
check start from the same rows.  Braces name tables and earlier views.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.joins import growing

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "images": """SELECT o_orderpriority AS dataset, o_orderkey AS image_id, CAST(800 + 100 * (o_orderkey % 5) AS INT) AS width,
        CAST(CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE 600 END AS INT) AS height, 'img ' || CAST(o_orderkey AS STRING) || '.jpg' AS file_name FROM {orders}""",
    "annotations": """SELECT i.dataset, i.image_id, i.width, i.height, i.file_name, lower(p.p_type) AS species, CASE l.l_returnflag WHEN 'R' THEN 'crop' ELSE 'weed' END AS role,
        CAST((l.l_partkey * 37) % 600 AS DOUBLE) AS x, CAST((l.l_suppkey * 53) % 400 AS DOUBLE) AS y, 5 * l.l_quantity AS w, 4 * l.l_quantity AS h,
        CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey) AS INT) AS ord
        FROM {lineitem} l JOIN {images} i ON i.image_id = l.l_orderkey JOIN {part} p ON p.p_partkey = l.l_partkey""",
    "questions": """SELECT q AS question_id, CASE q % 5 WHEN 0 THEN 'open_ended' WHEN 1 THEN 'multiple_choice' WHEN 2 THEN 'fine_grained' WHEN 3 THEN 'grounded' ELSE 'density' END AS question_type,
        CASE q % 5 WHEN 2 THEN 'fine_grained' WHEN 3 THEN 'grounded' WHEN 4 THEN 'density' ELSE 'species' END AS task, q % 3 = 0 AS annotated,
        CASE q % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' ELSE 'signup' END AS expected_answer, 'd' || CAST(q % 6 AS STRING) AS dataset,
        CASE WHEN q % 5 = 0 THEN q + 1 END AS ablation_of, CASE WHEN q % 2 = 0 THEN '["view","click","purchase","signup"]' ELSE '["view","click"]' END AS choices,
        'img/' || CAST(q % 50 AS STRING) || '.jpg' AS image_path FROM (SELECT DISTINCT event_id % 400 AS q FROM {events}) t""",
    "responses": """SELECT event_id AS id, 'run' || CAST(user_id % 3 AS STRING) AS run, 'm' || CAST(user_id % 5 AS STRING) AS model, event_id % 400 AS question_id,
        CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, CASE WHEN event_type <> 'error' THEN event_type END AS answer, value AS latency,
        CAST(floor(value * 7) AS BIGINT) AS tokens, value / 1000 AS cost, ts AS created_at, props AS parsed,
        CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'transient' WHEN 1 THEN 'request' ELSE 'fatal' END END AS error_kind,
        CASE WHEN event_type = 'error' THEN 'HTTP ' || CAST(500 + event_id % 4 AS STRING) || '  busy (retry in ' || CAST(user_id % 7 AS STRING) || 's)' END AS error_message,
        event_id % 4 AS retries FROM {events}""",
    "scored": """SELECT r.id, r.run, r.model, r.question_id, r.status, r.answer, r.latency, r.tokens, r.cost, r.created_at, q.task, q.question_type, q.annotated, q.expected_answer, q.dataset, q.ablation_of, q.choices,
        CASE WHEN r.status = 'ok' THEN r.answer = q.expected_answer END AS correct,
        CASE WHEN r.status <> 'ok' THEN NULL WHEN r.answer = q.expected_answer THEN 'correct' WHEN r.id % 11 = 0 THEN 'unsure' WHEN r.id % 13 = 0 THEN 'invalid' ELSE 'incorrect' END AS outcome,
        CAST(r.id % 9 AS BIGINT) AS true_count, CASE WHEN r.status = 'ok' THEN CAST(r.id % 9 + r.tokens % 5 - 2 AS BIGINT) END AS est_count,
        CASE WHEN r.status = 'ok' AND r.id % 7 <> 0 THEN r.tokens % 100 / 100.0E0 END AS matched_iou
        FROM {responses} r JOIN {questions} q ON q.question_id = r.question_id""",
    "judges": """SELECT doc_id AS response_id, 't' || CAST(doc_id % 3 AS STRING) AS task, 'm' || CAST(doc_id % 4 AS STRING) AS model,
        CAST(doc_id * 7 % 5 AS INT) AS interpretation1, CAST((doc_id * 7 + quality) % 5 AS INT) AS interpretation2,
        CAST(doc_id * 3 % 5 AS INT) AS knowledge1, CAST((doc_id * 3 + toxic) % 5 AS INT) AS knowledge2,
        CAST(CASE WHEN doc_id % 17 = 0 THEN NULL ELSE doc_id * 11 % 5 END AS INT) AS visual1, CAST((doc_id * 11 + quality * toxic) % 5 AS INT) AS visual2, quality, toxic FROM {labels}""",
}


#: Rows of the annotations that one task sorts.
ANNOTATIONS_A_TASK = 400_000


class Views:
    """The tables and views of one folder as DataFrames, each made on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        made = self.__dict__["_made"]
        if name not in made:
            if name in TABLES:
                made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                text = VIEWS[name]
                made[name] = self.spark.sql(text, **{t: getattr(self, t) for t in (*TABLES, *VIEWS) if "{" + t + "}" in text})
            else:
                raise AttributeError(name)
        return made[name]

    @cached_property
    def annotation_parts(self) -> int:
        """Tasks over the annotations as they lie by image_id."""
        return max(-(-self.lineitem.count() // ANNOTATIONS_A_TASK), int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    @cached_property
    def annotations(self) -> DataFrame:
        """The view of that name, with tasks whose number grows with the lines.

        Images and parts grow with the lines too, and tables of keys are far smaller in their files than in a task's memory, so that
        a broadcast of them, which Spark decides on by the files, is made only of a few rows.  Rows lie by image_id once they are joined, and
        all that groups, joins or ranks by image finds them so."""
        lines = self.lineitem.select(F.col("l_orderkey").alias("image_id"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
        species = self.part.select(F.col("p_partkey").alias("l_partkey"), F.lower("p_type").alias("species"))
        images = self.images.select("image_id", "dataset", "width", "height", "file_name")
        tasks = -(-self.lineitem.count() // ANNOTATIONS_A_TASK)
        rows = growing(growing(lines, species, "l_partkey", tasks), images, "image_id", tasks)
        order = Window.partitionBy("image_id").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        return rows.select(
            *("dataset", "image_id", "width", "height", "file_name", "species"),
            F.expr("CASE l_returnflag WHEN 'R' THEN 'crop' ELSE 'weed' END AS role"),
            F.expr("CAST((l_partkey * 37) % 600 AS DOUBLE) AS x"), F.expr("CAST((l_suppkey * 53) % 400 AS DOUBLE) AS y"),
            F.expr("5 * l_quantity AS w"), F.expr("4 * l_quantity AS h"),
            F.row_number().over(order).cast("int").alias("ord"),
        )

    @cached_property
    def boxes(self) -> DataFrame:
        """One row per image with its boxes in order."""
        from plumbline.operators.reshape import collect_ordered

        return collect_ordered(self.annotations, ["dataset", "image_id", "width", "height"], "ord", ["x", "y", "w", "h"], "boxes")
