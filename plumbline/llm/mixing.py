"""Mix sources to target weights along a low-discrepancy schedule (DataFrame functions only).

Every source's documents are laid end to end in a hashed (shuffled) order and
cut into blocks of ``block`` words; a source whose target exceeds its size goes
round again.  Slot i of the schedule has the point frac(i * golden ratio); the
cumulative target shares map it to a source, and the slot takes that source's
next block by rank.  Blocks that the points have not asked for by the end
follow in the last slots, so a source gives its target to the word.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating; they
share all words, no target passes ``cap`` times its source's words, and the
excess is shared again by weight.

Skew: a source is ordered in 4096 hash buckets, whose sums (at most 4096 for a
source) are added up apart, so no task holds a whole source.

Defined results: a null text has size 0 and takes nothing; null sources are one
source; null ids are ordinary rows, dealt by their texts; repeated rows are laid out one by one, equal
keys by id and size; a text of any length is counted whole; an
empty table gives an empty mix; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm._store import keep, maybe_broadcast

WORDS = r"[^\x20\x09-\x0D]+"
#: 2^40 / golden ratio, made odd: slot i has the point (i * GOLDEN mod 2^40) / 2^40.
BITS, GOLDEN = 40, 679559336767
_LOW = 20


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(sid, source, source_size, target, quota): quota is the target in whole words."""
    every = Window.partitionBy()
    cycle = F.array(*map(F.lit, weights))
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", F.get(cycle, F.col("sid") % len(weights))).withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("w"), "sid")
    # in this order the capped sources come first; the level is highest where they end
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = F.max("level").over(every)
    s = s.withColumn("level", rest / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    share = level * F.col("w")
    s = s.withColumn("target", F.when(F.col("most") <= share, F.col("most").cast("double")).otherwise(share))
    return s.select("sid", "source", "source_size", "target", F.least(F.floor(F.col("target") + 0.5), F.col("most")).cast("long").alias("quota"))


def place(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``sized`` with sid and ``start``, the words of its source before it in the order of ``key``."""
    rows = sized.join(maybe_broadcast(sources.select("sid", F.col("source").alias("_s"))), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("bucket", F.substring("key", 1, 3))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy("sid", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(sums, ["sid", "bucket"]).select("sid", "id", "size", (F.col("base") + F.col("start")).alias("start"))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """(position, sid, rank): which source's which block comes when."""
    spark = sources.sparkSession
    blocks = F.ceil(F.col("quota") / block).cast("long")
    totals = sources.agg(F.sum(blocks).alias("n"), F.sum("quota").alias("q")).first()
    slots, words = totals["n"] or 0, totals["q"] or 0
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    s = sources.where("quota > 0").withColumn("hi", F.sum("quota").over(upto)).select(
        "sid", blocks.alias("blocks"), ((F.col("hi") - F.col("quota")) / max(words, 1)).alias("lo"), (F.col("hi") / max(words, 1)).alias("hi")
    )
    cells = 1024
    s_cells = s.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.col("hi") * cells))))
    hi_part, low_part = F.shiftright("id", _LOW), F.col("id").bitwiseAND((1 << _LOW) - 1)
    mask = (1 << BITS) - 1
    point = (hi_part * F.lit((GOLDEN << _LOW) & mask) + low_part * F.lit(GOLDEN)).bitwiseAND(mask) / float(1 << BITS)
    slot = spark.range(slots).select("id", point.alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    hit = slot.join(s_cells, "cell").where("lo <= u and u < hi").select("id", "sid", "blocks")
    hit = hit.withColumn("part", F.shiftright("id", 16))
    counts = hit.groupBy("sid", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy("sid", "part").orderBy("id")) - 1
    ranked = hit.withColumn("rank", number).join(counts, ["sid", "part"]).select(F.col("id").alias("position"), "sid", (F.col("rank") + F.col("base")).alias("rank"), "blocks")
    got = hit.groupBy("sid").agg(F.count("*").alias("n"))
    tail = s.join(got, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < blocks")
    tail = tail.select((F.lit(slots) + F.col("sid")).alias("position"), "sid", F.explode(F.expr("sequence(n, blocks - 1)")).alias("rank"))
    return ranked.where("rank < blocks").select("position", "sid", "rank").unionByName(tail)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """(documents, mix).

    documents: id, size, source, source_size, target, sid, start.
    mix: position, sid, rank, id, start, skip, words: at that position of the mix come
    ``words`` words of the document, after its first ``skip``."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    text = F.col(text_col).cast("string")
    # the text is in the key too, so that rows that share an id, or have none, are spread
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text), F.lit(""))))
    sized = keep(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), key.alias("key")), "sized")
    sources = keep(targets(sized, weights, cap), "sources")
    placed = keep(place(sized, sources), "placed")
    plan = maybe_broadcast(sources.select("sid", "source_size", "quota", "source", "target"))
    laps = placed.where("size > 0").join(plan, "sid").select("sid", "id", "size", "start", "quota", "source_size", F.explode(F.expr("sequence(0, greatest(cast(ceil(quota / source_size) as bigint) - 1, 0))")).alias("lap"))
    laps = laps.withColumn("at", F.col("lap") * F.col("source_size") + F.col("start")).withColumn("end", F.least(F.col("at") + F.col("size"), F.col("quota"))).where("at < end")
    pieces = laps.withColumn("rank", F.explode(F.expr(f"sequence(at div {block}, (end - 1) div {block})")))
    lo, hi = F.greatest("at", F.col("rank") * block), F.least("end", (F.col("rank") + 1) * block)
    pieces = pieces.select("sid", "rank", "id", "start", (lo - F.col("at")).alias("skip"), (hi - lo).alias("words"))
    mix = schedule(sources, block).join(pieces, ["sid", "rank"])
    return placed.join(plan, "sid").select("id", "size", "source", "source_size", "target", "sid", "start"), mix


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, size, source_size, target, taken) for every document."""
    rows, mix = mix_sources(docs, id_col, **options)
    taken = mix.groupBy("sid", "start").agg(F.sum("words").alias("taken"))
    out = rows.join(taken.withColumn("some", F.lit(True)), (rows.sid == taken.sid) & (rows.start == taken.start) & (rows["size"] > 0), "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS key FROM documents
), p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS w,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM d GROUP BY source
), l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
         / (sum(w) OVER (ORDER BY 3 * source_size / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s
), t AS (
  SELECT source, source_size, CASE WHEN 3 * source_size <= max(level) OVER () * w THEN (3 * source_size)::DOUBLE ELSE max(level) OVER () * w END AS target FROM l
), q AS (
  SELECT *, least(floor(target + 0.5), 3 * source_size)::BIGINT AS quota FROM t
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE quota // source_size * size + greatest(0, least(start + size, quota % source_size) - start) END::BIGINT AS taken
FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source
"""
