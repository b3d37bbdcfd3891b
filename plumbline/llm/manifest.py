"""A Merkle manifest of a dataset, built and proved level by level as DataFrames.

Every row is a leaf: the SHA-256 of its columns, each ``-`` where null and else its UTF-8 byte count,
``:`` and value.  The leaves of a group are numbered in order; at each level every ``fanout`` consecutive
nodes (grouped by the floor of their number over the fanout, children in a sorted array) are hashed into a
parent, until one node of the group is left, its subroot.  The subroots, by group, are the leaves of a tree
of the same kind, whose top is the root.  Proofs go the other way: a level's runs are joined with the paths
of their parents, and every child puts its own siblings before its parent's path.

Scale: a level has an eighth of the rows of the one below it, so that all joins together cost little more
than the first; both sides of each have one row per key.  Numbers come from a sort by range and from counts
per range, so no task holds a group, and a group with most of the rows is many ranges.  Levels are written
tables: a lost executor costs its tasks.  The driver learns the length of the longest group, nothing else.

Defined results: a null group is a group of its own and comes first; null ids come first in their group; equal ids are ordered by
leaf; repeated rows are leaves of their own; an empty table has an empty manifest; a lone leaf is its subroot and
a lone subroot the root, with the hash of no siblings as proof; texts of any length are hashed whole, in one pass; columns
that are not named as parts are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm._store import discard, keep, maybe_broadcast

FANOUT = 8
PARTS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(values: Sequence[Column]) -> Column:
    """The leaf of a row with these values."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def hashed(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (a kept table) with ``idx``, the place within ``grp`` in this order, and ``n``, the rows of ``grp``."""
    by = ["grp", *order]
    place = F.monotonically_increasing_id()
    spread = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", place)
    # the bounds of the ranges are sampled: written, so that counts and numbers see the same ones
    spread = keep(spread.withColumns({"_p": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m"), "leaves")
    cells = spread.groupBy("grp", "_p").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    ahead = Window.partitionBy("grp").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("grp", "_p", "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy("grp")).alias("n"))
    out = spread.join(maybe_broadcast(keep(cells, "cells")), ["grp", "_p"])
    return out.withColumn("idx", F.col("_base") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_first", "_base")


def runs(nodes: DataFrame, carry: Sequence[str], fanout: int) -> DataFrame:
    """(grp, up, n, kids, digest): the parents of all nodes whose group has more than one; kids are in order."""
    up = F.floor(F.col("idx") / fanout).alias("up")
    found = nodes.where("n > 1").groupBy("grp", up, F.ceil(F.col("n") / fanout).alias("n")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest", *carry))).alias("kids"))
    return keep(found.withColumn("digest", hashed(F.col("kids.digest"))), "runs")


def climb(nodes: DataFrame, carry: Sequence[str], fanout: int) -> tuple[list[DataFrame], list[DataFrame | None]]:
    """The nodes of each level and the runs that made the next; the last level has none."""
    longest = nodes.agg(F.max("n")).first()[0] or 0
    levels, made = [nodes], []
    while longest > 1:
        made.append(runs(levels[-1], carry if not made else (), fanout))
        levels.append(made[-1].select("grp", F.col("up").alias("idx"), "n", "digest"))
        longest = -(-longest // fanout)
    return levels, [*made, None]


def descend(levels: list[DataFrame], made: list[DataFrame | None], heads: DataFrame, carry: Sequence[str], fanout: int) -> DataFrame:
    """(grp, idx, digest, subroot, root, path, *carry) of the lowest level.  heads (grp, subroot, root, path): of every group's top."""
    known = ["subroot", "root", "path"]
    above = None
    for k in reversed(range(len(levels))):
        extra = carry if k == 0 else ()
        here = levels[k].where("n = 1").join(heads, "grp").select("grp", "idx", "digest", *known, *extra)
        if above is not None:
            digests = F.col("kids.digest")
            side = lambda start, length: F.array_join(F.slice(digests, start, length), "")
            kids = F.transform("kids", lambda kid, i: F.struct(*[kid[c].alias(c) for c in ("idx", "digest", *extra)], F.struct(side(F.lit(1), i).alias("left"), side(i + 2, F.lit(fanout)).alias("right")).alias("step")))  # noqa: B023
            upper = above.select("grp", F.col("idx").alias("up"), *known)
            below = made[k].join(upper, ["grp", "up"]).select("grp", F.explode(kids).alias("kid"), *known)
            below = below.withColumn("path", F.concat(F.array("kid.step"), "path"))
            here = here.unionByName(below.select("grp", *[F.col(f"kid.{c}").alias(c) for c in ("idx", "digest")], *known, *[F.col(f"kid.{c}").alias(c) for c in extra]))
        above = here
    return above


def manifest(docs: DataFrame, parts: Sequence[str] = PARTS, group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """(order, grp, leaf, subroot, root, path, *carry) for every row of ``docs``.

    path: from the leaf to the root, the digests of the run's others as one text ``left`` of the node and one ``right`` of it."""
    carry = carry or {}
    names = [order, *carry]
    value = F.col(group).cast("string")
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), value), F.lit("")).alias("grp"), digest([F.col(c) for c in parts]).alias("digest"), F.col(order).alias(order), *[c.alias(n) for n, c in carry.items()])
    hashed_rows = keep(leaves, "hashed")
    levels, made = climb(numbered(hashed_rows, [order, "digest"]), names, fanout)
    tops = levels[0].where("n = 1").select("grp", "digest")
    for level in levels[1:]:
        tops = tops.unionByName(level.where("n = 1").select("grp", "digest"))
    subroots = keep(tops.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest"), "subroots")
    upper, joined = climb(numbered(subroots, ["of"]), ["of"], fanout)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    top = upper[-1].where("n = 1").select("grp", F.col("digest").alias("subroot"), F.col("digest").alias("root"), nothing.alias("path"))
    of_groups = descend(upper, joined, top, ["of"], fanout)
    heads = keep(of_groups.select(F.col("of").alias("grp"), F.col("digest").alias("subroot"), "root", "path"), "heads")
    discard(hashed_rows)
    return descend(levels, made, heads, names, fanout).withColumnRenamed("digest", "leaf").drop("idx")


def proof_digest(path: Column) -> Column:
    """The hash of all siblings, from the leaf's to the root's."""
    return hashed(F.transform(path, lambda step: F.concat(step["left"], step["right"])))


def folded(leaf: Column, path: Column) -> Column:
    """The root that this leaf leads to along ``path``."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def tamper_check(docs: DataFrame) -> DataFrame:
    """The manifest with each proof's digest, and whether it still holds after every third document (by crc32 of its id) has
    had the letters A-Z of its text lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = digest([F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text")) if c == "text" else F.col(c) for c in PARTS])
    rows = manifest(docs, carry={"tampered": changed})
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("tampered"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS k, i::BIGINT AS c, 0 AS b FROM range(256) r(i)
  UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b + 1 FROM bits WHERE b < 8
), crc AS (
  SELECT list(c ORDER BY k) AS tab FROM bits WHERE b = 8
), named AS (
  SELECT d.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
         lambda a, x: xor(a >> 8, tab[1 + (xor(a, x) & 255)])), 4294967295) AS code FROM documents d, crc
), changed AS (
  SELECT *, CASE WHEN code % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM named
), parts AS (
  SELECT doc_id, lang, other, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM changed
), leaves AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS tampered FROM parts
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM leaves
), up AS (
  SELECT 0 AS level, grp, idx, n, leaf AS digest FROM numbered
  UNION ALL SELECT level + 1, grp, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY level, grp, idx // 8, (n + 7) // 8
), subroots AS (
  SELECT grp, digest AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1
), upper_up AS (
  SELECT 0 AS level, idx, n, subroot AS digest FROM subroots
  UNION ALL SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM upper_up WHERE n > 1 GROUP BY level, idx // 8, (n + 7) // 8
), runs AS (
  SELECT level, grp, idx // 8 AS up, (n + 7) // 8 AS m, list(digest ORDER BY idx) AS kids FROM up WHERE n > 1 GROUP BY ALL
), upper_runs AS (
  SELECT level, idx // 8 AS up, (n + 7) // 8 AS m, list(digest ORDER BY idx) AS kids FROM upper_up WHERE n > 1 GROUP BY ALL
), walk AS (
  SELECT r, grp, 0 AS level, idx, n, tampered AS node, '' AS proof FROM numbered
  UNION ALL SELECT w.r, w.grp, w.level + 1, w.idx // 8, k.m, sha256(array_to_string(kids[:w.idx % 8], '') || node || array_to_string(kids[w.idx % 8 + 2:], '')),
         proof || array_to_string(kids[:w.idx % 8], '') || array_to_string(kids[w.idx % 8 + 2:], '')
  FROM walk w JOIN runs k ON k.level = w.level AND k.grp = w.grp AND k.up = w.idx // 8 WHERE w.n > 1
), upper_walk AS (
  SELECT w.r, 0 AS level, s.idx, s.n, w.node, w.proof FROM walk w JOIN subroots s ON s.grp = w.grp WHERE w.n = 1
  UNION ALL SELECT w.r, w.level + 1, w.idx // 8, k.m, sha256(array_to_string(kids[:w.idx % 8], '') || node || array_to_string(kids[w.idx % 8 + 2:], '')),
         proof || array_to_string(kids[:w.idx % 8], '') || array_to_string(kids[w.idx % 8 + 2:], '')
  FROM upper_walk w JOIN upper_runs k ON k.level = w.level AND k.up = w.idx // 8 WHERE w.n > 1
)
SELECT d.doc_id, d.leaf, s.subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = t.digest AS verified
FROM numbered d JOIN subroots s ON s.grp = d.grp JOIN upper_walk w ON w.r = d.r AND w.n = 1 JOIN upper_up t ON t.n = 1
"""
