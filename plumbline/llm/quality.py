r"""Quality rules with cross-document line frequency (DataFrame functions only).

Lines are normalised (A-Z lower-cased, digits to 0, white space to single spaces) and hashed.  A line is
common on a host when more than ``max_docs`` of its documents have it and these are more than ``percent``
of a hundred of the host's documents.  Common lines are removed; a document is depleted, and
rejected, when it had common lines and less than ``least_percent`` of a hundred of its words are left.  Rules on the
text alone (``least_words``, repeated runs of words) reject too.

Scale: all measures of a text are expressions over its own row, so texts are never shuffled; a row is
read once and leaves numbers and 16 bytes for each line with words.  A document names each line once and
counts are summed before they are dealt, so that a host or a line with a third of all rows costs no
task more than another.  Common lines are broadcast only where they are counted and few; else the lines are
dealt by host, line and a salt.

Defined results: a null text is an empty one and fails the base rules; a null host is a host of its own; null ids are ordinary rows,
repeated rows are documents of their own; equality to the limits removes nothing; an empty table has an
empty result; a long text needs memory in proportion to its own length; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._store import keep, maybe_broadcast, salted_join

GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
GAPS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Letters and digits as a normalised line has them.
PLAIN = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0000000000")
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows of ``window`` words that occur more than once, the first included.

    Windows are compared by 64-bit hashes; only a text that repeats one sorts them with their places."""
    none = F.lit(0).cast("long")
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(window))))

    def twins(sorted_: Column) -> Column:
        beside = lambda e, i: (e["h"] == F.get(sorted_, i - 1)["h"]) | (e["h"] == F.get(sorted_, i + 1)["h"])
        return F.sort_array(F.transform(F.filter(sorted_, beside), lambda e: e["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-window).cast("long").alias("last"), none.alias("n"))
        step = lambda acc, at: F.struct(at.cast("long").alias("last"), (acc["n"] + F.least(F.lit(window).cast("long"), at - acc["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def of(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(placed, lambda s: let(twins(s), covered)))

    return F.when(F.size(words) < window, none).otherwise(let(hashes, of))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, *PLAIN), GAP, " "))


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str, also: Sequence[Column] = ()) -> DataFrame:
    """A kept table: _row, id, host, the base measures, and ``lines`` (hash, words) of the lines that have words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, GAP), "")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    full = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))

    def of_lines(lines: Column) -> Column:
        each = F.transform(lines, lambda line: F.struct(F.xxhash64(normalised(line)).alias("hash"), F.regexp_count(line, F.lit(WORD)).cast("long").alias("words")))
        return F.struct((F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), each.alias("lines"))

    host = F.col(host_col).cast("string")
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), host), F.lit("")).alias("host"),
        F.length(F.translate(text, GAPS, "")).cast("long").alias("word_chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        of_words.alias("w"), let(full, of_lines).alias("l"), *also,
    )
    return keep(rows.select("*", "w.*", "l.*").drop("w", "l"), "measured")


def matched(left: DataFrame, right: DataFrame, on: list[str], by: str) -> DataFrame:
    """``left`` with the one row of ``right`` (a kept table) that has its key."""
    small = maybe_broadcast(right)
    return salted_join(left, right, on, by) if small is right else left.join(small, on)


def common_lines(rows: DataFrame, max_docs: int = 10, percent: int = 1) -> DataFrame:
    """(host, hash, n_docs) of the lines that too many documents of a host have."""
    hosts = keep(rows.groupBy("host").agg(F.count("*").alias("docs")), "hosts")
    counts = rows.select("host", F.explode(F.array_distinct("lines.hash")).alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n_docs"))
    return keep(matched(counts.where(F.col("n_docs") > max_docs), hosts, ["host"], "hash").where(100 * F.col("n_docs") > percent * F.col("docs")).select("host", "hash", "n_docs"), "common")


def removals(rows: DataFrame, common: DataFrame) -> DataFrame:
    """(_row, n_removed_lines, n_removed_words, removed) of documents with common lines; removed: places among the lines with words."""
    lines = rows.select("_row", "host", F.posexplode("lines").alias("at", "line")).select("_row", "host", "at", "line.hash", "line.words")
    hit = matched(lines, common.select("host", "hash"), ["host", "hash"], "_row")
    return hit.groupBy("_row").agg(F.count("*").alias("n_removed_lines"), F.sum("words").alias("n_removed_words"), F.collect_list("at").alias("removed"))


def judged(rows: DataFrame, common: DataFrame, least_words: int = 20, most_repeated: int = 30, least_percent: int = 30) -> DataFrame:
    """``rows`` without their lines, with base_failed, n_removed_lines, n_left_words, removed and kept."""
    out = rows.drop("lines").join(removals(rows, common), "_row", "left")
    gone = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    left = F.col("n_words") - gone
    depleted = (gone > 0) & (100 * left < least_percent * F.col("n_words"))
    return out.withColumns({"n_removed_lines": F.coalesce("n_removed_lines", F.lit(0).cast("long")), "n_left_words": left, "base_failed": failed, "kept": ~failed & ~depleted}).drop("n_removed_words")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 10, percent: int = 1, **rules: int) -> DataFrame:
    """(id, base measures, base_failed, kept, n_removed_lines, n_left_words) for every row."""
    rows = measured(docs, id_col, text_col, host_col)
    out = judged(rows, common_lines(rows, max_docs, percent), **rules)
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(F.col("id").alias(id_col), *measures, "base_failed", "kept", "n_removed_lines", "n_left_words")


def without_common_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_docs: int = 10, percent: int = 1, **rules: int) -> DataFrame:
    """The documents that the rules keep, with all their columns; ``text_col`` has lost its common lines."""
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("doc")
    rows = measured(docs, docs.columns[0], text_col, host_col, [whole])
    kept = judged(rows, common_lines(rows, max_docs, percent), **rules).where("kept")
    text = F.col(f"doc.`{text_col}`")
    split = F.split(text, "\n", -1)
    full = F.filter(F.transform(split, lambda line, i: F.when(line.rlike(WORD), i)), lambda i: i.isNotNull())
    cut = let(full, lambda at: F.transform("removed", lambda k: F.get(at, k)))
    rest = let(split, lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut), lambda i: F.get(lines, i)), "\n"))
    new = F.when(F.col("n_removed_lines") > 0, rest).otherwise(text)
    return kept.select(*[(new if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)
), twins AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1
), repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twins) GROUP BY r
), lines AS MATERIALIZED (
  SELECT r, source, line, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT r, source, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), same AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r
), hosts AS (
  SELECT source, count(*) AS docs FROM d GROUP BY source
), common AS (
  SELECT l.source, l.norm FROM lines l JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source
  GROUP BY l.source, l.norm, h.docs HAVING count(DISTINCT l.r) > 10 AND 100 * count(DISTINCT l.r) > h.docs
), gone AS (
  SELECT l.r, count(*) AS n, sum(l.words)::BIGINT AS words FROM lines l JOIN common c ON c.source IS NOT DISTINCT FROM l.source AND c.norm = l.norm GROUP BY l.r
), m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(s.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(g.n, 0)::BIGINT AS n_removed_lines, coalesce(g.words, 0)::BIGINT AS lost
  FROM d LEFT JOIN repeats p USING (r) LEFT JOIN same s USING (r) LEFT JOIN gone g USING (r)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words - lost AS n_left_words FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines, n_left_words,
       NOT base_failed AND NOT (lost > 0 AND 100 * n_left_words < 30 * n_words) AS kept FROM f
"""
