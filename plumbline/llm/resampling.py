"""Importance resampling towards a target distribution by hashed n-grams (external sort-count).

Features of a text are its runs of one to three words, each in the bucket crc32 modulo ``buckets``.
The buckets of a chunk of texts are written once, as one packed stream of uint16 with the documents'
offsets beside it.  Counting sorts each stream and run-length encodes it; scoring reads the
streams again, gathers each bucket's gain and adds up between offsets with ``np.add.reduceat``.
A document's score is the sum of its gains and a Gumbel number drawn from its id, so that
the highest scores are a draw without replacement in proportion to exp(weight / 1000).

Scale: both passes are linear and keep a chunk of about 1 MB of text in memory (or one longer text); a
task sends one row per bucket, and the gains are a table of ``buckets`` numbers, at most 65,536,
that goes with the tasks.  Ranks come from a sort by range with counts per range.

Defined results: a null text has no features and the weight 0, as one without words; a null id draws as the
empty text; equal ids get equal draws; ties of score go to the smaller id, then to fewer features (null ids last);
repeated rows are rows of their own; without any text to count, all gains follow from the formula with
zeros; an empty table has an empty result, an empty target is one without features; texts of any
length are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm._store import discard, keep, map_texts
from plumbline.llm._words import chunks

BUCKETS = 10_000
LONGEST_RUN = 3
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 48

_U32 = np.uint32
#: Bytes of words: 0-9, a-z and all of multi-byte characters, after A-Z are lower-cased.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[ord("0") : ord("9") + 1] = IS_WORD[ord("a") : ord("z") + 1] = IS_WORD[0x80:] = True


def _byte_steps() -> np.ndarray:
    """What a CRC-32 register's low byte becomes, by the reflected polynomial."""
    register = np.arange(256, dtype=_U32)
    for _ in range(8):
        register = (register >> _U32(1)) ^ np.where(register & _U32(1), _U32(0xEDB88320), _U32(0))
    return register


STEP = _byte_steps()
ONES = _U32(0xFFFFFFFF)


def _fed(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return STEP[(state ^ _U32(byte) if np.isscalar(byte) else state ^ byte) & _U32(0xFF)] ^ (state >> _U32(8))


def crc_over(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC registers after ``data[start : start + length]``, all rows a byte at a time; the longest rows come first, so
    that those which still have a byte are always a prefix."""
    order = np.argsort(-np.minimum(length, LONG_WORD + 1), kind="stable")
    s, at, size = state[order], start[order], length[order]
    longs = int(np.count_nonzero(length > LONG_WORD))
    for k in range(longs):
        piece = data[at[k] : at[k] + size[k]].tobytes()
        s[k] = zlib.crc32(piece, int(s[k] ^ ONES)) ^ int(ONES)
    s_short, at, left = s[longs:], at[longs:], size[longs:]
    falling = -left
    for j in range(int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(falling, -j, "left"))  # rows with more than j bytes
        s_short[:m] = _fed(s_short[:m], data[at[:m] + j])
    out = np.empty_like(state)
    out[order] = s
    return out


def bucket_stream(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, features, words) of the rows of a chunk: buckets of all features, row after row, and how many each row has."""
    rows = len(offsets) - 1
    data = FOLD[data]
    word = IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    length = np.flatnonzero(word & (~after | edge[1:])) + 1 - start
    row = np.searchsorted(offsets, start, "right") - 1
    n_words = np.bincount(row, minlength=rows)
    n = len(start)
    last = np.cumsum(n_words)[row]  # the first word of a later row
    runs = np.minimum(LONGEST_RUN, last - np.arange(n))  # features that begin at a word
    place = np.cumsum(runs) - runs
    stream = np.empty(int(runs.sum()), np.uint16)
    state, which = np.full(n, ONES, _U32), np.arange(n)
    for k in range(LONGEST_RUN):
        if k:
            more = runs[which] > k
            which, state = which[more], _fed(state[more], 0x20)
        state = crc_over(state, data, start[which + k], length[which + k])
        stream[place[which] + k] = (state ^ ONES) % _U32(buckets)
    features = np.bincount(row, runs, rows).astype(np.int64)
    return stream, features, n_words.astype(np.int64)


def streams(texts: DataFrame, id_col: str | None, text_col: str, buckets: int, tag: str) -> DataFrame:
    """A kept table with a row per chunk: ids, features and words of its rows, and the packed stream."""
    text = F.col(text_col).cast("string").alias("text")
    ids = (F.col(id_col) if id_col else F.lit(None).cast("long")).alias("id")
    rows = texts.select(ids, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column(1)):
                stream, features, words = bucket_stream(data, offsets, buckets)
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                columns = [one(batch.column(0).slice(row, len(offsets) - 1)), one(pa.array(features)), one(pa.array(words)), pa.array([stream.astype("<u2").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "features", "words", "stream"])

    return keep(map_texts(rows, run, f"ids array<{dict(rows.dtypes)['id']}>, features array<long>, words array<long>, stream binary"), tag)


def bucket_counts(packed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all streams fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed_stream in batch.column(0):
                stream = np.sort(np.frombuffer(packed_stream.as_buffer(), "<u2"))
                first = np.flatnonzero(np.diff(stream, prepend=stream[:1] ^ 1))  # where a run of equal buckets begins
                total[stream[first]] += np.diff(np.append(first, len(stream)))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    # at most one row per bucket
    for bucket, n in packed.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of target and source frequency) for each bucket."""
    buckets = len(source)
    top, bottom = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log(((t + 1.0) * top) / ((s + 1.0) * bottom))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def draw(key: object, seed: int) -> int:
    """floor(1000 x a Gumbel number) that depends on the id and the seed only."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(packed: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """(id, n_features, n_words, weight, score) of every row behind the streams."""
    kind = packed.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, features, words = (batch.column(c)[k].values for c in range(3))
                features_of = features.to_numpy()
                stream = np.frombuffer(batch.column(3)[k].as_buffer(), "<u2")
                weight = np.zeros(len(features_of), np.int64)
                some = np.flatnonzero(features_of)
                if len(some):
                    weight[some] = np.add.reduceat(gains[stream], (np.cumsum(features_of) - features_of)[some])
                score = weight + np.array([draw(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, features, words, pa.array(weight), pa.array(score)], ["id", "n_features", "n_words", "weight", "score"])

    return packed.mapInArrow(run, f"id {kind}, n_features long, n_words long, weight long, score long")


def ranked(rows: DataFrame, least_words: int, percent: int) -> DataFrame:
    """``rows`` with the rank of those drawn: the first ``percent`` of a hundred of all with enough words."""
    rows = rows.withColumn("_short", F.col("n_words") < least_words)
    order = ["_short", F.col("score").desc(), F.col("id").asc_nulls_last(), "n_features"]
    place = F.monotonically_increasing_id()
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", place)
    # the bounds of the ranges are sampled: written, so that counts and ranks see the same ones
    spread = keep(spread.withColumns({"_p": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m"), "ordered")
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    cells = spread.groupBy("_p").agg(F.count("*").alias("_n"), F.count_if(~F.col("_short")).alias("_long"))
    cells = cells.select("_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"), F.sum("_long").over(Window.partitionBy()).alias("_all"))
    rank = F.col("_base") + F.col("_i") + 1
    drawn = rank <= F.floor(F.col("_all") * percent / 100)
    return spread.join(F.broadcast(cells), "_p").withColumn("rank", F.when(drawn, rank)).drop("_p", "_i", "_base", "_all", "_short")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, least_words: int = 20, percent: int = 5, seed: int = 42) -> DataFrame:
    """(id, n_features, weight, score, rank) for every row of ``docs``; rank is null where it is not drawn."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket is a uint16")
    raw, wanted = streams(docs, id_col, text_col, buckets, "streams"), streams(target, None, target_col, buckets, "target")
    gains = bucket_gains(bucket_counts(raw, buckets), bucket_counts(wanted, buckets))
    out = ranked(scored(raw, gains, seed), least_words, percent)
    discard(raw, wanted)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS k, i::BIGINT AS c, 0 AS b FROM range(256) r(i)
  UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b + 1 FROM bits WHERE b < 8
), crc AS (
  SELECT list(c ORDER BY k) AS tab FROM bits WHERE b = 8
), texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, true AS own, doc_id, text FROM documents UNION ALL SELECT -row_number() OVER (), false, NULL, text FROM benchmark
), words AS MATERIALIZED (
  SELECT r, own, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS (
  SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM words
), feats AS MATERIALIZED (
  SELECT r, f, count(*) AS n FROM (SELECT r, unnest([w[i], CASE WHEN i < len(w) THEN w[i] || ' ' || w[i + 1] END, CASE WHEN i + 1 < len(w) THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END]) AS f FROM runs)
  WHERE f IS NOT NULL GROUP BY r, f
), named AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)),
         lambda a, x: xor(a >> 8, tab[1 + (xor(a, x) & 255)])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT f FROM feats), crc
), counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (r > 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (r < 0), 0)::DOUBLE AS t FROM feats JOIN named USING (f) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((sum(s) OVER ()) + 10000)) / ((s + 1) * ((sum(t) OVER ()) + 10000))))::BIGINT AS gain FROM counts
), weights AS (
  SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM feats JOIN named USING (f) JOIN gains USING (bucket) WHERE r > 0 GROUP BY r
), scored AS (
  SELECT doc_id, len(w) >= 20 AS long, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (r) WHERE own
), placed AS (
  SELECT *, row_number() OVER (ORDER BY long DESC, score DESC, doc_id NULLS LAST, n_features) AS place, 5 * (count(*) FILTER (long) OVER ()) // 100 AS most FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM placed
"""
