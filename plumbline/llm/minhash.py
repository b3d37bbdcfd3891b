"""Near-duplicate documents: b-bit MinHash with a multi-index Hamming join.

Signature: 64 symbols of 16 bits, each the low bits of one MinHash over the
distinct five-word shingles.  The 64 symbols form 16 chunks of four.  If two
signatures differ in at most 31 symbols, some chunk differs in at most one
(16 chunks with two errors each would make 32), so every such pair shares one
of the 64 keys "chunk c without its symbol j".  At a Jaccard similarity of 0.75
a pair differs in 16 symbols on average; more than 31 has odds under 1 : 100,000.

Copies (equal word sequences) are one vertex.  Links are confirmed on the full
shingle sets.  A bucket is never expanded into its pairs: its members are first
linked to one centre, and only members that are still in different components
afterwards are paired, where the shingles that others have too are enough for a link.

Defined results: null or blank texts have no shingles and link with nothing;
rows with a null id come back with a null component and are kept; repeated
rows share their id's component; a tie of centres goes to the smallest id; a text of any length is
read whole, as a chunk of its own; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._graph import components
from plumbline.llm._store import discard, keep, map_texts, maybe_broadcast
from plumbline.llm._words import Words, chunks, mix

SYMBOLS, CHUNKS, WIDTH = 64, 16, 4
#: Symbols in which a pair may differ: WIDTH * CHUNKS signatures share a key up to here.
RADIUS = 2 * CHUNKS - 1

_rng = np.random.Generator(np.random.PCG64(7))
_XOR = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: One-bit symbols of the longer sketch, 64 to a number, and how many may differ: at a
#: similarity of 0.75 an eighth differs, 128 with a deviation of 10.6.
BITS, BITS_RADIUS = 1024, 176
_BIT_XOR = _rng.integers(0, 1 << 63, BITS, dtype=np.uint64)
_BIT_MUL = _rng.integers(0, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16-bit MinHash symbols (rows x SYMBOLS) of non-empty runs of shingle hashes."""
    out = np.empty((len(first) - 1, SYMBOLS), np.uint16)
    starts = first[:-1]
    for k in range(SYMBOLS):
        least = np.minimum.reduceat((hashes ^ _XOR[k]) * _MUL[k], starts)
        out[:, k] = mix(least) >> np.uint64(48)
    return out


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets)
                hashes, first = words.shingles(size)
                each = np.diff(first)
                full = np.flatnonzero(each)
                count = np.zeros(words.rows, np.int64)
                for r in full:
                    count[r] = len(np.unique(hashes[first[r] : first[r + 1]]))
                sig = signatures(hashes, np.append(first[:-1][full], first[-1])) if len(full) else np.zeros((0, SYMBOLS), np.uint16)
                at = iter(range(len(full)))
                seq = words.sequences()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, words.rows),
                        pa.array([seq[r].tobytes() if each[r] else None for r in range(words.rows)], pa.binary()),
                        pa.array(count),
                        pa.array([sig[next(at)].tobytes() if each[r] else None for r in range(words.rows)], pa.binary()),
                    ],
                    ["id", "cls", "n_shingles", "sig"],
                )

    return run


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for _, data, offsets in chunks(column):
        hashes, first = Words(data, offsets).shingles(size)
        for r in range(len(first) - 1):
            yield np.unique(hashes[first[r] : first[r + 1]])


def _shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, hashes in zip(batch.column(0).to_numpy(), _sets(batch.column(1), size), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), v)), pa.array(hashes.view(np.int64))], ["v", "h"])

    return run


def _bits(size: int):
    """One bit each of BITS MinHashes, for the texts of column 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for hashes in _sets(batch.column(1), size):
                least = np.full(BITS, np.uint64((1 << 64) - 1))
                for k in range(0, len(hashes), 512):
                    part = hashes[k : k + 512, None]
                    least = np.minimum(least, ((part ^ _BIT_XOR) * _BIT_MUL).min(axis=0))
                out.append(np.packbits((mix(least) >> np.uint64(63)).astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["v", "bits"])

    return run


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for a, b in zip(_sets(batch.column(2), size), _sets(batch.column(3), size), strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                same.append(100 * both >= percent * (len(a) + len(b) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts are as similar as asked, as a kept table."""
    pairs = keep(pairs, "pairs")
    right = texts.join(maybe_broadcast(pairs.select(F.col("b").alias("id"), "a")), "id").select("a", F.col("id").alias("b"), F.col("text").alias("text_b"))
    ends = keep(pairs.select(F.col("a").alias("id")).distinct(), "ends")
    left = texts.join(maybe_broadcast(ends), "id").select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    # an id may stand on several rows; its texts are then all compared
    both = left.join(right, "a").select("a", "b", "text_a", "text_b")
    links = keep(map_texts(both, _verify(size, percent), "a long, b long").distinct(), "links")
    discard(pairs, ends)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row of ``docs``.

    Linked are rows whose distinct ``size``-word shingles overlap in at least
    ``percent`` % of their union."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = keep(map_texts(rows, _sign(size), "id long, cls binary, n_shingles long, sig binary"), "signed")
    reps = keep(
        signed.where("cls is not null and id is not null").groupBy("cls").agg(F.min("id").alias("v"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")),
        "reps",
    )
    # rows that share an id are one vertex
    vertices = reps.select("v", "n", "sig", "cls")
    skip = "cast(i % 4 as int)"
    chunk = "cast(i div 4 as int) * 8"
    keys = vertices.select("v", F.posexplode(F.expr(f"transform(sequence(0, {CHUNKS * WIDTH - 1}), i -> xxhash64(i, concat(substring(sig, {chunk} + 1, 2 * {skip}), substring(sig, {chunk} + 2 * {skip} + 3, 6 - 2 * {skip}))))")).alias("i", "key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = keep(keys.join(sizes, "key"), "buckets")
    sig = vertices.select("v", "n", "sig")

    def close(a: str, b: str) -> str:
        return (
            f"least({a}.n, {b}.n) * 100 >= {percent} * greatest({a}.n, {b}.n) and "
            f"size(filter(sequence(0, {SYMBOLS - 1}), i -> substring({a}.sig, 2 * i + 1, 2) <> substring({b}.sig, 2 * i + 1, 2))) <= {RADIUS}"
        )

    # First everyone meets one centre, the bucket mate that shares most: a family
    # of n copies costs n comparisons, and its original is what they share most with.
    weight = buckets.groupBy("v").agg(F.sum("n").alias("weight"))
    weighed = buckets.join(weight, "v").select("key", "v", F.struct("weight", (-F.col("v")).alias("low")).alias("rank"))
    centre = weighed.groupBy("key").agg(F.max("rank").alias("top"))
    star = weighed.join(centre, "key").groupBy("v").agg((-F.max("top")["low"]).alias("centre")).where("v <> centre")
    near = star.alias("e").join(sig.alias("x"), F.expr("e.centre = x.v")).join(sig.alias("y"), F.expr("e.v = y.v")).where(F.expr(close("x", "y")))
    texts = rows.where("id is not null")
    links = _confirmed(near.select(F.col("x.v").alias("a"), F.col("y.v").alias("b")), texts, size, percent)
    labels = components(links)

    # Then whatever a bucket still holds of different components, unless shingles
    # that nobody else there has keep a pair under the threshold.
    placed = keep(buckets.join(labels, "v", "left").select("key", "i", "v", F.coalesce("comp", "v").alias("comp")), "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    torn = keep(placed.join(mixed, "key"), "torn")
    asked = keep(torn.select(F.col("v").alias("id")).distinct(), "asked")
    own = map_texts(texts.join(maybe_broadcast(asked), "id"), _shingles(size), "v long, h long").distinct()
    own = own.groupBy("h").agg(F.count("*").alias("c"), F.min("v").alias("v")).where("c = 1").groupBy("v").agg(F.count("*").alias("own"))
    several = reps.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v").union(_same_id(signed, reps).select("a")).distinct()
    own = own.join(several, "v", "left_anti")
    able = keep(sig.join(asked.withColumnRenamed("id", "v"), "v").join(own, "v", "left").withColumn("s", F.col("n") - F.coalesce("own", F.lit(0))).drop("own").where(f"100 * s >= {percent} * n"), "able")
    bits = map_texts(texts.join(maybe_broadcast(keep(able.select(F.col("v").alias("id")).distinct(), "able_ids")), "id"), _bits(size), "v long, bits array<bigint>")
    able = keep(able.join(bits.join(several, "v", "left_anti"), "v", "left"), "able")
    left = keep(torn.join(able, "v"), "open")
    main = left.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.mode("comp").alias("main")).where("lo <> hi").select("key", "main")
    left = left.join(main, "key")
    most = "least(x.s, y.s)"
    apart = " + ".join(f"bit_count(x.bits[{k}] ^ y.bits[{k}])" for k in range(BITS // 64))
    without = lambda t: f"concat(substring({t}.sig, {chunk} + 1, 2 * {skip}), substring({t}.sig, {chunk} + 2 * {skip} + 3, 6 - 2 * {skip}))"
    pairs = left.where("comp <> main").alias("x").join(
        left.alias("y"),
        F.expr(
            f"x.key = y.key and x.comp <> y.comp and (y.comp = y.main or x.comp < y.comp) and 100 * {most} >= {percent} * (x.n + y.n - {most})"
            f" and coalesce({apart} <= {BITS_RADIUS}, true)"
            # a pair counts in the first bucket it shares
            f" and not exists(sequence(0, {CHUNKS * WIDTH - 1}), i -> i < x.i and {without('x')} = {without('y')})"
        ),
    )
    pairs = pairs.select(F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b")).distinct()
    more = _confirmed(pairs, texts, size, percent)
    everything = keep(links.select("a", "b").union(more.select("a", "b")), "edges")
    discard(labels, buckets, placed, torn, asked, able, links, more)
    labels = components(everything.union(_same_id(signed, reps)))
    discard(everything)

    named = reps.select("cls", "v").join(labels, "v", "left").select("cls", F.coalesce("comp", "v").alias("comp"))
    out = signed.select("id", "cls", "n_shingles").join(named, "cls", "left")
    comp = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("comp", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def _same_id(signed: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges between the classes of rows that share an id."""
    ids = signed.where("id is not null and cls is not null").select("id", "cls").distinct()
    twice = ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    return ids.join(twice, "id").join(reps.select("cls", "v"), "cls").select(F.col("id").alias("a"), F.col("v").alias("b"))
