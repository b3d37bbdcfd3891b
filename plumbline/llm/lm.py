"""Language-model scores by deleted interpolation of a bigram model.

p(w | h) = a * c(h w) / c(h) + b * c(w) / N + (1 - a - b) / (V + 1), with weights for
each bucket of context counts (0, 1, 2-3, 4-7, ...).  The weights come from
expectation-maximisation on held-out counts: every training event is judged
by the counts without itself.  Events with similar frequencies share a cell of a histogram
of fixed size and count with its means, so all events count and the driver sees only cells.

Counts of the whole corpus: documents are put into batches of ``batch_bytes`` of text as they
are read.  A batch names its distinct words and bigrams by 64-bit hashes and sends each shard of
the hash range one packed, sorted array; a shard adds up what all batches sent and returns
each its counts in the same order.  So a frequent word costs a batch one entry,
and no table of the corpus is ever broadcast.  There are as many shards as batches, so what a
task holds stays the same at every size.  Arrays get shorter as the corpus grows: with batches of 64 MB
100 TB still send several names in each, fewer rows than one for every name.

Defined results: null and empty texts are one end token; null ids are training
rows; repeated rows count as often as they stand; a text longer than a batch is a batch of its own;
an empty table gives an empty table; ties cannot occur; without training rows both
scores are 0 for every text; extra columns are ignored.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._store import discard, keep, lean_group, map_texts
from plumbline.llm._words import Words, chunks, mix

_END = np.uint64(0x5851F42D4C957F2D)
_H, _W = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ONE = np.uint64(1)
BUCKETS, STEP, LEVELS = 40, 1.4, 64
#: Bytes of text in a batch.
BATCH = 8 << 20


def pack(a: np.ndarray) -> bytes:
    """Integers as byte planes, compressed; sorted numbers are best sent as differences."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def _joined(batches, size: int):
    """Batches put together until they hold ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _parcel(size: int):
    """Rows put together as compressed parcels of about ``size`` bytes of text; a longer text is one alone."""

    def run(batches):
        for batch in _joined(batches, size):
            for row, data, offsets in chunks(batch.column(1), size):
                n = len(offsets) - 1
                nest = lambda c: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c.slice(row, n))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        nest(batch.column(0)), nest(batch.column(2)), pa.array([np.diff(offsets)], pa.list_(pa.int64())),
                        pa.array([zstandard.ZstdCompressor(level=3).compress(data.tobytes())], pa.binary()), pa.array([len(data)], pa.int64()),
                    ],
                    ["ids", "train", "sizes", "texts", "bytes"],
                )

    return run


class Batch:
    """Tokens of a batch of documents: word, bigram, row; and the sorted names of both."""

    def __init__(self, table: pa.Table):
        words, bigrams, rows, base = [], [], [], 0
        for blob, sizes in zip(table.column("texts"), table.column("sizes"), strict=True):
            text = pa.py_buffer(zstandard.ZstdDecompressor().decompress(blob.as_py()))
            offsets = np.concatenate([[0], np.cumsum(sizes.values.to_numpy())])
            part = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), text)
            for first_row, data, offsets in chunks(part):
                w = Words(data, offsets)
                end = w.first[1:] + np.arange(w.rows)
                token = np.full(len(w.hash) + w.rows, _END)
                inner = np.ones(len(token), bool)
                inner[end] = False
                token[inner] = w.hash
                context = np.concatenate([[_END], token[:-1]])
                words.append(token & ~_ONE)
                bigrams.append(mix(context * _H + mix(token * _W)) | _ONE)
                rows.append(np.repeat(np.arange(w.rows), np.diff(w.first) + 1) + base + first_row)
            base += len(part)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.word, self.bigram, self.row = cat(words, np.uint64), cat(bigrams, np.uint64), cat(rows, np.int64)
        self.begins = np.concatenate([[True], self.row[1:] != self.row[:-1]])
        self.rows = base
        self.ids, self.train_column = (pa.concat_arrays([c.flatten() for c in table.column(n).chunks]) for n in ("ids", "train"))
        self.train = self.train_column.to_numpy(zero_copy_only=False).astype(bool)
        self.names, self.at = np.unique(np.concatenate([self.word, self.bigram]), return_inverse=True)
        self.own = np.bincount(self.at, np.tile(self.train[self.row], 2), len(self.names)).astype(np.uint32)

    def context(self, of_word: np.ndarray) -> np.ndarray:
        """Each token's context's value: that of the word before it, or of the end at a start."""
        end = of_word[-1] if len(of_word) else 0
        out = np.empty_like(of_word)
        out[1:] = of_word[:-1]
        out[self.begins] = end  # the last token is an end
        return out


def _cuts(names: np.ndarray, shards: int) -> np.ndarray:
    edges = [(k << 64) // shards for k in range(1, shards)]
    return np.concatenate([[0], np.searchsorted(names, np.array(edges, np.uint64)), [len(names)]])


def _send(shards: int):
    """Of every parcel its distinct names and their counts, one row for each shard that has some."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                b = Batch(pa.Table.from_batches([batch.slice(r, 1)]))
                cuts = _cuts(b.names, shards)
                full = [k for k in range(shards) if cuts[k + 1] > cuts[k]]
                part = lambda a, k: a[cuts[k] : cuts[k + 1]]  # noqa: E731, B023
                names = [pack(np.diff(part(b.names, k), prepend=np.uint64(0))) for k in full]
                counts = [pack(part(b.own, k)) for k in full]
                key = batch.column("batch")[r].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([key] * len(full), pa.int64()), pa.array(names, pa.binary()), pa.array(counts, pa.binary())], ["shard", "batch", "names", "counts"])

    return run


def _add_up(key, table):
    batch = table.column("batch").to_pylist()
    names = [np.cumsum(unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("names")]
    own = [unpack(x.as_py(), np.uint32) for x in table.column("counts")]
    all_names, at = np.unique(np.concatenate(names), return_inverse=True)
    total = np.bincount(at, np.concatenate(own), len(all_names)).astype(np.int64)
    word = (all_names & _ONE) == 0
    edges = np.cumsum([0, *map(len, names)])
    back = [pack(total[at[a:z]].astype(np.uint64 if total.max() >> 32 else np.uint32)) for a, z in zip(edges, edges[1:], strict=False)]
    wide = bool(total.max() >> 32)
    n = len(batch)
    return pa.table(
        {
            "batch": pa.array([*batch, -1], pa.int64()),
            "shard": pa.array([key[0].as_py()] * (n + 1), pa.int32()),
            "counts": pa.array([*back, b""], pa.binary()),
            "wide": pa.array([wide] * (n + 1)),
            "tokens": pa.array([0] * n + [int(total[word].sum())], pa.int64()),
            "types": pa.array([0] * n + [int((total[word] > 0).sum())], pa.int64()),
        }
    )


def _counts(b: Batch, got: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corpus counts of every token's word, bigram and context."""
    parts = sorted(zip(got.column("shard").to_pylist(), got.column("wide").to_pylist(), got.column("counts").to_pylist(), strict=True))
    count = np.concatenate([unpack(x, np.uint64 if wide else np.uint32).astype(np.int64) for _, wide, x in parts])
    if len(count) != len(b.names):
        raise RuntimeError("a shard's counts are missing")
    n = len(b.word)
    word = count[b.at[:n]]
    return word, count[b.at[n:]], b.context(word)


def bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, 1 + np.log2(np.maximum(context, 1)).astype(np.int64), 0).clip(0, BUCKETS - 1)


def _level(ratio: np.ndarray) -> np.ndarray:
    """0 for nothing, else 1 + the logarithm in steps."""
    out = np.zeros(len(ratio), np.int64)
    some = ratio > 0
    out[some] = (np.log(ratio[some]) / STEP + 10.5).astype(np.int64).clip(1, LEVELS - 1)
    return out


def _cells(tokens: int, types: int):
    """How many training events have which frequencies in the counts without themselves."""

    def run(key, docs, got):
        b = Batch(docs)
        word, pair, context = (x[b.train[b.row]] - 1 for x in _counts(b, got))
        f2 = np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0) * (types + 1)
        f1 = word / max(tokens - 1, 1) * (types + 1)
        cell = (bucket(context) * LEVELS + _level(f2)) * LEVELS + _level(f1)
        cells, at = np.unique(cell, return_inverse=True)
        add = lambda w=None: pa.array(np.bincount(at, w, len(cells)).astype(np.float64))
        return pa.table({"cell": pa.array(cells), "n": add(), "f2": add(f2), "f1": add(f1)})

    return run


def mixture_weights(cells: np.ndarray, n: np.ndarray, f2: np.ndarray, f1: np.ndarray, rounds: int = 60) -> np.ndarray:
    """(a, b, rest) for each bucket, from the cells of all events: how many, and their mean frequencies."""
    which = cells // LEVELS**2
    out = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    out[0] = 0, 0.9, 0.1
    f = np.stack([f2, f1, np.ones(len(cells))])
    for k in np.unique(which):
        mine = which == k
        part, weight, a = f[:, mine], n[mine], out[k].copy()
        for _ in range(rounds):
            each = a[:, None] * part
            a = (each / each.sum(axis=0) * weight).sum(axis=1) / weight.sum()
        a[2] = max(a[2], 1e-6)
        out[k] = a / a.sum()
    out[0] = 0, out[0, 1] / (out[0, 1] + out[0, 2]), out[0, 2] / (out[0, 1] + out[0, 2])
    return out


def _score(tokens: int, types: int, weights: np.ndarray):
    def run(key, docs, got):
        b = Batch(docs)
        word, pair, context = _counts(b, got)
        a = weights[bucket(context)]
        f2 = np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0)
        p = a[:, 0] * f2 + a[:, 1] * word / max(tokens, 1) + a[:, 2] / (types + 1) if tokens else np.ones(len(word))
        base = np.log10((word + 1) / (tokens + types + 1))
        add = lambda w=None: np.bincount(b.row, w, b.rows)
        return pa.table(
            {
                "id": b.ids,
                "train": b.train_column,
                "n_tokens": pa.array(add().astype(np.int64)),
                "n_known": pa.array(add(word > 0).astype(np.int64)),
                "base_score": pa.array(add(base)),
                "score": pa.array(add(np.log10(p))),
            }
        )

    return run


def _free(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of finished stages now."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score), learning from the rows where ``training`` holds.

    Results do not depend on ``batch_bytes``, which bounds what a task holds."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(training, F.lit(True)).alias("train"))
    kind = dict(rows.dtypes)["id"]
    parcels = map_texts(rows, _parcel(batch_bytes), f"ids array<{kind}>, train array<boolean>, sizes array<long>, texts binary, bytes long")
    # written once, so that a parcel holds the same rows in every pass
    rows = keep(parcels.withColumn("batch", F.monotonically_increasing_id()), "parcels")
    shards = 1 + int(rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]) // batch_bytes
    sent = map_texts(rows, _send(shards), "shard int, batch long, names binary, counts binary")
    counts = keep(sent.groupBy("shard").applyInArrow(lean_group(_add_up), "batch long, shard int, counts binary, wide boolean, tokens long, types long"), "counts")
    _free(docs)
    total = counts.where("batch = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()
    back = counts.where("batch >= 0").select("batch", "shard", "counts", "wide")
    both = lambda f, schema: rows.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(lean_group(f), schema)
    cells = both(_cells(total.n, total.v), "cell long, n double, f2 double, f1 double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "f2", "f1")]).orderBy("cell").toArrow()
    _free(docs)
    n, f2, f1 = (cells.column(c).to_numpy() for c in ("n", "f2", "f1"))
    weights = mixture_weights(cells.column("cell").to_numpy(), n, f2 / n, f1 / n)
    out = keep(both(_score(total.n, total.v, weights), f"id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double"), "scores")
    discard(counts, rows)
    return out.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(total.n).cast("long").alias("train_tokens"), "base_score", "score")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score); rows with crc32(id) mod 7 = 2 are never learned from."""
    out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))
    return scores(docs, ~out, id_col, text_col, batch_bytes).withColumn("held_out", ~F.col("train")).select(id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
