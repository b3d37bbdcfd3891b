"""Remove byte strings of a given length, and find word passages, that stand more than once in the corpus.

The texts are parsed prefix-free: a rolling hash over a few symbols triggers at its
local minima, and every window of ``length`` symbols is owned by the first
trigger of its first symbols.  Equal windows have the same owner at the same
distance, so corpus order only has to be compared among positions whose
trigger is followed by the same phrases.  The orders of dictionary and parse
are combined as equality classes (hashes) in place of ranks, because all that
matters of an order here is which neighbours agree on ``length`` symbols:

1. ``g`` names the symbols after a trigger that all its windows contain.  A class of
   one cannot repeat anything.
2. ``f`` names a trigger's whole stretch, all its windows.  A class of two or
   more repeats all of them.
3. Only what lies between (same ``g``, ``f`` alone) is compared window by
   window, once for each distinct stretch.

Names are compared in pairs, (g, f) and (g, h), of 64 bits each, and texts by two hashes and
their sizes.  Classes are counted by partial aggregates, so a passage of a third of all
documents is no heavier for one task than any other; joins with a hot class are split by
adaptive execution.

A symbol is a byte, or a word ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: the bytes that are removed
repeat in strings of ``length`` bytes, a passage is a run of words that repeats in strings of
``passage`` words.  ``passage`` is 50, as work on exact substring duplicates takes 50 tokens.

Defined results: a null text is empty; texts under ``length`` bytes lose
nothing; repeated rows are copies of each other; null ids are ordinary rows; a text of any
size is parsed in pieces of 4 million symbols; ties of the rolling hash go to the leftmost;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._store import discard, keep, map_texts, maybe_broadcast, salted_join
from plumbline.llm._words import BYTE_CODE, BYTES, SEQ_A, Words, chunks, mix, prefix_sums

#: Symbols hashed for a trigger; no trigger may depend on symbols outside its window.
GRAM = {"byte": 16, "word": 3}
#: Words of a passage.
PASSAGE = 50
WORD = r"[^\x20\x09-\x0D]+"
_PIECE, _POS = 1 << 22, np.uint64((1 << 24) - 1)
_FAR, _LEN = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_KEY = ["k", "kk"]


def reach(length: int, symbol: str) -> int:
    """First symbols of a window in which its trigger lies.  Few stretches of many words are best, as few
    of their windows have to be compared one by one; of bytes many do."""
    return max(1, min(96, length // (2 if symbol == "word" else 4), length - GRAM[symbol]))


class Parse:
    """The stretches of one chunk of texts: owner, first window, end of windows, row; in symbols."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, symbol: str = "byte"):
        if symbol == "word":
            words = Words(data, offsets)
            codes, powers, offsets = words.hash, SEQ_A, words.first
        else:
            codes, powers = BYTE_CODE[data], BYTES
        gram = min(GRAM[symbol], length)
        self.length, self.near, self.offsets = length, reach(length, symbol), offsets
        self.sums, self.down = prefix_sums(codes, powers)
        m = max(0, len(codes) - gram + 1)
        grams = mix((self.sums[gram:] - self.sums[:m]) * self.down[:m])
        owner, start, end, row = [], [], [], []
        for r in np.flatnonzero(np.diff(offsets) >= length):
            for lo in range(int(offsets[r]), int(offsets[r + 1]) - length + 1, _PIECE):
                n = min(_PIECE, int(offsets[r + 1]) - length + 1 - lo)
                cur = (grams[lo : lo + n + self.near - 1] & ~_POS) | np.arange(n + self.near - 1, dtype=np.uint64)
                size = 1
                while 2 * size <= self.near:
                    cur, size = np.minimum(cur[:-size], cur[size:]), 2 * size
                if size < self.near:
                    cur = np.minimum(cur[: len(cur) - (self.near - size)], cur[self.near - size :])
                at = (cur & _POS).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                owner.append(at[first] + lo)
                start.append(first + lo)
                end.append(np.append(first[1:], n) + lo)
                row.append(np.full(len(first), r))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.owner, self.start, self.end, self.row = map(cat, (owner, start, end, row))

    def name(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return mix((self.sums[j] - self.sums[i]) * self.down[i])

    def core(self) -> np.ndarray:
        return self.name(self.owner, self.owner + (self.length - self.near))

    def whole(self) -> np.ndarray:
        lead, width = (self.owner - self.start).astype(np.uint64), (self.end - self.start).astype(np.uint64)
        return mix(self.name(self.start, self.end + self.length - 1) + lead * _FAR + width * _LEN)


def _stretches(length: int, symbol: str):
    """(g, f, k, kk, at, m) of all stretches of the texts in column 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, kk = (batch.column(c).to_numpy() for c in (0, 1))
            for row, data, offsets in chunks(batch.column(2)):
                p = Parse(data, offsets, length, symbol)
                if len(p.row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (p.core().view(np.int64), p.whole().view(np.int64), k[row + p.row], kk[row + p.row], (p.start - p.offsets[p.row]).astype(np.int32), (p.end - p.start).astype(np.int32))],
                        ["g", "f", "k", "kk", "at", "m"],
                    )

    return run


def _windows(length: int, symbol: str):
    """Of the stretches named in column 3 (and alone, in column 4), every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, kk = (batch.column(c).to_numpy() for c in (0, 1))
            for row, data, offsets in chunks(batch.column(2)):
                p = Parse(data, offsets, length, symbol)
                g, f = p.core(), p.whole().view(np.int64)
                cut = np.searchsorted(p.row, np.arange(len(offsets)))
                for r in range(len(offsets) - 1):
                    every, alone = (batch.column(c)[row + r].values.to_numpy() for c in (3, 4))
                    mine = np.arange(cut[r], cut[r + 1])
                    mine = mine[np.isin(f[mine], every)]
                    if not len(mine):
                        continue
                    each = p.end[mine] - p.start[mine]
                    of = np.repeat(mine, each)
                    at = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + p.start[of]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(g[of].view(np.int64)),
                            pa.array(p.name(at, at + length).view(np.int64)),
                            pa.array(np.full(len(of), k[row + r])),
                            pa.array(np.full(len(of), kk[row + r])),
                            pa.array((at - p.offsets[r]).astype(np.int32)),
                            pa.array(np.repeat(np.isin(f[mine], alone), each)),
                        ],
                        ["g", "h", "k", "kk", "at", "alone"],
                    )

    return run


def removed_runs(size: int, at: np.ndarray, m: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs (start, end) of symbols in the windows at .. at + m - 1."""
    cover = np.zeros(size + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + m - 1 + length, -1)
    gone = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
    edge = np.flatnonzero(gone[1:] != gone[:-1])
    return edge.reshape(-1, 2)


def with_key(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with _t (text, never null), k and kk (its hashes) and _n (its bytes)."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select("*", t.alias("_t"), F.xxhash64(t).alias("k"), F.xxhash64(F.lit(1), t).alias("kk"), F.octet_length(t).cast("long").alias("_n"))


def copied(counts: DataFrame, length: int, passage: int | None) -> DataFrame:
    """(k, kk, _n, _w) of the texts on several rows that have a repeated string or passage: all of them."""
    some = F.col("_n") >= length
    if passage:
        some |= F.col("_w") >= passage
    return keep(counts.where(some).groupBy(*_KEY, "_n", "_w").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "copies")


def repeats(keyed: DataFrame, copies: DataFrame, length: int, symbol: str = "byte") -> DataFrame:
    """(k, kk, at, m), a kept table: for every text but ``copies`` the lists of its repeated windows."""
    # a text of so many words has two bytes for each but the last
    long = keyed.where(F.col("_n") >= (length if symbol == "byte" else 2 * length - 1))
    schema = "g long, f long, k long, kk long, at int, m int"
    parsed = map_texts(long.select(*_KEY, "_t"), _stretches(length, symbol), schema)
    cores = keep(parsed.groupBy("g").agg(F.count("*").alias("n"), F.min("f").alias("lo"), F.max("f").alias("hi")).where("n > 1").select("g", (F.col("lo") == F.col("hi")).alias("same")), "cores")
    # dealt by g at every size: the classes grow with the corpus
    shared = keep(parsed.join(cores.hint("shuffle_merge"), "g"), "shared")
    wholes = keep(shared.where("not same").groupBy("g", "f").agg(F.count("*").alias("c"), F.min(F.struct(*_KEY)).alias("text")).select("g", "f", "c", "text.*"), "wholes")
    torn = wholes.groupBy("g").agg(F.min("c").alias("least")).where("least = 1").select("g")
    ask = salted_join(wholes, torn, "g", "f").groupBy(*_KEY).agg(F.collect_set("f").alias("every"), F.collect_set(F.when(F.col("c") == 1, F.col("f"))).alias("alone"))
    ask = keep(ask, "ask")
    who = keep(ask.select(*_KEY), "who")
    few = long.join(maybe_broadcast(who), _KEY, "left_semi").select(*_KEY, "_t")
    windows = keep(map_texts(few.join(ask, _KEY).select(*_KEY, "_t", "every", "alone"), _windows(length, symbol), "g long, h long, k long, kk long, at int, alone boolean"), "windows")
    twice = windows.groupBy("g", "h").agg(F.count("*").alias("c"), F.max("alone").alias("alone")).where("c > 1 and alone").select("g", "h")
    torn_spans = windows.where("alone").join(twice, ["g", "h"]).select(*_KEY, "at", F.lit(1).alias("m"))
    # a class may hold a third of the stretches: dealt by their texts too
    several = wholes.where("c > 1").select("g", "f")
    whole_spans = shared.where("same").select(*_KEY, "at", "m").unionByName(salted_join(shared.where("not same"), several, ["g", "f"], "k", salts=4).select(*_KEY, "at", "m"))
    alone = whole_spans.join(maybe_broadcast(copies.select(*_KEY)), _KEY, "left_anti").unionByName(torn_spans)
    spans = keep(alone.groupBy(*_KEY).agg(F.collect_list(F.struct("at", "m")).alias("runs")).select(*_KEY, F.col("runs.at").alias("at"), F.col("runs.m").alias("m")), "spans")
    discard(cores, shared, wholes, ask, who, windows)
    return spans


def _found(keyed: DataFrame, copies: DataFrame, length: int, passage: int | None) -> DataFrame:
    """(k, kk, at, m, w_at, w_m): repeated windows of bytes, and of words, by text; NULL lists where there are none."""
    none = F.lit(None).cast("array<int>")
    out = repeats(keyed, copies, length)
    if not passage:
        return out.withColumns({"w_at": none, "w_m": none})
    words = repeats(keyed, copies, passage, "word").select(*_KEY, F.col("at").alias("w_at"), F.col("m").alias("w_m"))
    both = keep(out.join(words, _KEY, "full"), "found")
    discard(out)
    return both


def _torn_rows(keyed: DataFrame, copies: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of ``keyed`` that repeat something but are no copies, with their windows."""
    who = maybe_broadcast(keep(spans.select(*_KEY), "who"))
    rest = keyed.join(who, _KEY, "left_semi").join(maybe_broadcast(copies.select(*_KEY)), _KEY, "left_anti")
    return rest.join(spans, _KEY)


def _list(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy() if column[row].is_valid else np.zeros(0, np.int32)


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, passage: int | None = PASSAGE) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words) for every row of ``docs``.

    Only strings of ``length`` bytes are removed.  The passages, whatever their bytes, are reported: how
    many runs of repeated words there are, and their words."""
    keyed = with_key(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text")
    words = F.regexp_count("_t", F.lit(WORD)).cast("long") if passage else F.lit(0).cast("long")
    base = keep(keyed.select("_id", *_KEY, "_n", words.alias("_w"), F.sha2("_t", 256).alias("sha")), "base")
    copies = copied(base, length, passage)
    spans = _found(keyed, copies, length, passage)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r, t in enumerate(batch.column(2)):
                text = t.as_buffer()
                at, m, w_at, w_m = (_list(batch.column(c), r) for c in (3, 4, 5, 6))
                runs = removed_runs(len(text), at, m, length)
                said = removed_runs(int((w_at + w_m).max(initial=0)) + (passage or 0), w_at, w_m, passage or 0)
                sha, last = hashlib.sha256(), 0
                for a, z in runs:
                    sha.update(text[last:int(a)])
                    last = int(z)
                sha.update(text[last:])
                out.append((*(batch.column(c)[r].as_py() for c in (0, 1)), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), sha.hexdigest(), len(said), int((said[:, 1] - said[:, 0]).sum())))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [*_KEY, "gone", "runs", "rest", "said", "said_words"])

    torn = map_texts(_torn_rows(keyed, copies, spans).select(*_KEY, "_t", "at", "m", "w_at", "w_m"), cut, "k long, kk long, gone long, runs long, rest string, said long, said_words long")
    torn = keep(torn, "torn")
    discard(spans)
    out = base.join(maybe_broadcast(copies.select(*_KEY, F.lit(True).alias("copy"))), _KEY, "left").join(torn, _KEY, "left")
    gone = F.col("copy") & (F.col("_n") >= length)
    told = F.col("copy") & (F.col("_w") >= (passage or 1 << 62))
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_bytes"),
        F.when(gone, F.col("_n")).otherwise(F.coalesce("gone", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("runs", zero)).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("rest", "sha")).alias("kept_sha256"),
        F.when(told, F.lit(1).cast("long")).otherwise(F.coalesce("said", zero)).alias("n_passages"),
        F.when(told, F.col("_w")).otherwise(F.coalesce("said_words", zero)).alias("n_passage_words"),
    )


def byte_runs(text: bytes, at: np.ndarray, m: np.ndarray, length: int, w_at: np.ndarray, w_m: np.ndarray, passage: int) -> np.ndarray:
    """Maximal runs of bytes in repeated strings of bytes or from the first to the last of repeated words."""
    gone = np.zeros(len(text) + 2, bool)
    for a, z in removed_runs(len(text), at, m, length):
        gone[a + 1 : z + 1] = True
    if len(w_at):
        words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        for a, z in removed_runs(len(words.start), w_at, w_m, passage):
            gone[words.start[a] + 1 : words.end[z - 1] + 1] = True
    return np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)


def without_repeated(docs: DataFrame, text_col: str = "text", length: int = 400, passage: int | None = PASSAGE) -> DataFrame:
    """``docs`` with repeated bytes and repeated passages cut out of its text; half characters at a cut go too."""
    keyed = with_key(docs.select(F.col(text_col).alias("_text")), "_text")
    words = F.regexp_count("_t", F.lit(WORD)).cast("long") if passage else F.lit(0).cast("long")
    counts = keep(keyed.select(*_KEY, "_n", words.alias("_w")), "base")
    copies = copied(counts, length, passage)
    spans = _found(keyed, copies, length, passage)
    names = docs.columns
    schema = docs.withColumn(text_col, F.col(text_col).cast("string")).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = [], len(names)
            for r, t in enumerate(batch.column(n)):
                text = t.as_buffer().to_pybytes()
                left, last = [], 0
                at, m, w_at, w_m = (_list(batch.column(c), r) for c in range(n + 1, n + 5))
                for a, z in byte_runs(text, at, m, length, w_at, w_m, passage or 0):
                    left.append(text[last:a])
                    last = z
                left.append(text[last:])
                texts.append(b"".join(left).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else batch.column(i) for i, c in enumerate(names)], names)

    # by position: the table may have columns of these names itself
    own = [f"_c{i}" for i in range(len(names))]
    rows = with_key(docs.toDF(*own), own[names.index(text_col)])
    torn = map_texts(_torn_rows(rows, copies, spans).select(*own, "_t", "at", "m", "w_at", "w_m"), cut, schema)
    who = maybe_broadcast(keep(spans.select(*_KEY).union(copies.select(*_KEY)).distinct(), "who"))
    clean = rows.join(who, _KEY, "left_anti").select(own).toDF(*names)
    gone = rows.join(maybe_broadcast(copies.select(*_KEY)), _KEY, "left_semi").select(own).toDF(*names).withColumn(text_col, F.lit(""))
    discard(counts)
    return clean.unionByName(torn).unionByName(gone)
