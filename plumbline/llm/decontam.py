"""Benchmark passages in documents, by SimHash over item-sized windows.

Every window of as many words as an item has gets a 64-bit SimHash of its distinct
five-word shingles.  Two fingerprints within RADIUS bits agree in one of eight bytes up to
RADIUS // 8 bits, so the items are indexed under every byte value that close to
their own, and every window looks up its eight bytes: no fingerprint within the
radius is missed.  Candidates are verified by the exact weighted Jaccard similarity
of the shingle sets; a shingle weighs one over the number of items of the whole
benchmark that hold it.

A window without any shingle of an item has similarity 0, so only windows
that cover one are fingerprinted.

Items are worked on in blocks of at most ``block_words`` words, one pass over the
documents each, so what is sent to the tasks is bounded however large the benchmark.
With several blocks the items that hold a shingle are counted by a distributed
aggregate; a block gets the counts of its own shingles, and every text those of the shared
shingles in it, so that results do not depend on the number of blocks.

Defined results: null and empty texts match nothing, on either side; items and
documents with fewer than five words have one shingle, of all words; a document
shorter than an item is one window; repeated rows match alike; null ids are
reported as null; equal windows of a text are reported by the first; a text of any length is one
task's work, its windows looked up CELLS at a time; an empty table on either side gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._store import keep, map_texts, salted_join
from plumbline.llm._words import SEQ_A, Words, chunks, mix, prefix_sums

#: At a similarity of 0.75 about 11 of 64 bits differ, with a deviation of 3.
RADIUS = 22
BYTES = 8
#: A shingle's weight of 1 in a fingerprint.
UNITS = 1 << 28
#: Words of a shingle; bits of a shingle by which texts are asked for shared ones.
SIZE, MET = 5, 22
#: Windows times items that are looked up at once.
CELLS = 1 << 22
_BIT = np.arange(64, dtype=np.uint64)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Names of all runs of ``size`` word hashes, as Words.shingles gives them."""
    sums, down = prefix_sums(hashes, SEQ_A)
    n = max(0, len(hashes) - size + 1)
    return mix((sums[size : size + n] - sums[:n]) * down[:n] + np.array([size], np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signed(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Every bit's signed weight, in whole units: their sums are exact in any order."""
    bits = ((mix(shingles ^ np.uint64(0x2545F4914F6CDD1D))[:, None] >> _BIT) & np.uint64(1)).astype(np.float64) * 2 - 1
    return bits * np.rint(weights * UNITS)[:, None]


def planes(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Prefix sums of every bit's signed weights, (n + 1) x 64."""
    out = np.zeros((len(shingles) + 1, 64))
    np.cumsum(signed(shingles, weights), axis=0, out=out[1:])
    return out


def repeats(shingles: np.ndarray) -> np.ndarray:
    """Where each shingle stood last before, or -1."""
    order = np.argsort(shingles, kind="stable")
    before = np.full(len(shingles), -1)
    twin = shingles[order[1:]] == shingles[order[:-1]]
    before[order[1:][twin]] = order[:-1][twin]
    return before


def surplus(shingles: np.ndarray, weights: np.ndarray, before: np.ndarray, m: int) -> np.ndarray | None:
    """For each window of ``m`` shingles what occurrences after the first add to its signed weights."""
    again = np.flatnonzero((before >= 0) & (np.arange(len(before)) - before < m))
    if not len(again):
        return None
    each = signed(shingles[again], weights[again])
    out = np.zeros((len(shingles) + 1, 64))
    # the windows that begin at the one before or earlier and reach this one
    np.add.at(out, np.maximum(again - m + 1, 0), each)
    np.add.at(out, before[again] + 1, -each)
    return np.cumsum(out, axis=0, out=out)


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """SimHashes as eight bytes each."""
    return np.packbits(sums > 0, axis=1)


def _near(windows: np.ndarray, prints: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, bits apart) within RADIUS; as many windows at a time as CELLS allows."""
    step, out = max(1, CELLS // len(prints)), []
    for lo in range(0, len(windows), step):
        some = windows[lo : lo + step]
        candidate = index[0][some[:, 0]]
        for b in range(1, BYTES):
            candidate |= index[b][some[:, b]]
        w, i = np.nonzero(candidate)
        apart = _NEAR[some[w], prints[i]].sum(axis=1)
        close = apart <= RADIUS
        out.append((w[close] + lo, i[close], apart[close]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_NEAR = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)], np.uint8)


def weights(shingles: np.ndarray, names: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One over the count of each shingle, by sorted names; 1 for those without."""
    if not len(names):
        return np.ones(len(shingles))
    at = np.minimum(np.searchsorted(names, shingles), len(names) - 1)
    return np.where(names[at] == shingles, 1.0 / count[at], 1.0)


class Items:
    """A block of items: for each number of words its items, their shingles and their index."""

    def __init__(self, ids: list, texts: list[str], size: int = SIZE, shared: tuple[np.ndarray, np.ndarray] | None = None):
        """``shared``: the block's shingles that several items of the benchmark hold, sorted, and how
        many do; without it the block is the whole benchmark."""
        self.size = size
        column = pa.array(texts, pa.string())
        held: list[tuple[int, int, np.ndarray]] = []
        row = 0
        for _, data, offsets in chunks(column):
            w = Words(data, offsets)
            hashes, first = w.shingles(size)
            for r in range(w.rows):
                if first[r + 1] > first[r]:
                    held.append((row + r, int(w.first[r + 1] - w.first[r]), np.unique(hashes[first[r] : first[r + 1]])))
            row += w.rows
        every = np.concatenate([h for *_, h in held]) if held else np.zeros(0, np.uint64)
        self.names, count = np.unique(every, return_counts=True)
        self.weight = 1.0 / count if shared is None else weights(self.names, *shared)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.names >> np.uint64(44)).astype(np.int64)] = True
        self.classes = {}
        for words in sorted({n for _, n, _ in held}):
            mine = [(ids[i], h) for i, n, h in held if n == words]
            prints = np.stack([fingerprint(planes(h, self.weigh(h))[-1:])[0] for _, h in mine])
            # index[byte][value]: the items whose byte is within the allowed errors of the value
            index = _NEAR[prints.T].transpose(0, 2, 1) <= RADIUS // BYTES
            self.classes[words] = ([i for i, _ in mine], [h for _, h in mine], prints, index)
        # postings: which lengths have an item with the shingle
        self.lengths = list(self.classes)
        held_by = [np.searchsorted(self.names, np.unique(np.concatenate(sets))) for _, sets, *_ in self.classes.values()]
        name = np.concatenate([np.zeros(0, np.int64), *held_by])
        length = np.repeat(np.arange(len(held_by)), [len(h) for h in held_by])
        order = np.argsort(name, kind="stable")
        self.posted, self.post = np.searchsorted(name[order], np.arange(len(self.names) + 1)), length[order]

    def weigh(self, shingles: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.names, shingles), max(len(self.names) - 1, 0))
        return np.where(self.names[at] == shingles, self.weight[at], 1.0) if len(self.names) else np.ones(len(shingles))

    def known(self, shingles: np.ndarray) -> np.ndarray:
        may = np.flatnonzero(self.maybe[(shingles >> np.uint64(44)).astype(np.int64)])
        out = np.zeros(len(shingles), bool)
        if len(may):
            at = np.minimum(np.searchsorted(self.names, shingles[may]), len(self.names) - 1)
            out[may] = self.names[at] == shingles[may]
        return out

    def met(self, shingled: dict[int, np.ndarray], hits: dict[int, np.ndarray]) -> list[tuple[int, np.ndarray]]:
        """(number of words, places) of the items' lengths that share a shingle with the text, and where; by one look at
        each known shingle's postings."""
        found = []
        for k, places in hits.items():
            at = np.searchsorted(self.names, shingled[k][places])
            each = self.posted[at + 1] - self.posted[at]
            of = np.repeat(np.arange(len(places)), each)
            length = self.post[np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + self.posted[at][of]]
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1))
            for i, group in zip(length[order][edges], np.split(order, edges[1:]), strict=True) if len(of) else ():
                if min(self.size, self.lengths[i]) == k:
                    found.append((self.lengths[i], places[of[group]]))
        return sorted(found, key=lambda x: x[0])

    def match(self, hashes: np.ndarray, shingled: dict[int, np.ndarray], hits: dict[int, np.ndarray], least: float, shared: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple]:
        """(item, similarity, first word, words, bits apart) of the best window for each item in a text.

        ``shared``: shingles of the text that several items of the benchmark hold, and how many do."""
        found = []
        for words, mine in self.met(shingled, hits):
            ids, sets, prints, index = self.classes[words]
            span = min(words, len(hashes))
            k = min(self.size, span)
            if k != min(self.size, words):
                continue
            shingles = shingled[k]
            m, last = span - k + 1, len(hashes) - span
            starts = np.unique(np.clip(mine[:, None] - np.arange(m), 0, last))
            starts = starts[(mine[np.minimum(np.searchsorted(mine, starts), len(mine) - 1)] >= starts)]
            lo, hi = int(starts[0]), int(starts[-1]) + m
            local = shingles[lo:hi]
            weigh = self.weigh(local) if shared is None else weights(local, *shared)
            sums = planes(local, weigh)
            at = starts - lo
            before = repeats(local)
            more = surplus(local, weigh, before, m)
            print_ = fingerprint(sums[at + m] - sums[at] - (0 if more is None else more[at]))
            w, i, apart = _near(print_, prints, index)
            if not len(w):
                continue
            total = np.concatenate([[0.0], np.cumsum(weigh)])
            for item in np.unique(i):
                inside = np.isin(local, sets[item])
                common = np.concatenate([[0.0], np.cumsum(weigh * inside)])
                own = self.weigh(sets[item]).sum()
                pick = i == item
                best = None
                for p, bits in zip(at[w[pick]], apart[pick], strict=True):
                    both, whole = common[p + m] - common[p], total[p + m] - total[p]
                    if (before[p : p + m] >= p).any():  # a shingle twice in the window
                        once = np.unique(local[p : p + m], return_index=True)[1] + p
                        both, whole = weigh[once][inside[once]].sum(), weigh[once].sum()
                    like = both / (whole + own - both)
                    if like >= least - 1e-12 and (best is None or like > best[1] + 1e-12):
                        best = (ids[item], min(float(like), 1.0), int(p + lo), span, int(bits))
                if best:
                    found.append(best)
        return found


def _scan(items: Items, least: float):
    sizes = sorted({min(items.size, n) for n in items.classes})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, data, offsets in chunks(batch.column(1)):
                w = Words(data, offsets)
                every = {k: runs(w.hash, k) for k in sizes}
                hit = {k: np.flatnonzero(items.known(x)) for k, x in every.items()}
                rows = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.searchsorted(w.first, h, "right") - 1 for h in hit.values())]))
                for r in rows:
                    a, z = w.first[r], w.first[r + 1]
                    # runs that would reach into the next text are left out
                    near = {k: (lambda h: h[(h >= a) & (h <= z - k)] - a)(h) for k, h in hit.items() if z - a >= k}
                    shingled = {k: every[k][a : z - k + 1] for k in near}
                    shared = _shared(batch, int(row + r)) if batch.num_columns > 2 else None
                    out += [(batch.column(0)[int(row + r)].as_py(), *m) for m in items.match(w.hash[a:z], shingled, near, least, shared)]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (batch.column(0).type, pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "item_id", "similarity", "first_word", "n_words", "bits_apart"])

    return run


def _shared(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns 2 and 3: the shared shingles in a text, sorted, and their counts."""
    if not batch.column(2)[row].is_valid:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    names, count = (batch.column(c)[row].values.to_numpy() for c in (2, 3))
    order = np.argsort(names.view(np.uint64))
    return names.view(np.uint64)[order], count[order]


def _held(size: int):
    """(b, h, k): the block of each item, its distinct shingles and their number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            for row, data, offsets in chunks(batch.column(1)):
                w = Words(data, offsets)
                hashes, first = w.shingles(size)
                for r in range(w.rows):
                    h = np.unique(hashes[first[r] : first[r + 1]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), block[row + r])), pa.array(h.view(np.int64)), pa.array(np.full(len(h), min(size, w.first[r + 1] - w.first[r]), np.int32))], ["b", "h", "k"])

    return run


def _met(bits: np.ndarray, sizes: list[int]):
    """(k, h): the distinct runs of the texts in column 1 that may be shared, by their first bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column(1)):
                w = Words(data, offsets)
                for k in sizes:
                    every = runs(w.hash, k)
                    at = (every >> np.uint64(64 - MET)).astype(np.int64)
                    may = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                    of = np.searchsorted(w.first, may, "right") - 1
                    inside = may + k <= w.first[of + 1]
                    may, of = may[inside], of[inside]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + of)), pa.array(every[may].view(np.int64))], ["key", "h"])

    return run


def _with_shared(rows: DataFrame, shared: DataFrame, sizes: list[int]) -> DataFrame:
    """``rows`` (id, text) with the shared shingles (h, c) in each text as lists, as a kept table."""
    met = shared.select(F.shiftrightunsigned("h", 64 - MET).alias("at")).distinct().toArrow().column("at").to_numpy()
    flags = np.zeros(1 << MET, bool)
    flags[met] = True
    keyed = rows.withColumn("key", F.xxhash64("text"))
    runs_ = map_texts(keyed.select("key", "text"), _met(np.packbits(flags, bitorder="little"), sizes), "key long, h long").distinct()
    lists = runs_.join(shared, "h").groupBy("key").agg(F.collect_list(F.struct("h", "c")).alias("l")).select("key", F.col("l.h").alias("names"), F.col("l.c").alias("counts"))
    return keep(salted_join(keyed, keep(lists, "lists"), "key", "id", "left").select("id", "text", "names", "counts"), "texts")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = 0.75, block_words: int = 1_000_000) -> DataFrame:
    """(id, item_id, similarity, first_word, n_words, bits_apart): for every document and item
    that it holds, the most similar window."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    schema = f"id {dict(rows.dtypes)['id']}, item_id long, similarity double, first_word long, n_words long, bits_apart int"
    items = keep(benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null"), "items")
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = 1 + total // (4 * block_words)
    block = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    if blocks > 1:
        held = keep(map_texts(items.select(block.alias("b"), "t"), _held(SIZE), "b long, h long, k int"), "held")
        shared = keep(held.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "shared")
        of_blocks = keep(held.select("b", "h").distinct().join(shared, "h"), "of_blocks")
        rows = _with_shared(rows, shared, [r.k for r in held.select("k").distinct().orderBy("k").collect()])
    out = None
    for k in range(blocks):
        got = items.where(block == k).orderBy("i", "t").toArrow()
        mine = None
        if blocks > 1:
            counts = of_blocks.where(F.col("b") == k).select("h", "c").toArrow()
            names, count = counts.column("h").to_numpy().view(np.uint64), counts.column("c").to_numpy()
            order = np.argsort(names)
            mine = names[order], count[order]
        found = map_texts(rows, _scan(Items(got.column("i").to_pylist(), got.column("t").to_pylist(), SIZE, mine), least), schema)
        if blocks > 1:  # a block's items are held only while it is worked on
            found = keep(found, "found")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)
