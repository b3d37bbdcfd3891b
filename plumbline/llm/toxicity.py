"""Toxicity scores: gradient-boosted trees over dense features, isotonically calibrated.

Features of a text: densities of hits in a lexicon of words and word beginnings
(learned from the labelled rows by log odds), how often a hit stands within
three words of a second-person word, and rates of capitals, shouted words,
punctuation and obfuscated words.  Trees are fitted to features from lexicons
of the other half of the rows, and the calibration to scores of trees of the
other half, so neither sees its own labels twice.

The classifier is fitted on a bounded sample: of the labelled training rows,
the distinct texts of at most ``max_rows`` (default 4,000), by hash of the id.
Every text is scored whole.

Defined results: null and empty texts have all features 0 and a score; rows
with several labels count as toxic if any is; without both labels every score
is the share of toxic rows; null ids are scored and are never training rows; repeated rows get equal scores, and
of equal training texts one counts; a text of any length is read whole; equal raw scores get
one calibrated score; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm._store import keep, map_texts, maybe_broadcast
from plumbline.llm._words import BYTES, FOLDED_CODE, SEPARATOR, chunks, mix, prefix_sums

MAX_ROWS = 4000
#: Bytes of text of that sample.
MAX_BYTES = 256 << 20
#: Bytes of the word beginnings that the lexicon may hold.
BEGINNINGS = (4, 5, 6, 7, 8)
LEXICON = 4000
#: Second-person words of the languages in use (fixed values).
SECOND_PERSON = "you your yours yourself u tu te toi vous votre vos du dich dir dein ihr euch tú ti usted ustedes vosotros".split()

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True
_SYMBOL = ~_WORD & ~SEPARATOR
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True


class Units:
    """Words of a chunk without outer punctuation, and the hashes a lexicon knows them by."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        gap = SEPARATOR[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = gap[:-1], gap[1:]
        a = np.flatnonzero(~gap & (before | cut[:-1]))
        z = np.flatnonzero(~gap & (after | cut[1:])) + 1
        # the first and last word byte inside each run
        inside = np.concatenate([[0], np.cumsum(_WORD[data])])
        has = inside[z] > inside[a]
        at = np.flatnonzero(_WORD[data])
        self.row = np.searchsorted(offsets, a, "right") - 1
        self.raw = (a, z)
        self.start, self.end = a.copy(), a.copy()
        self.start[has], self.end[has] = at[inside[a[has]]], at[inside[z[has]] - 1] + 1
        self.sums, self.down = prefix_sums(FOLDED_CODE[data], BYTES)
        self.data, self.offsets = data, offsets

    def names(self, size: int | None) -> np.ndarray:
        """Hash of the whole word, or of its first bytes; 0 where it has no more than those."""
        end = self.end if size is None else np.minimum(self.start + size, self.end)
        name = mix((self.sums[end] - self.sums[self.start]) * self.down[self.start] + np.uint64(1 + (size or 0)))
        name[(end == self.start) if size is None else (self.end - self.start <= size)] = 0
        return name


def unit_names(text: str) -> int:
    data = np.frombuffer(text.encode(), np.uint8)
    return int(Units(data, np.array([0, len(data)])).names(None)[0])


_YOU = np.sort(np.array([unit_names(w) for w in SECOND_PERSON], np.uint64))


class Lexicon:
    def __init__(self, names: np.ndarray, weights: np.ndarray):
        order = np.argsort(names)
        self.names, self.weights = names[order], weights[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.names >> np.uint64(48)).astype(np.int64)] = True

    def weigh(self, names: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names), np.float32)
        may = np.flatnonzero(self.maybe[(names >> np.uint64(48)).astype(np.int64)])
        if len(self.names) and len(may):
            at = np.minimum(np.searchsorted(self.names, names[may]), len(self.names) - 1)
            hit = self.names[at] == names[may]
            out[may[hit]] = self.weights[at[hit]]
        return out


def learn_lexicon(units: list[np.ndarray], toxic: np.ndarray) -> Lexicon:
    """units: each row's distinct unit names."""
    names, inverse = np.unique(np.concatenate(units) if units else np.zeros(0, np.uint64), return_inverse=True)
    row = np.repeat(np.arange(len(units)), [len(u) for u in units])
    bad = np.bincount(inverse, toxic[row], len(names))
    good = np.bincount(inverse, ~toxic[row], len(names))
    t, c = toxic.sum() + 1.0, (~toxic).sum() + 1.0
    weight = np.log((bad + 0.05) / t) - np.log((good + 0.5) / c)
    share = (bad + good) / (t + c)
    z = (bad / t - good / c) / np.sqrt(share * (1 - share) * (1 / t + 1 / c) + 1e-12)
    fit = np.flatnonzero((bad >= 3) & (z > 4) & (weight > 0.7) & (names != 0))
    fit = fit[np.argsort(-z[fit], kind="stable")[:LEXICON]]
    return Lexicon(names[fit], weight[fit].astype(np.float32))


FEATURES = ("log_words", "hit", "strong", "weight", "hits", "strong_hits", "near_you", "capitals", "shouted", "symbols", "exclaimed", "obfuscated", "starred", "best", "kinds")


def features(units: Units, lexicon: Lexicon) -> np.ndarray:
    rows = len(units.offsets) - 1
    out = np.zeros((rows, len(FEATURES)), np.float32)
    row, data = units.row, units.data
    count = lambda w=None: np.bincount(row, w, rows)
    n = np.maximum(count(), 1)
    weight = lexicon.weigh(units.names(None))
    for size in BEGINNINGS:
        weight = np.maximum(weight, lexicon.weigh(units.names(size)))
    hit, strong = weight > 0, weight > 2.5
    whole = units.names(None)
    you = np.flatnonzero(np.isin(whole, _YOU))
    near = np.zeros(len(row), bool)
    for step in range(-3, 4):
        to = you + step
        ok = (to >= 0) & (to < len(row))
        ok[ok] = row[to[ok]] == row[you[ok]]
        near[to[ok]] = True
    size = np.diff(units.offsets)
    line = np.repeat(np.arange(rows), size)
    byte = lambda mask: np.bincount(line, mask[data], rows)
    letters, a, z = np.maximum(byte(_LETTER), 1), *units.raw
    within = lambda mask: (c := np.concatenate([[0], np.cumsum(mask[data])]))[units.end] - c[units.start]
    upper, letter, digit, symbol = map(within, (_UPPER, _LETTER, _DIGIT, _SYMBOL))
    length = units.end - units.start
    best = np.zeros(rows, np.float32)
    np.maximum.at(best, row, weight)
    cols = (
        np.log1p(count()), count(hit) / n, count(strong) / n, count(weight) / n, np.log1p(count(hit)), np.log1p(count(strong)),
        count(near & hit) / n, byte(_UPPER) / letters, count((upper == letter) & (letter > 1)) / n, byte(_SYMBOL) / np.maximum(size, 1),
        byte(np.arange(256) == ord("!")) / n, count((letter > 0) & (digit > 0)) / n, count((letter > 0) & (symbol > 0) & (length > 2)) / n,
        best, np.log1p(count(hit & (weight > 1.5))),
    )
    for k, c in enumerate(cols):
        out[:, k] = c
    out[count() == 0] = 0
    return out


class Trees:
    """Boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, leaf: float = 4.0, bins: int = 32):
        self.rounds, self.depth, self.rate, self.leaf, self.bins = rounds, depth, rate, leaf, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)
        score, self.trees = np.full(len(y), self.base), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            self._grow(tree, 0, codes, y - p, p * (1 - p), np.arange(len(y)), score)
            self.trees.append(tree)
        return self

    def _grow(self, tree, node, codes, g, h, rows, score):
        best = (1e-6, -1, 0)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        if node < 2**self.depth - 1 and total_h >= 2 * self.leaf / 4:
            for j in range(codes.shape[1]):
                width = len(self.edges[j]) + 1
                left_g = np.cumsum(np.bincount(codes[rows, j], g[rows], width))[:-1]
                left_h = np.cumsum(np.bincount(codes[rows, j], h[rows], width))[:-1]
                many = np.cumsum(np.bincount(codes[rows, j], minlength=width))[:-1]
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                gain[(many < self.leaf) | (len(rows) - many < self.leaf)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
        _, j, cut = best
        if j < 0:
            value = self.rate * total_g / (total_h + 1)
            tree[node] = (-1, 0.0, value)
            score[rows] += value
            return
        tree[node] = (j, float(self.edges[j][cut]), 0.0)
        low = codes[rows, j] <= cut
        self._grow(tree, 2 * node + 1, codes, g, h, rows[low], score)
        self._grow(tree, 2 * node + 2, codes, g, h, rows[~low], score)

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            feature, edge, value = (np.array(c) for c in zip(*tree, strict=True))
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = feature[node]
                split = j >= 0
                right = x[np.arange(len(x)), np.maximum(j, 0)] > edge[node]
                node = np.where(split, 2 * node + 1 + right, node)
            score += value[node]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, share) of the non-decreasing fit, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, t in zip(score[order], y[order], strict=True):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += t
            blocks[-1][1] += 1
        else:
            blocks.append([t, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, blocks[-1][2], hi]
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([b[0] / b[1] for b in blocks for _ in range(2)])
    return xs, ys


class Model:
    """fit on texts with labels, then scores of chunks of texts."""

    def __init__(self, texts: pa.Array, toxic: np.ndarray):
        self.share = float(toxic.mean()) if len(toxic) else 0.0
        self.trees = None
        if not 1 < toxic.sum() < len(toxic) - 1:
            return
        units = []
        for _, data, offsets in chunks(texts):  # one chunk's words at a time are held
            u = Units(data, offsets)
            names = np.stack([u.names(size) for size in (None, *BEGINNINGS)])
            cut = np.searchsorted(u.row, np.arange(len(u.offsets)))
            units += [np.unique(names[:, cut[r] : cut[r + 1]]) for r in range(len(u.offsets) - 1)]
        fold = np.zeros(len(toxic), np.int64)
        for side in (toxic, ~toxic):
            fold[side] = np.arange(side.sum()) % 2
        both = [learn_lexicon([units[i] for i in np.flatnonzero(fold != k)], toxic[fold != k]) for k in (0, 1)]
        x = np.where((fold == 0)[:, None], *(np.concatenate([features(Units(data, offsets), lexicon) for _, data, offsets in chunks(texts)]) for lexicon in both))
        y = toxic.astype(float)
        self.lexicon = learn_lexicon(units, toxic)
        raw = np.zeros(len(y))
        for k in (0, 1):
            raw[fold == k] = Trees().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
        self.knots = isotonic(raw, y)
        self.trees = Trees().fit(x, y)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.share)
        raw = self.trees.raw(features(Units(data, offsets), self.lexicon))
        # a sliver of the raw score keeps the order within a calibrated step
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw)), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, training: Column, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the labelled rows for whose id ``training`` holds: of at most ``max_rows`` distinct whole texts in a hashed
    order, and of the first of these that have ``max_bytes`` together."""
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & training).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    y = keep(y, "labels")
    # a hash threshold bounds the sample; a little above, then cut exactly
    part = min(1.0, 1.1 * max_rows / max(1, y.count()))
    some = y.where(F.pmod(F.xxhash64("_id", F.lit("toxicity")), F.lit(1_000_000)) < int(part * 1_000_000))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).join(maybe_broadcast(keep(some, "sample")), "_id")
    rows = rows.groupBy(F.xxhash64("_t").alias("_k")).agg(F.min_by("_t", "_id").alias("_t"), F.max("_y").alias("_y"), F.min("_id").alias("_id"))
    rows = keep(rows.withColumns({"_o": F.xxhash64("_id", F.lit("order")), "_n": F.octet_length("_t").cast("long")}), "texts")
    # at most max_rows rows of a few numbers
    first = rows.select("_k", "_o", "_id", "_n").orderBy("_o", "_id").limit(max_rows)
    first = first.withColumn("_sum", F.sum("_n").over(Window.orderBy("_o", "_id").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= max_bytes)
    got = rows.join(F.broadcast(first.select("_k")), "_k").orderBy("_o", "_id").select("_t", "_y").toArrow()
    texts = got.column("_t").combine_chunks()
    texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
    return Model(texts, got.column("_y").to_numpy() > 0)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(offsets) - 1), pa.array(model.score(data, offsets))], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_texts(rows, run, f"id {dict(rows.dtypes)['id']}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(of: int, remainder: int, id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % of == remainder, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted); rows with crc32(id) mod 4 = 2 are never learned from."""
    model = fit(docs, labels, ~held_out(4, 2, id_col), id_col=id_col)
    return scores(docs, model, id_col).select(id_col, held_out(4, 2, id_col).alias("held_out"), "score", "predicted")
