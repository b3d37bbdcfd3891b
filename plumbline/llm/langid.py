"""Language identification by mixture inference over n-gram likelihoods.

A text is a bag of three-byte grams (ASCII letters folded, other ASCII as
space) in 65,536 hashed bins; each language has a smoothed distribution over the
bins, counted over all its training texts.  Expectation-maximisation estimates in
what proportions the languages make up a document, and the language set is
what its likelihood keeps after a penalty for each language: one is dropped
where that costs less than ``penalty`` * log(grams) / 2.

Defined results: texts that are null or without letters are ``und`` with score
0 and no languages; rows with a null language or id are predicted but never
learned from; without training rows all is ``und``; repeated rows get equal
results; of equal shares the first language by name is taken; a text of any length is read whole; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._store import map_texts
from plumbline.llm._words import chunks

BINS = 1 << 16
SMOOTH = 0.5
ROUNDS = 12
#: Languages of a model.
MOST = 1000

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 0x20
for _c in range(26):
    _FOLD[ord("A") + _c] = _FOLD[ord("a") + _c] = ord("a") + _c
_K = tuple(np.uint32(k) for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
_SPACE = np.uint32(0x20)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, row) of every gram of a chunk that holds a letter; a text is framed by spaces."""
    n, rows = len(data), len(offsets) - 1
    size = np.diff(offsets)
    framed = np.full(n + 2 * rows, _SPACE)
    row = np.repeat(np.arange(rows), size)
    framed[np.arange(n) + 2 * row + 1] = _FOLD[data]
    if len(framed) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = framed[:-2], framed[1:-1], framed[2:]
    owner = np.repeat(np.arange(rows), size + 2)
    good = (owner[:-2] == owner[2:]) & ((a != _SPACE) | (b != _SPACE) | (c != _SPACE))
    bins = (a * _K[0] + b * _K[1] + c * _K[2]) >> np.uint32(16)
    return bins[good].astype(np.int64), owner[:-2][good]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        lang = batch.column(0).to_pylist()
        for row, data, offsets in chunks(batch.column(1)):
            bins, owner = grams(data, offsets)
            names = {x: k for k, x in enumerate(dict.fromkeys(lang[row : row + len(offsets) - 1]))}
            code = np.array([names[x] for x in lang[row : row + len(offsets) - 1]])
            for name, k in names.items():
                totals[name] = totals.get(name, 0) + np.bincount(bins[code[owner] == k], minlength=BINS)
    for name, count in totals.items():
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(count[at].astype(np.int64))], ["lang", "bin", "n"])


class Model:
    def __init__(self, names: list[str], counts: np.ndarray, penalty: float):
        self.names, self.penalty = names, penalty
        smooth = counts + SMOOTH
        self.p = (smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Proportions (rows x languages) of the chosen language sets."""
        rows, k = len(offsets) - 1, len(self.names)
        bins, owner = grams(data, offsets)
        key = np.sort((owner << 16 | bins).astype(np.uint64 if rows > 65535 else np.uint32))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key))).astype(np.float32)
        key = key[first]
        row = (key >> 16).astype(np.int64)
        p = self.p[:, (key & 0xFFFF).astype(np.int64)]
        total = np.bincount(row, count, rows)
        share = np.full((k, rows), 1 / k, np.float32)
        share, fit = self._em(p, count, row, rows, total, share)
        open_rows = np.flatnonzero(((share > 0).sum(axis=0) > 1) & (total > 0))
        while len(open_rows):
            pick = np.isin(row, open_rows)
            local = np.searchsorted(open_rows, row[pick])
            part = share[:, open_rows]
            weakest = np.where(part > 0, part, 2).argmin(axis=0)
            part[weakest, np.arange(len(open_rows))] = 0
            part /= part.sum(axis=0)
            part, lower = self._em(p[:, pick], count[pick], local, len(open_rows), total[open_rows], part)
            drop = fit[open_rows] - lower < self.penalty * 0.5 * np.log(np.maximum(total[open_rows], 2))
            done = open_rows[drop]
            share[:, done], fit[done] = part[:, drop], lower[drop]
            open_rows = done[(share[:, done] > 0).sum(axis=0) > 1]
        share[:, total == 0] = 0
        return share.T

    def _em(self, p, count, row, rows, total, share):
        edges = np.searchsorted(row, np.arange(rows))
        full = np.flatnonzero(np.diff(np.append(edges, len(row))))
        for _ in range(ROUNDS):
            each = p * share[:, row]
            each *= count / each.sum(axis=0)
            new = np.zeros_like(share)
            if len(full):
                new[:, full] = np.add.reduceat(each, edges[full], axis=1)
            new /= np.maximum(total, 1)
            moved = np.abs(new - share).max(initial=0)
            share = new.astype(np.float32)
            if moved < 0.003:
                break
        fit = np.bincount(row, count * np.log((p * share[:, row]).sum(axis=0)), rows)
        return share, fit


def train(docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", penalty: float = 1.0) -> Model:
    """Counts over all rows where ``training`` holds; they are languages x 65,536 numbers, of ``MOST`` languages at most."""
    known = docs.where(training & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string")).distinct()
    if known.limit(MOST + 1).count() > MOST:
        raise ValueError(f"{lang_col} has more than {MOST} values; a model of so many languages does not fit the driver")
    rows = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    table = map_texts(rows, _count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    lang = table.column("lang").to_pylist()
    names = sorted(set(lang))
    counts = np.zeros((len(names), BINS))
    code = {x: i for i, x in enumerate(names)}
    counts[[code[x] for x in lang], table.column("bin").to_numpy()] = table.column("n").to_numpy()
    return Model(names, counts, penalty)


def predict(docs: DataFrame, model: Model, text_col: str = "text", into: tuple[str, str, str] = ("lang_pred", "score", "languages")) -> DataFrame:
    """``docs`` with the language, its share of the text and the chosen set, as the columns ``into``;
    columns of ``docs`` by these names are replaced."""
    names = [n for n in docs.columns if n not in into]
    text = F.col(f"`{text_col}`").cast("string")
    # a Java class, because it knows the letters of every script
    rows = docs.select(*[F.col(f"`{n}`") for n in names], F.when(text.rlike(r"\p{L}"), text).alias("_text_"))
    extra = f"{into[0]} string, {into[1]} double, {into[2]} array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            parts = [model.predict(data, offsets) for _, data, offsets in chunks(column)] if model.names else []
            share = np.concatenate(parts) if parts else np.zeros((len(column), 1))
            known = valid & (share.sum(axis=1) > 0) & bool(model.names)
            best = share.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(len(names))),
                    pa.array([model.names[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()),
                    pa.array(np.where(known, np.clip(share.max(axis=1, initial=0), 0, 1), 0.0).astype(np.float64)),
                    pa.array([[model.names[j] for j in np.flatnonzero(s)] if k else [] for s, k in zip(share, known, strict=True)], pa.list_(pa.string())),
                ],
                [*names, *into],
            )

    schema = rows.drop("_text_").schema.simpleString()  # struct<a:int,...>
    return map_texts(rows, run, f"{schema[:-1]},{','.join(x.replace(' ', ':', 1) for x in extra.split(', '))}>")


def held_out(of: int, remainder: int, id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % of == remainder, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, languages); rows with crc32(id) mod 3 = 1 are never learned from."""
    out = held_out(3, 1, id_col)
    model = train(docs, ~out & F.col(id_col).isNotNull(), text_col, lang_col)
    rows = docs.select(F.col(id_col), out.alias("held_out"), F.col(text_col).alias("_t_"))
    return predict(rows.select("*"), model, "_t_").drop("_t_")
