"""Token counts under a sentencepiece BPE model by rank-synchronous array merging.

Texts become code points; a space is the word mark and every non-empty text
begins with one.  They are cut wherever no piece of the vocabulary spans two
neighbouring code points, which no merge can cross, and equal pre-tokens are
counted once.  Distinct pre-tokens lie end to end in flat arrays; every round
finds each one's lowest-rank pair and merges it in all of them at once.  A
piece that could be part of an earlier-ranked one is merged leftmost first, so
the result is that of the library's priority queue.  What no piece covers
counts its UTF-8 bytes (byte fallback).

Defined results: null and empty texts have no tokens; any length of text is
counted whole; repeated rows and ties of id are counted row by row; an empty table gives an
empty table; ids are carried as they are and extra columns ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._store import map_texts
from plumbline.llm._words import Powers, chunks, mix

MARK = 0x2581
_CHUNK = 1 << 21
#: Distinct pre-tokens that a worker remembers; beyond it they are counted anew.
REMEMBER = 1 << 20
_NONE = np.int64(1) << 40
_POINTS = Powers(0x9E3779B97F4A7C15 | 1)


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in ids}
        order = {p: k for k, p in enumerate(sorted(pieces, key=lambda p: -pieces[p]))}
        symbol = np.full(0x110000, -1, np.int64)
        letters = np.zeros(0x110000, np.int32)
        pairs, bigrams, unsafe = {}, set(), set()
        for p, k in order.items():
            if len(p) == 1:
                symbol[ord(p)] = k
            bigrams.update(zip(p, p[1:]))
            for cut in range(1, len(p)):
                a, b = order.get(p[:cut]), order.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * len(order) + b] = k
                    unsafe.update(x for x in (a, b) if x > k)
        for k, c in enumerate(sorted({c for ab in bigrams for c in ab}), 1):
            letters[ord(c)] = k
        n = int(letters.max()) + 1
        self.joins = np.zeros((n, n), bool)
        for a, b in bigrams:
            self.joins[letters[ord(a)], letters[ord(b)]] = True
        self.symbol, self.letters, self.size = symbol, letters, len(order)
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.unsafe = np.zeros(len(order), bool)
        self.unsafe[list(unsafe)] = True
        self.known, self.value = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that a and b make, which is its rank, or _NONE."""
        key = np.where((a < 0) | (b < 0), -1, a * self.size + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NONE)

    def merge(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tokens of each of the sequences first[i]:first[i + 1] of code points."""
        sym = self.symbol[points]
        count = np.diff(first)
        wide = np.where(sym < 0, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), 1)
        total = np.add.reduceat(wide, first[:-1])
        live = np.flatnonzero(count > 1)
        seq = np.repeat(np.arange(len(count)), count)
        keep = (count > 1)[seq]
        sym, seq = sym[keep], seq[keep]
        rank = np.full(len(sym), _NONE)
        fresh = np.flatnonzero(seq[1:] == seq[:-1])
        while len(sym):
            rank[fresh] = self.ranks(sym[fresh], sym[fresh + 1])
            start = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            live = seq[start]
            least = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(sym)))
            going = np.repeat(least < _NONE, length)
            hit = np.flatnonzero((rank == np.repeat(least, length)) & going)
            if not len(hit):
                break
            new_run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            run = np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
            take = (np.arange(len(hit)) - run) % 2 == 0
            head = np.concatenate([[True], seq[hit[1:]] != seq[hit[:-1]]])
            hit = hit[np.where(self.unsafe[rank[hit]], head, take)]
            sym[hit] = rank[hit]
            total -= np.bincount(seq[hit], minlength=len(total))
            stay = going.copy()
            stay[hit + 1] = False
            moved = np.cumsum(stay) - 1
            rank[hit] = _NONE
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
            at = moved[hit]
            fresh = np.unique(np.concatenate([at, at - 1]))
            fresh = fresh[(fresh >= 0) & (fresh < len(sym) - 1)]
            last = seq[fresh] != seq[fresh + 1]
            rank[fresh[last]] = _NONE
            fresh = fresh[~last]
        return total

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row of a chunk of UTF-8 texts."""
        text = data.tobytes()
        points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        if lead[-1] != len(points):  # not valid UTF-8: row by row
            return np.concatenate([self.counts(c, np.array([0, len(c)])) for c in (np.frombuffer(text[a:z].decode("utf-8", "replace").encode(), np.uint8) for a, z in zip(offsets, offsets[1:]))])
        bounds = lead[offsets]
        full = np.flatnonzero(np.diff(bounds))
        rows = len(offsets) - 1
        if not len(full):
            return np.zeros(rows, np.int64)
        points = np.insert(points, bounds[full], MARK)
        starts = bounds[full] + np.arange(len(full))
        points[points == 0x20] = MARK
        letter = self.letters[points]
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.joins[letter[:-1], letter[1:]]
        cut[starts] = True
        first = np.append(np.flatnonzero(cut), len(points))
        up, down = _POINTS.to(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        name = mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(np.uint64))
        names, example, back = np.unique(name, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, names), max(len(self.known) - 1, 0))
        old = self.known[at] == names if len(self.known) else np.zeros(len(names), bool)
        value = np.zeros(len(names), np.int64)
        value[old] = self.value[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            size = first[example[new] + 1] - first[example[new]]
            inner = np.concatenate([[0], np.cumsum(size)])
            where = np.repeat(first[example[new]] - inner[:-1], size) + np.arange(inner[-1])
            value[new] = self.merge(points[where], inner)
            if len(self.known) + len(new) <= REMEMBER:
                both = np.concatenate([self.known, names[new]])
                order = np.argsort(both, kind="stable")
                self.known, self.value = both[order], np.concatenate([self.value, value[new]])[order]
        row = full[np.searchsorted(starts, first[:-1], "right") - 1]
        return np.bincount(row, value[back], rows).astype(np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(path)
        for batch in batches:
            for row, data, offsets in chunks(batch.column(1), _CHUNK):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(offsets) - 1), pa.array(np.diff(offsets)), pa.array(pieces.counts(data, offsets))], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_texts(rows, run, f"id {dict(rows.dtypes)['id']}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
