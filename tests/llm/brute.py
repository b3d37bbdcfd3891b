"""Plain Python versions of the operators, for small inputs."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(fold(text))


def shingles(text, size=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def components(vertices, edges):
    parent = {v: v for v in vertices}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in vertices}


def near_duplicates(docs, percent=75):
    """docs: (id, text) -> {id: (n, component)}"""
    sets = {i: shingles(t) for i, t in docs}
    index = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            index[x].add(i)
    edges = set()
    for i, s in sets.items():
        for j in {j for x in s for j in index[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                edges.add((i, j))
    comp = components(sets, edges)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def repeated_bytes(docs, length=400):
    """docs: texts -> [(n_bytes, n_removed, n_spans, remaining bytes)]"""
    data = [(t or "").encode() for t in docs]
    seen = defaultdict(int)
    for d in data:
        for i in range(len(d) - length + 1):
            seen[hash(d[i : i + length])] += 1
    out = []
    for d in data:
        gone = bytearray(len(d) + 1)
        for i in range(len(d) - length + 1):
            if seen[hash(d[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(gone[i] and not gone[i + 1] for i in range(len(d)))
        out.append((len(d), sum(gone), runs, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def passages(docs, size=50):
    """docs: texts -> [(n_passages, n_passage_words, runs of bytes)] of repeated runs of ``size`` words."""
    cut = [[(m.start(), m.end(), fold(m.group())) for m in WORD.finditer(t or "")] for t in docs]
    seen = defaultdict(int)
    for ws in cut:
        for i in range(len(ws) - size + 1):
            seen[tuple(w for *_, w in ws[i : i + size])] += 1
    out = []
    for t, ws in zip(docs, cut):
        gone = [False] * (len(ws) + 1)
        for i in range(len(ws) - size + 1):
            if seen[tuple(w for *_, w in ws[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        edges = [i for i in range(len(ws) + 1) if gone[i] != (gone[i - 1] if i else False)]
        runs = [(len((t or "")[: ws[a][0]].encode()), len((t or "")[: ws[z - 1][1]].encode())) for a, z in zip(edges[::2], edges[1::2])]
        out.append((len(runs), sum(gone), runs))
    return out


def without_repeated(docs, length=400, size=50):
    """docs: texts -> the text left of each."""
    data, out = [(t or "").encode() for t in docs], []
    seen = defaultdict(int)
    for d in data:
        for i in range(len(d) - length + 1):
            seen[hash(d[i : i + length])] += 1
    for d, (_, _, runs) in zip(data, passages(docs, size)):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[hash(d[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        for a, z in runs:
            gone[a:z] = b"\1" * (z - a)
        out.append(bytes(b for b, g in zip(d, gone) if not g).decode("utf-8", "ignore"))
    return out


def contaminated(docs, items, least=0.75):
    """docs, items: (id, text) -> {(doc, item): best weighted similarity over item-sized windows}"""
    sets = {i: shingles(t) for i, t in items}
    held = defaultdict(int)
    for s in sets.values():
        for x in s:
            held[x] += 1
    weigh = lambda s: sum(1 / held[x] if x in held else 1 for x in s)
    out = {}
    for d, text in docs:
        w = words(text)
        mine = shingles(text) | {tuple(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1)}
        for i, t in items:
            n = len(words(t))
            if not sets[i] & mine:
                continue
            for p in range(max(1, len(w) - n + 1)):
                s = shingles(" ".join(w[p : p + n]))
                both = weigh(s & sets[i])
                like = both / (weigh(s) + weigh(sets[i]) - both)
                if like >= least - 1e-12:
                    out[d, i] = max(out.get((d, i), 0), like)
    return out
