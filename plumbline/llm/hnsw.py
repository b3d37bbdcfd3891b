"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Vectors of one label (and dimension) are dealt into shards of about ``shard`` distinct
vectors by hash.  A shard's graph is built layer by layer with batches of insertions;
beams run for many queries at once in numpy.  Every vector queries every shard of its
label (each pair of shards once, from one side).  A beam that holds nothing but links is
widened, and all beams of a task are widened until a brute-force audit of some
of its queries finds no link missing; beyond MAX_BEAM the rest is scanned exactly.  Between two
shards links may be so rare that no audited query has one: there copies of the searched shard's own
vectors, as far off as a link may be, are searched too, and RECALL of these must be found.
Every link is verified by its cosine in double precision.

A task returns each vector's number of links and a spanning set of edges, never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null label, link with nothing and are kept; equal vectors of a label are one
vertex and count as links of each other; rows with a null id come back with a null component;
rows that share an id are one vertex of the components; a tie of ids goes to the smallest; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._graph import components
from plumbline.llm._store import discard, keep, partitions

SHARD = 8192
DEGREE, BEAM, MAX_BEAM, AUDIT, RECALL = 12, 48, 384, 48, 0.995
#: Planted queries of a search in another shard.
PLANTED = 600
_BLOCK = 256


class Graph:
    """A layered graph over unit vectors x (float32)."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]] | None = None):
        self.x = x
        self.layers = layers if layers is not None else []
        if layers is None:
            self._build()

    def _build(self) -> None:
        n = len(self.x)
        rng = np.random.default_rng(11)
        level = np.floor(-np.log(rng.random(n)) / math.log(DEGREE)).astype(int) if n else np.zeros(0, int)
        top = int(level.max(initial=0))
        done = np.zeros(0, np.int64)
        for k in range(top, -1, -1):
            rest = np.setdiff1d(np.flatnonzero(level >= k), done)
            order = np.concatenate([done, rest])
            width = DEGREE * (2 if k == 0 else 1)
            links = np.full((n, width), -1, np.int32)
            at = 0
            while at < len(order):
                size = 256 if at == 0 else min(at, 1024)
                batch = order[at : at + size]
                near, sim = self._among(batch, min(BEAM, len(batch)))
                if at:
                    entry = self._descend(batch) if self.layers else np.full(len(batch), order[0])
                    for b in range(0, len(batch), _BLOCK):
                        found, like = self._beam(links, self.x[batch[b : b + _BLOCK]], entry[b : b + _BLOCK, None] if entry.ndim == 1 else entry[b : b + _BLOCK], BEAM)[:2]
                        pad = BEAM - found.shape[1]
                        if b == 0:
                            graph_near, graph_sim = [], []
                        graph_near.append(np.pad(found, ((0, 0), (0, pad)), constant_values=-1))
                        graph_sim.append(np.pad(like, ((0, 0), (0, pad)), constant_values=-2))
                    near = np.concatenate([near, np.concatenate(graph_near)], axis=1)
                    sim = np.concatenate([sim, np.concatenate(graph_sim)], axis=1)
                self._connect(links, batch, near, sim, width)
                at += size
            self.layers.insert(0, (order.astype(np.int32), links))
            done = order

    def _among(self, batch: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        sim = self.x[batch] @ self.x[batch].T
        np.fill_diagonal(sim, -2)
        pick = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        like = np.take_along_axis(sim, pick, 1)
        return np.where(like > -2, batch[pick], -1), like

    def _connect(self, links, batch, near, sim, width) -> None:
        """Links to the nearest that no chosen one is nearer to, and back."""
        order = np.argsort(-sim, axis=1, kind="stable")[:, :BEAM]
        near, sim = np.take_along_axis(near, order, 1), np.take_along_axis(sim, order, 1)
        take = np.zeros(near.shape, bool)
        closest = np.full(near.shape, -2, np.float32)  # to a chosen one
        count = np.zeros(len(batch), int)
        for c in range(near.shape[1]):
            ok = (near[:, c] >= 0) & (count < DEGREE) & (sim[:, c] > closest[:, c])
            take[ok, c] = True
            count += ok
            rows = np.flatnonzero(ok)
            if len(rows):
                to = np.einsum("rd,rkd->rk", self.x[near[rows, c]], self.x[near[rows]])
                closest[rows] = np.maximum(closest[rows], to)
        for c in range(near.shape[1]):  # fill up with the nearest others
            more = (near[:, c] >= 0) & ~take[:, c] & (count < DEGREE // 2)
            take[more, c] = True
            count += more
        r, c = np.nonzero(take)
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        links[batch[r], rank] = near[r, c]
        self._back(links, near[r, c], batch[r], width)

    def _back(self, links, to, frm, width) -> None:
        if not len(to):
            return
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        nodes, first = np.unique(to, return_index=True)
        for node, a, z in zip(nodes, first, np.append(first[1:], len(to)), strict=True):
            have = links[node]
            every = np.unique(np.concatenate([have[have >= 0], frm[a:z]]))
            if len(every) > width:
                sim = self.x[every] @ self.x[node]
                by = every[np.argsort(-sim, kind="stable")]
                # the nearest half, and an even choice of the farther ones
                far = by[width // 2 :]
                every = np.concatenate([by[: width // 2], far[np.linspace(0, len(far) - 1, width - width // 2).astype(int)]])
            links[node] = -1
            links[node, : len(every)] = every

    def _descend(self, batch: np.ndarray) -> np.ndarray:
        return self.entries(self.x[batch])

    def entries(self, q: np.ndarray, down_to: int = 0) -> np.ndarray:
        """For each query a near node of the lowest layer above, by greedy descent."""
        layers = self.layers[down_to:]
        out = np.full(len(q), layers[-1][0][0], np.int64)
        for _, links in layers[::-1]:
            for b in range(0, len(q), _BLOCK):
                out[b : b + _BLOCK] = self._beam(links, q[b : b + _BLOCK], out[b : b + _BLOCK, None], 4)[0][:, 0]
        return out

    def _beam(self, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, least: float = 2.0):
        """(ids, similarities) of the best ``beam`` nodes met, and all pairs met with at least ``least``."""
        m, step = len(q), 4
        rows = np.arange(m)[:, None]
        seen = np.zeros((m, len(self.x)), bool)
        ids = entry.astype(np.int64)
        sim = np.einsum("md,mkd->mk", q, self.x[ids])
        seen[rows, ids] = True
        open_ = np.ones(ids.shape, bool)
        hits = [np.argwhere(sim >= least)]
        hits = [np.stack([hits[0][:, 0], ids[tuple(hits[0].T)]], 1)]
        while open_.any():
            rank = np.where(open_, -sim, np.inf)
            width = min(step, rank.shape[1])
            pick = np.argpartition(rank, width - 1, axis=1)[:, :width]
            live = np.take_along_axis(open_, pick, 1)
            np.put_along_axis(open_, pick, False, 1)
            new = links[np.take_along_axis(ids, pick, 1)].astype(np.int64)
            new[~live] = -1
            new = new.reshape(m, -1)
            new[seen[rows, np.maximum(new, 0)]] = -1
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            r, c = np.nonzero(new >= 0)
            if not len(r):
                continue
            at = new[r, c]
            seen[r, at] = True
            like = np.full(new.shape, -2, np.float32)
            like[r, c] = np.einsum("kd,kd->k", q[r], self.x[at])
            good = like >= least
            if good.any():
                hits.append(np.stack([np.nonzero(good)[0], new[good]], 1))
            ids, sim = np.concatenate([ids, new], 1), np.concatenate([sim, like], 1)
            open_ = np.concatenate([open_, like > -2], 1)
            if ids.shape[1] > beam:
                best = np.argpartition(-sim, beam - 1, axis=1)[:, :beam]
                ids, sim, open_ = (np.take_along_axis(x, best, 1) for x in (ids, sim, open_))
        order = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1), np.concatenate(hits)

    def planted(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, queries): nodes by lot, and for each a vector with a cosine of ``least`` to it."""
        rng = np.random.default_rng(13)
        nodes = rng.choice(len(self.x), min(PLANTED, len(self.x)), replace=False)
        at = self.x[nodes].astype(np.float64)
        off = rng.normal(size=at.shape)
        off -= np.einsum("kd,kd->k", off, at)[:, None] * at
        off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-9)
        return nodes, (least * at + math.sqrt(max(0.0, 1 - least * least)) * off).astype(np.float32)

    def near(self, q: np.ndarray, least: float, own: bool) -> np.ndarray:
        """Pairs (query, node) with a cosine of ``least`` or a hair less."""
        soft = least - 1e-4
        n = len(q)
        if not n or not len(self.x):
            return np.zeros((0, 2), np.int64)
        audit = np.unique(np.linspace(0, n - 1, min(AUDIT, n)).astype(int))
        truth = q[audit] @ self.x.T >= soft
        nodes = np.zeros(0, np.int64)
        if not own:
            nodes, more = self.planted(least)
            q = np.concatenate([q, more])
        entry = np.arange(n) if own else self.entries(q, 1 if len(self.layers) > 1 else 0)
        beam, todo, found = BEAM, np.arange(len(q)), np.zeros((0, 2), np.int64)
        while len(todo):
            if beam > MAX_BEAM:
                found = np.concatenate([found[~np.isin(found[:, 0], todo)], self._scan(q, todo[todo < n], soft)])
                break
            again = []
            found = found[~np.isin(found[:, 0], todo)]
            parts = [found]
            for b in range(0, len(todo), _BLOCK):
                rows = todo[b : b + _BLOCK]
                _, sim, hits = self._beam(self.layers[0][1], q[rows], entry[rows, None], beam, soft)
                parts.append(np.stack([rows[hits[:, 0]], hits[:, 1]], 1))
                again.append(rows[(sim[:, -1] >= soft) & (sim.shape[1] >= beam)])
            found = np.concatenate(parts)
            got = np.zeros(truth.shape, bool)
            at = np.searchsorted(audit, found[:, 0])
            mine = (at < len(audit)) & (audit[np.minimum(at, len(audit) - 1)] == found[:, 0])
            got[at[mine], found[mine, 1]] = True
            crowded = np.concatenate(again)
            checked = ~np.isin(audit, crowded)
            missed = (truth & ~got)[checked].sum()
            failed = missed > (1 - RECALL) * max(truth[checked].sum(), 1)
            if not own:
                ours = found[found[:, 0] >= n] - [n, 0]
                met = np.zeros(len(nodes), bool)
                met[ours[nodes[ours[:, 0]] == ours[:, 1], 0]] = True
                lost = ~met[~np.isin(np.arange(n, len(q)), crowded)]
                # an audit without a link shows nothing
                failed |= lost.sum() > (1 - RECALL) * len(lost) or not (len(lost) or truth[checked].any())
            todo = np.arange(len(q)) if failed else crowded
            beam *= 2
        return found[found[:, 0] < n]

    def _scan(self, q, rows, soft):
        out = [np.zeros((0, 2), np.int64)]
        for b in range(0, len(rows), 1024):
            r, c = np.nonzero(q[rows[b : b + 1024]] @ self.x.T >= soft)
            out.append(np.stack([rows[b + r], c], 1))
        return np.concatenate(out)


def _array(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


_SHARD = "label string, dim int, shard int, ids binary, copies binary, vectors binary, layers array<struct<members: binary, links: binary>>"


def _index(key, table):
    label, dim, shard = (k.as_py() for k in key)
    table = table.sort_by("v")
    raw = table.column("vec").combine_chunks()
    raw = np.asarray(raw.values if isinstance(raw, pa.Array) else raw.chunk(0).values, np.float64).reshape(-1, dim)
    graph = Graph((raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32))
    layers = [{"members": _array(m), "links": _array(links[m])} for m, links in graph.layers]
    row = {
        "label": [label], "dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()),
        "ids": pa.array([_array(table.column("v").to_numpy())], pa.binary()), "copies": pa.array([_array(table.column("copies").to_numpy())], pa.binary()),
        "vectors": pa.array([_array(raw)], pa.binary()),
        "layers": pa.array([layers], pa.list_(pa.struct([("members", pa.binary()), ("links", pa.binary())]))),
    }
    return pa.table(row)


def _search(least: float):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield from search(batch.slice(k, 1)).to_batches()

    def search(row):
        out = []
        for r in row.to_pylist():
            ids, copies, raw = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["copies"], np.int64), np.frombuffer(r["vectors"], np.float64).reshape(-1, r["dim"])
            unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
            layers = []
            for layer in r["layers"]:
                members = np.frombuffer(layer["members"], np.int32)
                links = np.full((len(ids), len(layer["links"]) // 4 // len(members)), -1, np.int32)
                links[members] = np.frombuffer(layer["links"], np.int32).reshape(len(members), -1)
                layers.append((members, links))
            graph = Graph(unit.astype(np.float32), layers)
            own = r["shard"] == r["other"]
            other = unit if own else (x := np.frombuffer(r["other_vectors"], np.float64).reshape(-1, r["dim"])) / np.linalg.norm(x, axis=1, keepdims=True)
            pairs = np.unique(graph.near(other.astype(np.float32), least, own), axis=0)
            if own:  # each pair from both sides, whichever found it
                pairs = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            keep_ = np.concatenate([np.einsum("kd,kd->k", other[p[:, 0]], unit[p[:, 1]]) >= least for p in np.array_split(pairs, 1 + len(pairs) // 100_000)])
            pairs = pairs[keep_]
            offset = 0 if own else len(ids)
            names = ids if own else np.concatenate([ids, np.frombuffer(r["other_ids"], np.int64)])
            many = copies if own else np.concatenate([copies, np.frombuffer(r["other_copies"], np.int64)])
            a, b = pairs[:, 0] + offset, pairs[:, 1]
            links = np.bincount(a, many[b], len(names)) + (0 if own else np.bincount(b, many[a], len(names)))
            root = np.arange(len(names))
            while True:  # the smallest name of each local component
                low = root.copy()
                np.minimum.at(low, a, root[b])
                np.minimum.at(low, b, root[a])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            some = np.flatnonzero(links)
            out.append((names[some], links[some].astype(np.int64), names[root[some]]))
        cols = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
        return pa.table({"v": cols[0], "links": cols[1], "w": cols[2]})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, shard: int = SHARD) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("vec"))
    sound = F.expr("label is not null and vec is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)")
    rows = rows.withColumn("sound", sound)
    cls = F.when(F.col("sound"), F.sha2(F.concat_ws("|", "label", F.to_json("vec")), 256))
    rows = keep(rows.withColumn("cls", cls), "vectors")
    reps = rows.where("sound").groupBy("cls").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("id").alias("low"), F.count("*").alias("copies"))
    # classes without an id still count as links; they get names below all ids
    reps = keep(reps.select("cls", "label", "vec", "copies", "low", F.coalesce("low", -1 - F.abs(F.xxhash64("cls") % (1 << 62))).alias("v"), F.size("vec").alias("dim")), "reps")
    sizes = keep(reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards")), "sizes")
    dealt = reps.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("cls"), F.col("shards")).cast("int"))
    index = keep(dealt.select("label", "dim", "shard", "v", "copies", "vec").groupBy("label", "dim", "shard").applyInArrow(_index, _SHARD), "index")
    # a shard against itself needs no other vectors; the other pairs are dealt by the label and the other
    # shard, so that a label's shards are spread however many rows it has
    none = F.lit(None).cast("binary")
    own = index.select("*", F.col("shard").alias("other"), *[none.alias(f"other_{c}") for c in ("ids", "copies", "vectors")])
    several = index.join(sizes, ["label", "dim"]).where("shards > 1 and shard < shards - 1")
    ask = index.select("label", "dim", F.col("shard").alias("other"), F.col("ids").alias("other_ids"), F.col("copies").alias("other_copies"), F.col("vectors").alias("other_vectors"))
    across = several.withColumn("other", F.explode(F.expr("sequence(shard + 1, shards - 1)"))).drop("shards").join(ask, ["label", "dim", "other"])
    schema = "v long, links long, w long"
    # a row is all that a search needs: dealt by shard, not grouped again
    alone = own.repartition(partitions(spark), "label", "dim", "shard").mapInArrow(_search(least), schema)
    found = keep(alone.unionByName(across.mapInArrow(_search(least), schema)), "found")
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    same = rows.where("sound and id is not null").join(reps.select("cls", "v"), "cls").where("id <> v").select(F.col("id").alias("a"), F.col("v").alias("b"))
    edges = found.where("v <> w").select(F.col("v").alias("a"), F.col("w").alias("b")).union(same)
    labels = components(edges.distinct())
    # a component's name is the smallest real id in it
    real = labels.where("v >= 0").groupBy("comp").agg(F.min("v").alias("name")) if reps.where("low is null").limit(1).count() else labels.where("v = comp").select("comp", F.col("v").alias("name"))
    named = labels.join(real, "comp").select(F.col("v").alias("id"), "name")
    about = reps.join(links, "v", "left").select("cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("id", "cls").join(about, "cls", "left").join(named, "id", "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("name", "id"))
    discard(index)
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))
