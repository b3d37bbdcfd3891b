import brute
import numpy as np
import pytest

from plumbline.llm.hnsw import Graph, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, cls string"


def want(rows, least=0.98):
    ids, vecs, labels = zip(*rows)
    ok = [v is not None and len(v) and lab is not None and None not in v and np.isfinite(v).all() and np.any(v) for v, lab in zip(vecs, labels)]
    unit = [np.asarray(v, np.float32).astype(np.float64) / np.linalg.norm(np.asarray(v, np.float32).astype(np.float64)) if k else None for v, k in zip(vecs, ok)]
    links, edges = [0] * len(rows), []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and labels[i] == labels[j] and len(vecs[i]) == len(vecs[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                edges.append((ids[i], ids[j]))
    comp = brute.components(ids, edges)
    return sorted((i, n, comp[i], comp[i] == i) for i, n in zip(ids, links))


def run(spark, rows, **options):
    got = near_vectors(spark.createDataFrame([(i, v, lab, "x", "y") for i, v, lab in rows], SCHEMA), **options).collect()
    return sorted(map(tuple, got))


def clustered(rng, n, dim=16):
    centres = rng.normal(size=(n // 8 + 1, dim))
    return (centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.15, 0.4], (n, 1))).astype(np.float32)


@pytest.mark.parametrize(("shard", "of"), [(8192, 5), (150, 5), (90, 2)])
def test_against_brute_force(spark, shard, of):
    """of 2: two labels with several shards each."""
    rng = np.random.default_rng(5)
    rows = [(1000 - i, v.tolist(), int(i % of == 0)) for i, v in enumerate(clustered(rng, 700))]
    rows += [(5000 + i, rows[i % 3][1], rows[i % 3][2]) for i in range(9)]
    assert run(spark, rows, shard=shard) == want(rows)


def test_tables(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    got = sorted(map(tuple, near_vectors(vectors).collect()))
    assert got == want(rows)


def test_a_crowd_of_near_copies(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=24)
    rows = [(i, (base + rng.normal(size=24) * 0.02).tolist(), 3) for i in range(500)] + [(600 + i, v.tolist(), 3) for i, v in enumerate(rng.normal(size=(300, 24)))]
    assert run(spark, rows) == want(rows)


def test_odd_rows(spark):
    one = [1.0, 0.0]
    rows = [(1, one, 1), (2, one, None), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [3.0, 0.1], 1), (10, [1.0, 0.0, 0.0], 1), (11, one, 2)]
    assert run(spark, rows) == want(rows)
    got = run(spark, [(4, one, 1), (4, one, 1), (7, one, 1)])
    assert got == [(4, 2, 4, True), (4, 2, 4, True), (7, 2, 4, False)]
    none = near_vectors(spark.createDataFrame([(None, one, 1, "", ""), (3, one, 1, "", "")], SCHEMA)).collect()
    assert sorted(map(str, map(tuple, none))) == ["(3, 1, 3, True)", "(None, 1, None, True)"]
    assert run(spark, []) == []


def test_rare_links_to_another_shard():
    rng = np.random.default_rng(3)
    unit = lambda v: (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    x, q = unit(rng.normal(size=(5000, 48))), unit(rng.normal(size=(3000, 48)))
    audited = np.linspace(0, len(q) - 1, 48).astype(int)
    some = np.setdiff1d(np.arange(0, len(q), 12), audited)
    q[some] = unit(x[rng.choice(len(x), len(some), replace=False)] + rng.normal(size=(len(some), 48)) * 0.02)
    truth = {tuple(p) for p in np.argwhere(q @ x.T >= 0.98)}
    assert len(truth) > 200 and not {r for r, _ in truth} & set(audited)
    graph = Graph(x)
    got = {tuple(p) for p in graph.near(q, 0.98, False)}
    assert len(truth - got) <= 0.005 * len(truth), f"{len(truth - got)} of {len(truth)} lost"
    assert max(r for r, _ in got) < len(q)
    # a graph in which a seventh of the nodes cannot be reached is found out
    for _, links in graph.layers:
        links[links % 7 == 0] = -1
    assert {tuple(p) for p in graph.near(q, 0.98, False)} == truth


def test_graph_recall():
    x = clustered(np.random.default_rng(0), 4000, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(x)
    ids, _, _ = graph._beam(graph.layers[0][1], x[:256], graph.entries(x[:256], 1)[:, None], 64)
    true = np.argsort(-(x[:256] @ x.T), axis=1)[:, :10]
    assert np.mean([len(np.intersect1d(a, b)) / 10 for a, b in zip(ids, true)]) > 0.9
