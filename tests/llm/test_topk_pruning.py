"""Node pairs and whole cells are skipped by the dual-tree search, and nothing is lost by it."""

import numpy as np
from pyspark.sql import functions as F

from promptscreen.llm import covertree


def clustered(n: int, clusters: int, d: int = 32, noise: float = 0.15, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(clusters, d))
    x = c[rng.integers(0, clusters, n)] + noise * rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    return np.sort(scores, axis=1)[:, ::-1][:, :k]


def test_tree_covers():
    x = np.floor(256 * clustered(3000, 20))
    x[100:400] = x[100]
    tree = covertree.CoverTree(x)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    for node, children in enumerate(tree.children):
        assert np.linalg.norm(x[tree.rows(node)] - tree.centres[node], axis=1).max() <= tree.radii[node] + 1e-9
        if children:
            assert [tree.span[c][0] for c in children] == [tree.span[node][0], *[tree.span[c][1] for c in children[:-1]]]
            gaps = [np.linalg.norm(tree.centres[a] - tree.centres[b]) for a in children for b in children if a < b]
            assert min(gaps) > tree.radii[node] / 2


def test_node_pairs_are_pruned():
    for clusters, most in ((64, 0.2), (0, 1.01)):
        x = np.floor(256 * clustered(4096, clusters or 4096)).astype(np.int64)
        ids = np.random.default_rng(1).permutation(len(x))
        search = covertree.DualSearch(x[::8], x, ids, ids, 6)
        search.run()
        scores = x[::8] @ x.T
        assert (search.scores == best(scores, 6)).all()
        assert search.products <= most * scores.size
        if clusters:
            assert search.pruned > 1000
            # A bar from elsewhere prunes more, and what is found at it or above is all there is.
            bars = best(scores, 6)[:, 2].astype(float)
            barred = covertree.DualSearch(x[::8], x, ids, ids, 6, bars)
            barred.run()
            q, row, score = barred.results()
            assert barred.products <= search.products and sorted(zip(q.tolist(), score.tolist())) == sorted((i, int(v)) for i, s in enumerate(scores) for v in best(s[None], 6)[0] if v >= bars[i])


def test_cells_are_skipped(spark, monkeypatch):
    """Of 20 clusters a query meets the blocks of few cells; results are those of brute force, with a third of the rows alike."""
    x = clustered(1200, 20)
    x[300:700] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    counts = []
    plain = covertree.sent

    def counted(queries, pivots, cells, radii, blocks, first):
        out = plain(queries, pivots, cells, radii, blocks, first)
        counts.append((first, out.count(), queries.count() * int(blocks.sum())))
        return out

    monkeypatch.setattr(covertree, "sent", counted)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = covertree.top_k(df, F.col("vec_id") % 10 == 0, k=5, block=64).orderBy("query_id", "rank").collect()
    v = np.floor(256 * x).astype(np.int64)
    want = []
    for i in range(0, len(v), 10):
        order = sorted((-int(s), j) for j, s in enumerate(v @ v[i]) if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(order)]
    assert [tuple(r) for r in got] == want
    assert all(n < 0.5 * most for first, n, most in counts if not first) and len(counts) == 2
