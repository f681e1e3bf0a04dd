"""Near-duplicate vectors in cells: recall on vectors that lie in no groups, groups of very many near copies, and how rows grow."""

import numpy as np
import pytest

from promptscreen.llm import vectors as V


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(n=2500, pairs=400, copies=600, d=64, seed=0):
    """Random vectors, partners of some at a cosine just above 0.95 (or just below), and near copies of one."""
    rng = np.random.default_rng(seed)
    x = unit(rng.normal(size=(n, d)))
    y = rng.normal(size=(pairs, d))
    y = unit(y - (y * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs])
    cos = np.where(np.arange(pairs) % 4 < 3, 0.9505, 0.9495)[:, None]
    near = unit(x[-1] + 0.008 * rng.normal(size=(copies, d)))
    wide = unit(x[-2] + 0.026 * rng.normal(size=(copies // 2, d)))  # links at about the threshold, within no core
    return np.concatenate([x, cos * x[:pairs] + np.sqrt(1 - cos**2) * y, near, wide])


def truth(x):
    """Links by all products; those at the threshold to rounding are left out of what is asked."""
    s = x @ x.T
    np.fill_diagonal(s, 0)
    assert not (np.abs(s - 0.95) < 1e-12).any()
    return s >= 0.95


@pytest.mark.parametrize("exact", [False, True])
def test_recall(spark, monkeypatch, exact):
    monkeypatch.setattr(V, "PER", 64)
    monkeypatch.setattr(V, "BLOCK", 100)
    x = table() if not exact else table(500, 100, 200)
    linked = truth(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    out = {r.vec_id: r for r in V.near_duplicate_vectors(df, exact=exact).collect()}
    links, want = np.array([out[i].n_links for i in range(len(x))]), linked.sum(axis=1)
    if exact:
        assert (links == want).all()
    assert (links <= want).all() and links.sum() >= 0.99 * want.sum()
    planted = np.flatnonzero(np.arange(len(x)) < (400 if not exact else 100))
    assert (links[planted] > 0).sum() >= 0.99 * (want[planted] > 0).sum()
    comp = np.array([out[i].component_id for i in range(len(x))])
    assert (links == want).mean() > 0.99
    for a, b in zip(*np.nonzero(linked[:300])):
        if links[a] == want[a]:
            assert comp[a] == comp[b]
    assert all(out[i].kept == (comp[i] == i) and comp[i] <= i for i in range(len(x)))


def test_cores_are_not_compared(spark, monkeypatch):
    """Of 600 near copies of one vector no two meet: the blocks compared hold few of them."""
    monkeypatch.setattr(V, "PER", 64)
    met = []
    plain = V.map_groups

    def counted(groups, *rest):
        met.append(groups.where("kind = 0 AND member").count())
        return plain(groups, *rest)

    monkeypatch.setattr(V, "map_groups", counted)
    x = table(600, 0, 600)[:1200]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = V.near_duplicate_vectors(df).collect()
    assert sum(r.n_links for r in out) == truth(x).sum()
    assert met[0] <= 620  # the others, each a member once


def test_cells_grow_with_the_table():
    """A vector goes to few cells, and members and guests of a cell hardly grow as vectors and cells do."""
    rows = []
    for n in (16_384, 65_536):
        x = unit(np.random.default_rng(n).normal(size=(n, 64)))
        c = V.spherical_kmeans(x, n // V.PER)
        sims = x @ c.T
        home = sims.argmax(axis=1)
        rows.append((sims >= sims.max(axis=1, keepdims=True) - V.margins(c, V.moments(x), np.sqrt(0.1))[home]).sum() / n)
    assert rows[0] < 6 and rows[1] < 2.2 * rows[0]


def low(n, free, d, rng):
    """Vectors of few free dimensions in many, on a plane turned at random."""
    return unit(rng.normal(size=(n, free)) @ np.linalg.qr(rng.normal(size=(d, free)))[0].T)


def falling(n, d, power, rng):
    """Vectors whose spread falls by a power from dimension to dimension, and partners of a fifth near the threshold, by a difference of the same spectrum."""
    scale = np.arange(1, d + 1) ** -power
    x = unit(rng.normal(size=(n, d)) * scale)
    y = rng.normal(size=(n // 5, d)) * scale
    y = unit(y - (y * x[: n // 5]).sum(axis=1, keepdims=True) * x[: n // 5])
    return np.concatenate([x, 0.951 * x[: n // 5] + np.sqrt(1 - 0.951**2) * y])


SPECTRA = {"5 in 512": lambda r: low(4096, 5, 512, r), "3 in 256": lambda r: low(1500, 3, 256, r), "8 in 128": lambda r: low(8192, 8, 128, r), "20 in 256": lambda r: np.concatenate([x := low(4096, 20, 256, r), unit(x + 0.3 * low(4096, 20, 256, np.random.default_rng(0)))]), "k^-1": lambda r: falling(6000, 256, 1.0, r), "k^-1.5": lambda r: falling(6000, 256, 1.5, r)}


@pytest.mark.parametrize("name", sorted(SPECTRA))
def test_recall_of_cells(name):
    """Of all pairs at the threshold nearly all have one that is a guest of the other's cell, whatever dimensions vectors have of their own."""
    x = SPECTRA[name](np.random.default_rng(7))
    c = V.spherical_kmeans(x, 64)
    sims = x @ c.T
    home = sims.argmax(axis=1)
    for spread, least in ((None, 1.0), (V.moments(x), 0.99)):
        near = sims >= sims.max(axis=1, keepdims=True) - V.margins(c, spread, np.sqrt(0.1))[home]
        met = total = 0
        for lo in range(0, len(x), 1024):
            a, b = np.nonzero(x[lo : lo + 1024] @ x.T >= 0.95)
            a, b = a[a + lo < b] + lo, b[a + lo < b]
            total += len(a)
            met += (near[a, home[b]] | near[b, home[a]]).sum()
        assert total > 300 and met >= least * total


def test_low_dimension(spark, monkeypatch):
    """Through the operator: vectors of 5 free dimensions in 64, in 16 cells; every link, and every count."""
    monkeypatch.setattr(V, "PER", 128)
    x = low(2048, 5, 64, np.random.default_rng(3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    out = {r.vec_id: r.n_links for r in V.near_duplicate_vectors(df).collect()}
    want = truth(x).sum(axis=1)
    assert want.sum() > 2000 and all(out[i] == want[i] for i in range(len(x)))
