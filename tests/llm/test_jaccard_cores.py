"""Large groups of near copies are counted without comparing them, chains do not copy sets, and no link is lost."""

import random

import pytest

from promptscreen.llm import jaccard as J
from promptscreen.llm import common
from tests.llm.test_tables import brute_jaccard, documents


def near_copies(n, words=120, seed=0, start=0, most=1):
    """n texts, each with up to `most` words of one text replaced."""
    rng = random.Random(seed)
    base = [f"w{seed}x{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, most)):
            copy[rng.randrange(words)] = f"c{i}x{rng.randrange(10**6)}"
        out.append((start + i, " ".join(copy), "s"))
    return out


def chain(n, words=100, step=4, start=0):
    """n texts, each a window of one long text moved on: neighbours link, those farther apart do not."""
    rng = random.Random(7)
    long = [f"l{rng.randrange(10**7)}" for _ in range(words + step * n)]
    return [(start + i, " ".join(long[i * step : i * step + words]), "s") for i in range(n)]


@pytest.mark.parametrize("block", [8, 40])
def test_cores_and_chains(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = near_copies(150, seed=1) + near_copies(60, seed=2, start=1000, most=5) + chain(60, start=2000) + near_copies(30, seed=1, start=3000) + [(4000, "alone and by itself it stands", "s")]
    got = sorted(repr(tuple(r)) for r in J.jaccard_join(documents(spark, rows)).collect())
    assert got == brute_jaccard(rows)


def test_core_is_not_compared(spark, monkeypatch):
    """Of 400 near copies of one text hardly any goes with its set to a bucket."""
    monkeypatch.setattr(J, "BLOCK", 32)
    sent = []
    plain = J.map_groups

    def counted(groups, keys, *rest):
        if keys == J.GROUP and "set" in groups.columns:
            sent.append(groups.count())
        return plain(groups, keys, *rest)

    monkeypatch.setattr(J, "map_groups", counted)
    rows = near_copies(400, seed=3, words=200)
    out = J.jaccard_join(documents(spark, rows)).collect()
    distinct = len({t for _, t, _ in rows})
    assert distinct > 150 and all(r.class_id == 0 for r in out)
    assert sum(sent) < distinct


def test_chain_ships_sets_to_few(spark, monkeypatch):
    """A chained component of 600 texts: a set goes to the buckets of its neighbours, not to blocks of the whole component."""
    monkeypatch.setattr(J, "BLOCK", 16)
    sent = []
    plain = J.map_groups

    def counted(groups, keys, *rest):
        if keys == J.GROUP and "set" in groups.columns:
            sent.append(groups.count())
        return plain(groups, keys, *rest)

    monkeypatch.setattr(J, "map_groups", counted)
    rows = chain(600)
    out = J.jaccard_join(documents(spark, rows)).collect()
    assert {r.class_id for r in out} == {0} and sum(sent) < 12 * len(rows)


def test_keys_are_equal_where_signatures_are():
    import numpy as np

    rng = np.random.default_rng(0)
    sigs = rng.integers(0, 4, (200, J.HASHES)).astype(np.uint32) + np.uint32(256) * rng.integers(0, 9, (200, J.HASHES)).astype(np.uint32)
    keys, low = np.array([J.bands(s) for s in sigs]), (sigs & 255).reshape(200, J.BANDS, J.ROWS)
    for i in range(0, 200, 7):
        assert ((keys[i] == keys).astype(int) == (low[i] == low).all(axis=2)).all()


def test_hubs(spark, monkeypatch):
    """Components with hubs larger than the bound, against a plain search."""
    monkeypatch.setattr(common, "HUB", 3)
    rng = random.Random(2)
    edges = [(0, k) for k in range(1, 40)] + [(100, k) for k in range(50, 90)] + [(39, 200), (200, 201), (89, 300)] + [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low


def test_small_is_by_rows_and_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    hinted = lambda df: "broadcast" in common.small(df)._jdf.queryExecution().logical().toString().lower()
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 50).alias("s"), F.array(F.lit(1)).alias("a"), F.lit(None).cast("binary").alias("b"))
    assert hinted(df) and hinted(df.limit(0))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 7000)
    assert not hinted(df) and hinted(df.limit(50))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 40)
    assert not hinted(df.limit(50))
