"""Importance resampling: against a plain computation, odd rows, ties, many runs and ranges; the tournament tree."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from promptscreen.llm import resampling as R

DOCS = "doc_id long, text string, score string, rank int, id string"


def rows(spark, data, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in data], DOCS).repartition(parts)


def plain(docs, target, percent, least, buckets, longest):
    """(doc_id, n_features, weight, score, rank) of each document; ranks of rows alike are a set."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(b for _, x in docs for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        n, f = features(x)
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def drawn(spark, docs, target, parts=3, **options):
    t = spark.createDataFrame([(x,) for x in target], "text string")
    return sorted((tuple(r) for r in R.resample(rows(spark, docs, parts), t, **options).collect()), key=repr)


VOCABULARY = ["Alpha", "beta", "GAMMA", "été", "x9", "it's", "a-b", "日本", "The", "of"] + [f"w{i}" for i in range(80)]


def corpus(n, seed=1, most=60):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(VOCABULARY[: rng.choice([5, 20, 90])]) for _ in range(rng.randint(0, most)))) for i in range(n)]


@pytest.mark.parametrize("longest", [1, 2])
def test_against_plain(spark, longest):
    docs, target = corpus(400), [t for _, t in corpus(20, 9)]
    want = plain(docs, target, 30, 20, 500, longest)
    for options in ({}, {"range_rows": 7, "run_rows": 11}, {"range_rows": 1, "run_rows": 1}):
        assert drawn(spark, docs, target, percent=30, buckets=500, longest=longest, **options) == want
    assert sum(r[4] is not None for r in want) > 60


def test_odd_rows(spark):
    """Nulls, no words, repeated rows and ids, no target, nothing to draw, an empty table."""
    docs = [(1, None), (2, ""), (3, "!? \x00 --"), (4, "a b c"), (4, "a b c"), (None, "d e f"), (None, "d e f"), (5, "w " * 50_000), (6, "é É A")]
    for target in ([], [None, ""], ["a b"]):
        for percent in (0, 50, 100):
            assert drawn(spark, docs, target, percent=percent, least_words=2, buckets=50) == plain(docs, target, percent, 2, 50, 1)
    assert drawn(spark, docs, ["a"], percent=100, least_words=0, buckets=50) == plain(docs, ["a"], 100, 0, 50, 1)
    assert drawn(spark, [], ["a"]) == []


def test_one_id_in_a_third_of_the_rows(spark):
    """Rows of one key are cut into ranges as others are: no range grows with them, and each rank is given once."""
    docs = [(None if i % 3 else i, "one two three") for i in range(600)]
    t = spark.createDataFrame([("two",)], "text string")
    out = R.resample(rows(spark, docs, 8), t, percent=90, least_words=1, buckets=50, range_rows=50, run_rows=64).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 541))
    assert sorted(tuple(r) for r in ((r.doc_id or -1, r.n_features, r.weight, r.score) for r in out)) == sorted((d or -1, n, w, s) for d, n, w, s, _ in plain(docs, ["two"], 90, 1, 50, 1))
    ordered = [r.score for r in sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])]
    assert ordered == sorted(ordered, reverse=True)
    scored = R.scored(rows(spark, docs, 8), R.gains(R.np.zeros(50, int), R.np.zeros(50, int)), "doc_id", "text", 1, "2024").cache()
    bounds = R.range_bounds(scored, 600, 50)
    sizes = [r.n for r in R.sorted_runs(scored, bounds, 64).groupBy("range").agg(F.sum("n").alias("n")).collect()]
    assert len(sizes) > 6 and max(sizes) < 250


def test_tournament():
    rng = random.Random(2)
    for k in [1, 2, 3, 7, 64]:
        runs = [sorted((rng.randrange(50), i, j) for j in range(rng.randint(0, 30))) for i in range(k)]
        assert list(R.Tournament([iter(r) for r in runs])) == list(heapq.merge(*runs))
        tree = R.Tournament([iter(r) for r in runs])
        total = sum(map(len, runs))
        head = [x for _, x in zip(range(min(5, total)), tree)]
        assert sorted(head + (list(tree.rest()) if head else [])) == sorted(x for r in runs for x in r)


def test_merge_stops_at_the_count():
    """Of the last range only as many rows are merged as are drawn."""
    assert list(R.Tournament([iter([])])) == []
    steps = []
    heads = R.Tournament([iter([(1,), (4,)]), iter([(2,), (3,)])])
    for x in heads:
        steps.append(x)
        if len(steps) == 2:
            break
    assert steps == [(1,), (2,)] and sorted(heads.rest()) == [(3,), (4,)]
