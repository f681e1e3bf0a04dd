"""Runs of words against a plain search over all periods; odd rows; the query's digests."""

import hashlib
import random
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptscreen.llm import periodic_runs as R


def plain(words):
    """All periods, all maximal stretches; of the periods of one stretch the smallest."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            k = 0
            while i + q + k < len(words) and words[i + k] == words[i + q + k]:
                k += 1
            if k and k + q >= max(6, 4 * q):
                found.setdefault((i, k + q), q)
            i += k + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def bytes_of(words):
    return [str(w).encode() for w in words]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=5))
def test_small_alphabets(texts):
    texts = [bytes_of(t) for t in texts]
    assert R.runs_of(texts) == [sorted(plain(t), key=lambda r: (r[0], r[2])) for t in texts]


def test_planted_runs():
    """Repeats of all periods at all places, in texts side by side; runs in runs, runs that meet, and texts of one word."""
    rng = random.Random(3)
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += [rng.randrange(1000) for _ in range(rng.randint(0, 60))]
            base = [rng.randrange(rng.choice([2, 5, 1000])) for _ in range(rng.randint(1, 30))]
            words += (base * 12)[: rng.randint(1, 11 * len(base))]
            if rng.random() < 0.3:
                words += (words[-20:] * 8)[: rng.randint(0, 150)]
        texts.append(bytes_of(words))
    texts += [[], [b"a"], [b"a"] * 5, [b"a"] * 6, [b"a"] * 1000, bytes_of(([0] * 8 + [1]) * 40), bytes_of(list(range(300)) * 4)]
    assert R.runs_of(texts) == [plain(t) for t in texts]
    assert sum(len(plain(t)) for t in texts) > 300
    for t in texts[:20]:
        assert R.runs_of([t]) == [plain(t)]


def test_z_function():
    rng = random.Random(5)
    for _ in range(200):
        x = [rng.randrange(2) for _ in range(rng.randint(1, 30))]
        assert R.z_function(x) == [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]


def test_every_run_comes_from_a_z_function(monkeypatch):
    """Where the Z-function finds no square, no run is found."""
    words = bytes_of([7, 8, 9] * 10)
    assert R.runs_of([words])
    monkeypatch.setattr(R, "z_function", lambda x: [0] * len(x))
    assert R.runs_of([words]) == [[]]


def test_growth():
    """Four times the words take about four times the CPU time: texts of one word, of long periods, of natural repeats."""
    rng = np.random.default_rng(1)
    natural = (rng.zipf(1.3, 400_000) % 5000).tolist()
    for make in (lambda n: [0] * n, lambda n: (list(range(n // 5)) * 5)[:n], lambda n: natural[:n], lambda n: ([0] * 50 + [1]) * (n // 51)):

        def seconds(n, make=make):
            words = bytes_of(make(n))
            start = time.process_time()
            R.runs_of([words])
            return time.process_time() - start

        quarter = min(seconds(100_000) for _ in range(2))
        assert seconds(400_000) < 9 * quarter + 0.5


DOCS = "doc_id long, text string, runs string, n_words int"


def rows(spark, data):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in data], DOCS).repartition(3)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000)) + " go on" * 30
    data = [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 4), (4, "a b " * 4), (None, "x" + " y" * 9), (5, long), (6, "a\xa0a " * 7), (7, "é é\x1cé " * 6)]
    out = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in R.find_runs(rows(spark, data)).collect()]
    assert sorted(map(repr, out)) == sorted(map(repr, [
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 8, [(0, 8, 2)], "a b"), (4, 8, [(0, 8, 2)], "a b"), (None, 10, [(1, 9, 1)], "x y"),
        (5, 40_060, [(40_000, 60, 2)], long[: -len(" go on" * 29)]), (6, 7, [(0, 7, 1)], "a\xa0a"), (7, 6, [(0, 6, 1)], "é é\x1cé"),
    ]))
    assert R.find_runs(rows(spark, [])).collect() == []


def test_made_periodic(spark):
    """Ids whose crc32 ends in 0 get their tail repeated; others, and null ids, stay as they are."""
    text = " ".join(f"w{i}" for i in range(97))
    data = [(i, text if i % 3 else None if i % 2 else "one") for i in range(300)] + [(None, text)]
    seen = 0
    for r in rows(spark, data).select("doc_id", "text", R.made_periodic(F.col("doc_id"), F.col("text")).alias("made")).collect():
        h = zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is None or h % 10:
            assert r.made == r.text
            continue
        words, g = (r.text or "").split(), h // 10
        if n := len(words):
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
            seen += n == 97
        assert r.made == " ".join(words)
    assert seen > 10


def test_query(spark, sf):
    """The query's columns from the plain search over each text."""
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words, h = (r.text or "").encode().split(), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        runs = plain(words)
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        s, k, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in sorted(runs, key=lambda r: (r[0], r[2])))
        want[r.doc_id] = (len(runs), s, k, q, 1000 * k // q if runs else None, digest(lines.encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))
    got = {r.doc_id: tuple(r)[1:] for r in R.op11_periodic_runs(spark, sf).collect()}
    assert got == want
    assert any(v[0] for v in want.values())
