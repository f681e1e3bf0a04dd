"""Nulls, empty and long texts, ties, repeated rows, empty tables, and further columns, for operators on tables."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptscreen.llm import covertree, jaccard, mixing, packing, vectors, warc
from promptscreen.llm.common import connected_components, new_path, word_count

DOCS = "doc_id long, text string, source string, size int, kept string, score double"


def documents(spark, rows):
    """Rows of (id, text, source), with columns whose names operators use for their own."""
    return spark.createDataFrame([(i, t, s, 7, "x", 1.0) for i, t, s in rows], DOCS).repartition(3)


LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one two three", None), (4, "one two three", None), (None, "four five", "b"), (5, LONG, "b"), (6, "é x y z", "b")]


# Mixing


def mix(spark, rows, **options):
    out = mixing.mix_sources(documents(spark, rows), word_count(F.col("text")), **options)
    return out.select("doc_id", "source", "__size", "__source_size", "__target", "__taken").collect()


def test_mix_odd_rows(spark):
    rows = mix(spark, ODD)
    assert len(rows) == len(ODD)
    assert {r.doc_id: r["__size"] for r in rows if r.doc_id} == {1: 0, 2: 0, 3: 0, 4: 3, 5: 30_000, 6: 2}
    by = defaultdict(lambda: [0, 0.0])
    for r in rows:
        assert 0 <= r["__taken"] <= 2 * r["__size"]
        by[r.source][0] += r["__taken"]
        by[r.source][1] = r["__target"]
    for taken, target in by.values():
        assert abs(taken - target) <= 0.5
    assert mix(spark, ODD[:1])[0]["__taken"] == 0
    assert mix(spark, []) == []
    assert sorted(map(repr, rows)) == sorted(map(repr, mix(spark, ODD)))


def water_fill(sizes, weights, share, cap):
    """Targets by the plain method: clamp and reshare until none is above."""
    budget, free, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        level = (budget - sum(out[i] for i in range(len(sizes)) if i not in free)) / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * level >= cap * sizes[i]]
        for i in over:
            out[i] = cap * sizes[i]
        free -= set(over)
        if not over:
            for i in free:
                out[i] = weights[i] * level
            break
    return out


def test_mix_targets(spark):
    rng = random.Random(3)
    for share in (0.3, 1.5, 1.99):
        sizes = [rng.randint(1, 400) for _ in range(9)]
        rows = mix(spark, [(i, "w " * n, f"s{i}") for i, n in enumerate(sizes)], share=share)
        want = water_fill(sizes, [(5, 2, 1)[i % 3] for i in range(9)], share, 2)
        for r in rows:
            assert math.isclose(r["__target"], want[r.doc_id], rel_tol=1e-9)
            assert r["__taken"] == round(want[r.doc_id]) or abs(r["__taken"] - want[r.doc_id]) <= 0.5


def test_mixed_rows(spark):
    docs = documents(spark, ODD + [(10 + i, f"a b c d {i}", "c") for i in range(40)])
    out = mixing.mixed_rows(docs).withColumn("n", word_count(F.col("text"))).collect()
    assert out and set(out[0].asDict()) == {*docs.columns, "n"}
    total = sum(r.n for r in out)
    assert abs(total - 1.5 * (3 + 3 + 2 + 30_000 + 2 + 200)) <= 3


# Packing


def test_best_fit_bits():
    fit = packing.BestFit(10, 3)
    assert [fit.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert fit.open == 0 and fit.bits == 0
    fit = packing.BestFit(10, 2)
    assert [fit.place(n)[0] for n in (6, 7, 8, 3, 4)] == [0, 1, 2, 3, 0] or fit.made <= 4
    rng = random.Random(1)
    fit, used = packing.BestFit(2048, 64), defaultdict(int)
    for n in (rng.randint(1, 2048) for _ in range(5000)):
        at, offset = fit.place(n)
        assert used[at] == offset
        used[at] += n
        assert used[at] <= 2048 and fit.open <= 64 and sum(map(len, fit.free)) == fit.open


def test_pieces():
    assert packing.pieces_of(1) == [(0, 1)] and packing.pieces_of(2048) == [(0, 2048)]
    assert packing.pieces_of(5000) == [(0, 904), (904, 2048), (2952, 2048)]


def check_packing(rows, docs, ids_of):
    want = sorted((str(i), p, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for i, t in docs for ids in [ids_of(t)] for p, (s, n) in enumerate(packing.pieces_of(len(ids))))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


@pytest.fixture(scope="module")
def ids_of():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    return lambda t: [*exact.encode(t or "", add_special_tokens=False).ids, 0]


def test_packing_odd_rows(spark, ids_of):
    rows = ODD + [(7, "\U0001f642 ‍ x", "c"), (8, "a" * 5000, "c"), (9, " " * 3000 + "b", "c")]
    out = packing.pack_documents(documents(spark, rows), with_ids=True).collect()
    check_packing(out, [(i, t) for i, t, _ in rows], ids_of)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)
    assert packing.pack_documents(documents(spark, [])).collect() == []


def test_packing_query(spark, sf, ids_of):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = packing.op2_packing(spark, sf).collect()
    assert check_packing(rows, docs, ids_of) <= -(-sum(r.length for r in rows) // 2048) + 2


# WARC


def test_warc_round_trip(spark):
    page = "<p>" + "é" * 200
    rows = [(1, "http://a/", page), (2, None, page), (3, "http://b/\r\nX: y", ""), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (1, "again", page), (None, "n", page), (9, "u", "<b>" * 100_000)]
    pages = spark.createDataFrame([(*r, "payload") for r in rows], "page_id long, url string, html string, digest string")
    out = {(r.page_id, r.url): r for r in warc.archive_pages(pages, new_path(spark, "t")).collect()}
    assert len(out) == len(rows)
    assert out[1, "http://a/"].record_type == "response" == out[1, "again"].record_type
    assert (out[2, None].record_type, out[2, None].refers_to) == ("revisit", 1) == (out[None, "n"].record_type, out[None, "n"].refers_to)
    assert out[5, "u"].record_type == out[6, "u"].record_type == "response"
    assert bytes(out[1, "again"].payload) == page.encode() and out[2, None].payload_bytes == len(page.encode())
    assert out[3, "http://b/\r\nX: y"].record_type == "response"
    assert out[4, "u"].payload_bytes == 0 and len(out[9, "u"].payload) == 300_000
    assert warc.archive_pages(pages.limit(0), new_path(spark, "t")).count() == 0


def test_archive_is_plain_zstandard(spark, tmp_path):
    import zstandard

    pages = spark.createDataFrame([(i, "u", f"<p>{i} " + "text of a page " * 30) for i in range(300)], "page_id long, url string, html string")
    warc.write_archives(warc.classify(pages.coalesce(1)), str(tmp_path / "w"))
    (data,) = [f.read_bytes() for f in (tmp_path / "w").glob("part-*")]
    size = int.from_bytes(data[4:8], "little")
    assert data[:4] == bytes.fromhex("5d2a4d18") and size > 0
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).stream_reader(data, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 300


def records_of(folder):
    """Fields and bodies of all records, read by the standard's grammar alone."""
    import zstandard

    for f in folder.glob("part-*"):
        data = f.read_bytes()
        size = int.from_bytes(data[4:8], "little")
        known = zstandard.ZstdCompressionDict(data[8 : 8 + size]) if size else None
        at = zstandard.ZstdDecompressor(dict_data=known).stream_reader(data, read_across_frames=True).read()
        while at:
            head, _, rest = at.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            length = int(fields["Content-Length"])
            assert version == "WARC/1.1" and rest[length : length + 4] == b"\r\n\r\n"
            yield f, fields, rest[:length]
            at = rest[length + 4 :]


def test_warc_fields(spark, tmp_path):
    """What the standard asks of every record, of a response and of a revisit; ids are unique though page ids repeat."""
    import re

    page = "<p>" + "x" * 200
    rows = [(1, "http://a/p q?x=%20#f", page), (1, "http://a/", page), (1, "http://a/", page), (2, "http://b/é", page), (3, None, "c"), (None, "", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.write_archives(warc.classify(pages), str(tmp_path / "w"))
    seen = [(fields, body) for _, fields, body in records_of(tmp_path / "w")]
    assert len(seen) == len(rows) and len({f["WARC-Record-ID"] for f, _ in seen}) == len(rows)
    for f, body in seen:
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", f["WARC-Record-ID"]) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", f["WARC-Date"])
        assert f["WARC-Type"] in ("response", "revisit") and not re.search(r"\s", f["WARC-Target-URI"]) and f["Content-Type"].startswith("application/http")
        assert body.startswith(b"HTTP/1.1 200 OK\r\n") and re.fullmatch("sha256:[0-9a-f]{64}", f["WARC-Payload-Digest"])
        assert (f["WARC-Type"] == "revisit") == ("WARC-Profile" in f)
    (again,) = [f for f, _ in seen if f["WARC-Type"] == "revisit"]
    assert again["X-Page-ID"] == "2" and again["X-Refers-To-Page"] == "1" and again["WARC-Refers-To-Target-URI"].startswith("http://a/")
    back = {(r.page_id, r.url) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert back == {(i, u) for i, u, _ in rows}


def test_archives_are_bounded(spark, tmp_path, monkeypatch):
    """Archives have few runs of few bytes, a record longer than that has a run of its own, and all comes back; ids may be text."""
    monkeypatch.setattr(warc, "RUN_BYTES", 2000)
    monkeypatch.setattr(warc, "ARCHIVE_RUNS", 3)
    rng = random.Random(5)
    text = lambda n: "".join(chr(rng.randrange(33, 0x2000)) for _ in range(n))
    rows = [(f"p/{i} {'é' if i % 2 else ''}", f"http://h/{i}", text(20_000 if i == 17 else 300)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").coalesce(1)
    warc.write_archives(warc.classify(pages), str(tmp_path / "w"))
    sizes = {f: f.stat().st_size - 8 - int.from_bytes(f.read_bytes()[4:8], "little") for f, _, _ in records_of(tmp_path / "w")}
    assert len(sizes) > 5 and sum(s > 3 * 2000 + 100 for s in sizes.values()) <= 1
    back = {(r.page_id, bytes(r.payload).decode()) for r in warc.read_archives(spark, str(tmp_path / "w"), "string").collect()}
    assert back == {(i, t) for i, _, t in rows}


# Components, vectors


def test_components(spark):
    rng = random.Random(5)
    for n, m in ((1, 1), (60, 40), (200, 400)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(1000 + i, 1001 + i) for i in range(70)]
        parent = {}

        def find(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in {y for e in edges if e[0] != e[1] for y in e}}


def brute_vectors(rows, threshold=0.95):
    fit = {k: np.array(v, float) for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    link = defaultdict(set)
    for a in fit:
        for b in fit:
            if a != b and len(fit[a]) == len(fit[b]):
                x, y = (z / np.abs(z).max() for z in (fit[a], fit[b]))
                if (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= threshold:
                    link[a].add(b)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in link[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        low = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        out.append((i, len(link[k]), low, i == low))
    return sorted(map(repr, out))


def vector_rows(n, seed, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 6), dim))
    return [(i, (centres[rng.integers(len(centres))] + rng.normal(size=dim) * rng.choice([0.02, 0.15, 0.6])).astype(np.float32).astype(float).tolist()) for i in range(n)]


ODD_VECTORS = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] * 8), (905, [float("inf")] + [1.0] * 7), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, [1.0, 2.0]), (908, [1e30] * 8), (909, [1e-30] * 8), (906, [1.0, 2.0])]


@pytest.mark.parametrize("per", [8, 10_000])
def test_vectors(spark, monkeypatch, per):
    monkeypatch.setattr(vectors, "PER", per)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows = ODD_VECTORS + vector_rows(150, 2)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n_links int").repartition(3)
    got = sorted(repr(tuple(r)) for r in vectors.near_duplicate_vectors(df).collect())
    want = brute_vectors(rows)
    assert [g.replace("True", "1").replace("False", "0") for g in got if "None" not in g] == [w.replace("True", "1").replace("False", "0") for w in want if "None" not in w]
    assert sum("None" in g for g in got) == 1
    assert vectors.near_duplicate_vectors(df.limit(0)).collect() == []


def test_top_k(spark, monkeypatch):
    rows = [(i, v) for i, v in ODD_VECTORS if i != 908] + vector_rows(400, 4) + [(1000 + i, [0.5] * 8) for i in range(30)]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = defaultdict(list)
    for r in covertree.top_k(df, F.col("vec_id") % 10 == 0, k=5, block=64).orderBy("rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    fit = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    asked = [(k, i, q) for k, (i, q) in enumerate(fit) if i % 10 == 0]
    for k, i, q in asked:
        s = sorted((-int(q @ v), j) for n, (j, v) in enumerate(fit) if n != k and len(v) == len(q))[:5]
        assert got[i] == [(r + 1, j, -x) for r, (x, j) in enumerate(s)]
    assert covertree.top_k(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []


# Jaccard


def words_set(text):
    w = jaccard_words(text)
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def jaccard_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_jaccard(rows, threshold=0.8):
    sets = [words_set(t) if i is not None else set() for i, t, _ in rows]
    link = [{b for b in range(len(rows)) if a != b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])} for a in range(len(rows))]
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in link[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        low = None if i is None else min(rows[x][0] for x in seen)
        out.append(repr((i, low, len(link[k]), i == low)))
    return sorted(out)


@pytest.mark.parametrize("block", [4, 1024])
def test_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "ELEMENTS", 500)
    monkeypatch.setattr(jaccard, "SINGLY", 2)
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(300)]
    rows, passage = list(ODD), " ".join(rng.choice(vocabulary) for _ in range(60))
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 150]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((100 + len(rows), " \n".join(copy) + (" " + passage if g % 3 == 0 else ""), "s"))
    got = sorted(repr(tuple(r)) for r in jaccard.jaccard_join(documents(spark, rows)).collect())
    assert got == brute_jaccard(rows)
    assert jaccard.jaccard_join(documents(spark, [])).collect() == []
    assert all(r.kept for r in jaccard.jaccard_join(documents(spark, ODD[:3])).collect())


def test_pruning_keeps_links():
    """A pair at the threshold is pruned with less than the tolerance, about; pairs far below go early."""
    least = jaccard.least_agreements(0.8)
    rng = np.random.default_rng(0)
    agree = rng.random((100_000, jaccard.HASHES)) < 0.8 + 0.2 / 256
    counts = np.stack([agree[:, : jaccard.PART * (i + 1)].sum(axis=1) for i in range(len(least))], axis=1)
    assert (counts >= np.array(least)).all()
    assert least[0] > 0.3 * jaccard.PART
