"""Compression distance: window lengths against plain calls of zstandard, what each dictionary holds, and recall by language."""

import os
import random
import zlib

import numpy as np
import pytest
import zstandard

from promptscreen.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def word(rng):
    return "".join(rng.choice(["er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ti"]) for _ in range(rng.randint(1, 4)))


def made(n, seed=2):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["blastard", "grumpkin", "öde wicht"]) if i % 4 == 0 and j % 12 == 5 else word(rng) for j in range(rng.choice([1, 40, 90]))) for i in range(n)]
    return texts, np.array([int(i % 4 == 0 and len(t.split()) > 5) for i, t in enumerate(texts)])


@pytest.fixture(scope="module")
def model():
    return X.Model(*made(500))


def brute_score(model, text):
    """The score from the dictionaries' contents alone: each window compressed by a compressor made for it."""
    how = zstandard.ZstdCompressionParameters.from_level(3, min_match=6, hash_log=17, chain_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
    data = b" " + (text or "").encode() + b" "
    diff, lo = [], 0
    while lo == 0 or lo < len(data) - 52 + 36:
        window = bytes(range(1, 9)) * 4 + data[lo : lo + 52] + bytes(range(14, 22))
        size = [len(zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(window)) for c in model.contents]
        diff.append(size[1] - size[0])
        lo += 36
    beyond = [np.log1p(sum(max(d - t + 1, 0) for d in diff)) for t in model.thresholds]
    some = np.log1p(len(diff) / 50)
    x = [*beyond, *(b - some for b in beyond), np.log1p(sum(max(-d, 0) for d in diff)) - some, 1.0]
    return 1 / (1 + np.exp(-np.clip(np.dot(x, model.weights), -30, 30)))


def test_scores_by_brute_force(model):
    for text in [None, "", "a", "blastard", *made(30, 5)[0], "the blastard " * 200, "x" * 5000, "é\U0001f642 " * 300]:
        assert np.isclose(model.score(text), brute_score(model, text)), text


def test_whole_texts_count(model):
    plain = made(200, 9)[0]
    clean = " ".join(t for i, t in enumerate(plain) if i % 4)
    assert model.score(clean + " blastard grumpkin blastard grumpkin öde wicht blastard") > model.score(clean)


def test_both_dictionaries_are_trained(model):
    toxic, ordinary = model.contents
    assert len(toxic) == len(ordinary)
    differ = next(i for i, (a, b) in enumerate(zip(toxic, ordinary)) if a != b)
    parts = [c[differ : -len(X.ANCHOR)].replace(X.APART, b"") for c in (toxic, ordinary)]
    assert all(len(p) > 8 for p in parts) and parts[0] != parts[1]
    assert b"blasta" in toxic and b"blasta" not in ordinary
    # The trainer puts segments of its samples one after another, so strings within segments are those of the texts.
    texts, y = made(500)
    own = parts[1]
    assert np.mean([any(own[i : i + X.D] in t.encode() for t, k in zip(texts, y) if k == 0) for i in range(len(own) - X.D + 1)]) > 0.6


def test_ordinary_dictionary_matters(model):
    """With the bytes of the ordinary dictionary in another order, lengths and so scores change."""
    other = bytearray(model.contents[1])
    random.Random(0).shuffle(other)
    texts = [t for t in made(80, 6)[0] if len(t) > 60]
    before = [model.score(t) for t in texts]
    model.lengths = X.Lengths((model.contents[0], bytes(other)))
    try:
        assert np.mean([abs(model.score(t) - b) > 1e-6 for t, b in zip(texts, before)]) > 0.5
    finally:
        model.lengths = None


def test_thresholds_are_calibrated():
    y = np.array([0] * 50 + [1] * 50)
    rng = np.random.default_rng(0)
    low = X.calibrated([rng.integers(0, 3, 200) for _ in y], y)
    high = X.calibrated([rng.integers(0, 30, 200) for _ in y], y)
    assert (np.diff(low) > 0).all() and (high > low).all() and low[0] >= 1


def test_trainer_on_little():
    assert X.content([], 4096, 16) == b""
    assert X.content([b"abcdefgh\xff"], 4096, 16) == b"abcdefgh\xff"
    few = X.Model(["a bad bad word here", "fine words are here", "", "x"], np.array([1, 0, 0, 0]))
    assert 0 <= few.score("bad") <= 1


def test_peculiar_strings():
    """By rates against brute force: what a class's texts have three times as often, and more than chance."""
    texts, y = made(400, 3)
    toxic, ordinary = ([t.encode() for t, k in zip(texts, y) if k == c] for c in (1, 0))
    marked = X.peculiar(X.Rates(toxic), X.Rates(ordinary))
    rates = lambda ts, s: np.array([sum(t.startswith(s, i) for i in range(len(t))) * 1000 / max(len(t), 500) for t in ts])
    for s in (b"blasta", b"rumpki", b" onan ", b"erhean"):
        a, b = rates(toxic, s), rates(ordinary, s)
        both = np.concatenate([a, b])
        want = a.mean() > 3 * b.mean() and a.mean() - b.mean() > X.T * both.std() * np.sqrt(1 / len(a) + 1 / len(b))
        assert marked[X.grams(s)[0]] == want
    assert marked[X.grams(b"blasta")[0]]


def test_held_out_recall_by_language():
    """On the rows of the larger table that are held out. Where this was written: en 0.81, fr 0.61, de 0.67, es 1.00; ordinary rows taken for toxic 0.004."""
    import pyarrow.parquet as pq

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    known = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    rows = [(r["doc_id"], r["lang"], r["text"], known[r["doc_id"]]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist() if known.get(r["doc_id"]) in (0, 1)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    model = X.Model([t for i, _, t, _ in rows if not held(i)], np.array([k for i, _, _, k in rows if not held(i)]))
    said = [(lang, k, model.score(t) >= 0.5) for i, lang, t, k in rows if held(i)]
    assert np.mean([p for _, k, p in said if k == 0]) < 0.03
    assert np.mean([p for _, k, p in said if k == 1]) > 0.7
    for lang, least in (("en", 0.7), ("fr", 0.5), ("de", 0.4), ("es", 0.5)):
        assert np.mean([p for g, k, p in said if k == 1 and g == lang]) >= least
