"""The quality classifier: features of long texts, and scores, ratios and the fit against brute force."""

import random

import numpy as np

from promptscreen.llm import quality as Q


def test_slices_lose_nothing(monkeypatch):
    """Features in slices of any size are those of the text as one."""
    rng = random.Random(1)
    texts = ["", "a", "!!", "a!!b", "!" * 50, "Ab1 .. é\n\n" * 40, *["".join(rng.choice("aB1 .!\n-é#") for _ in range(rng.randint(1, 300))) for _ in range(60)]]
    whole = [Q.features(t).tolist() for t in texts]
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(Q, "SLICE", size)
        assert [Q.features(t).tolist() for t in texts] == whole


def plain_signs(text):
    """Signs by a loop over bytes."""
    out = []
    data = text.encode()
    at = 0
    while at < len(data):
        c, end = Q.CLASSES[data[at]], at
        while end < len(data) and Q.CLASSES[data[end]] == c:
            end += 1
        out.append(int(c) + (40 if c >= Q.MARK and end - at > 1 else 0))
        at = end
    return out


def plain_features(text):
    """Indicators by loops over n-grams and counts."""
    signs, hash_of, out = plain_signs(text), lambda x: (x * 0x9E3779B97F4A7C15 % 2**64) >> (64 - Q.BITS), set()
    for n in range(1, 6):
        for i in range(len(signs) - n + 1):
            code = 0
            for s in signs[i : i + n]:
                code = (code * Q.SIGNS + s) % 2**64
            out.add(hash_of((code * 8 + n) % 2**64))
    words = text.split()
    counts = {s: signs.count(s) for s in signs}
    if again := sum(a == b for a, b in zip(words, words[1:])):
        counts[Q.SIGNS - 1] = again
    for sign, count in counts.items():
        top = int(min(7, max(-8, np.floor(np.log2(count / max(1, len(words))))))) + 8
        out |= {hash_of((sign * 16 + k) * 8 + 7) for k in range(top + 1)}
    return sorted(out)


def test_features_by_brute_force():
    rng = random.Random(2)
    for text in ["", "a a a b", "Ab, 1!! x", *["".join(rng.choice("aB1 .!\n-é#") for _ in range(rng.randint(1, 200))) for _ in range(60)]]:
        assert Q.features(text).tolist() == plain_features(text)


def test_model_by_brute_force():
    """Log-count ratios by counting; the fit reaches the least squared hinge loss that plain steps along the gradient find; scores by sums."""
    rng = random.Random(3)
    texts = [("".join(rng.choice("ab cd. ") for _ in range(80)) if i % 3 else "".join(rng.choice("AB!! 12 ") for _ in range(80))) for i in range(60)]
    y = np.array([int(i % 3 > 0) for i in range(60)])
    rows = [np.asarray(plain_features(t)) for t in texts]
    model = Q.Model(rows, y, (1.0, 1.0))
    counts = np.ones((2, Q.FEATURES))
    for r, k in zip(rows, y):
        for f in r:
            counts[k, f] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.allclose(Q.log_count_ratio(rows, y), ratio)
    x = np.zeros((60, Q.FEATURES + 1))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
        x[i, -1] = 1
    used = np.flatnonzero(x.any(axis=0))
    x = x[:, used]
    cost, sign = np.where(y == 1, 0.5 * 60 / y.sum(), 0.5 * 60 / (60 - y.sum())), np.where(y == 1, 1.0, -1.0)
    loss = lambda w: 0.5 * w @ w + cost @ np.maximum(0, 1 - sign * (x @ w)) ** 2
    w = Q.dual_coordinate_descent(rows, [ratio[r] / np.linalg.norm(ratio[r]) for r in rows], y, cost, epochs=200)[used]
    plain = np.zeros(len(used))
    for _ in range(4000):
        plain -= 0.005 * (plain - 2 * x.T @ (cost * sign * np.maximum(0, 1 - sign * (x @ plain))))
    assert loss(w) <= loss(plain) * 1.001
    for t in texts[:10]:
        r = np.asarray(plain_features(t))
        m = (model.weights[r] / np.linalg.norm(model.ratio[r].astype(float))).sum() + model.bias
        assert np.isclose(model.score(t), 1 / (1 + np.exp(-np.clip(model.slope * m + model.offset, -30, 30))), atol=1e-6)


def test_repeated_ids_are_bounded(spark):
    """An id that very many rows share brings no more rows to the driver than the bound."""
    from pyspark.sql import functions as F

    docs = spark.range(3000).select(F.when(F.col("id") < 2900, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.createDataFrame([(1, 1), (2950, 0)], "doc_id long, quality int")
    assert Q.labelled_sample(docs, labels, "quality", F.lit(True), (50, 50)).count() <= 200
