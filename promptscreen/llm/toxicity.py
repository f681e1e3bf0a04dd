"""Toxicity by compression distance: which of two Zstandard dictionaries shortens a text's windows more.

Two dictionaries are trained by Zstandard's own trainer, one on what is peculiar to
toxic text and one on what is peculiar to ordinary text: the places whose byte strings of length D are
commoner in one class, by their rates over texts (a t statistic of T or more, and TIMES the
other's rate). What both classes share is trained once, from all texts without those places, and
stands in the same place in both dictionaries, so a window without anything peculiar
has the same length under both: the difference of two lengths is evidence and no chance.

A text's evidence (how much its windows differ by beyond each threshold, also
against its length, and how much the other way) gives the score by a
logistic curve. Thresholds are quantiles of the differences of ordinary text. Rows of the fit
count by how many of their class the sample left out. Both, thresholds and curve, are calibrated on rows
that no dictionary was trained on: half of the learning rows train, the others
calibrate, and the other way round, and the final dictionaries use both.

Learns from at most SAMPLE_TOXIC and SAMPLE_ORDINARY labelled rows, by hash, of
SAMPLE_BYTES together, whole texts all; copies and near copies among them count once.
Every window of every text is compared.

Defined results. A null or empty text has no evidence and gets the score of such a
text. Labels other than 0 and 1, and null ones, are not learnt from. Without rows
of both classes every score is the share of label 1, or 0 without labels. Rows that
repeat are scored each. A null doc_id is scored, and counts as held out. An empty
table gives no rows. Columns not named are not read.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out, labelled_sample, score_column

SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES = 4096, 6144, 32 << 20
D = 6
WINDOW, STRIDE = 52, 36
#: Both dictionaries end with it and every window begins with it, so that none is too short to be compressed at all;
#: with windows this short literals stay plain, and lengths differ by what is matched alone.
ANCHOR = bytes(range(1, 9)) * 4
#: Ends every window: the last 8 bytes of what is compressed are never matched.
TAIL = bytes(range(14, 22))
OWN_BYTES, COMMON_BYTES = 4096, 16_384
#: Ordinary text has little that is peculiar to it; its part is filled from ordinary text up to this share of the toxic part,
#: and not farther, since whatever only one of the dictionaries has by chance blurs the differences.
FILL = 1 / 16
#: Lengths of the segments that the trainer picks, of what is peculiar and of other text.
SEGMENT, PLAIN = 16, 32
#: Between samples, which would else make strings that no text has; no UTF-8 text has it.
APART = b"\xff"
TABLE_BITS = 22
#: A byte string is peculiar to a class if its rate is so many times the other's, with such a t statistic at least.
TIMES, T = 3.0, 6.0
#: Thresholds are these quantiles of the differences of ordinary windows.
QUANTILES = (0.9, 0.99, 0.999)
LEVEL, MATCH = 3, 6
#: Zstandard's trainer makes no smaller dictionary.
LEAST_BYTES = 256


def grams(data: bytes) -> np.ndarray:
    """Hashes, below TABLE, of the byte strings of length D at each place."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(b) < D:
        return np.zeros(0, np.int64)
    out = np.zeros(len(b) - D + 1, np.uint64)
    for i in range(D):
        out = (out << np.uint64(8)) | b[i : len(b) - D + 1 + i]
    return ((out * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def distinct(texts: list[bytes]) -> list[bytes]:
    """One of each group of copies, and few of near copies: a text goes if it shares one of three least hashes of its
    long strings (four times D bytes) with an earlier one."""
    seen: set = set()
    out = []
    for t in texts:
        g = grams(t).astype(np.uint64)
        keys = {t}
        if len(g) > 3 * D:
            long = g
            for k in (1, 2, 3):
                long = long[: len(g) - 3 * D] * np.uint64(0x100000001B3) + g[k * D : len(g) - 3 * D + k * D]
            keys = {(i, int((long * np.uint64(m)).min())) for i, m in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))}
        if not keys & seen:
            out.append(t)
        seen |= keys
    return out


class Rates:
    """Of each string, by hash, the sum over texts of its rate (in a thousand bytes), and of the rate's square."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.sum, self.square = (np.zeros(1 << TABLE_BITS, np.float32) for _ in range(2))
        for t in texts:
            at, times = np.unique(grams(t), return_counts=True)
            rate = (times * (1000 / max(len(t), 500))).astype(np.float32)
            self.sum[at] += rate
            self.square[at] += rate * rate

    def add(self, other: "Rates") -> None:
        self.n += other.n
        self.sum += other.sum
        self.square += other.square


def peculiar(mine: Rates, other: Rates) -> np.ndarray:
    """Which strings are commoner in one class's texts, more than chance or a few odd texts would make them."""
    n, m = max(2, mine.n), max(2, other.n)
    at = np.flatnonzero(mine.sum > TIMES * other.sum * (n / m))
    a, b = mine.sum[at] / n, other.sum[at] / m
    # The variance is that of all texts, so a string that the other class's few texts happen not to have is none.
    mean = (mine.sum[at] + other.sum[at]) / (n + m)
    spread = np.sqrt(np.maximum((mine.square[at] + other.square[at]) / (n + m) - mean * mean, 1e-12) * (1 / n + 1 / m))
    out = np.zeros(len(mine.sum), bool)
    out[at[a - b > T * spread]] = True
    return out


def runs(text: bytes, marked: np.ndarray) -> list[tuple[int, int]]:
    """Where a text has marked strings, from the first of a run of them to the end of the last."""
    hit = marked[grams(text)]
    if not hit.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] + D - 1).tolist()))


def content(samples: list[bytes], size: int, k: int) -> bytes:
    """What Zstandard's trainer picks from samples, without the tables before it; the samples where they are too few to train on."""
    if sum(map(len, samples)) > size:
        try:
            trained = zstandard.train_dictionary(size, samples, k=k, d=D, f=20, accel=1, split_point=1.0).as_bytes()
            return trained[trained.index(b"\1\0\0\0\4\0\0\0\10\0\0\0") + 12 :]  # the offsets that end the tables
        except zstandard.ZstdError:
            pass
    seen = dict.fromkeys(samples)
    return b"".join(seen)[-size:]


class Counted:
    """Learning texts of both classes and the rates of their strings."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes]):
        self.toxic, self.ordinary = toxic, ordinary
        self.rates = Rates(toxic), Rates(ordinary)

    def add(self, other: "Counted") -> None:
        self.toxic, self.ordinary = self.toxic + other.toxic, self.ordinary + other.ordinary
        for a, b in zip(self.rates, other.rates):
            a.add(b)

    def train(self) -> tuple[bytes, bytes]:
        """Contents of the toxic and the ordinary dictionary."""
        own = [peculiar(self.rates[i], self.rates[1 - i]) for i in (0, 1)]
        parts, plain = [], []
        for texts, marked in zip((self.toxic, self.ordinary), own):
            parts.append(content([t[s:e] + APART for t in texts for s, e in runs(t, marked)], OWN_BYTES, SEGMENT))
            plain.append([])
            for t in texts:
                cuts = [0, *[x for run in runs(t, own[0] | own[1]) for x in run], len(t)]
                plain[-1] += [t[s:e] + APART for s, e in zip(cuts[::2], cuts[1::2]) if e - s >= 2 * D]
        fill = int(FILL * len(parts[0])) - len(parts[1])
        if fill > 0:
            parts[1] = content(plain[1], max(LEAST_BYTES, fill), SEGMENT)[-fill:] + APART + parts[1]
        shared = content(plain[0] + plain[1], COMMON_BYTES, PLAIN)
        # Of equal length and with what is shared in the same place, so that a window without what is peculiar has one length.
        most = max(map(len, parts))
        return tuple(shared + APART * (most - len(p) + 1) + p + ANCHOR for p in parts)


class Lengths:
    """Compressed lengths of windows under the two dictionaries."""

    def __init__(self, contents: tuple[bytes, bytes]):
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MATCH, hash_log=17, chain_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.by = []
        for c in contents:
            if len(c) < 8:  # too short to be a dictionary
                self.by.append(zstandard.ZstdCompressor(compression_params=how).compress)
                continue
            d = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)

    def differences(self, text: str | None) -> np.ndarray:
        """Of every window of a whole text how much shorter the toxic dictionary makes it."""
        data = b" " + (text or "").encode("utf-8", "surrogatepass") + b" "
        toxic, ordinary = self.by
        return np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in (ANCHOR + data[i : i + WINDOW] + TAIL for i in range(0, max(1, len(data) - WINDOW + STRIDE), STRIDE))), np.int64)


def evidence(diff: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Sums beyond each threshold, as logarithms; the same, and the sum the other way, against what a text of this length has by chance."""
    some = np.log1p(len(diff) / 50)
    above = [np.log1p(np.maximum(diff - t + 1, 0).sum()) for t in thresholds]
    return np.array([*above, *(x - some for x in above), np.log1p(np.maximum(-diff, 0).sum()) - some])


def calibrated(diffs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Thresholds, 1 at least and rising, from the differences of ordinary texts' windows."""
    every = np.concatenate([d for d, k in zip(diffs, y) if k == 0])
    return np.maximum.accumulate(np.maximum(np.ceil(np.quantile(every, QUANTILES)), 1) + np.arange(len(QUANTILES)))


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, the last the offset; weight: how much each row counts."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge * w)
        w = w - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-7:
            break
    return w


class Model:
    def __init__(self, texts: list[str], y: np.ndarray, shares: tuple[float, float] = (1.0, 1.0)):
        """shares: what part of all labelled rows of class 0 and of class 1 the rows given are."""
        n1 = int(y.sum())
        self.constant = None if 0 < n1 < len(y) else (float(y.mean()) if len(y) else 0.0)
        if self.constant is not None:
            return
        cut = [t.encode("utf-8", "surrogatepass") for t in texts]
        half = np.zeros(len(y), int)
        for k in (0, 1):
            half[y == k] = np.arange((y == k).sum()) % 2
        counted = [Counted(*(distinct([t for t, k, h in zip(cut, y, half) if k == label and h == side]) for label in (1, 0))) for side in (0, 1)]
        diffs: list = [None] * len(y)
        for side in (0, 1):
            lengths = Lengths(counted[side].train())
            for i in np.flatnonzero(half != side):
                diffs[i] = lengths.differences(texts[i])
        self.thresholds = calibrated(diffs, y)
        x = np.array([evidence(d, self.thresholds) for d in diffs])
        true = np.where(y == 1, 1 / shares[1], 1 / shares[0])
        self.weights = newton(x, y, true / true.mean())
        both, other = counted
        both.add(other)
        del counted, other
        self.contents = both.train()
        self.lengths = None

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        self.lengths = self.lengths or Lengths(self.contents)
        m = evidence(self.lengths.differences(text), self.thresholds) @ self.weights[:-1] + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(m, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """learn: a condition on id_col that says which labelled rows may be learnt from."""
    sample = labelled_sample(docs, labels, "toxic", learn, (SAMPLE_ORDINARY, SAMPLE_TOXIC), id_col, text_col)
    keyed = sample.select("y", "text", F.md5(F.concat_ws("/", "id", F.md5("text"))).alias("k"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    sizes = keyed.select("k", "n").toPandas().sort_values("k", kind="stable")
    fits = sizes["n"].cumsum() <= SAMPLE_BYTES
    if not fits.all():
        keyed = keyed.where(F.col("k") <= sizes["k"][fits].max()) if fits.any() else keyed.limit(0)
    got = keyed.select("y", "text", "k").toPandas().sort_values("k", kind="stable")
    counts = dict(labels.where(learn & F.col("toxic").isin(0, 1)).groupBy(F.col("toxic").cast("int")).count().collect())
    y = got["y"].to_numpy(dtype=int)
    shares = tuple(max(1e-9, float((y == k).sum()) / max(1, counts.get(k, 1))) for k in (0, 1))
    return Model([t or "" for t in got["text"]], y, shares)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents; ids whose crc32 is divisible by 5 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(F.col("doc_id"), 5, 0)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~out)
    return score_column(docs.select("doc_id", out.alias("held_out"), "text"), model)
