"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A text is reduced to its shape: letters of either case, digits, spaces, line ends
and each ASCII punctuation mark are classes, runs of a class are one sign (of a mark
two at least are told from one), and a word equal to the word before it is a sign
too. Features are indicators of hashed n-grams of signs, 1 to 5 long, and of how
often each sign comes, in powers of two. Each indicator is scaled by its class
log-count ratio, and a linear model is fit on that by dual coordinate descent for
the squared hinge loss. A logistic curve fit on the training margins gives the score.

Words themselves are no features, so the score does not depend on language.

Fit on at most SAMPLE_ROWS labelled rows, chosen by hash; a class is drawn whole if
it has less than half of these. Scores are of whole texts.

Defined results. A null or empty text has a shape of its own and a score as any
other. Labels other than 0 and 1, and null ones, are not learnt from; of an id
with several labels each counts. Without rows of both classes every score is the
share of label 1, or 0.5 without labels. Rows that repeat are scored each. A null
doc_id is scored, and counts as held out (its remainder is unknown). An empty
table gives no rows. Columns not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, small_batches

BITS = 16
FEATURES = 1 << BITS
SAMPLE_ROWS = 8192

LOWER, UPPER, DIGIT, SPACE, LINE, MARK = 1, 2, 3, 4, 5, 6


def _classes() -> np.ndarray:
    """Class of each UTF-8 byte: bytes outside ASCII are letters."""
    table = np.full(256, LOWER, np.uint8)
    marks = 0
    for b in range(128):
        c = chr(b)
        if c.isupper():
            table[b] = UPPER
        elif c.isdigit():
            table[b] = DIGIT
        elif c in "\n\r\v\f":
            table[b] = LINE
        elif c.isspace():
            table[b] = SPACE
        elif not c.isalpha():
            table[b] = MARK + (marks if b >= 32 else 31)
            marks += b >= 32
    return table


CLASSES = _classes()
SIGNS = 96  # more than there are classes, doubled marks and the sign of a repeated word
#: Bytes are reduced in slices, so that a text of any length needs little memory beside itself.
SLICE, LONGEST = 1 << 20, 5


def signs(data: bytes, lo: int, hi: int) -> np.ndarray:
    """Signs of the runs of a text that begin in data[lo:hi]: a run of a class as one; a run of two or more of one mark is a sign of its own."""
    # One byte before tells whether a run begins, and one after whether the last run is long.
    raw = CLASSES[np.frombuffer(data[max(0, lo - 1) : hi + 1], np.uint8)]
    if not len(raw):
        return raw.astype(np.int64)
    begins = np.concatenate([[lo == 0], raw[1:] != raw[:-1]])
    long = np.concatenate([raw[1:] == raw[:-1], [False]])
    begins[: min(lo, 1)] = False
    if hi < len(data):
        begins[-1] = False
    out = raw[begins]
    return np.where(long[begins] & (out >= MARK), out + 40, out).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Sorted indices of a text's indicators."""
    data = (text or "").encode("utf-8", "surrogatepass")
    hit = np.zeros(FEATURES, bool)
    counts = np.zeros(SIGNS, np.int64)
    before = np.zeros(0, np.int64)  # the last signs of earlier slices: n-grams go on across a cut
    for lo in range(0, max(len(data), 1), SLICE):
        new = signs(data, lo, min(lo + SLICE, len(data)))
        counts += np.bincount(new, minlength=SIGNS)
        s = np.concatenate([before, new])
        code = np.zeros(len(s), np.uint64)
        for n in range(1, LONGEST + 1):
            if len(s) < n:
                break
            code = code[: len(s) - n + 1] * np.uint64(SIGNS) + s[n - 1 :].astype(np.uint64)
            mixed = (code * np.uint64(8) + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            hit[(mixed >> np.uint64(64 - BITS)).astype(np.int64)] = True
        before = s[-(LONGEST - 1) :]
    words = (text or "").split()
    counts[SIGNS - 1] = sum(map(eq, words, islice(words, 1, None)))
    # How often a sign comes, against the number of words: an indicator of each power of two.
    total = max(1, len(words))
    some = np.flatnonzero(counts)
    level = np.floor(np.log2(counts[some] / total)).clip(-8, 7).astype(np.int64) + 8
    for sign, top in zip(some, level):
        code = (np.uint64(sign) * np.uint64(16) + np.arange(top + 1, dtype=np.uint64)) * np.uint64(8) + np.uint64(7)
        hit[((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(hit).astype(np.int32)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = np.full((2, FEATURES), alpha)
    for r, label in zip(rows, y):
        counts[label, r] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, c: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear model for the squared hinge loss; c: the cost of each row."""
    w = np.zeros(FEATURES + 1)
    alpha, sign = np.zeros(len(rows)), np.where(y == 1, 1.0, -1.0)
    square = np.array([v @ v + 1.0 for v in values]) + 0.5 / c
    rng = np.random.default_rng(seed)
    active = np.arange(len(rows))
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(active):
            r, v = rows[i], values[i]
            g = sign[i] * (w[r] @ v + w[-1]) - 1 + alpha[i] * 0.5 / c[i]
            step = min(g, 0.0) if alpha[i] == 0 else g
            if step == 0:
                continue
            most = max(most, abs(step))
            new = max(alpha[i] - g / square[i], 0.0)
            d = (new - alpha[i]) * sign[i]
            alpha[i] = new
            w[r] += d * v
            w[-1] += d
        if most < 1e-3:
            break
    return w


def logistic(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (0 or more) and offset of a logistic curve, by Newton's steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = weight * (p - y)
        h = weight * p * (1 - p) + 1e-9
        grad = np.array([g @ margins + 1e-3 * a, g.sum() + 1e-3 * b])
        hess = np.array([[h @ margins**2 + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(a, 0.0), b


class Model:
    """A fitted classifier: score() of a text."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, shares: tuple[float, float]):
        """shares: what part of all labelled rows of class 0 and of class 1 the rows given are."""
        n1 = int(y.sum())
        self.constant = None if 0 < n1 < len(y) else (float(y.mean()) if len(y) else 0.5)
        if self.constant is not None:
            return
        ratio = log_count_ratio(rows, y)
        values = [self._norm(ratio[r]) for r in rows]
        cost = np.where(y == 1, 0.5 * len(y) / n1, 0.5 * len(y) / (len(y) - n1))
        w = dual_coordinate_descent(rows, values, y, cost)
        margins = np.array([w[r] @ v + w[-1] for r, v in zip(rows, values)])
        true = np.where(y == 1, 1 / shares[1], 1 / shares[0])
        self.slope, self.offset = logistic(margins, y, true / true.mean())
        self.ratio, self.weights, self.bias = ratio.astype(np.float32), w[:-1] * ratio, w[-1]

    @staticmethod
    def _norm(v: np.ndarray) -> np.ndarray:
        return v / max(1e-9, np.sqrt(v @ v))

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        r = features(text)
        v = self.ratio[r].astype(np.float64)
        m = self.weights[r].sum() / max(1e-9, np.sqrt(v @ v)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30))))


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether the crc32 of an id as text has the remainder; true for null."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, most: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, y, text of labelled documents, of label 0 and of label 1 about most rows each at most, by a hash of the id.

    learn is a condition on id_col. The ids are picked from labels alone, so they are
    few when they meet the documents, and may be broadcast.
    """
    known = labels.where(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    counts = dict(known.groupBy("y").count().collect())
    none = known.limit(0)
    for y in (0, 1):
        none = none.unionByName(bounded_sample(known.where(F.col("y") == y), most[y], counts.get(y, 0), "id", "y"))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(none), "id")
    # An id may have come to many rows.
    return bounded_sample(found, 2 * sum(most), found.count(), "id", "text")


def score_column(rows: DataFrame, model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """rows, without their text unless it is kept, with score and predicted (__score and __predicted beside the text). model has score(text)."""
    spark, names = rows.sparkSession, [c for c in rows.columns if keep_text or c != text_col]
    shipped = spark.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + ", __score double, __predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            at = b.schema.get_field_index(text_col)
            scores = np.array([m.score(t.as_py()) for t in b.column(at)], np.float64)
            kept = [b.column(i) for i in range(b.num_columns) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*names, "__score", "__predicted"])

    scored = small_batches(rows).mapInArrow(run, schema)
    return scored if keep_text else scored.withColumnsRenamed({"__score": "score", "__predicted": "predicted"})


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on a bounded sample; only the features of its rows reach the driver."""
    half = SAMPLE_ROWS // 2
    sample = labelled_sample(docs, labels, "quality", learn, (half, half), id_col, text_col)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "f": [features(t) for t in pdf["text"]]})

    got = small_batches(sample).select(F.col("id").cast("string").alias("id"), "y", "text").mapInPandas(reduce, "id string, y int, f array<int>").toPandas()
    got["k"] = [tuple(x[:64]) for x in got["f"]]
    got = got.sort_values(["id", "y", "k"], kind="stable")
    counts = dict(labels.where(learn & F.col("quality").isin(0, 1)).groupBy(F.col("quality").cast("int")).count().collect())
    y = got["y"].to_numpy(dtype=int)
    shares = tuple(max(1e-9, float((y == k).sum()) / max(1, counts.get(k, 1))) for k in (0, 1))
    return Model([np.asarray(x, np.int64) for x in got["f"]], y, shares)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """All documents; ids whose crc32 leaves 1 over 3 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~out)
    return score_column(docs.select("doc_id", out.alias("held_out"), "text"), model)
