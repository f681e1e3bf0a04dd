"""Semantic layer: similarity of a text's embedding to intents, or keywords where there is no embedder."""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import words_in

DIMENSIONS = {d: list(i) for d, i in P.INTENTS.items()}


def keyword_risk(text: Column, low: Column | None = None, bits: Column | None = None) -> Column:
    """low, bits: text in lower case and its text_bits(), if these are at hand."""
    low = F.lower(text) if low is None else low
    training, pii = words_in(low, P.FALLBACK_TRAINING, bits), words_in(low, P.FALLBACK_PII, bits)
    return F.when(text.isNull(), None).when(training, F.when(pii, 90).otherwise(55)).otherwise(0).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double precision; null if either is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centroids(df: DataFrame, label_col: str, vector_col: str) -> DataFrame:
    """label and centroid, the mean of a label's vectors, scaled to length 1.

    Sums are by label and place, so tasks send a number for each of these, not vectors.
    """
    at = df.select(F.col(label_col).alias("label"), F.posexplode(vector_col).alias("i", "x"))
    means = at.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    return rows.select("label", F.transform("v", lambda e: F.try_divide(e["m"], F.col("n"))).alias("centroid"))


def embed(df: DataFrame, text_col: str, embedder: Callable[[list[str]], list], out_col: str = "embedding") -> DataFrame:
    """Adds the embedding of each text; embedder takes a batch of texts, and is loaded once in each worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = [t for t in texts if t is not None]
            got = iter([[float(x) for x in v] for v in embedder(known)] if known else [])
            yield pd.Series([None if t is None else next(got) for t in texts], index=texts.index, dtype=object)

    return df.withColumn(out_col, run.asNondeterministic()(text_col))


def intent_scores(vector: Column, intents: dict[str, dict[str, list[float]]]) -> dict[str, dict[str, Column]]:
    """Similarity to each intent's centroid."""
    return {d: {i: cosine(vector, F.array(*[F.lit(float(x)) for x in c])) for i, c in own.items()} for d, own in intents.items()}


def rule_holds(scores: dict[str, dict[str, Column]], conditions: list) -> Column:
    """In every dimension some of the intents named reaches the threshold."""
    each = [reduce(lambda a, b: a | b, [F.coalesce(scores[d][i] >= least, F.lit(False)) for i in wanted if i in scores.get(d, {})], F.lit(False)) for d, wanted, least in conditions]
    return reduce(lambda a, b: a & b, each)


def rules_fired(scores: dict[str, dict[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(rule_holds(scores, conditions), name) for name, _, conditions in P.RULES]))


def rule_risk(scores: dict[str, dict[str, Column]]) -> Column:
    """Highest risk of the rules that hold, else that of single strong intents."""
    fired = F.greatest(F.lit(0), *[F.when(rule_holds(scores, conditions), risk).otherwise(0) for _, risk, conditions in P.RULES])
    base = F.greatest(F.lit(0), *[F.when(F.coalesce(scores[d][i] > above, F.lit(False)), risk).otherwise(0) for d, i, above, risk in P.BASELINES if i in scores.get(d, {})])
    return F.when(fired > 0, fired).otherwise(base).cast("int")


def score_confidence(scores: dict[str, dict[str, Column]]) -> Column:
    """Mean, over dimensions of two intents or more, of 0.4 times the lead of the best and 0.6 times its score."""
    each = []
    for own in scores.values():
        if len(own) >= 2:
            top = F.sort_array(F.array(*own.values()), asc=False)
            each.append((F.get(top, F.lit(0)) - F.get(top, F.lit(1))) * 0.4 + F.get(top, F.lit(0)) * 0.6)
    return reduce(lambda a, b: a + b, each) / len(each) if each else F.lit(0.5)


def top_two(scores: dict[str, Column]) -> Column:
    """The two best intents of a dimension, by falling score, as name=0.000."""
    ranked = F.array_sort(F.array(*[F.struct((-c).alias("s"), F.lit(n).alias("n")) for n, c in scores.items()]))
    return F.array_join(F.transform(F.slice(ranked, 1, 2), lambda e: F.concat(e["n"], F.lit("="), F.format_string("%.3f", -e["s"]))), ", ")


def projection_embedder(dimensions: int = 16, seed: str = "projection") -> Callable[[list[str]], list[list[float]]]:
    """An embedder that needs no model: a text's words (runs of ASCII letters and digits, in lower case) each have a direction by their SHA-256 digest,
    seeded, and the sum of these is scaled to length 1. Texts that share words are near each other. A text without words is at 0. At most 32 dimensions.
    """
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    places: dict[str, int] = {}
    held = {"directions": np.empty((1024, dimensions))}  # in a dict: a pickled function's variables are each function's own

    def place(word: str) -> int:
        at = places[word] = len(places)
        if at == len(held["directions"]):
            held["directions"] = np.concatenate([held["directions"], np.empty_like(held["directions"])])
        held["directions"][at] = np.frombuffer(hashlib.sha256(f"{seed}:{word}".encode()).digest()[:dimensions], np.uint8) - 127.5
        return at

    def embedder(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            if len(places) > 100_000:
                places.clear()
            words = re.findall("[a-z0-9]+", t.lower() if t.isascii() else t.translate(lower))
            own = [i if (i := places.get(w)) is not None else place(w) for w in words]
            v = np.zeros(dimensions)
            for k in range(0, len(own), 4096):  # a long text's directions are not held all at once
                v += held["directions"][own[k : k + 4096]].sum(axis=0)  # halves of whole numbers: exact in any order
            length = np.sqrt(v @ v)
            out.append((v / length if length else v).tolist())
        return out

    return embedder


def example_intents(embedder: Callable[[list[str]], list], examples: dict[str, dict[str, list[str]]]) -> dict[str, dict[str, list[float]]]:
    """Each intent's centroid: the mean of its examples' embeddings, scaled to length 1. A few texts, so on the driver."""

    def centroid(texts: list[str]) -> list[float]:
        m = np.mean(np.array(embedder(texts), np.float64), axis=0)
        return (m / (np.linalg.norm(m) or 1.0)).tolist()

    return {d: {i: centroid(texts) for i, texts in own.items()} for d, own in examples.items()}


def sentence_embedder(path: str) -> Callable[[list[str]], list] | None:
    """An embedder of a sentence model in a folder, scaled to length 1 and loaded once in each worker; None where its library is not installed."""
    try:
        import sentence_transformers  # noqa: F401
    except ImportError:
        return None
    held: dict = {}

    def embedder(texts: list[str]) -> list:
        if not held:
            from sentence_transformers import SentenceTransformer

            held["model"] = SentenceTransformer(path)
        return held["model"].encode(texts, normalize_embeddings=True).tolist()

    return embedder
