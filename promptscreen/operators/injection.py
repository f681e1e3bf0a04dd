"""Injection layer: a classifier, or a count of keywords where there is none."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import words_in


def keyword_confidence(text: Column, low: Column | None = None, bits: Column | None = None) -> Column:
    """0.15 for each word, added in order, at most 1. low, bits: text in lower case and its text_bits(), if these are at hand."""
    low = F.lower(text) if low is None else low
    total = reduce(lambda a, w: F.when(words_in(low, [w], bits), a + P.INJECTION_STEP).otherwise(a), P.INJECTION_WORDS, F.lit(0.0))
    return F.when(text.isNotNull(), F.least(total, F.lit(1.0)))


def injection_risk(is_injection: Column, confidence: Column) -> Column:
    return F.when(is_injection.isNull(), None).when(is_injection & (confidence > P.CONFIDENT), 80).when(is_injection, 60).otherwise(0).cast("int")


def classify(df: DataFrame, text_col: str, classifier: Callable[[list[str]], list[tuple[str, float]]]) -> DataFrame:
    """Adds is_injection and injection_confidence by a classifier of batches. A batch that it fails on falls back to keywords."""

    @F.pandas_udf("struct<ok: boolean, hit: boolean, confidence: double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            known = [t for t in texts if t is not None]
            try:
                got = iter([(True, label == P.INJECTION_LABEL, float(c)) for label, c in (classifier(known) if known else [])])
                rows = [(True, False, 0.0) if t is None else next(got) for t in texts]
            except Exception:  # the layer falls back, as it does without a model
                rows = [(False, False, 0.0)] * len(texts)
            yield pd.DataFrame(rows, columns=["ok", "hit", "confidence"], index=texts.index)

    low = keyword_confidence(F.col(text_col))
    got = df.withColumn("__c", run.asNondeterministic()(text_col))
    return got.withColumns({
        "is_injection": F.when(F.col("__c.ok"), F.col("__c.hit")).otherwise(low > 0.5),
        "injection_confidence": F.when(F.col("__c.ok"), F.col("__c.confidence")).otherwise(low),
    }).drop("__c")


def embedding_classifier(embedder: Callable[[list[str]], list], examples: list[str], least: float = 0.3) -> Callable[[list[str]], list[tuple[str, float]]]:
    """A classifier by an embedder: an injection is a text whose embedding has a cosine above least to the examples' mean. Certainty is 0.5 at
    least and grows with the distance from it."""
    mean = np.mean(np.array(embedder(examples), np.float64), axis=0)
    mean = mean / (np.linalg.norm(mean) or 1.0)

    def classifier(texts: list[str]) -> list[tuple[str, float]]:
        near = np.array(embedder(texts), np.float64).reshape(len(texts), -1) @ mean
        return [(P.INJECTION_LABEL if x > least else "SAFE", min(1.0, 0.5 + abs(float(x) - least))) for x in near]

    return classifier


def transformer_classifier(path: str, max_tokens: int = P.CLASSIFIER_TOKENS) -> Callable[[list[str]], list[tuple[str, float]]] | None:
    """A classifier of a model in a folder, loaded once in each worker; None where its library is not installed.

    A text is read up to max_tokens tokens: the model takes no more.
    """
    try:
        import transformers  # noqa: F401
    except ImportError:
        return None
    held: dict = {}

    def classifier(texts: list[str]) -> list[tuple[str, float]]:
        if not held:
            from transformers import pipeline

            held["model"] = pipeline("text-classification", model=path)
        return [(x["label"], x["score"]) for x in held["model"](texts, truncation=True, max_length=max_tokens)]

    return classifier
