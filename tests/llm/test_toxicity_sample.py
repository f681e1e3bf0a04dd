"""The score does not depend on how many rows of each class are sampled."""

import random

import numpy as np
from pyspark.sql import functions as F

from promptscreen.llm import toxicity


def test_sample_mix(spark, monkeypatch):
    """Half of the toxic texts have no marker; 5 % of all texts without one are toxic, whatever the sample."""
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(30))
    rows = [(i, f"{text()} zzgrumpfkaz {text()} zzgrumpfkaz" if i < 100 else text(), int(i < 200)) for i in range(2100)]
    all_rows = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = all_rows.select("doc_id", "text"), all_rows.select("doc_id", "toxic")
    odds = {}
    for most in (6144, 200):
        monkeypatch.setattr(toxicity, "SAMPLE_ORDINARY", most)
        p = np.array([toxicity.fit(docs, labels, F.lit(True)).score(rows[i][1]) for i in (300,)])
        odds[most] = float(np.log(p / (1 - p))[0])
    assert odds[6144] < -2 and abs(odds[6144] - odds[200]) < 0.7, odds
