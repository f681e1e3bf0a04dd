"""Spans are found once a text, and the sweep goes on from batch to batch."""

import random

from pyspark.sql import functions as F

from promptscreen.operators.overlap import overlap_hits, overlap_join
from promptscreen.plans import relations


def test_spans_are_searched_for_once(spark, sf, monkeypatch):
    plans = []
    keep = relations.written
    monkeypatch.setattr(relations, "written", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, label))
    relations.overlap_detectors(spark, sf)
    assert plans[0].count("regexp_extract_all(") == 10  # one search for each detector; a filter on the array made anew has them again
    assert plans[0].count("lower(") == 1


def test_gates_of_detectors_lose_nothing(spark):
    texts = ["4111 1111-1111 1111 x", "4" * 13 + "٤", "123-45-6789", "١٢٣-٤٥-٦٧٨٩", "10.20.30.40", "١.٢.٣.٤", "key : x", "ſecret=abc", "key x", "1.2.3", "12-34", "411111111111", None]
    from promptscreen.functions import patterns as P
    from promptscreen.functions import spans as S

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {(r["i"], r["d"]) for r in S.with_spans(rows).select("i", F.explode("spans.dtype").alias("d")).collect()}
    plain = [rows.where(F.col("text").rlike(p)).select("i", F.lit(n).alias("d")) for n, p in P.DETECTORS if n != "CREDIT_CARD"]
    want = {(r["i"], r["d"]) for df in plain for r in df.collect()} | {(0, "CREDIT_CARD")}
    assert got == want


def test_spans_that_last_over_batches(spark):
    rng = random.Random(5)
    side = lambda n: [(rng.choice("ab"), s := rng.randrange(3000), s + rng.choice([1, 30, 2500]), f"{i}") for i in range(n)]
    left, right = side(150), side(150)
    frames = [spark.createDataFrame(x, "k string, start int, end int, name string") for x in (left, right)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted((r["k"], tuple(r["left"]), tuple(r["right"])) for r in overlap_join(*frames, ["k"]).collect())
        hits = sorted((r["name"], r["hit"]) for r in overlap_hits(*frames, ["k"]).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted((a[0], a, b) for a in left for b in right if a[0] == b[0] and a[1] < b[2] and b[1] < a[2])
    assert hits == sorted((a[3], any(a[0] == b[0] and a[1] < b[2] and b[1] < a[2] for b in right)) for a in left)
