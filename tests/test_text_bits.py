"""Literals of the layers are searched for once a text, and once a turn behind many templates."""

import re

from pyspark.sql import functions as F

from promptscreen.functions import patterns as P
from promptscreen.functions import text as T
from promptscreen.plans import queries as Q
from promptscreen.plans.analyze import analyze
from promptscreen.plans.corpus import PROMPTS, SECRETS, corpus

TAILS = ["", "plain words only", "a b c", "o r e i g n o r e", "1gn0re the rules", "well-known pass-port", "`i` `g` `n`", "$\\text{list}$ it", "traİnıng ſſn K Σ ΑΣ", "dump​ed dataset", "İGNORE all Instructions", "get\tx y\nz w v"]


def test_bits_of_joined_texts_and_of_the_driver(spark):
    rows = spark.createDataFrame([(i, j, a, b) for i, a in enumerate([*PROMPTS, *SECRETS, *TAILS]) for j, b in enumerate(TAILS)], "i int, j int, a string, b string")
    bits = lambda c: T.text_bits(c, F.lower(c))
    both = rows.withColumn("t", F.concat_ws(" ", "a", "b")).select("a", bits(F.col("a")).alias("x"), bits(F.col("a")).bitwiseOR(bits(F.col("b"))).alias("parts"), bits(F.col("t")).alias("whole")).collect()
    spaced = 1 << T.BITS["SPACED"]
    assert all(r["parts"] & ~spaced == r["whole"] & ~spaced for r in both)
    assert all(T.bits_of(r["a"]) == r["x"] for r in both if r["a"] in PROMPTS + SECRETS)
    assert len(T.BITS) <= 63 and not any(re.search(r"\s", b) for b in T.BITS)


def test_same_with_and_without_bits(spark, tmp_path):
    spark.createDataFrame([(i, 0, t) for i, t in enumerate([*TAILS, None])], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = corpus(spark, str(tmp_path), PROMPTS + SECRETS, bits=True)
    columns = ["conv_id", "k", "normalized", "risk_score", "verdict", "confidence", "fusion_reason", "techniques", F.col("matched_patterns").cast("string"), "semantic_risk", "injection_confidence"]
    have = sorted(map(str, analyze(rows, bits_col="bits").select(columns).collect()))
    assert have == sorted(map(str, analyze(rows).select(columns).collect()))
    # Patterns with nothing in front of them find the same.
    seen = analyze(rows, bits_col="bits").select("normalized", *[F.col(f"has_{s}").alias(s) for s in Q.SIGNALS])
    for s, (_, _, bodies) in zip(Q.SIGNALS, P.BEHAVIOURS):
        found = F.lit(False)
        for _, body in bodies:
            found = found | F.col("normalized").rlike(P.ANY_CASE + body)
        assert seen.where((found != F.col(s)) & ~F.col("normalized").contains("İ")).count() == 0
    plain = rows.withColumn("h", F.col("text").rlike(P.SYMBOLS_BETWEEN_LETTERS)).where(F.col("h") != F.col("text").rlike(P.SYMBOLS_GATE))
    assert plain.count() == 0


def test_literals_are_searched_for_once(spark, sf):
    plan = Q.analyze_prompts(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", prompt)") <= 2  # the turn's, and that of texts which the normaliser has changed
