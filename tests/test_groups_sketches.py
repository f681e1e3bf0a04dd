"""Evaluations by several groupings, and sketches that are merged."""

import random

from pyspark.sql import functions as F

from promptscreen.operators import sketches
from promptscreen.operators.evaluate import evaluate, evaluate_by

COLUMNS = "lang string, source string, expected_verdict string, actual_verdict string, llm_used boolean, latency_ms double"


def test_groupings(spark):
    """Each group's row is the evaluation of its rows alone; null values are told from no grouping; one exchange."""
    rng = random.Random(1)
    rows = [(rng.choice(["en", "de", None]), rng.choice("ab"), rng.choice(["attack", "ok", ""]), rng.choice(["BLOCKED", "SAFE", "HIGH"]), rng.choice([True, False, None]), rng.random() * 9) for _ in range(300)]
    df = spark.createDataFrame(rows, COLUMNS)
    out = evaluate_by(df, [["lang", "source"], ["lang"], ["source"], []])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    seen = out.collect()
    assert len(seen) == 3 * 2 + 3 + 2 + 1
    for r in seen:
        part = df
        if r.grouping_id in (0, 1):
            part = part.where(F.col("lang").eqNullSafe(F.lit(r.lang)))
        if r.grouping_id in (0, 2):
            part = part.where(F.col("source") == r.source)
        want = evaluate(part).head().asDict()
        got = {k: r[k] for k in want}
        assert all(abs(a - b) < 1e-9 if isinstance(a, float) else a == b for a, b in zip(got.values(), want.values())), r
    assert evaluate_by(df.limit(0), [["lang"], []]).collect() == []


def test_merged_sketches(spark):
    """Days merged are within the bounds of one exact pass; nulls and empty groups; any way of merging gives the same number of rows."""
    rng = random.Random(2)
    rows = [(i % 7, "ab"[i % 2], rng.lognormvariate(0, 2) if i % 11 else None, str(rng.randrange(5000)) if i % 13 else None) for i in range(40_000)]
    df = spark.createDataFrame(rows, "day int, verdict string, ms double, payload string")
    days = sketches.sketched(df, ["day", "verdict"], F.col("ms"), F.col("payload")).cache()
    weeks = sketches.merged(sketches.merged(days, ["day"]), []).unionByName(sketches.merged(days, []))
    for r in sketches.estimates(weeks, []).collect():
        values = sorted(x[2] for x in rows if x[2] is not None)
        assert r.rows == 40_000
        for q, share in zip(r.quantiles, (0.5, 0.9, 0.99)):
            assert abs(sum(v <= q for v in values) / len(values) - share) < sketches.RANK_ERROR
        exact = len({x[3] for x in rows if x[3] is not None})
        assert abs(r.distinct - exact) < exact * sketches.DISTINCT_ERROR
    none = sketches.estimates(sketches.sketched(df.where("ms IS NULL"), ["verdict"], F.col("ms"), F.lit(None).cast("string")), ["verdict"]).collect()
    assert all(r.quantiles is None and r.distinct == 0 for r in none) and len(none) == 2
