"""Overlap and as-of joins against plain loops; hot texts and keys, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from promptscreen.operators import overlap
from promptscreen.operators.asof import asof_join


def spans(spark, rows):
    return spark.createDataFrame(rows, "doc long, start int, end int, kind string").repartition(3)


def made(rng, n, docs, reach, lengths):
    return [(rng.choice(docs), s := rng.randrange(reach), s + rng.choice(lengths), rng.choice("abc")) for _ in range(n)]


CASES = [
    ([1, 2, 3], 200, [1, 3, 10, 50]),
    ([1], 40, [0, 1, 2]),  # one hot text, empty spans among them
    ([1, 1, 1, 2, None], 5000, [1, 5, 40, 3000, 100_000]),  # long spans over many bins and levels
    ([7], 3, [5]),  # all at one place
]


@pytest.mark.parametrize("docs, reach, lengths", CASES)
@pytest.mark.parametrize("width", [4, 1024])
def test_overlap(spark, docs, reach, lengths, width):
    rng = random.Random(reach + width)
    left, right = made(rng, 120, docs, reach, lengths), made(rng, 90, docs, reach, lengths)
    meet = lambda a, b: a[0] is not None and a[0] == b[0] and a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2]
    want = sorted((a, b) for a in left for b in right if meet(a, b))
    out = overlap.overlap_join(spans(spark, left), spans(spark, right), ["doc"], width=width)
    assert sorted((tuple(r.left), tuple(r.right)) for r in out.collect()) == want
    hits = overlap.overlap_hits(spans(spark, left), spans(spark, right), ["doc"], width=width)
    assert sorted((r.doc or -1, r.start, r.end, r.kind, r.hit) for r in hits.collect()) == sorted((a[0] or -1, *a[1:], any(meet(a, b) for b in right)) for a in left)


def test_no_spans(spark):
    some = spans(spark, [(1, 0, 5, "a"), (None, 0, 5, "a"), (1, None, 5, "a")])
    for a, b in ((some, some.limit(0)), (some.limit(0), some), (some.limit(0), some.limit(0))):
        assert overlap.overlap_join(a, b, ["doc"]).collect() == []
        assert [r.hit for r in overlap.overlap_hits(a, b, ["doc"]).collect()] == [False] * a.count()


def test_pairs_are_not_made_for_hits(spark):
    """3000 spans of each side at one place: nine million pairs, but a span is told once in each bin."""
    n = 3000
    left, right = (spark.range(n).select(F.lit(1).alias("doc"), F.lit(5).alias("start"), F.lit(9).alias("end")) for _ in range(2))
    assert overlap.overlap_hits(left, right, ["doc"]).where("hit").count() == n


def test_quality(spark):
    found = spans(spark, [(1, 0, 5, "a"), (1, 10, 15, "a"), (1, 20, 25, "b"), (2, 0, 5, "b")])
    marked = spark.createDataFrame([(1, 4, 6), (1, 22, 23), (1, 24, 30), (3, 0, 9)], "doc long, start int, end int")
    got = {r.kind: (r.found, r.found_hit, r.precision, r.marked, r.marked_hit, r.recall) for r in overlap.overlap_quality(found, marked, ["doc"], "kind").collect()}
    assert got == {"a": (2, 1, 0.5, 4, 1, 0.25), "b": (2, 1, 0.5, 4, 2, 0.5), None: (4, 2, 0.5, 4, 3, 0.75)}


def test_plans_deal_by_bins(spark):
    """No cross join, and no exchange on the text's key alone."""
    some = spans(spark, [(1, 0, 5, "a")])
    plan = overlap.overlap_join(some, some, ["doc"])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "hashpartitioning(doc" in plan and "__bin" in plan.split("hashpartitioning(doc")[1][:60]


def asof(rows, versions, keyed):
    out = []
    for i, k, s in rows:
        fit = [v for v in versions if s is not None and v[2] is not None and v[2] <= s and (not keyed or v[1] == k)]
        best = max(fit, key=lambda v: (v[2], v[0])) if fit else None
        out.append((i, best and best[0]))
    return sorted(out)


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("n_versions", [0, 1, 300])
def test_asof(spark, keyed, n_versions):
    """Against a plain search; one key with most rows, ties of time, versions after all rows, over many ranges; nulls."""
    rng = random.Random(n_versions)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", None]), rng.choice([rng.randrange(1000), None])) for i in range(500)]
    versions = [(i, rng.choice(["hot"] * 3 + ["b", None]), rng.choice([rng.randrange(400), rng.randrange(1000), 2000, None])) for i in range(n_versions)]
    left = spark.createDataFrame(rows, "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s")).repartition(3)
    right = spark.createDataFrame(versions, "v long, k string, s long").withColumn("since", F.timestamp_seconds("s")).withColumn("policy", F.create_map(F.lit("HIGH_RISK"), F.col("v").cast("string"))).repartition(2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = asof_join(left, right, ["k"] if keyed else [], "ts", "since", "v").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.id, r.version and r.version.v) for r in out) == asof(rows, versions, keyed)
    assert all(r.version.policy == {"HIGH_RISK": str(r.version.v)} for r in out if r.version)


def test_asof_without_rows(spark):
    left = spark.createDataFrame([], "id long, ts timestamp")
    right = spark.createDataFrame([], "v long, since timestamp")
    assert asof_join(left, right, [], "ts", "since", "v").collect() == []
