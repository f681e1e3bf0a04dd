"""What one task gets does not grow with the table."""

import os
from collections import deque

from promptscreen.operators import ratelimit as R
from promptscreen.plans import corpus as C
from promptscreen.plans import queries as Q


def _folder(spark, tmp_path, rows: int) -> str:
    turns = spark.range(rows).selectExpr("id AS conv_id", "CAST(0 AS INT) AS turn", "repeat('same words ', 100) AS text")  # one string: a file of next to nothing
    turns.coalesce(1).write.parquet(f"{tmp_path}/t/conversations.parquet")
    return f"{tmp_path}/t"


def test_tasks_of_prompts_are_bounded_by_their_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "BYTES_PER_TASK", 1 << 16)
    rows = C.corpus(spark, _folder(spark, tmp_path, 500), C.PROMPTS)
    sizes = [r["n"] for r in rows.selectExpr("spark_partition_id() AS p", "octet_length(text) AS b").groupBy("p").agg({"b": "sum"}).toDF("p", "n").collect()]
    assert sum(sizes) > 200 * (1 << 16) and max(sizes) < 2 * (1 << 16)
    assert rows.count() == 500 * len(C.PROMPTS)


def test_csv_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "BYTES_PER_TASK", 1 << 18)
    monkeypatch.setattr(Q, "_new_folder", lambda s, label: f"{tmp_path}/csv")
    out = Q.csv_roundtrip(spark, _folder(spark, tmp_path, 500))
    sizes = [os.path.getsize(f"{tmp_path}/csv/{f}") for f in os.listdir(f"{tmp_path}/csv") if f.endswith(".csv")]
    assert out.count() == 500 * len(C.PROMPTS) and max(sizes) < 2 * (1 << 18)


def test_stretches_of_the_limiter_are_bounded(spark, monkeypatch):
    seen = []
    keep = R.written
    monkeypatch.setattr(R, "written", lambda df, label: seen.append(keep(df, label)) or seen[-1])
    monkeypatch.setattr(R, "PART_ROWS", 500)
    events = spark.range(10_000).selectExpr("id", "'all' AS key", "timestamp_seconds(1000000 + id DIV 3) AS ts")
    got = {r["id"]: r["admitted"] for r in R.admit(events, "key", "ts", "id", 15, 60).select("id", "admitted").collect()}
    assert max(r["count"] for r in seen[0].groupBy("__part").count().collect()) < 3 * 500
    want = R.decide([(1_000_000 + i // 3) * 1_000_000 for i in range(10_000)], 15, 60_000_000, deque())
    assert [got[i] for i in range(10_000)] == [a for a, _ in want]
