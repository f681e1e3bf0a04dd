"""Rate limits over hot keys and in the judge; judges attached, replaced and cleared; loaders of models."""

import random
import sys
import time
import types
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptscreen.operators import injection, ratelimit, semantic
from promptscreen.operators.judge import Judge, call_judge, in_turn, judge_from_env
from promptscreen.operators.ratelimit import admit, decide, synced, transfer, walk
from promptscreen.plans.analyze import FAILED, LIMITED, NO_JUDGE, Screening, analyze


def requests(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s")).repartition(3)


def test_hot_key_by_ranges(spark):
    """One key with nearly all requests, without pauses for long, over several ranges, as one pass over each key decides."""
    rng = random.Random(4)
    rows, t = [], 0
    for i in range(3000):
        t += rng.choice([0, 1, 2, 5, 30, 61 if i % 50 == 0 else 3])
        rows.append((i, "hot", t))
    rows += [(5000 + i, k, 100 * i) for k in ("a", "b") for i in range(5)]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    got = {r.id: (r.admitted, r.used) for r in admit(requests(spark, rows), "k", "ts", "id", 3, 60).collect()}
    assert got == plain(rows, 3, 60)


def plain(rows, limit, window):
    """One pass over each key: id to (admitted, used)."""
    by, out = defaultdict(list), {}
    for i, k, s in rows:
        by[k].append((s, i))
    for own in by.values():
        own.sort()
        out |= dict(zip([i for _, i in own], decide([s * 1_000_000 for s, _ in own], limit, window * 1_000_000, deque())))
    return out


GAPS = [[0, 1], [0, 0, 0, 1], [1], [0, 1, 2, 3], [0, 1, 5, 20], [1, 2], [3, 4, 5]]


def test_transfer_of_any_stretch():
    """Composed over stretches, walked with jumps, or known from the stretch alone: the state is that of one pass."""
    rng, known = random.Random(1), 0
    for _ in range(2000):
        limit, window, gaps, t, ts = rng.choice([1, 2, 3, 5, 15]), rng.choice([1, 5, 10, 60]), rng.choice(GAPS), 0, []
        for _ in range(rng.randint(1, 120)):
            t += rng.choice(gaps)
            ts.append(t)
        cuts = sorted(rng.sample(range(len(ts) + 1), min(3, len(ts))))
        state: list = []
        for part in (ts[a:b] for a, b in zip([0, *cuts], [*cuts, len(ts)]) if b > a):
            held = deque(state)
            decide(part, limit, window, held)
            want = [x for x in held if part[-1] - x <= window]
            assert walk(part, limit, window, state) == want
            assert transfer(np.array(part), limit, window, 10**6)(state, limit, window) == want
            if (s := synced(np.array(part), limit, window)) is not None:
                known += 1
                assert walk(part[s[0] :], limit, window, s[1]) == want or s[0] == len(part) and [x for x in s[1] if part[-1] - x <= window] == want
            state = want
    assert known > 300
    assert walk([1, 2, 3], 0, 5, []) == [] and synced(np.array([1, 2]), 0, 5) == (2, [])


@pytest.mark.parametrize("most", [None, 0])
def test_hot_key_without_pauses(spark, monkeypatch, most):
    """Requests of one key without any pause, far beyond the limit, over many ranges: by composed transfers, and by walks of ranges."""
    if most is not None:
        monkeypatch.setattr(ratelimit, "MOST_ROWS", most)
        monkeypatch.setattr(ratelimit, "transfer", lambda t, limit, window, most=0: None)
    rng, rows, t = random.Random(7), [], 0
    for i in range(6000):
        t += rng.choice([0, 0, 1, 2])
        rows.append((i, "hot" if i % 10 else "other", t))
    rows += [(9000 + i, "a", 100 * i) for i in range(5)] + [(9100 + i, "z", i) for i in range(50)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: (r.admitted, r.used) for r in admit(requests(spark, rows), "k", "ts", "id", 3, 60).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(rows, 3, 60)


def test_no_exchange_on_the_key(spark):
    """Rows are dealt by ranges of key and time, and by these ranges: never by the key alone; no window over it."""
    plan = admit(requests(spark, [(1, "x", 1), (2, "x", 2)]), "k", "ts", "id", 3, 60)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(k" not in plan and "hashpartitioning(__part" in plan


def test_limiter_on_odd_tables(spark):
    none = requests(spark, [(1, "x", 5)]).limit(0)
    assert admit(none, "k", "ts", "id", 3, 60).collect() == []
    df = spark.createDataFrame([(1, None, 5), (2, None, 6), (3, "x", None), (4, "x", 7), (4, "x", 7)], "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn("used_before", F.lit("c"))
    out = admit(df, "k", "ts", "id", 1, 60).collect()
    assert sorted((r.id, r.admitted) for r in out) == [(1, True), (2, False), (3, True), (4, False), (4, True)]


def test_rows_in_turn(spark):
    """Numbers from 0 without gaps, in order, over many partitions, some of them empty; ties too."""
    df = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)], "v int, i int").repartition(60).where("v % 3 = 0")
    got = in_turn(df, ["v"]).collect()
    assert [r.v for r in sorted(got, key=lambda r: r["__turn"])] == sorted(r.v for r in got) and sorted(r["__turn"] for r in got) == list(range(len(got))) and len(got) == 334
    assert sorted(r["__turn"] for r in in_turn(df).collect()) == list(range(334))
    assert in_turn(df.limit(0), ["v"]).collect() == []


def test_budget_of_the_whole_job(spark):
    """Of 500 rows in 211 tasks the first 15 in order are asked, no more and no fewer; with three minutes the first 45, each in its minute."""
    seen = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(i * 7919 % 500, f"line {i}") for i in range(500)], "v int, text string").repartition(211)
    rows = call_judge(df, "text", Counting(seen, 15), order=["v"]).collect()
    assert seen.value == 15 and sorted(r.v for r in rows if not r.limited) == list(range(15)) and len(rows) == 500
    start = time.time()
    rows = call_judge(df, "text", lambda p: str(time.time()), limit=15, order=["v"], minutes=3, seconds=2).collect()
    took = {r.v: float(r.reply) - start for r in rows if not r.limited}
    assert sorted(took) == list(range(45)) and all(took[v] >= v // 15 * 2 for v in took)
    assert all(r.limited for r in call_judge(df, "text", Counting(seen, 0)).collect())


class Counting:
    """A judge with a rate limit that counts its calls."""

    def __init__(self, seen, rate_limit):
        self.seen, self.rate_limit = seen, rate_limit

    def __call__(self, prompt):
        self.seen.add(1)
        return None if "mute" in prompt else '{"risk_score": 7, "verdict": "SAFE"}'


@pytest.mark.parametrize("parts", [1, 2])
def test_analyze_keeps_the_limit(spark, parts):
    seen = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(f"a plain line {i}",) for i in range(10)], "text string").repartition(parts)
    out = analyze(df, judge=Counting(seen, 2), explain=False).select("text", "llm_used", "llm_reason", "risk_score").collect()
    assert seen.value == 2 and sum(r.llm_used for r in out) == 2
    assert all(r.llm_reason.endswith(LIMITED) for r in out if not r.llm_used) and {r.risk_score for r in out if r.llm_used} == {7}


def test_limit_is_told_from_failure(spark):
    seen = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([("mute one",), ("a line",), (None,)], "text string").coalesce(1)
    out = {r.text: r.llm_reason for r in analyze(df, judge=Counting(seen, 5), explain=False).collect()}
    assert out["mute one"].endswith(FAILED) and not out["a line"].endswith((FAILED, LIMITED)) and out[None] is None
    assert analyze(df, explain=False).head().llm_reason.endswith(NO_JUDGE)
    rows = call_judge(df, "text", Counting(seen, 1)).collect()
    assert [(r.reply is None, r.limited) for r in rows] == [(True, False), (True, True), (True, False)]
    assert [r.limited for r in call_judge(df, "text", Counting(seen, 1), limit=9).collect()] == [False] * 3


def test_judges_are_switched(spark):
    s = Screening(explain=False)
    df = spark.createDataFrame([("a line",)], "text string")
    assert s.status()["attached"] is False and s.screen(df).head().llm_reason.endswith(NO_JUDGE)
    assert s.attach("openai", "k1", "m", 3) and s.status() == {"attached": True, "provider": "openai", "model": "m", "rate_limit": 3}
    with pytest.warns(UserWarning, match="taking google"):
        assert s.attach("nobody", "k2")
    assert s.judge.provider == "google" and "k2" not in str(s.status())
    s.judge = lambda prompt: '{"risk_score": 90, "verdict": "BLOCKED"}'
    assert s.screen(df).head().action == "BLOCK"
    s.clear()
    assert s.screen(df).head().action == "ALLOW"
    assert s.attach("openai", "") is False and s.judge is None


def test_judge_of_an_environment():
    assert judge_from_env(env={}) is None and judge_from_env("openai", env={"GEMINI_API_KEY": "x"}) is None
    assert judge_from_env(env={"OPENAI_API_KEY": "x", "LLM_MODEL": "m"}) == Judge("openai", "x", "m")


def test_judge_over_http(monkeypatch):
    """A stub server: the reply's text, and None for errors and odd answers."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from promptscreen.functions import patterns as P

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = body["messages"][0]["content"]
            self.send_response(500 if said == "fail" else 200)
            self.end_headers()
            self.wfile.write(b"no json" if said == "odd" else json.dumps({"choices": [{"message": {"content": said.upper()}}]}).encode())

        def log_message(self, *args):
            return

    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setitem(P.PROVIDERS, "openai", (f"http://127.0.0.1:{server.server_port}", "m", "OPENAI_API_KEY"))
    judge = Judge("openai", "k", timeout=5)
    assert [judge(p) for p in ("hello", "fail", "odd")] == ["HELLO", None, None]
    server.shutdown()


def test_model_loaders(monkeypatch):
    """None without the library; with it, models are loaded on first use and texts truncated."""
    monkeypatch.setitem(sys.modules, "transformers", None)
    monkeypatch.setitem(sys.modules, "sentence_transformers", None)
    assert injection.transformer_classifier("m") is None and semantic.sentence_embedder("m") is None
    calls = []

    def pipeline(task, model):
        calls.append((task, model))
        return lambda texts, **options: [{"label": "INJECTION", "score": options["max_length"] / 1000} for _ in texts]

    class SentenceTransformer:
        def __init__(self, path):
            calls.append(path)

        def encode(self, texts, normalize_embeddings):
            import numpy as np

            return np.ones((len(texts), 2)) * normalize_embeddings

    monkeypatch.setitem(sys.modules, "transformers", types.SimpleNamespace(pipeline=pipeline))
    monkeypatch.setitem(sys.modules, "sentence_transformers", types.SimpleNamespace(SentenceTransformer=SentenceTransformer))
    classify, embed = injection.transformer_classifier("m"), semantic.sentence_embedder("e")
    assert calls == [] and classify(["a", "b"]) == [("INJECTION", 0.512)] * 2 and embed(["a"]) == [[1.0, 1.0]]
    assert classify(["c"]) and calls == [("text-classification", "m"), "e"]
