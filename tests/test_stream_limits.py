"""The limiter of streams: requests in any order within the watermark, late ones, and state that goes."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from promptscreen.operators.ratelimit import admit
from promptscreen.streaming.screening import admit_stream


def replay(spark, folder, batches, limit, seconds, delay, slice_seconds):
    """Rows of the stream of batches (lists of id, key, second), one micro-batch each, and the state's rows after each."""
    schema = "id long, k string, ts timestamp"
    for rows in batches:
        frame = spark.createDataFrame(rows, "id long, k string, s long").select("id", "k", F.timestamp_seconds("s").alias("ts"))
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = admit_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), "k", "ts", "id", limit, seconds, delay, slice_seconds)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/ck").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    state = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress]
    return spark.read.parquet(f"{folder}/out").collect(), state


@pytest.fixture(autouse=True)
def few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shuffled_batches_are_decided_as_the_batch_form_does(spark, tmp_path):
    """Requests come up to 90 s late; a request far ahead lets all that wait be decided, and then the state goes."""
    rng = random.Random(3)
    rows = [(i, rng.choice("aab"), rng.randrange(600)) for i in range(400)]
    order = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 90))
    batches = [order[i : i + 100] for i in range(0, 400, 100)] + [[(1000, "tick", 5000)], [(1001, "tick", 9000)]]
    got, state = replay(spark, tmp_path, batches, 5, 60, "90 seconds", 20)
    want = {r.id: r.admitted for r in admit(spark.createDataFrame(rows, "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s")), "k", "ts", "id", 5, 60).collect()}
    assert {r.id: r.admitted for r in got if r.id < 1000} == want
    assert len(got) == 401 and not any(r.late for r in got)  # each once; the last tick waits
    assert max(state) > 20 and state[-1] < 10


def test_late_requests(spark, tmp_path):
    """What comes behind the watermark is denied, told as late, and counts for nobody; a request without a time is admitted."""
    batches = [[(1, "x", 100), (2, "x", 101), (3, "y", None)], [(4, "x", 400)], [(5, "x", 90), (6, "x", 102), (7, "x", 401)], [(8, "tick", 9000)], [(9, "tick", 9001)]]
    got, _ = replay(spark, tmp_path, batches, 2, 60, "10 seconds", 10)
    seen = {r.id: (r.admitted, r.late) for r in got}
    assert seen == {1: (True, False), 2: (True, False), 3: (True, False), 4: (True, False), 5: (False, True), 6: (False, True), 7: (True, False)}


def test_sliding_window_by_event_time(spark, tmp_path):
    seconds, want = [0, 10, 20, 60, 61, 70, 71], [True, True, False, False, True, False, True]
    rows = [(i, "x", s) for i, s in enumerate(seconds)]
    got, _ = replay(spark, tmp_path, [rows[:3][::-1], rows[3:][::-1], [(50, "t", 9000)], [(51, "t", 9001)]], 2, 60, "200 seconds", 7)
    assert [r.admitted for r in sorted(got, key=lambda r: r.id)] == want


def test_frames_are_never_joined():
    """A key's rows of a batch are taken frame by frame into slices."""
    import inspect

    from promptscreen.streaming.screening import Limiter

    assert "concat" not in inspect.getsource(Limiter) and pd.DataFrame is not None


class Memory:
    """A state of one key in memory, which counts the requests written to it."""

    def __init__(self):
        self.kept, self.timers, self.written = {}, [], 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def getMapState(self, name, key_schema, schema):  # noqa: N802
        own = Memory()
        self.kept[name] = own
        return own

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def exists(self):
        return False

    def clear(self):
        pass

    def update(self, value):
        pass

    def containsKey(self, key):  # noqa: N802
        return key in self.kept

    def getValue(self, key):  # noqa: N802
        return self.kept[key]

    def updateValue(self, key, value):  # noqa: N802
        self.kept[key] = value
        self.written += len(value[-1]) // 8 if isinstance(value[-1], bytes) else 0

    def removeKey(self, key):  # noqa: N802
        del self.kept[key]

    def keys(self):
        return list(self.kept)


def test_requests_are_written_to_the_state_once(monkeypatch):
    """However many frames and calls a slice comes in, each request goes to the state once; before, each frame wrote all of its slice anew."""
    from types import SimpleNamespace

    import pyarrow as pa

    from promptscreen.streaming import screening

    monkeypatch.setattr(screening, "HELD", 700)
    rng = random.Random(5)
    rows = [(i, rng.randrange(10**9)) for i in range(20_000)]
    limiter, handle = screening.Limiter(40, 60, 100), Memory()
    limiter.init(handle)
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    out = []
    for lo in range(0, 20_000, 2000):
        tables = [pa.table({"key": ["k"] * 100, "id": [i for i, _ in some], "t": [t for _, t in some]}) for some in (rows[at : at + 100] for at in range(lo, lo + 2000, 100))]
        out += limiter.handleInputRows(("k",), iter([screening.pack(t, 10**8).to_pandas() for t in tables]), now)
    assert not out and limiter.waiting.written == 20_000
    assert len(handle.timers) == 10 and len(limiter.waiting.kept) <= 10 * (20_000 // 700 + 10)
    at = max(handle.timers)
    got = pd.concat(limiter.handleExpiredTimer(("k",), now, SimpleNamespace(getExpiryTimeInMs=lambda: at)))
    rows.sort(key=lambda r: (r[1], r[0]))
    held, want = [], []
    for _, t in rows:
        held = [x for x in held if t - x <= 60_000_000]
        want.append(len(held) < 40)
        held += [t] * want[-1]
    assert got["id"].tolist() == [i for i, _ in rows] and got["admitted"].tolist() == want
    assert not limiter.waiting.kept and not limiter.slices.kept


def test_packs():
    """Every request is in one pack, with its key, its slice or none, and its own time; null keys and times before 1970 too."""
    import pyarrow as pa

    from promptscreen.streaming.screening import numbers, pack

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None, ""]), i, rng.choice([None, rng.randrange(-500, 500)])) for i in range(1000)]
    got = []
    packs = pack(pa.table({"key": pa.array([r[0] for r in rows], pa.string()), "id": [r[1] for r in rows], "t": pa.array([r[2] for r in rows], pa.int64())}), 100).to_pylist()
    for p in packs:
        for t, i in zip(numbers([p["ts"]]).tolist(), numbers([p["ids"]]).tolist()):
            got.append((p["key"], i, t if p["timed"] else None))
            assert not p["timed"] or p["slice"] == t // 100
    assert sorted(got, key=lambda r: r[1]) == rows
    assert len(packs) == len({(p["key"], p["timed"], p["slice"]) for p in packs}) <= 4 * 11


@pytest.mark.parametrize("limit", [0, 1, 3, 50])
def test_decide_is_the_plain_walk(limit):
    from collections import deque

    from promptscreen.operators.ratelimit import decide

    rng = random.Random(limit)
    for n in (0, 1, 5, 400):
        times, held, plain, want = sorted(rng.randrange(300) for _ in range(n)), deque(), [], []
        for t in times:
            plain = [x for x in plain if t - x <= 20]
            ok = len(plain) < limit
            plain += [t] * ok
            want.append((ok, len(plain)))
        cut = n // 3
        assert decide(times[:cut], limit, 20, held) + decide(times[cut:], limit, 20, held) == want
