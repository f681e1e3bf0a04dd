"""Screening of streams: the stateless transforms as they are, and the limiter with state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.gate import audit_rows
from ..operators.ratelimit import decide
from ..plans.analyze import screen


def screen_stream(stream: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """A stream of texts, screened: no state, so any output mode will do."""
    return screen(stream, text_col, **options)


def audit_stream(decided: DataFrame, path: str, checkpoint: str, text_col: str = "text", snippets: str = "mask"):
    """Appends audit records of a stream as JSON lines, each once."""
    return audit_rows(decided, text_col, snippets).writeStream.format("json").option("ignoreNullFields", "false").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


#: Requests that are packed at once, and that a key's call holds before they go to its state.
PACKED = HELD = 250_000
#: Requests of a key and slice together: their times and ids as 64-bit numbers one behind the other. Those without a time are in no slice.
PACKS = "key string, timed boolean, slice bigint, ts binary, ids binary"


def numbers(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.int64)


def pack(rows: pa.Table, micros: int) -> pa.RecordBatch:
    """PACKS of rows of key, id, t, for slices of so many microseconds."""
    key, ids, t = (rows.column(c).combine_chunks() for c in ("key", "id", "t"))
    keys = key.dictionary_encode("encode")
    codes, timed = keys.indices.to_numpy(), t.is_valid().to_numpy(zero_copy_only=False)
    t = t.fill_null(0).to_numpy()
    k = t // micros
    order = np.lexsort((k, timed, codes))
    codes, timed, k = codes[order], timed[order], k[order]
    first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (timed[1:] != timed[:-1]) | (k[1:] != k[:-1])]))
    ends = pa.py_buffer((8 * np.append(first, len(order))).astype(np.int32))
    packed = [pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(x[order])]) for x in (t, ids.to_numpy())]
    return pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(codes[first])), pa.array(timed[first]), pa.array(k[first]), *packed], names=["key", "timed", "slice", "ts", "ids"])


class Limiter(StatefulProcessor):
    """A key's requests wait in slices of time until the watermark has passed their slice, and are then decided in the order of their times.

    Rows are PACKS. State of a key: the parts of each slice that waits, each written once and read once, and how many they are; and the times admitted
    in the last window before the slices decided. A timer at each
    slice's end decides it; another, a window after the last admitted time, forgets what is left. So a key
    that is silent keeps no state. Requests older than the watermark are late: their slice may have been decided, so they are
    denied, told as late, and count for nobody.
    """

    def __init__(self, limit: int, seconds: float, slice_seconds: float):
        self.limit, self.window, self.size = limit, int(seconds * 1_000_000), int(slice_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "times array<bigint>")
        self.slices = handle.getMapState("slices", "slice bigint", "parts int")
        self.waiting = handle.getMapState("waiting", "slice bigint, part int", "ts binary, ids binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - the names Spark calls
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        wait: dict[int, list[tuple[bytes, bytes]]] = {}
        timeless: list[bytes] = []
        late: list[bytes] = []
        n = 0
        for frame in rows:
            for timed, k, ts, ids in zip(frame["timed"].tolist(), frame["slice"].tolist(), frame["ts"], frame["ids"]):
                if not timed:
                    timeless.append(ids)
                elif k * self.size * 1000 >= watermark:
                    wait.setdefault(k, []).append((ts, ids))
                else:
                    t, own = numbers([ts]), numbers([ids])
                    behind = t < watermark
                    late.append(own[behind].tobytes())
                    if not behind.all():
                        wait.setdefault(k, []).append((t[~behind].tobytes(), own[~behind].tobytes()))
                n += len(ids) // 8
                if n >= HELD:
                    yield from self._kept(key, wait, timeless, late)
                    wait, timeless, late, n = {}, [], [], 0
        yield from self._kept(key, wait, timeless, late)

    def _kept(self, key, wait, timeless, late) -> Iterator[pd.DataFrame]:
        """Puts what waits into the state, a part for each slice; decides the others at once."""
        for ids, admitted in ((numbers(timeless), True), (numbers(late), False)):
            if len(ids):
                yield self._out(key, ids, admitted, 0, not admitted)
        for k, some in wait.items():
            part = 0
            if self.slices.containsKey((k,)):
                part = self.slices.getValue((k,))[0]
            else:
                self.handle.registerTimer((k + 1) * self.size)
            self.waiting.updateValue((k, part), (b"".join(ts for ts, _ in some), b"".join(ids for _, ids in some)))
            self.slices.updateValue((k,), (part + 1,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - the names Spark calls
        now = expiredTimerInfo.getExpiryTimeInMs()
        # Whatever the order of timers, slices are decided in theirs.
        due = sorted(k for (k,) in self.slices.keys() if (k + 1) * self.size <= now)
        held = deque(self.held.get()[0] if self.held.exists() else [])
        for k in due:
            own = [(k, part) for part in range(self.slices.getValue((k,))[0])]
            ts, ids = map(numbers, zip(*map(self.waiting.getValue, own)))
            order = np.lexsort((ids, ts))
            got = decide(ts[order].tolist(), self.limit, self.window, held)
            for part in own:
                self.waiting.removeKey(part)
            self.slices.removeKey((k,))
            yield self._out(key, ids[order], [a for a, _ in got], [u for _, u in got], False)
        # What comes next is of the slice that now is in, or of later ones.
        while held and now // self.size * self.size * 1000 - held[0] > self.window:
            held.popleft()
        if held:
            self.held.update((list(held),))
            self.handle.registerTimer(((held[-1] + self.window) // 1000 // self.size + 1) * self.size)
        else:
            self.held.clear()

    @staticmethod
    def _out(key, ids, admitted, used, late) -> pd.DataFrame:
        out = pd.DataFrame({"key": key[0], "id": ids, "admitted": admitted, "used": used, "late": late})
        return out.astype({"id": "int64", "admitted": "bool", "used": "int32", "late": "bool"})

    def close(self) -> None:
        pass


#: Rows of a limiter of streams.
LIMITED = "key string, id long, admitted boolean, used int, late boolean"


def admit_stream(stream: DataFrame, key_col: str, ts_col: str, id_col: str, limit: int, seconds: float, delay: str = "10 minutes", slice_seconds: float = 60) -> DataFrame:
    """key, id, admitted, used, late of a stream of requests, each once, when the watermark (delay behind the latest time) has passed its slice.

    In whatever order requests come within the delay, they are decided as the batch form does. Needs the RocksDB state store.
    """
    rows = stream.withWatermark(ts_col, delay).select(F.col(key_col).cast("string").alias("key"), F.col(id_col).cast("long").alias("id"), F.unix_micros(F.col(ts_col).cast("timestamp")).alias("t"))
    micros = int(slice_seconds * 1000) * 1000

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PACKED:
                yield pack(pa.Table.from_batches(held), micros)
                held, n = [], 0
        if n:
            yield pack(pa.Table.from_batches(held), micros)

    return rows.mapInArrow(packed, PACKS).groupBy("key").transformWithStateInPandas(Limiter(limit, seconds, slice_seconds), LIMITED, "append", "EventTime")


def audit_once(decided: DataFrame, path: str, checkpoint: str, ts_col: str, delay: str, text_col: str = "text", snippets: str = "mask"):
    """Audit records of a stream, each payload once within the delay, however often it comes and however often a batch is replayed.

    Payloads are told apart by their digest, in state that goes as the watermark passes. Each batch has a folder of its own by its number, which a
    replay of that batch writes anew: so a query that died between writing and noting it leaves nothing twice, and half a batch is not kept.
    """
    rows = decided.withWatermark(ts_col, delay)
    once = rows.withColumn("payload_sha256", F.sha2(F.col(text_col), 256)).dropDuplicatesWithinWatermark(["payload_sha256"]).drop("payload_sha256")

    def write(batch: DataFrame, number: int) -> None:
        audit_rows(batch, text_col, snippets).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")


def read_audit(spark, path: str, schema: str) -> DataFrame:
    """Records that audit_once has written, in whatever batches."""
    return spark.read.schema(schema).json(f"{path}/batch=*")
