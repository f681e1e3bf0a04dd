"""Sliding admission control: at most limit admitted requests of a key in any window; those denied do not count.

Whether a request is admitted hangs on those admitted before it, so a key looks like one long walk. It is cut all
the same. What a stretch of requests does to the limiter's state, the last admitted times, is a function of that
state that can be told without knowing it: the limiter that starts from several admitted requests admits its
k-th request where the latest of the limiters does that start from one of them each. So the stretch is walked once for all
requests at which a limiter may start, and what is kept is, for each number of admitted requests, the latest start that
still reaches it (transfer). These functions are composed in the order of the stretches, which gives each its state;
then all are decided side by side.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written

#: A stretch is described to the driver by so many rows of limit + 2 numbers at most; and worked out in so many numbers.
MOST_ROWS, MOST_CELLS = 1024, 1 << 25
#: Requests of a stretch, about. A stretch is held by a Python worker, so its memory hangs on this, not on the table.
PART_ROWS = 250_000
NEVER = np.iinfo(np.int64).min


def decide(times: list[int], limit: int, window: int, held: deque) -> list[tuple[bool, int]]:
    """(admitted, requests then in the window) of sorted times; held carries the admitted times of the window. From a full window it jumps to the next request after it."""
    out: list[tuple[bool, int]] = []
    while (i := len(out)) < len(times):
        t = times[i]
        while held and t - held[0] > window:
            held.popleft()
        if len(held) < limit:
            held.append(t)
            out.append((True, len(held)))
        else:
            out += [(False, len(held))] * ((bisect_right(times, held[0] + window, i) if held else len(times)) - i)
    return out


def walk(times: list[int], limit: int, window: int, held: list[int]) -> list[int]:
    """The admitted times of the last window after sorted times, from those before: from a full window it jumps to the next request after it."""
    state, i = deque(held), 0
    while i < len(times) and limit > 0:
        while state and times[i] - state[0] > window:
            state.popleft()
        if len(state) < limit:
            state.append(times[i])
            i += 1
        else:
            i = bisect_right(times, state[0] + window, i)
    while state and times and times[-1] - state[0] > window:
        state.popleft()
    return list(state)


def synced(t: np.ndarray, limit: int, window: int) -> tuple[int, list[int]] | None:
    """The last place in sorted times where the state is known whatever was before them, and that state.

    That is after a pause longer than the window, or after limit requests in a row that were surely admitted,
    because fewer than limit others, admitted or not, are in the window of each.
    """
    if limit <= 0:
        return len(t), []
    place, held = (int(p[-1]) + 1, []) if len(p := np.flatnonzero(np.diff(t) > window)) else (-1, [])
    sure = np.zeros(len(t) + 1, np.int64)
    sure[limit + 1 :] = np.cumsum(t[limit:] - t[:-limit] > window) if len(t) > limit else 0
    if len(t) >= limit:
        rows = np.flatnonzero(sure[limit:] - sure[:-limit] == limit)
        if len(rows) and rows[-1] + limit > place:
            place = int(rows[-1]) + limit
            held = t[place - limit : place].tolist()
    return (place, held) if place >= 0 else None


@dataclass
class Transfer:
    """What a stretch does to any state: at each kept request, how many all starts have admitted, and the times of the latest starts that have one more, and so on."""

    first: int  # of the window that ends the stretch
    at: np.ndarray
    base: np.ndarray
    starts: np.ndarray

    def __call__(self, state: list[int], limit: int, window: int) -> list[int]:
        """The state after the stretch."""
        slots = np.full(limit, NEVER)
        slots[limit - len(state) :] = np.array(state, np.int64) + window if state else []
        more = (self.starts[:, None, :] > slots[None, :, None]).sum(axis=2)
        top = (self.starts > NEVER).sum(axis=1)
        admitted = self.base + np.minimum(top, (more + np.arange(limit)).min(axis=1))
        new = self.at[1:][np.diff(admitted) > 0].tolist()
        return ([s for s in state if s >= self.first] + new)[-limit:]


def transfer(t: np.ndarray, limit: int, window: int, most: int = MOST_ROWS) -> Transfer | None:
    """The Transfer of sorted times, none of them before the state's; None if it would need more than most rows.

    V[y] holds, for the next limit numbers of admitted requests above base[y], the latest start of a limiter that has
    admitted as many of the first y requests. A request is admitted if one less was before it and no more than limit since its
    window began: both are shifts of earlier rows, of which the lesser starts hold.
    """
    n = len(t)
    reach = min(int(np.searchsorted(t, t[0] + window, "right")), n)  # starts after the first window make no difference
    if (n - reach) * limit > MOST_CELLS:
        return None
    since = np.searchsorted(t, t - window, "left").tolist()
    begin = since[-1]
    # In the first window a limiter admits from its start on, one by one: V[y] = y - 1, y - 2, ...
    down = np.concatenate([np.arange(reach - 1, -1, -1), np.full(limit + 1, -1)]).astype(np.int64)
    V, base = np.full((n - reach + 1, limit), -1, np.int64), [0] * (n - reach + 1)
    V[0] = down[:limit]
    last, old = np.full((2, 3 * limit + 2), -1, np.int64)
    last[: limit + 1] = old[: limit + 1] = reach
    mine = slice(limit + 1, 2 * limit + 1)
    for k in range(1, n - reach + 1):
        g = since[reach + k - 1]
        before, bottom = base[k - 1], base[g - reach] if g > reach else 0
        last[mine] = V[k - 1]
        old[mine] = V[g - reach] if g > reach else down[reach - g : reach - g + limit]
        base[k] = b = min(before + 1, bottom + limit)
        np.minimum(last[limit + b - before : 2 * limit + b - before], old[1 + b - bottom : 1 + b - bottom + limit], out=V[k])
    ys = np.arange(begin, n + 1)
    early = ys[ys < reach]
    rows = np.concatenate([down[(reach - early)[:, None] + np.arange(limit)], V[max(0, begin - reach) :]])
    bases = np.concatenate([np.zeros(len(early), np.int64), np.array(base[max(0, begin - reach) :])])
    keep = np.concatenate([[True], (np.diff(bases) > 0) | (rows[1:] != rows[:-1]).any(axis=1)])
    if keep.sum() > most:
        return None
    return Transfer(int(t[-1]) - window, t[np.maximum(ys[keep] - 1, 0)], bases[keep], np.where(rows[keep] >= 0, t[np.maximum(rows[keep], 0)], NEVER))


def _same(a, b) -> bool:
    return a == b or a is None and b is None or a != a and b != b


def _stretches(parts, keys, times) -> Iterator[tuple]:
    """(part, key, times) of each stretch of rows of one part and key; times that are null come first."""
    at, times = 0, times.to_pylist()
    for (p, k), rows in groupby(zip(parts.to_pylist(), keys.to_pylist())):
        n = sum(1 for _ in rows)
        yield p, k, times[at : at + n]
        at += n


#: What is told of a stretch: the state after it, where it is known by itself; else a Transfer, where one is small; else neither.
TOLD = "part int, known array<bigint>, first bigint, at array<bigint>, base array<bigint>, starts array<bigint>"


def _told(rows: DataFrame, through: dict[int, bool], limit: int, window: int) -> dict[int, tuple]:
    """What the last key of each part named does to the state; through: whether that key came from the part before."""
    few = rows.sparkSession.createDataFrame([(p,) for p in through], "__part int")
    dealt = rows.join(F.broadcast(few), "__part").repartition("__part").sortWithinPartitions("__part", "__k", "__t")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, held = None, None, []

        def one() -> pa.RecordBatch:
            t = np.array(held, np.int64)
            known, f = [], None
            if through[part]:
                if (s := synced(t, limit, window)) is not None:
                    known = walk(held[s[0] :], limit, window, s[1])
                else:
                    known, f = None, transfer(t, limit, window)
            else:
                known = walk(held, limit, window, [])
            row = [part, known, *((f.first, f.at.tolist(), f.base.tolist(), f.starts.ravel().tolist()) if f else (None,) * 4)]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if i == 0 else pa.int64() if i == 2 else pa.list_(pa.int64())) for i, x in enumerate(row)], names=["part", "known", "first", "at", "base", "starts"])

        for b in batches:
            for p, k, times in _stretches(b.column(0), b.column(1), b.column(2)):
                if p != part:
                    if part is not None and held:
                        yield one()
                    part, key, held = p, k, []
                elif not _same(k, key):
                    key, held = k, []
                held += times[times.count(None) :]
        if part is not None and held:
            yield one()

    out = {}
    for r in dealt.select("__part", "__k", "__t").mapInArrow(tell, TOLD).collect():
        f = None if r.at is None else Transfer(r.first, np.array(r.at), np.array(r.base), np.array(r.starts, np.int64).reshape(len(r.at), limit))
        out[r.part] = (r.known, f)
    return out


def _walked(rows: DataFrame, part: int, key, limit: int, window: int, state: list[int]) -> list[int]:
    """The state after one part, from that before: a task that reads this part's times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = [t for b in batches for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(walk(times, limit, window, state), pa.int64())], names=["t"])

    own = rows.where((F.col("__part") == part) & F.col("__k").eqNullSafe(F.lit(key)) & F.col("__t").isNotNull())
    return sorted(r.t for r in own.select("__t").repartition(1).sortWithinPartitions("__t").mapInArrow(run, "t bigint").collect())


def _states(numbered: DataFrame, limit: int, window: int) -> dict[int, list[int]]:
    """The state at the beginning of each part that goes on with the last key of the part before."""
    rows = numbered.select("__part", "__k", "__t")
    at = F.struct("__k", "__t")
    ends = rows.groupBy("__part").agg(F.min(at).alias("a"), F.max(at).alias("z")).orderBy("__part").collect()  # two rows for each range
    goes_on = [False] + [_same(a.z["__k"], b.a["__k"]) for a, b in zip(ends, ends[1:])]
    through = {e["__part"]: on and _same(e.a["__k"], e.z["__k"]) for e, on, after in zip(ends, goes_on, goes_on[1:] + [False]) if after}
    if not through:
        return {}
    told, states, state = _told(rows, through, limit, window), {}, []
    for e, on in zip(ends, goes_on):
        part = e["__part"]
        if on:
            states[part] = state
        if part in through:
            known, f = told.get(part, (None if through[part] else [], None))
            if known is None and part in told:
                known = f(state, limit, window) if f else _walked(rows, part, e.z["__k"], limit, window, state)
            state = state if known is None else known  # a part without times changes nothing
    return {p: s for p, s in states.items() if s}


def admit(df: DataFrame, key_col: str, ts_col: str, order_col: str, limit: int, seconds: float) -> DataFrame:
    """Adds admitted and used.

    Requests are dealt by ranges of (key, time), so that a key of any size is spread over tasks, and no step gathers it. A range that begins with the
    key of the range before needs that one's last state: after a pause longer than the window, or requests too few to fill one, it is known from the
    range alone; else the range's Transfer is told to the driver, where these are composed; a range whose Transfer is large (few windows, of
    very many requests) is walked by a task of its own, which jumps from one full window to the next.
    A request without a time is admitted, and counts for nobody.
    """
    window = int(seconds * 1_000_000)
    own = [F.col(key_col), F.col("__t"), F.col(order_col)]
    timed = df.withColumn("__t", F.unix_micros(F.col(ts_col).cast("timestamp")))
    kinds = T.StructType(timed.schema.fields).add("__part", T.IntegerType())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32())], names=[f.name for f in kinds])

    parts = -(-df.count() // PART_ROWS)
    dealt = timed.repartitionByRange(*own) if parts <= 1 else timed.repartitionByRange(max(parts, df.sparkSession.sparkContext.defaultParallelism), *own)
    numbered = written(dealt.sortWithinPartitions(*own).mapInArrow(number, kinds), "requests").withColumn("__k", F.col(key_col))
    states = _states(numbered, limit, window)
    columns = [*df.columns, "__t", "__part", "__k"]
    schema = T.StructType(df.schema.fields).add("admitted", T.BooleanType()).add("used", T.IntegerType())
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque = deque()
        part = key = None
        for b in batches:
            got = []
            for p, k, times in _stretches(b.column(b.num_columns - 2), b.column(b.num_columns - 1), b.column(b.num_columns - 3)):
                if p != part:
                    held = deque(states.get(p, ()))
                elif not _same(k, key):
                    held = deque()
                part, key, timeless = p, k, times.count(None)
                got += [(True, 0)] * timeless
                got += decide(times[timeless:], limit, window, held)
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array([a for a, _ in got], pa.bool_()), pa.array([u for _, u in got], pa.int32())], names=names)

    dealt = numbered.select(*columns).repartition("__part").sortWithinPartitions("__part", "__k", "__t", order_col)
    return dealt.mapInArrow(run, schema)


def status(used, limit: int, provider: str = "", model: str = ""):
    """What a limiter reports of itself, as a struct column."""
    return F.struct(
        used.alias("requests_used"), (F.lit(limit) - used).alias("requests_remaining"), F.lit(limit).alias("rate_limit"),
        (used < limit).alias("available"), F.lit(provider).alias("provider"), F.lit(model).alias("model"),
    )
