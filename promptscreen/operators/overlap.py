"""Join of spans that overlap: found spans against marked ones, detector against detector.

Spans are half-open and belong to a text by key columns. Each goes to the bins of its text that it touches, and the spans of a bin
are swept in the order of their starts, with those of either side that have not ended at hand; so a text of very many
spans is spread over tasks, and what does not overlap is never compared. Bins come in levels, 16 times as wide
each: a span is at home where it touches two bins at most, however long, and visits the levels above,
as far as there are spans so long. A pair is made in the bin in which the later of the two begins.

Empty spans, and those with a null key, start or end, overlap nothing. Rows that repeat are rows of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written

#: Width of the narrowest bins in code points, and how much wider those of the next level are.
WIDTH, STEP = 1024, 16


def _levels(rows: DataFrame, width: int) -> DataFrame:
    """Rows (__s, __e), once for each bin that they touch: __level, __bin, and __home, whether the level is their own."""
    longest = rows.agg(F.max(F.col("__e") - F.col("__s"))).head()[0] or 0
    edges = [width]
    while edges[-1] < longest:
        edges.append(edges[-1] * STEP)
    own = sum((F.col("__e") - F.col("__s") > w).cast("int") for w in edges)
    size = F.element_at(F.array(*[F.lit(w).cast("long") for w in edges]), F.col("__level") + 1)
    each = rows.withColumn("__own", own).withColumn("__level", F.explode(F.sequence(F.col("__own"), F.lit(len(edges) - 1))))
    each = each.withColumn("__width", size)
    return each.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__s") / F.col("__width")), F.floor((F.col("__e") - 1) / F.col("__width"))))).withColumn("__home", F.col("__own") == F.col("__level"))


def _sides(left: DataFrame, right: DataFrame, on: list[str], start: str, end: str) -> DataFrame:
    """Spans of both sides that can overlap any: keys, __side, __s, __e, and left or right, the row as it was."""
    out = []
    for side, df in enumerate((left, right)):
        row = F.struct(*[F.col(c) for c in df.columns])
        rows = df.select(*on, F.lit(side).alias("__side"), F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__e"), row.alias("left" if side == 0 else "right"))
        out.append(rows.where(" AND ".join(["__s < __e", *[f"`{k}` IS NOT NULL" for k in on]])))
    return out[0].unionByName(out[1], allowMissingColumns=True)


#: What the sweep reads of a row, after the keys.
ROW = ["__level", "__bin", "__width", "__home", "__side", "__s", "__e"]


def _new_bins(columns: list[pa.Array]) -> np.ndarray:
    """For each row but the first whether it is of another text, level or bin than the row before."""
    out = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        out |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


class Sweep:
    """The spans of a bin in the order of their starts, batch by batch. Rows are known by their place in the pool: the rows of the batch
    before that have not ended, as they were, and those of the batch. So what rows hold is never made into Python objects."""

    def __init__(self, keys: int) -> None:
        self.keys, self.pool, self.last = keys, None, None
        self.live: tuple[dict, dict] = ({}, {})  # number to (home, place)
        self.ends: tuple[list, list] = ([], [])
        self.n = 0

    def meetings(self, b: pa.RecordBatch) -> Iterator[tuple]:
        """(side, later row, rows of the other side that it begins in): rows are (home, place). Only where the later begins in the bin."""
        if not b.num_rows:
            return
        at, kept = self.keys + 2, 0
        rows = pa.Table.from_batches([b])
        if self.pool is not None:
            held = [(side, n, home, place) for side in (0, 1) for n, (home, place) in self.live[side].items()]
            for i, (side, n, home, _) in enumerate(held):
                self.live[side][n] = (home, i)
            kept = len(held)
            rows = pa.concat_tables([self.pool.take(pa.array([x[3] for x in held], pa.int64())), rows])
        self.pool = rows.combine_chunks()
        first = tuple(b.column(i)[0].as_py() for i in range(at))
        new = [first != self.last, *_new_bins(b.columns[:at]).tolist()]
        self.last = tuple(b.column(i)[b.num_rows - 1].as_py() for i in range(at))
        place = b.column(self.keys + 1).to_pylist()
        width, home, side, start, end = (b.column(self.keys + i).to_pylist() for i in range(2, 7))
        live, ends = self.live, self.ends
        for i, s in enumerate(start):
            if new[i]:
                for k in (0, 1):
                    live[k].clear()
                    ends[k].clear()
            mine, other = side[i], 1 - side[i]
            while ends[other] and ends[other][0][0] <= s:
                live[other].pop(heapq.heappop(ends[other])[1], None)
            own = (home[i], kept + i)
            if live[other] and s // width[i] == place[i]:
                yield mine, own, live[other]
            self.n += 1
            live[mine][self.n] = own
            heapq.heappush(ends[mine], (end[i], self.n))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], start: str = "start", end: str = "end", width: int = WIDTH) -> DataFrame:
    """Each pair of overlapping spans of the same keys once: the keys, and left and right, the two rows as structs."""
    binned = _levels(_sides(left, right, on, start, end), width)
    schema = T.StructType([*[binned.schema[k] for k in on], binned.schema["left"], binned.schema["right"]])
    at = len(on) + len(ROW)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, state = to_arrow_schema(schema), Sweep(len(on))

        def made(pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            a, z = (pa.array(x, pa.int64()) for x in zip(*pairs))
            columns = [*[state.pool.column(i).take(a) for i in range(len(on))], state.pool.column(at).take(a), state.pool.column(at + 1).take(z)]
            yield from pa.table([c.cast(f.type) for c, f in zip(columns, kinds)], names=kinds.names).to_batches()

        for b in batches:
            pairs: list[tuple[int, int]] = []
            for side, (home, own), others in state.meetings(b):
                for other_home, other in others.values():
                    if home or other_home:  # two visitors meet at a level below
                        pairs.append((own, other) if side == 0 else (other, own))
                        if len(pairs) >= 10_000:
                            yield from made(pairs)
                            pairs = []
            if pairs:
                yield from made(pairs)

    dealt = binned.select(*on, *ROW, "left", "right").repartition(*on, "__level", "__bin").sortWithinPartitions(*on, "__level", "__bin", "__s", "__e")
    return dealt.mapInArrow(sweep, schema)


def overlap_hits(left: DataFrame, right: DataFrame, on: list[str], start: str = "start", end: str = "end", width: int = WIDTH) -> DataFrame:
    """left with hit: whether it overlaps any span of right. No pairs are made: a span is told once in each bin, so many spans at one place cost no more than their number."""
    numbered = written(left.withColumn("__id", F.monotonically_increasing_id()), "spans")
    only = right.select(*on, start, end)
    binned = _levels(_sides(numbered.select(*on, start, end, "__id"), only, on, start, end).select(*on, "__side", "__s", "__e", F.col("left.__id").alias("__id")), width)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at = Sweep(len(on)), len(on) + len(ROW)
        for b in batches:
            found: list[int] = []
            for side, (home, own), others in state.meetings(b):
                if side == 0:
                    # Any at home will do, or any at all for one at home.
                    if home or any(h for h, _ in others.values()):
                        found.append(own)
                else:
                    hit = [k for k, (h, i) in others.items() if h or home]
                    found += [others[k][1] for k in hit]
                    for k in hit:
                        del others[k]  # told: it need not be met again here
            if found:
                ids = state.pool.column(at).take(pa.array(found, pa.int64())).combine_chunks()
                yield from pa.table([ids], names=["__id"]).to_batches()

    dealt = binned.select(*on, *ROW, "__id").repartition(*on, "__level", "__bin").sortWithinPartitions(*on, "__level", "__bin", "__s", "__e")
    ids = dealt.mapInArrow(sweep, "__id bigint").distinct().withColumn("hit", F.lit(True))
    return numbered.join(ids, "__id", "left").withColumn("hit", F.coalesce("hit", F.lit(False))).drop("__id")


def overlap_quality(found: DataFrame, marked: DataFrame, on: list[str], by: str, start: str = "start", end: str = "end") -> DataFrame:
    """A row for each kind (by) of found spans, and one of null for all: found, found_hit, precision, marked, marked_hit, recall.

    A found span is right if it overlaps any mark; a mark is recalled if a found span (of the kind) overlaps it.
    """
    right = overlap_hits(found, marked, on, start, end).rollup(by).agg(F.count(F.lit(1)).alias("found"), F.count_if("hit").alias("found_hit"))
    pairs = overlap_join(marked.withColumn("__m", F.monotonically_increasing_id()), found, on, start, end)
    recalled = pairs.select("left.__m", F.col(f"right.{by}").alias(by)).distinct().rollup(by).agg(F.count_distinct("__m").alias("marked_hit"))
    both = right.withColumnRenamed(by, "__by").join(recalled, F.col("__by").eqNullSafe(F.col(by)), "left").drop(by).withColumnRenamed("__by", by)
    n = marked.agg(F.count(F.lit(1)).alias("marked"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    rows = both.join(F.broadcast(n)).withColumn("marked_hit", F.coalesce("marked_hit", F.lit(0)))
    return rows.select(by, "found", "found_hit", share("found_hit", "found").alias("precision"), "marked", "marked_hit", share("marked_hit", "marked").alias("recall"))
