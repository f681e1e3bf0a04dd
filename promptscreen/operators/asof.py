"""As-of join: each row takes the version that was valid at its time, of its key or of all.

Rows and versions are one table, sorted by key and time and dealt by ranges of both; in a range the last version is carried forward, and
what a range ends with comes first in the next, one version a range. So versions of one key, or of no key at all, are not one
task, and no window gathers them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written


def _carried(ends: list) -> list[tuple[int, int]]:
    """(range, the range before whose newest version it begins with). ends: rows of part, its first and last key, and the key of its newest version."""
    out, held = [], None
    for e in ends:
        if held is not None and held[0] == e["first"]:
            out.append((e.part, held[1]))
        if e.of == e["last"]:
            held = (e["last"], e.part)
        elif held is not None and not e["first"] == e["last"] == held[0]:
            held = None
    return out


def asof_join(left: DataFrame, right: DataFrame, on: list[str], ts: str, valid_from: str, order: str, out: str = "version") -> DataFrame:
    """left with out: the row of right, as a struct, of the same keys (null like any other) with the greatest valid_from up to ts; null where there is none.

    Of versions of the same time the one of the greatest order holds. A row without a time gets none, a version without a time is none's.
    Two shuffles of rows; the driver sees the keys at the ends of ranges, no versions.
    """
    right = right.where(F.col(valid_from).isNotNull())
    names = [f"__k{i}" for i in range(len(on))]
    keys = lambda df: [F.col(k).alias(n) for k, n in zip(on, names)]
    rows = left.select(*keys(left), F.unix_micros(F.col(ts).cast("timestamp")).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[order].dataType).alias("__o"), F.struct(*[F.col(c) for c in left.columns]).alias("l"))
    versions = right.select(*keys(right), F.unix_micros(F.col(valid_from).cast("timestamp")).alias("__t"), F.lit(0).alias("__side"), F.col(order).alias("__o"), F.struct(*[F.col(c) for c in right.columns]).alias("r"))
    both = rows.unionByName(versions, allowMissingColumns=True)
    by = [*names, "__t", "__side", "__o"]
    kinds = T.StructType(both.schema.fields).add("__part", T.IntegerType())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32())], names=[f.name for f in kinds])

    dealt = written(both.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(number, kinds), "asof")
    key = F.struct(*names) if on else F.struct(F.lit(0).alias("__all"))
    newest = F.max_by(F.struct(key.alias("k"), "r"), F.when(F.col("__side") == 0, F.struct(key.alias("k"), "__t", "__o")))
    ends = written(dealt.groupBy(F.col("__part").alias("part")).agg(F.min(key).alias("first"), F.max(key).alias("last"), newest.alias("v")), "asof-ends")
    moves = _carried(ends.select("part", "first", "last", F.col("v.k").alias("of")).orderBy("part").collect())  # keys only
    # What a range begins with comes as a version before its first row.
    own = dealt.select(*names, "__side", "l", "r", "__part", F.lit(1).alias("__in"), "__t", "__o")
    moved = ends.join(F.broadcast(left.sparkSession.createDataFrame(moves, "__to int, part int")), "part")
    first = moved.select(*[F.col(f"v.k.{n}").alias(n) for n in names], F.lit(0).alias("__side"), F.col("v.r").alias("r"), F.col("__to").alias("__part"), F.lit(0).alias("__in"))
    sorted_rows = own.unionByName(first, allowMissingColumns=True).repartition("__part").sortWithinPartitions("__part", "__in", *by)
    version = kinds["r"].dataType
    schema = T.StructType(left.schema.fields).add(out, version)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key = held = None
        k = len(names)
        for b in batches:
            n, r = b.num_rows, b.column(k + 2)
            parts, own = b.column(k + 3).to_pylist(), list(zip(*(b.column(i).to_pylist() for i in range(k)))) if k else [()] * n
            # Where each row's stretch of one part and key begins; place 0 is what is held from the batch before, place i + 1 row i.
            begin, at = np.empty(n, np.int64), -1
            for i, (p, o) in enumerate(zip(parts, own)):
                if p != part or o != key:
                    part, key, at = p, o, i
                begin[i] = at
            side = b.column(k).to_numpy()
            last = np.maximum.accumulate(np.where(side == 0, np.arange(n), -1))
            place = np.where(last >= np.maximum(begin, 0), last + 1, np.where(begin < 0, 0, n + 1))
            none = pa.nulls(1, r.type)
            taken = pa.concat_arrays([held if held is not None else none, r, none]).take(pa.array(place))
            held = taken.slice(n - 1, 1) if n else held
            rows = pa.array(side == 1)
            yield pa.RecordBatch.from_arrays([*(c.filter(rows) for c in b.column(k + 1).flatten()), taken.filter(rows)], names=schema.names)

    return sorted_rows.mapInArrow(carry, schema)  # a time of null sorts before all versions
