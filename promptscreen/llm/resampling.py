"""Importance resampling towards a target distribution of hashed n-grams.

A document's weight is the mean gain of its n-grams: by how much, in logarithms,
an n-gram's bucket is more frequent in the target texts than in the corpus. A seeded
Gumbel number is added, so that the highest scores are a draw without replacement
in proportion to the weights.

Gains are one array; a document's buckets are an array of places in it. The draw: how
many documents have each score is counted first (scores are whole numbers of a
bounded range, so that is a small table), which tells the lowest score that is
drawn. Of the documents that reach it each task sorts its own into runs and writes
them, cut into ranges of the order; each range is merged from its runs by a
tournament tree, which stops after the exact count and gives ranks on from those of
the ranges before. A range is of a bounded number of rows, ties included, since
the order is total; so no task merges the whole.

Order. Higher score first, ties by smaller id (null last), then by fewer features; rows equal in
all three are alike in all that is returned, but for the rank, and follow their place in the table.

Defined results. A null or empty text has no words: weight 0, and it is never drawn
where words are asked for. A null id is drawn as an empty one. Rows that repeat are
rows of their own, and draw the same number, as it hangs on the id. Without target
texts all that is frequent loses. An empty table gives no rows. Columns not named are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, materialize, small_batches

BUCKETS = 10_000
#: Rows of a sorted run, of a block of one, and of a range that one task merges.
RUN_ROWS, BLOCK_ROWS, RANGE_ROWS = 1 << 18, 4096, 1 << 16
#: Keys that reach the driver to cut the order into ranges.
SAMPLE_KEYS = 200_000

#: Bytes of words as they are, A to Z lowered; all others part words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def ngrams(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to longest consecutive words, joined by one space."""
    out = list(words)
    for n in range(2, longest + 1):
        out += map(b" ".join, zip(*(words[k:] for k in range(n))))
    return out


class Buckets(dict):
    """Bucket of a feature; short ones are remembered, up to a number of them."""

    MOST, SHORT = 500_000, 64

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        at = zlib.crc32(feature) % self.buckets
        if len(feature) <= self.SHORT:
            if len(self) >= self.MOST:
                self.clear()
            self[feature] = at
        return at

    def of(self, features: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, features), np.int64, len(features))


def bucket_counts(docs: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """How often the features of all texts fall into each bucket; each task sends one number a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0):
                total += np.bincount(known.of(ngrams(words_of(text.as_py()), longest)), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in small_batches(docs).select(F.col(text_col)).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target by that in the corpus."""
    n = len(corpus)
    s, t = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((b + 1) * s / ((a + 1) * t))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def gumbel(doc_id, seed: str) -> int:
    """Thousandths of a Gumbel number, by the seed and the id as text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, longest: int, seed: str) -> DataFrame:
    """id, n_features, weight, score, words and row (a number of its own) of each document."""
    shipped = docs.sparkSession.sparkContext.broadcast(gain)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind)] + [T.StructField(n, T.LongType()) for n in ("n_features", "weight", "score", "words", "row")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shipped.value
        known, base = Buckets(len(gain)), TaskContext.get().partitionId() << 33
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(text.as_py())
                features = ngrams(words, longest)
                weight = int(gain[known.of(features)].sum()) // len(features) if features else 0
                out.append((len(features), weight, weight + gumbel(doc_id, seed), len(words), base))
                base += 1
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in zip(*out))] if out else [b.column(0), *[pa.array([], pa.int64())] * 5], names=schema.names)

    return small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def order_key(score: int, doc_id, n_features: int, row: int) -> tuple:
    return (-score, doc_id is None, 0 if doc_id is None else doc_id, n_features, row)


END = (math.inf,)


class Tournament:
    """Sorted runs merged by a tree of losers: after each step only the winner's run plays again, up its own path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.heads = [next(r, END) for r in runs] + [END] * (self.size - len(runs))
        self.losers = [0] * self.size
        self.first = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self.heads[b] < self.heads[a]:
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        heads, losers = self.heads, self.losers
        while (top := heads[self.first]) is not END:
            yield top
            at = self.first
            heads[at] = next(self.runs[at], END)
            node = (at + self.size) >> 1
            while node:
                if heads[losers[node]] < heads[at]:
                    losers[node], at = at, losers[node]
                node >>= 1
            self.first = at

    def rest(self) -> Iterator[tuple]:
        """What has not been yielded, in no order: the first has been."""
        for i, run in enumerate(self.runs):
            if i != self.first and self.heads[i] is not END:
                yield self.heads[i]
            yield from run


def cut_score(rows: DataFrame, count: int) -> int:
    """The lowest score of the first count rows; rows per score are one number each, of a bounded range."""
    for r in sorted(rows.groupBy("score").count().collect(), reverse=True):
        count -= r["count"]
        if count <= 0:
            return r.score
    raise ValueError("more rows asked for than there are")


ROW = T.StructType([T.StructField(n, T.LongType()) for n in ("score", "n_features", "weight", "row")])


def range_bounds(top: DataFrame, total: int, range_rows: int) -> list[tuple]:
    """Keys that cut the order into ranges of about range_rows rows, by a sample of bounded size."""
    ranges = -(-total // range_rows)
    if ranges <= 1:
        return []
    keys = sorted(order_key(r.score, r.id, r.n_features, r.row) for r in bounded_sample(top.select("score", "id", "n_features", "row"), min(SAMPLE_KEYS, 100 * ranges), total, "row").collect())
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


def sorted_runs(top: DataFrame, bounds: list[tuple], run_rows: int = RUN_ROWS) -> DataFrame:
    """Rows, sorted by each task into runs of bounded size and cut at the bounds of ranges into blocks.

    range, run, block (its number in the run), n, and the block's rows as arrays.
    """
    cuts = top.sparkSession.sparkContext.broadcast(bounds)
    kind = top.schema["id"].dataType
    schema = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("block", T.LongType()), T.StructField("n", T.LongType())])
    schema = schema.add("ids", T.ArrayType(kind)).add("rows", T.ArrayType(ROW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = TaskContext.get().partitionId() << 33
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n, number
            t = pa.Table.from_batches(held).sort_by([("score", "descending"), ("id", "ascending"), ("n_features", "ascending"), ("row", "ascending")])
            keys = list(map(order_key, *(t.column(c).to_pylist() for c in ("score", "id", "n_features", "row"))))
            edges = [0, *(bisect_left(keys, b) for b in cuts.value), len(keys)]
            block = 0
            for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
                for s in range(lo, hi, BLOCK_ROWS):
                    part = t.slice(s, min(BLOCK_ROWS, hi - s)).combine_chunks()
                    flat = lambda a: a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
                    ends = pa.array([0, part.num_rows], pa.int32())
                    rows = pa.StructArray.from_arrays([flat(part.column(c)) for c in ROW.names], names=ROW.names)
                    columns = [pa.array([k], pa.int32()), *(pa.array([v], pa.int64()) for v in (number, block, part.num_rows))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, flat(part.column("id"))), pa.ListArray.from_arrays(ends, rows)], names=schema.names)
                    block += 1
            held.clear()
            n, number = 0, number + 1

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= run_rows:
                yield from flush()
        if n:
            yield from flush()

    return top.select("id", "score", "n_features", "weight", "row").mapInArrow(run, schema)


def merged(runs: DataFrame, count: int) -> DataFrame:
    """id, n_features, weight, score, rank of the rows of runs; rank is null after the first count in the order."""
    spark, before, start = runs.sparkSession, {}, 0
    for r in sorted(runs.groupBy("range").agg(F.sum("n").alias("n")).collect()):
        before[r["range"]] = start
        start += r.n
    if not before:
        before = {0: 0}
    starts = spark.sparkContext.broadcast(before)
    kind = runs.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind)] + [T.StructField(n, T.LongType()) for n in ("n_features", "weight", "score", "rank")])
    kind = T.StructType([T.StructField("id", kind)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        id_type = to_arrow_schema(kind).field(0).type
        held: dict[int, list] = {}
        at = None

        def rows_of(blocks) -> Iterator[tuple]:
            for ids, rows in blocks:
                for doc_id, r in zip(ids.as_py(), rows.as_py()):
                    yield (*order_key(r["score"], doc_id, r["n_features"], r["row"]), r["weight"])

        def flush() -> Iterator[pa.RecordBatch]:
            first = starts.value[at]
            tree, out = Tournament([rows_of(blocks) for blocks in held.values()]), []
            draws = min(count - first, sum(len(ids) for blocks in held.values() for ids, _ in blocks))
            steps = iter(tree)
            for rank in range(first + 1, first + draws + 1):
                out.append((*next(steps), rank))
            # What is left of the last range is not drawn: no more is merged.
            undrawn = tree.rest() if draws > 0 else (x for r in (tree.heads, *tree.runs) for x in r if x is not END)
            out += [(*x, None) for x in undrawn]
            held.clear()
            for lo in range(0, len(out), 20_000):
                part = out[lo : lo + 20_000]
                ids = pa.array([None if x[1] else x[2] for x in part], id_type)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in ([x[3] for x in part], [x[5] for x in part], [-x[0] for x in part], [x[6] for x in part]))], names=schema.names)

        for b in batches:
            for k, number, ids, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4), b.column(5)):
                if at is not None and k != at:
                    yield from flush()
                at = k
                held.setdefault(number, []).append((ids, rows))
        if held:
            yield from flush()

    return runs.repartition(len(before), "range").sortWithinPartitions("range", "run", "block").mapInArrow(merge, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    buckets: int = BUCKETS,
    longest: int = 1,
    seed: str = "2024",
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    range_rows: int = RANGE_ROWS,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """id_col, n_features, weight, score, rank of every document; rank is null for those not drawn.

    Of the documents with least_words or more, percent in a hundred (rounded down) are drawn.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    rows = materialize(scored(docs, gain, id_col, text_col, longest, seed), "scored")
    able = F.col("words") >= least_words
    count = percent * rows.where(able).count() // 100
    if count == 0:
        out = rows.withColumn("rank", F.lit(None).cast("long"))
    else:
        reached = able & (F.col("score") >= cut_score(rows.where(able), count))
        top = rows.where(reached)
        runs = materialize(sorted_runs(top, range_bounds(top, top.count(), range_rows), run_rows), "runs")
        rest = rows.where(~reached).withColumn("rank", F.lit(None).cast("long"))
        columns = ["id", "n_features", "weight", "score", "rank"]
        out = merged(runs, count).select(*columns).unionByName(rest.select(*columns))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op12_resampling(spark, sf_dir: str) -> DataFrame:
    """All documents towards the benchmark's texts: a tenth of those with at least 20 words."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: A list of words, and crc32, which DuckDB lacks, over the bytes of distinct words.
WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CRC_TABLE_SQL = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i)) AS tab"


def crc_sql(value: str) -> str:
    """crc32 of a text's UTF-8 bytes, given a table crc_table with tab."""
    octets = f"list_transform(range(octet_length(encode({value}))), lambda i: CAST('0x' || substr(hex(encode({value})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295))"


OP12_SQL = f"""
WITH crc_table AS MATERIALIZED ({CRC_TABLE_SQL}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS f FROM d),
bw AS (SELECT unnest({WORDS_SQL}) AS f FROM benchmark),
df AS MATERIALIZED (SELECT r, f, count(*) AS n FROM dw GROUP BY r, f),
bf AS MATERIALIZED (SELECT f, count(*) AS n FROM bw GROUP BY f),
v AS MATERIALIZED (SELECT f, {crc_sql("f")} % 10000 AS k FROM (SELECT f FROM df UNION SELECT f FROM bf) AS x, crc_table),
s AS (SELECT k, sum(n) AS n FROM df JOIN v USING (f) GROUP BY k),
t AS (SELECT k, sum(n) AS n FROM bf JOIN v USING (f) GROUP BY k),
b AS (SELECT k.k, coalesce(s.n, 0) AS s, coalesce(t.n, 0) AS t, (SELECT coalesce(sum(n), 0) FROM s) AS ss, (SELECT coalesce(sum(n), 0) FROM t) AS tt
      FROM (SELECT DISTINCT k FROM v) AS k LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
g AS (SELECT k, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM b),
w AS (SELECT r, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM df JOIN v USING (f) JOIN g USING (k) GROUP BY r),
h AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
             CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
c AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h),
p AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS place,
             count(*) FILTER (WHERE n_features >= 20) OVER () AS able FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank FROM p
"""
