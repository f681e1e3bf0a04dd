"""Maximal periodic runs of words, by divide and conquer over interned word ids.

A run is a stretch of words of smallest period q, that no neighbouring word extends
keeping it. Texts of a batch are laid one after the other as one array of ids, with
an id of its own between any two, and halved: a run that lies in a segment and in
neither half of it crosses the midpoint. At least half of it is on one side, so
with an exponent of 4 or more the right half begins, or the left half ends, with a
square of its period, and the Z-function of that half finds it: z[q] >= q. The square
is extended to both sides as far as the period holds; the same interval
found again is one run, of the smallest period.

Segments are those of the binary numbers: midpoints are the multiples of 4. All
midpoints of a level are looked at together: a Z-function is made only
where the first words of a half come again in the right way (8 comparisons of a
whole level's arrays each), and not for squares in a stretch already known
whose period is no longer, as these give that stretch again. Long segments
come first, so a long periodic stretch is extended once.

Defined results. A null or empty text has no words and no runs. A text is taken
whole, however long. Rows that repeat, and null ids, are rows of their own. An empty table gives
no rows. Columns not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, small_batches
from .resampling import CRC_TABLE_SQL, crc_sql

#: A run is so long at least, and so many periods long.
LEAST, EXPONENT = 6, 4
#: Words that are laid side by side.
WORDS = 1 << 20
#: Comparisons before a Z-function is made, and elements of a level looked at at once.
FIRST, SLAB = 8, 1 << 21


def z_function(x: list[int]) -> list[int]:
    """z[i]: how many items from i on are those of the beginning."""
    n = len(x)
    z, lo, hi = [n] + [0] * (n - 1), 0, 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def same(a: np.ndarray, i: int, j: int) -> int:
    """How many items from i on are those from j on; i < j."""
    k, step = 0, 64
    while j + k < len(a):
        m = min(step, len(a) - j - k)
        other = a[i + k : i + k + m] != a[j + k : j + k + m]
        if other.any():
            return k + int(other.argmax())
        k, step = k + m, min(2 * step, 1 << 16)
    return k


class Runs:
    """Periodic stretches of ids. Ids that part texts come once only, so no stretch crosses them."""

    def __init__(self, ids: np.ndarray, longest: int):
        """longest: words of the longest text."""
        self.n = n = len(ids)
        self.most = longest // EXPONENT
        # Beyond both ends stand ids that come nowhere else, so that comparisons need no bounds.
        pad = np.arange(2 * self.most + FIRST + 8, dtype=np.int64)
        self.ahead = np.concatenate([ids, -2 - 2 * n - pad])
        self.back = np.concatenate([ids[::-1], -2 - 2 * n - pad])
        self.ids = ids
        # Of each word the longest known stretch it is in: where it begins and ends, and its period.
        self.begin, self.end, self.period = np.zeros(n, np.int32), np.zeros(n, np.int32), np.full(n, n + 1, np.int32)
        self.found: dict[tuple[int, int], int] = {}
        half = 4
        while half < n:
            half *= 2
        while half >= 4 and self.most:
            mids = np.arange(half, n, 2 * half)
            reach = min(half // 2, self.most)
            self.level(self.ahead, mids, reach, False)
            self.level(self.back, n - mids, reach, True)
            half //= 2

    def starting(self, a: np.ndarray, mids: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(mid, p), p up to reach, where the first words from mid on come again p later: FIRST words, or p, but two at least."""
        view = np.lib.stride_tricks.sliding_window_view(a, reach + 1)
        rows = max(1, SLAB // (reach + 1))
        ats, ps = [], []
        for lo in range(0, len(mids), rows):
            some = mids[lo : lo + rows]
            w = view[some]
            r, p = np.nonzero(w[:, 1:] == w[:, :1])
            at, p = some[r], p + 1
            for k in range(1, FIRST):
                if not len(at):
                    break
                keep = (k >= np.maximum(p, 2)) | (a[at + k] == a[at + p + k])
                at, p = at[keep], p[keep]
            ats.append(at)
            ps.append(p)
        return (np.concatenate(ats), np.concatenate(ps)) if ats else (mids[:0], mids[:0])

    def new(self, mid: np.ndarray, p: np.ndarray, backwards: bool) -> np.ndarray:
        """Whether the squares of periods p that begin (or, backwards, end) at mid are in no known stretch of a period as short."""
        lo, hi = (mid - 2 * p, mid) if backwards else (mid, mid + 2 * p)
        at = np.clip(mid - 1 if backwards else mid, 0, self.n - 1)
        return ~((self.period[at] <= p) & (self.begin[at] <= lo) & (self.end[at] >= hi))

    def level(self, a: np.ndarray, mids: np.ndarray, reach: int, backwards: bool) -> None:
        at, p = self.starting(a, mids, reach)
        keep = self.new(self.n - at if backwards else at, p, backwards)
        at, p = at[keep], p[keep]
        cuts = np.flatnonzero(np.diff(at, prepend=-1)).tolist() + [len(at)]
        for lo, hi in zip(cuts, cuts[1:]):
            m, ps = int(at[lo]), p[lo:hi]
            mid = np.array(self.n - m if backwards else m)
            z = np.array(z_function(a[m : m + max(4, 2 * int(ps[-1]))].tolist()))
            ps = ps[z[ps] >= np.maximum(ps, 3 - ps)]
            while len(ps := ps[self.new(mid, ps, backwards)]):
                q = int(ps[0])
                begin, end = self.extend(int(mid) - 2 * q if backwards else int(mid), q)
                # Longer squares in this stretch give it again, also where a longer stretch keeps it out of what is known.
                ps = ps[(mid - 2 * ps < begin) if backwards else (mid + 2 * ps > end)]

    def extend(self, at: int, q: int) -> tuple[int, int]:
        """Takes the square of period q at a place as far as the period holds: the stretch's ends."""
        end = at + q + same(self.ahead, at, at + q)
        begin = at - same(self.back, self.n - at - q, self.n - at)
        begin, end = max(begin, 0), min(end, self.n)
        part = slice(begin, end)
        longer = self.end[part] - self.begin[part] < end - begin
        for known, value in ((self.begin, begin), (self.end, end), (self.period, q)):
            known[part][longer] = value
        if end - begin >= max(LEAST, EXPONENT * q):
            self.found[begin, end] = min(q, self.found.get((begin, end), q))
        return begin, end


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start and period."""
    known: dict[bytes, int] = {}
    longest = max(map(len, texts), default=0)
    parts, starts, at = [], [], 0
    for k, words in enumerate(texts):
        starts.append(at)
        parts += [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)), np.array([-2 - k])]
        at += len(words) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if longest < LEAST:
        return out
    found = Runs(np.concatenate(parts), longest).found
    if found:
        rows = np.array([(b, e - b, q) for (b, e), q in found.items()])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        of = np.searchsorted(starts, rows[:, 0], side="right") - 1
        for k, (b, n, q) in zip(of.tolist(), rows.tolist()):
            out[k].append((b - starts[k], n, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [w for w, g in zip(words, gone.tolist()) if not g]


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def find_runs(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str | Column = "text") -> DataFrame:
    """keys, n_words, runs (array of start, length, period, by start and period) and collapsed, the text's words without the repeats of runs."""
    schema = T.StructType([docs.schema[k] for k in keys]).add("n_words", T.LongType()).add("runs", T.ArrayType(RUN)).add("collapsed", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            lo = 0
            while lo < b.num_rows:
                split, n, hi = [], 0, lo
                while hi < b.num_rows and (hi == lo or n < WORDS):
                    split.append((texts[hi].as_py() or "").encode().split())
                    n += len(split[-1])
                    hi += 1
                found = runs_of(split)
                rows = [r for x in found for r in x]
                ends = np.cumsum([0, *map(len, found)])
                spans = pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=RUN.names)
                rest = [b" ".join(collapsed(w, r)).decode() for w, r in zip(split, found)]
                columns = [c.slice(lo, hi - lo) for c in b.columns[:-1]]
                columns += [pa.array(list(map(len, split)), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans), pa.array(rest, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                lo = hi

    text = F.col(text_col) if isinstance(text_col, str) else text_col
    return small_batches(docs).select(*keys, text.alias("__text")).mapInArrow(run, schema)


def made_periodic(id_col: Column, text: Column) -> Column:
    """The text, of every tenth document (by crc32 of its id) with the words from some place on replaced by repeats of the first of them."""
    h = F.crc32(id_col.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i))), " ")).otherwise("")

    # The words are made once: the array of them is the one element of an array that is transformed.
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), repeated), F.lit(0))).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them made periodic first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_runs(docs, ("doc_id",), made_periodic(F.col("doc_id"), F.col("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digests = [F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")]
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), *digests)
    period = -F.col("best.period")
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), period.alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


#: Equal words of a run at distance q follow each other five times at least, so runs are made of equal 5-grams.
OP11_SQL = f"""
WITH crc_table AS MATERIALIZED ({CRC_TABLE_SQL}),
c AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc_table),
e AS (SELECT *, CAST(len(w) AS BIGINT) AS n, h // 10 AS g FROM c),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM e),
d AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM a),
x AS MATERIALIZED (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS x FROM d),
f AS MATERIALIZED (SELECT r, n, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS f FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
m AS (SELECT a.r, a.i, b.i - a.i AS q FROM f AS a JOIN f AS b ON a.r = b.r AND a.f = b.f WHERE b.i > a.i AND 4 * (b.i - a.i) <= a.n),
k AS (SELECT r, i, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM m),
s AS (SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM k GROUP BY r, q, k HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
t AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM s GROUP BY r, start, length),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM t),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (r, i) GROUP BY r),
b AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
             arg_min({{'start': start, 'length': length, 'period': period}}, (-length, start, period)) AS best FROM t GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (r) LEFT JOIN kept USING (r)
"""
