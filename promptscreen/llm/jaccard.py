"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its runs of five words (of all its words, if it has fewer).
Copies (equal sets) are one class, so they are never compared. Representatives get
MinHash signatures, eight bits of each value, and meet in buckets, where a band of their signatures is equal. Pairs that
meet are compared signature part by part; a pair goes as soon as the posterior
probability that its similarity reaches the threshold, given the agreements so far
and a uniform prior, is below TOLERANCE. Of the buckets in which two documents meet the one of the first band
counts the pair, and verifies it exactly on the whole sets, which go to buckets with
surviving pairs only.

With BANDS bands of ROWS values a pair at a similarity of 0.8 fails to meet with a
probability of 3e-6, at 0.85 of 2e-8.

Large groups of near copies. In a bucket of more than BLOCK documents the smallest is a leader, and its set is
compared with those of the rest. Jaccard distance is a metric, so any two documents within half of the link distance of one
leader link: this core is counted, not compared, and in buckets only the others meet it and each other.

Nothing is a list of all pairs: a task compares the rows of one bucket, or of two
blocks of a large one, and returns for each row a count and one row it is
connected with.

Defined results. A null text, or one without words, links with nothing, not even
with its like. Rows that repeat count as documents of their own. A null doc_id
takes no part in links: 0 links, class_id null, kept. An empty table gives an empty
result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_meetings, block_pairs, connected_components, discard, map_groups, materialize, small, small_batches

WORDS = 5
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
TOLERANCE = 1e-9
#: Signature values are compared in parts of so many.
PART = 32
#: Documents of a block, and elements of their sets together, about.
BLOCK, BLOCK_ELEMENTS = 512, 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """A random 64-bit value for each byte, and which bytes are white space."""
    values = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64)
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return values, space


#: Bytes that are hashed at once, and the odd base of the powers.
SLICE = 1 << 18
BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, np.uint64(base))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of a text's words: polynomials of their bytes, taken from running sums, so no word is cut out."""
    b = np.frombuffer(data, np.uint8)
    values, space = tables()
    inside = np.concatenate([[False], ~space[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    out, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):
        # Whole words of about SLICE bytes, one at least.
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE, side="right")))
        lo, n = start[i], end[j - 1] - start[i]
        up, down = powers(SLICE) if n <= SLICE else powers(int(n))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[b[lo : lo + n]] * up[:n], dtype=np.uint64)])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of a text's runs of words."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(h):
        return h
    n = min(words, len(h))
    code = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        code = mix(code * np.uint64(BASE) + h[i : len(h) - n + 1 + i])
    return np.unique(code)


@functools.cache
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(sh: np.ndarray) -> np.ndarray:
    """The least of each hash function over a set, 32 bits each."""
    a, b = multipliers()
    least = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for lo in range(0, len(sh), 512):
        least = np.minimum(least, ((sh[lo : lo + 512, None] * a + b) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return least


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of a signature's low bits, so that two keys are equal where these are."""
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + (sig & np.uint32(255)).reshape(BANDS, ROWS)[:, r].astype(np.uint64))
    return key.astype(np.int64)


@functools.cache
def least_agreements(threshold: float, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each number of values compared (PART, 2 PART, ...) how many must agree, at least, to go on.

    Only eight bits of each value are compared, so two values agree with
    probability s + (1 - s) / 256 at similarity s. The posterior of s, from a uniform
    prior, is summed on a grid.
    """
    grid = np.linspace(0, 1, 20_001)
    p = grid + (1 - grid) / 256
    out = []
    for n in range(PART, HASHES + 1, PART):
        for k in range(n + 1):
            with np.errstate(divide="ignore"):
                log = k * np.log(p) + (n - k) * np.log(np.maximum(1 - p, 1e-300))
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() >= tolerance * weight.sum():
                break
        out.append(k)
    return tuple(out)


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (a, b) of rows of sig that are not pruned."""
    same = np.zeros(len(a), np.int32)
    for part, least in enumerate(least_agreements(threshold)):
        lo = part * PART
        for at in range(0, len(a), 1 << 17):
            s = slice(at, at + (1 << 17))
            same[s] += (sig[a[s], lo : lo + PART] == sig[b[s], lo : lo + PART]).sum(axis=1, dtype=np.int32)
        ok = same >= least
        a, b, same = a[ok], b[ok], same[ok]
        if not len(a):
            break
    return a, b


def pairs_of(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a group's rows that are to meet here: of one block, or one row of each of two."""
    if side.any():
        i, j = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        return np.repeat(i, len(j)), np.tile(j, len(i))
    return np.triu_indices(len(side), 1)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each of n rows by the pairs."""
    labels = np.arange(n)
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def bytes_matrix(column) -> np.ndarray:
    """A column of binary values of equal length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def counted_here(sig: np.ndarray, core: np.ndarray, band: int, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket's rows that survive, meet in no earlier band, and are not of one core."""
    a, b = surviving(sig, *pairs_of(side), threshold)
    new = (core[a] != core[b]) | (core[a] < 0)
    a, b = a[new], b[new]
    first = np.zeros(len(a), np.int64)
    for lo in range(0, len(a), 1 << 16):
        s = slice(lo, lo + (1 << 16))
        first[s] = (sig[a[s]] == sig[b[s]]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
    return a[first == band], b[first == band]


GROUP = ["key", "kind", "bi", "bj"]
TOUCHED = "key long, kind int, bi int, bj int, side int, band int, rep long, n long, core long, sig binary"


def candidates(threshold: float):
    """For a bucket, or two blocks of one: its rows that are of a pair to be verified here."""

    def run(table: pa.Table) -> pa.Table | None:
        sig, side, core = bytes_matrix(table.column("sig")), table.column("side").to_numpy(), table.column("core").to_numpy()
        a, b = counted_here(sig, core, table.column("band")[0].as_py(), side, threshold)
        return table.take(pa.array(np.unique(np.concatenate([a, b])))).select([x.split()[0] for x in TOUCHED.split(", ")]) if len(a) else None

    return run


#: Up to so many pairs of a group are verified one by one; more by products of incidence matrices, of so many cells
#: and from so many elements at once.
SINGLY = 64
CELLS, ELEMENTS = 8 << 20, 2 << 20


def _products(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    codes, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out, step = np.zeros((len(sets), len(sets)), np.float32), max(1, CELLS // len(sets))
    for lo in range(0, len(codes), step):
        s = slice(*np.searchsorted(column, [lo, lo + step]))
        block = np.zeros((len(sets), min(step, len(codes) - lo)), np.float32)
        block[owner[s], column[s] - lo] = 1
        out += block @ block.T
    return out


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a and b, pair by pair."""
    out = np.zeros(len(a), np.int64)
    # Sets are taken in parts of about ELEMENTS elements, a part with each other.
    part = np.cumsum([len(x) for x in sets]) // ELEMENTS
    pair = np.stack([np.minimum(part[a], part[b]), np.maximum(part[a], part[b])])
    for p, q in np.unique(pair, axis=1).T:
        at = np.flatnonzero((pair[0] == p) & (pair[1] == q))
        if len(at) <= SINGLY:
            out[at] = [len(np.intersect1d(sets[a[k]], sets[b[k]], assume_unique=True)) for k in at]
            continue
        used, place = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        out[at] = _products([sets[i] for i in used])[place[: len(at)], place[len(at) :]]
    return out


def similar(size: np.ndarray, a: np.ndarray, b: np.ndarray, both: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs of sets reach the threshold, in whole numbers, so that a similarity of just that counts."""
    top, bottom = round(threshold * 10_000), 10_000
    return bottom * both >= top * (size[a] + size[b] - both)


def sets_in(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]


def verified(threshold: float):
    """For (blocks of) a bucket: each row's links, weighted by copies, and one row it is connected with."""

    def run(table: pa.Table) -> pa.Table | None:
        sig, rep, side, n, core = bytes_matrix(table.column("sig")), *(table.column(c).to_numpy() for c in ("rep", "side", "n", "core"))
        a, b = counted_here(sig, core, table.column("band")[0].as_py(), side, threshold)
        sets = sets_in(table)
        ok = similar(np.array([len(x) for x in sets]), a, b, overlaps(sets, a, b), threshold)
        a, b = a[ok], b[ok]
        if not len(a):
            return None
        links = np.bincount(a, n[b], len(rep)) + np.bincount(b, n[a], len(rep))
        some = np.flatnonzero(links)
        return pa.table({"rep": rep[some], "links": links[some].astype(np.int64), "peer": rep[roots(len(rep), a, b)[some]]})

    return run


def near_leader(distance: float):
    """For a leader (side 0) and documents of its bucket: those within that distance of it."""

    def run(table: pa.Table) -> pa.Table | None:
        sets, side, rep = sets_in(table), table.column("side").to_numpy(), table.column("rep").to_numpy()
        lead, rest = int(np.flatnonzero(side == 0)[0]), np.flatnonzero(side == 1)
        both = np.array([len(np.intersect1d(sets[lead], sets[i], assume_unique=True)) for i in rest], np.int64)
        close = rest[similar(np.array([len(x) for x in sets]), np.full(len(rest), lead), rest, both, 1 - distance)] if len(rest) else rest
        return pa.table({"rep": rep[close], "core": np.full(len(close), rep[lead])}) if len(close) else None

    return run


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest of the set (null without words), its size m, sig (8 bits of each value) and keys of bands of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                digests, sigs, keys, sizes = [], [], [], []
                for t in part.column(1):
                    sh = shingles(t.as_py())
                    sizes.append(len(sh))
                    if not len(sh):
                        digests.append(None), sigs.append(None), keys.append(None)
                        continue
                    s = signature(sh)
                    digests.append(hashlib.blake2b(sh.tobytes(), digest_size=16).digest())
                    sigs.append((s & np.uint32(255)).astype(np.uint8).tobytes())
                    keys.append(bands(s))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "digest", "m", "sig", "keys"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, digest binary, m long, sig binary, keys array<bigint>")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, set of the rows rep, id, digest of wanted, from docs (id, text). An id that several texts have brings them all; the one of that digest is meant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                raw = [shingles(t.as_py()).tobytes() for t in part.column(2)]
                own = [i for i, (x, d) in enumerate(zip(raw, part.column(1))) if hashlib.blake2b(x, digest_size=16).digest() == d.as_py()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own, pa.int64())), pa.array([raw[i] for i in own], pa.binary())], names=["rep", "set"])

    wanted = materialize(wanted.select("rep", "id", "digest"), "wanted")
    found = docs.join(small(wanted), "id").select("rep", "digest", "text").mapInArrow(run, "rep long, set binary")
    sets = materialize(found, "sets")
    # Copies that share an id bring a set twice.
    return sets if sets.count() <= wanted.count() else materialize(sets.dropDuplicates(["rep"]), "sets")


def cores(met: DataFrame, reps: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame | None, DataFrame | None]:
    """rep, core of documents that are so near to the leader of a large bucket that any two of one leader's link, and the sets read for that.

    A document tries the leader of its first large bucket alone.
    """
    sizes = materialize(met.groupBy("key", "band").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("lead")).where(F.col("c") > BLOCK), "large")
    if not sizes.count():
        return None, None
    own = met.join(small(sizes.select("key", "lead")), "key").groupBy("rep").agg(F.min_by("lead", "band").alias("lead"))
    own = materialize(own.join(reps.select("rep", "id", "digest", "m"), "rep"), "led")
    leaders = own.select(F.col("lead").alias("rep")).distinct()
    sets = sets_of(texts, own)
    rest = own.where("rep <> lead").select("lead", "rep", "m").join(sets, "rep")
    first = leaders.join(sets, "rep").select(F.col("rep").alias("lead"), "rep", F.octet_length("set").cast("long").alias("m"), "set")
    tried = block_meetings(first.select("lead", "rep", "m", "set"), rest.select("lead", "rep", "m", "set"), "lead", "rep", BLOCK, "m", BLOCK_ELEMENTS)
    near = materialize(map_groups(tried, ["lead", "bi", "bj"], near_leader((1 - threshold) / 2), "rep long, core long"), "core")
    # A leader that follows another is of that one's core, or of none.
    followers = near.join(leaders.withColumnRenamed("rep", "core"), "core")
    alone = leaders.join(near, "rep", "left_anti").select("rep", F.col("rep").alias("core")).join(near.select("core").distinct(), "core").select("rep", "core")
    return materialize(followers.select("rep", "core").unionByName(alone), "cores"), sets


def jaccard_join(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links, kept for each row of docs.

    class_id is the smallest id that links reach, itself included; n_links the number
    of other documents, copies too, at threshold or more; kept says id = class_id.
    """
    sketch = materialize(sketches(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sketches")
    known = sketch.where("id IS NOT NULL AND digest IS NOT NULL")
    # Of copies the row of the smallest id stands for all.
    first = F.min(F.struct("id", "row"))
    copies = materialize(known.groupBy("digest").agg(first.alias("f"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", F.col("f.row").alias("first"), "copies"), "copies")
    reps = known.join(small(copies), "digest", "left").where("first IS NULL OR first = row")
    reps = materialize(reps.select(F.col("row").alias("rep"), F.coalesce("copies", F.lit(1)).alias("n"), "id", "digest", "m", "sig", "keys"), "reps")

    # Buckets with company; only their rows carry a signature.
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    rows = reps.select("rep", F.posexplode("keys").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    met = materialize(rows.join(shared, "key").join(reps.select("rep", "n", "m", "sig"), "rep"), "met")
    core, sets = cores(met, reps, texts, threshold)
    found = []
    if core is None:
        groups = block_pairs(met.withColumn("core", F.lit(-1).cast("long")), "key", "rep", BLOCK, "m", BLOCK_ELEMENTS).withColumn("kind", F.lit(0))
    else:
        met = materialize(met.join(core, "rep", "left").withColumn("core", F.coalesce("core", F.lit(-1).cast("long"))), "met")
        # All of a core link with each other.
        counted = core.join(reps.select("rep", "n"), "rep")
        sums = counted.groupBy("core").agg(F.sum("n").alias("all"))
        found.append(counted.join(small(sums), "core").select("rep", (F.col("all") - F.col("n")).alias("links"), F.col("core").alias("peer")))
        # In each bucket its largest core meets the others, and these each other.
        main = met.where("core >= 0").groupBy("key", "core").count().groupBy("key").agg(F.max_by("core", "count").alias("main"))
        parts = met.join(small(materialize(main, "main")), "key", "left").withColumn("mine", F.coalesce(F.col("core") == F.col("main"), F.lit(False))).drop("main")
        ours, others = parts.where("mine").drop("mine"), parts.where("NOT mine").drop("mine")
        among = block_pairs(others, "key", "rep", BLOCK, "m", BLOCK_ELEMENTS).withColumn("kind", F.lit(0))
        across = block_meetings(ours, others, "key", "rep", BLOCK, "m", BLOCK_ELEMENTS).withColumn("kind", F.lit(1))
        groups = among.unionByName(across.select(*among.columns))
    touched = materialize(map_groups(groups, GROUP, candidates(threshold), TOUCHED), "touched")

    # Texts of candidates alone.
    wanted = touched.select("rep").distinct()
    if sets is not None:
        more = sets_of(texts, wanted.join(sets.select("rep"), "rep", "left_anti").join(reps.select("rep", "id", "digest"), "rep"))
        sets = sets.unionByName(more)
    else:
        sets = sets_of(texts, wanted.join(reps.select("rep", "id", "digest"), "rep"))
    found.append(map_groups(touched.join(sets, "rep"), GROUP, verified(threshold), "rep long, links long, peer long"))
    found = materialize(functools.reduce(DataFrame.unionByName, found), "verified")
    discard(met, touched, sets)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("peer").alias("b")), "links").select(F.col("node").alias("rep"), "component")
    linked = parts.join(reps.select("rep", "id", "digest"), "rep").join(links, "rep", "left")
    least = materialize(linked.groupBy("component").agg(F.min("id").alias("class_id")), "least")
    linked = linked.join(small(least), "component").select("digest", "class_id", F.coalesce("links", F.lit(0)).alias("links"))

    # A class of copies without links is all there is to say of most copies.
    alone = copies.join(reps.select(F.col("rep").alias("first"), "id"), "first").select("digest", "copies", "id")
    per_class = alone.join(linked, "digest", "full").select(
        "digest", F.coalesce("class_id", "id").alias("class_id"), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    per_class = materialize(per_class, "jaccard-classes")
    discard(reps, copies, found)
    per_class = small(per_class)
    ids = sketch.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    out = ids.join(per_class, "digest", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.select(F.col("id").alias(id_col), "class_id", "n_links", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    """All documents, runs of five words, similarity of 0.8 or more."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM w WHERE len(w) > 0),
k AS (SELECT s, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM g) GROUP BY s),
t AS (SELECT doc_id, unnest(s) AS t, len(s) AS m FROM k),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.m) AS ma, any_value(b.m) AS mb FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i WHERE 5 * c >= 4 * (ma + mb - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT l.a, sum(k.n) AS n FROM l JOIN k ON k.doc_id = l.b GROUP BY l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a),
o AS (SELECT g.doc_id, k.n - 1 + coalesce(n.n, 0) AS links, least(k.doc_id, coalesce(c.c, k.doc_id)) AS class_id
  FROM g JOIN k ON k.s = list_sort(g.s) LEFT JOIN n ON n.a = k.doc_id LEFT JOIN c ON c.a = k.doc_id)
SELECT d.doc_id, coalesce(o.class_id, d.doc_id) AS class_id, CAST(coalesce(o.links, 0) AS BIGINT) AS n_links, d.doc_id = coalesce(o.class_id, d.doc_id) AS kept
FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id
"""
