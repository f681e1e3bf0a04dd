"""What the corpus operators share: tables in the cluster's shared folder, words, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: A side may be broadcast up to so many rows and so many bytes of their values; both are counted first.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir; it goes when the driver ends.

    Where that is unset a local session (tests) gets one of our own; a cluster, whose executors share no local folder, an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = tempfile.mkdtemp(prefix="promptscreen-")
            atexit.register(shutil.rmtree, base, True)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    path = f"{base}/promptscreen-{sc.applicationId}"
    if path not in _ours:
        _ours.add(path)
        atexit.register(_delete, spark, path)
    return path


_ours: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours, on whatever store it is; does nothing if the session has ended."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    try:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the driver is ending, or the table has gone already
        return


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of materialize() that nothing to come reads: what was made of them has been written."""
    for t in tables:
        if t is not None and (path := getattr(t, "stored", None)):
            _delete(t.sparkSession, path)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Rows and bytes of an Arrow batch of texts. Spark's own limits let a Python worker hold several times 64 MB.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session gets smaller Arrow batches, where these settings are still Spark's own."""
    conf = df.sparkSession.conf
    for key, (default, value) in BATCH.items():
        if conf.get(key, None) == default:
            conf.set(key, value)
    return df


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    This cuts the lineage with files that outlive any executor, and gives the
    planner true sizes, so that it broadcasts a small table by itself.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored = path
    return out


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_sample(df: DataFrame, rows: int, total: int, *keys: str) -> DataFrame:
    """About rows of df's total rows, never more, by a hash of keys.

    A row decides by itself, so no task sends more than its share to the driver.
    """
    if total <= rows:
        return df.limit(rows)
    part = F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < int((1 << 40) * 0.95 * rows / total)
    return df.where(part).limit(rows)


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its counted rows and bytes are few, else df as it is, to be joined by shuffle."""

    def width(f) -> Column:
        kind, c = f.dataType.typeName(), F.col(f.name)
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
        return F.greatest(F.size(c), F.lit(0)).cast("long") * 16 if kind == "array" else F.lit(8).cast("long")

    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum((width(f) for f in df.schema), F.lit(0).cast("long"))), F.lit(0))).head()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


#: A node of HUB edges and of one in HUBS of all edges is a hub: so there are no more than HUBS hubs, and their table may be broadcast,
#: and what any other node brings to one task is no more than that share.
HUB, HUBS = 100, 100_000


def with_least(e: DataFrame, least: Column) -> DataFrame:
    """Rows u, v of e with m, the least of each u's rows. A hub's rows stay where they are and get theirs by broadcast; no task gathers them."""
    most = max(HUB, e.count() // HUBS)
    low = e.groupBy("u").agg(least.alias("m"), F.count(F.lit(1)).alias("__c"))
    hubs = materialize(low.where(F.col("__c") > most).select("u", F.col("m").alias("__m")), "hubs")
    met = e.join(F.broadcast(hubs), "u", "left")
    few = met.where("__m IS NULL").drop("__m").join(low.where(F.col("__c") <= most).select("u", "m"), "u")
    return few.select("u", "v", "m").union(met.where("__m IS NOT NULL").select("u", "v", F.col("__m").alias("m")))


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Smallest node reachable from each node.

    edges: columns a, b (long), in any direction, repeated edges allowed; loops are ignored.
    Returns node, component, for nodes with an edge. Alternating large-star and
    small-star steps; each round halves paths, and goes through a table in the
    shared folder, so lineage stays short and a lost executor costs one round.
    No row of a hub is gathered: minima are partial in each task, and hubs get theirs by broadcast.
    """
    spark = edges.sparkSession
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    while True:
        # Large star: every larger neighbour of x is linked to the smallest of x's neighbourhood.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, F.least(F.min("v"), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every smaller neighbour, and the node itself, is linked to the smallest.
        large = materialize(large, label)
        joined = with_least(large, F.min("v"))
        star = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).distinct()
        nxt = materialize(star, label)
        # A forest of stars: nobody has two parents, and no parent has a parent.
        chained = nxt.select("v").distinct().join(nxt.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        twice = 0 if chained else nxt.groupBy("u").count().where("count > 1").limit(1).count()
        discard(e, large)
        e = nxt
        if not chained and not twice:
            break
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def map_groups(df: DataFrame, keys: list[str], fn, schema: str, partitions: int | None = None) -> DataFrame:
    """fn(arrow table of one group) -> arrow table or None, over groups of a bounded size.

    Rows are dealt by keys and sorted, and groups are cut from the stream of
    batches, so thousands of small groups cost little; a task holds one batch and
    one group. The caller splits groups that could be large. partitions: a fixed
    number of tasks, for groups that take long for their size.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: list[pa.Table] = []
        last = None

        def done():
            out = fn(pa.concat_tables(held).combine_chunks())
            held.clear()
            return out.to_batches() if out is not None and out.num_rows else []

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            columns = [table.column(k).to_numpy() for k in keys]
            change = np.zeros(table.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), table.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(c[lo] for c in columns)
                if key != last and held:
                    yield from done()
                last = key
                held.append(table.slice(lo, hi - lo))
        if held:
            yield from done()

    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)


def every_block(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(count) - 1))


def own_block(row_id: str, count: str) -> Column:
    return F.pmod(F.xxhash64(row_id), F.col(count)).cast("int")


def blocks_of(df: DataFrame, key: str, limit: int, weight: str | None = None, most: int = 1) -> Column:
    """Number of blocks of a key's rows: about limit rows in each, and about most of the sum of weight."""
    by_rows = F.ceil(F.count(F.lit(1)) / F.lit(limit))
    return (by_rows if weight is None else F.greatest(by_rows, F.ceil(F.sum(weight) / F.lit(most)))).cast("int")


def block_pairs(df: DataFrame, key: str, row_id: str, limit: int, weight: str | None = None, most: int = 1) -> DataFrame:
    """Deals the rows of each key to pairs of blocks, so that any two rows of a key meet in exactly one group (key, bi, bj).

    Adds bi, bj (bi <= bj) and side: 0 for the rows of block bi, 1 for those of bj
    (all 0 if bi = bj). A key of up to limit rows, and most of weight, is one block; a larger one has
    blocks of about that, and each row goes to as many groups as there are
    blocks. Keys of one row are left out.
    """
    counts = materialize(df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), blocks_of(df, key, limit, weight, most).alias("__nb")).where("__n > 1"), "blocks")
    dealt = df.join(counts, key).withColumn("__b", own_block(row_id, "__nb"))
    one = dealt.where("__nb = 1").withColumns({"bi": F.lit(0), "bj": F.lit(0), "side": F.lit(0)})
    many = (
        dealt.where("__nb > 1")
        .withColumn("__o", every_block("__nb"))
        .withColumns({"bi": F.least("__b", "__o"), "bj": F.greatest("__b", "__o"), "side": (F.col("__b") > F.col("__o")).cast("int")})
    )
    return one.unionByName(many.drop("__o")).drop("__n", "__nb", "__b")


def block_meetings(left: DataFrame, right: DataFrame, key: str, row_id: str, limit: int, weight: str | None = None, most: int = 1) -> DataFrame:
    """Deals the rows of each key, of left (side 0) and right (side 1), to pairs of blocks (key, bi, bj), in which every row of one
    meets every row of the other once. Keys that only one of them has are left out."""
    sizes = lambda df, name: df.groupBy(key).agg(blocks_of(df, key, limit, weight, most).alias(name))
    both = materialize(sizes(left, "__a").join(sizes(right, "__b"), key), "blocks")
    one = left.join(both, key).withColumn("bi", own_block(row_id, "__a")).withColumn("bj", every_block("__b")).withColumn("side", F.lit(0))
    other = right.join(both, key).withColumn("bj", own_block(row_id, "__b")).withColumn("bi", every_block("__a")).withColumn("side", F.lit(1))
    return one.unionByName(other).drop("__a", "__b")
