"""Exact top-k inner products by dual-tree search over cover trees.

One cover tree over a bounded sample gives pivots; every row goes to the cell of its
nearest pivot, and a cell knows its covering radius. A query meets one block of the
cell whose centre has the highest product with it first; its kth score then is its
bar, and of all other cells only those come into question whose bound (the product
with the centre plus what the covering radius allows) reaches the bar: the rest are
skipped whole. Large cells are split into blocks, and so are many queries of a cell.

Within a block, queries and rows are indexed by cover trees, and both are walked
together. A pair of nodes is pruned if the most that any query of the one could get
from any row of the other is below the worst kth score of the query group. Bars are
those of earlier cells, and each group of queries first takes the leaf that promises
most, so that pairs go high up in the trees.

Equal vectors have equal products, so of the rows with one vector only the k + 1
of the smallest ids are searched (a query may be one of them), and equal queries are
searched once. That loses nothing.

Components are floor(scale * x), so scores are whole numbers and exact: in
doubles while every product stays below 2**53, else in 64-bit integers.

Defined results. Vectors that are null, or hold null or non-finite components, and
rows with a null id, take no part. Only vectors of equal length are compared.
Rows that repeat are candidates of their own; a query's own row never is. Ties go
to the smaller id. Fewer candidates than k give fewer rows; an empty table none.
Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, discard, map_groups, materialize
from .vectors import rows_of

#: Rows of a block, and queries that meet it in one group, about.
BLOCK, QUERIES = 8192, 16_384
#: Pivots are taken from so many rows at most, and there are so many of them at most.
SAMPLE, PIVOTS = 16_384, 2048
LEAF, FAN = 32, 24
LEAST = np.iinfo(np.int64).min


class CoverTree:
    """A batch-built cover tree: the centres of a node's children lie within its radius and are apart by more than half of it.

    They are taken one after another, each the row farthest from those before, the first the node's own, until no row is
    farther than that; at most FAN of them, so that a node costs FAN passes over its rows even where nothing clusters.
    Rows go to the nearest. The rows below a node are order[lo:hi], and its radius is what covers them.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.most = points, leaf
        self.order = np.arange(len(points))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.span: list[tuple[int, int]] = []
        if len(points):
            self._grow()
        self.centres = points[self.centre] if self.centre else points[:0]
        self.radii = np.array(self.radius)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.centres, self.centres))
        self.leaf = np.array([not c for c in self.children], dtype=bool)

    def _node(self, lo: int, hi: int, centre: int, radius: float) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.children.append([])
        self.span.append((lo, hi))
        return len(self.centre) - 1

    def _grow(self) -> None:
        """Nodes from the root down, without recursion, so depth is no limit."""

        def distances(rows: np.ndarray, centre: int) -> np.ndarray:
            diff = self.points[rows] - self.points[centre]
            return np.sqrt(np.einsum("ij,ij->i", diff, diff))

        away = distances(self.order, 0)  # of each place's row from the centre of its node
        todo = [self._node(0, len(self.order), 0, float(away.max()))]
        while todo:
            node = todo.pop()
            (lo, hi), wide = self.span[node], self.radius[node]
            if hi - lo <= self.most or wide == 0:
                continue
            rows, near = self.order[lo:hi].copy(), away[lo:hi].copy()
            owner, centres = np.zeros(len(rows), np.int64), [self.centre[node]]
            while len(centres) < FAN and near[far := int(near.argmax())] > wide / 2:
                d = distances(rows, int(rows[far]))
                closer = d < near
                owner[closer], near[closer] = len(centres), d[closer]
                centres.append(int(rows[far]))
            by = np.argsort(owner, kind="stable")
            self.order[lo:hi], away[lo:hi] = rows[by], near[by]
            ends = lo + np.cumsum(np.bincount(owner, minlength=len(centres)))
            for start, end, centre in zip([lo, *ends[:-1].tolist()], ends.tolist(), centres):
                if end > start:
                    child = self._node(start, end, centre, float(away[start:end].max()))
                    self.children[node].append(child)
                    todo.append(child)

    def rows(self, node: int) -> np.ndarray:
        return self.order[slice(*self.span[node])]

    def cut(self, most: int) -> np.ndarray:
        """Centres of a cut through the tree, of about so many nodes, the widest split first."""
        import heapq

        heap = [(-self.radius[0], 0)]
        while len(heap) < most and heap[0][0] < 0 and self.children[heap[0][1]]:
            for c in self.children[heapq.heappop(heap)[1]]:
                # A leaf is split no further.
                heapq.heappush(heap, (-self.radius[c] if self.children[c] else 0.0, c))
        return self.centres[[n for _, n in heap]]


class DualSearch:
    """Best k rows of a data tree for each point of a query tree. bars: scores below which a query needs no row."""

    def __init__(self, queries: np.ndarray, data: np.ndarray, d_id: np.ndarray, d_uid: np.ndarray, k: int, bars: np.ndarray | None = None, tree: CoverTree | None = None):
        self.k, self.d_id, self.d_uid = k, d_id, d_uid
        small = max(1.0, np.abs(queries).max(initial=0)) * max(1.0, np.abs(data).max(initial=0)) * max(1, queries.shape[1]) < 2**52
        self.exact = (queries.astype(np.float64), data.astype(np.float64)) if small else (queries, data)
        self.q, self.d = CoverTree(queries.astype(np.float64)), tree or CoverTree(data.astype(np.float64))
        self.scores = np.full((len(queries), k), LEAST, np.int64)
        self.at = np.full((len(queries), k), -1, np.int64)  # rows of data
        self.bars = np.full(len(queries), -np.inf) if bars is None else bars.astype(np.float64)
        self.worst = self.bars.copy()  # kth score so far
        self.rank = np.empty(len(data), np.int64)  # of rows by id, for ties
        self.rank[np.lexsort((d_uid, d_id))] = np.arange(len(data))
        self.pruned = self.products = 0

    def bounds(self, node: int, cand: np.ndarray) -> np.ndarray:
        q, d = self.q, self.d
        most = d.centres[cand] @ q.centres[node] + q.norms[node] * d.radii[cand] + q.radius[node] * (d.norms[cand] + d.radii[cand])
        return most + np.abs(most) * 1e-9 + 1e-6  # rounding

    def bar(self, node: int) -> float:
        """The worst kth score of the queries below a node."""
        return float(self.worst[self.q.rows(node)].min())

    def seed(self) -> dict[int, tuple[int, int]]:
        """Each query leaf takes the rows of the least data node of k rows or more that it comes to by going where the bound is highest."""
        seen, sizes = {}, np.array([hi - lo for lo, hi in self.d.span])
        for node in np.flatnonzero(self.q.leaf).tolist():
            at = 0
            while len(below := np.array([c for c in self.d.children[at] if sizes[c] >= self.k], np.int64)):
                at = int(below[self.bounds(node, below).argmax()])
            if self.bounds(node, np.array([at]))[0] >= self.bar(node):
                self.take(self.q.rows(node), self.d.rows(at))
                seen[node] = self.d.span[at]
        return seen

    def run(self) -> None:
        if not len(self.q.points) or not len(self.d.points):
            return
        seen = self.seed()
        todo = [(0, np.zeros(1, np.int64))]
        while todo:
            node, cand = todo.pop()
            cand = self.open(node, cand)
            # Data nodes wider than the query node are split before it is.
            while len(split := cand[~self.d.leaf[cand] & (self.d.radii[cand] >= (0 if self.q.leaf[node] else self.q.radius[node]))]):
                below = np.concatenate([self.d.children[c] for c in split])
                cand = np.concatenate([cand[~np.isin(cand, split)], self.open(node, below)])
            if self.q.leaf[node]:
                lo, hi = seen.get(node, (0, 0))
                self.base(node, np.array([c for c in cand.tolist() if not lo <= self.d.span[c][0] < hi], np.int64))
            elif len(cand):
                todo += [(c, cand) for c in self.q.children[node]]

    def open(self, node: int, cand: np.ndarray) -> np.ndarray:
        """Those of the data nodes that could better the worst kth score of the query node's group."""
        kept = cand[self.bounds(node, cand) >= self.bar(node)]
        self.pruned += len(cand) - len(kept)
        return kept

    def base(self, node: int, leaves: np.ndarray) -> None:
        """Leaves by falling bound, in growing batches; the bar rises between them."""
        if not len(leaves):
            return
        rows, d = self.q.rows(node), self.d
        # Of a leaf's queries each has a bound of its own, without the leaf's radius.
        each = self.q.points[rows] @ d.centres[leaves].T + np.sqrt(np.einsum("ij,ij->i", self.q.points[rows], self.q.points[rows]))[:, None] * d.radii[leaves][None, :]
        each += np.abs(each) * 1e-9 + 1e-6
        some = (each >= self.worst[rows][:, None]).any(axis=0)
        self.pruned += len(leaves) - int(some.sum())
        leaves, bounds = leaves[some], each[:, some].max(axis=0, initial=-np.inf)
        order = np.argsort(-bounds, kind="stable")
        leaves, bounds = leaves[order], bounds[order]
        sizes = np.cumsum([self.d.span[x][1] - self.d.span[x][0] for x in leaves])
        at, want = 0, max(64, 4 * self.k)
        while at < len(leaves) and bounds[at] >= self.bar(node):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + want)))
            end = min(end, int(np.searchsorted(-bounds, -self.bar(node), side="right")))
            self.take(rows, np.concatenate([self.d.rows(x) for x in leaves[at:end]]))
            at, want = end, want * 4
        self.pruned += len(leaves) - at

    def take(self, rows: np.ndarray, found: np.ndarray) -> None:
        q, d = self.exact
        self.products += len(rows) * len(found)
        s = (q[rows] @ d[found].T).astype(np.int64)
        some = (s >= self.worst[rows][:, None]).any(axis=0)
        if not some.any():
            return
        s, found = s[:, some], found[some]
        s = np.concatenate([self.scores[rows], s], axis=1)
        i = np.concatenate([self.at[rows], np.broadcast_to(found, (len(rows), len(found)))], axis=1)
        top = np.lexsort((self.rank[i], np.invert(s)), axis=1)[:, : self.k]  # invert: falling, without overflow
        self.scores[rows], self.at[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        last = self.scores[rows][:, -1]
        self.worst[rows] = np.maximum(self.bars[rows], np.where(last == LEAST, -np.inf, last.astype(np.float64)))

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, data row and score of what was found, at the bars or above."""
        ok = (self.scores > LEAST) & (self.scores >= self.bars[:, None])
        return np.nonzero(ok)[0], self.at[ok], self.scores[ok]


def search_group(k: int):
    def run(table: pa.Table) -> pa.Table | None:
        x = rows_of(table.column("vec"))
        uid, vid, ask = (table.column(c).to_numpy() for c in ("uid", "vid", "ask"))
        bar = table.column("bar").to_numpy().astype(np.float64)
        q, d = ask == 1, ask == 0
        if not q.any() or not d.any():
            return None
        bars = np.where(bar[q] == LEAST, -np.inf, bar[q])
        search = DualSearch(x[q], x[d], vid[d], uid[d], k, bars)
        search.run()
        at, row, score = search.results()
        return pa.table({"qid": uid[q][at], "uid": uid[d][row], "vec_id": vid[d][row], "score": score})

    return run


FOUND = "qid long, uid long, vec_id long, score long"


def nearest_cell(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows with the cell of their nearest pivot, and the distance to it."""
    shipped = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shipped.value
        square = np.einsum("ij,ij->i", c, c)
        step = max(1, 2_000_000 // len(c))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                x = rows_of(part.column(part.num_columns - 1)).astype(np.float64)
                cell = (square[None, :] - 2 * (x @ c.T)).argmin(axis=1)
                diff = x - c[cell]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(np.sqrt(np.einsum("ij,ij->i", diff, diff)))], names=[*part.schema.names, "cell", "away"])

    return rows.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, cell int, away double")


def sent(queries: DataFrame, pivots: np.ndarray, cells: np.ndarray, radii: np.ndarray, blocks: np.ndarray, first: bool) -> DataFrame:
    """qid, bar, vec, cell, blk: the blocks that each query is to meet.

    First: one block of the cell whose centre has the highest product. Then: all blocks of cells whose bound reaches
    the bar, but for that one.
    """
    shipped = queries.sparkSession.sparkContext.broadcast((pivots[cells], cells, radii, blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, names, wide, count = shipped.value
        step = max(1, 1_000_000 // len(c))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                qid, bar = part.column(0).to_numpy(), part.column(1).to_numpy().astype(np.float64)
                x = rows_of(part.column(2)).astype(np.float64)
                products = x @ c.T
                best = products.argmax(axis=1)
                own = qid % count[best]
                if first:
                    at, cell, blk = np.arange(len(x)), best, own
                else:
                    most = products + np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] * wide[None, :]
                    most += np.abs(most) * 1e-9 + 1e-6
                    at, cell = np.nonzero((most >= bar[:, None]) | (bar[:, None] == LEAST))
                    many = count[cell]
                    at, cell = np.repeat(at, many), np.repeat(cell, many)
                    blk = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                    other = (cell != best[at]) | (blk != own[at])
                    at, cell, blk = at[other], cell[other], blk[other]
                for cut in range(0, len(at), 4096):  # a batch of few rows may come to many
                    s = slice(cut, cut + 4096)
                    out = part.take(pa.array(at[s]))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(names[cell[s]], pa.int32()), pa.array(blk[s], pa.int32())], names=["qid", "bar", "vec", "cell", "blk"])

    return queries.select("qid", "bar", "vec").mapInArrow(run, "qid long, bar long, vec array<bigint>, cell int, blk int")


def search(data: DataFrame, asks: DataFrame, k: int, block: int) -> DataFrame:
    """Rows FOUND that hold the best k rows of each query, for vectors of one length. data: uid, vid, vec; asks: qid, vec."""
    spark = data.sparkSession
    n = data.count()
    sample = rows_of(bounded_sample(data, SAMPLE, n, "uid").select("vec").toArrow().column(0)).astype(np.float64)
    pivots = CoverTree(sample).cut(min(PIVOTS, max(1, 2 * n // block)))
    celled = materialize(nearest_cell(data.select("uid", "vid", "vec"), pivots), "cells")
    stats = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).orderBy("cell").collect()  # a row for a pivot
    cells, radii = np.array([r.cell for r in stats]), np.array([r.r for r in stats])
    blocks = np.array([-(-r.n // block) for r in stats])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def met(queries: DataFrame, first: bool) -> DataFrame:
        to = materialize(sent(queries, pivots, cells, radii, blocks, first), "sent")
        asked = {r.cell: r.n for r in to.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for a pivot
        sizes = [(int(c), int(b), -(-asked.get(int(c), 0) // (QUERIES * int(b)))) for c, b in zip(cells, blocks)]
        size = F.broadcast(spark.createDataFrame(sizes, "cell int, nb int, ns int"))
        # A cell that no query is sent to has no groups, and its rows stay where they are.
        rows = celled.join(size, "cell").where("ns > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("ns") - 1)))
        rows = rows.select("cell", F.pmod("uid", F.col("nb")).cast("int").alias("blk"), "salt", "uid", "vid", F.lit(LEAST).alias("bar"), "vec", F.lit(0).alias("ask"))
        own = to.join(size, "cell").select("cell", "blk", F.pmod(F.xxhash64("qid"), F.col("ns")).cast("int").alias("salt"), F.col("qid").alias("uid"), F.lit(None).cast("long").alias("vid"), "bar", "vec", F.lit(1).alias("ask"))
        return materialize(map_groups(rows.unionByName(own.withColumn("vid", F.lit(0).cast("long"))), ["cell", "blk", "salt"], search_group(k), FOUND, parts), "found")

    some = met(asks.withColumn("bar", F.lit(LEAST)), True)
    # The bar of a query: its kth score so far, if it has as many.
    place = Window.partitionBy("qid").orderBy(F.desc("score"))
    bars = some.withColumn("r", F.row_number().over(place)).where(F.col("r") == k).select("qid", F.col("score").alias("reached"))
    raised = asks.join(bars, "qid", "left").select("qid", F.coalesce("reached", F.lit(LEAST)).alias("bar"), "vec")
    return some.unionByName(met(materialize(raised, "bars"), False))


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest integer inner products with each query row."""
    v, spark = F.col(vector_col), df.sparkSession
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.col(id_col).isNotNull()
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    rows = df.where(fit).select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("vid"), whole.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = materialize(rows.where(F.size("vec") > 0).withColumns({"dim": F.size("vec"), "h": F.xxhash64("vec")}), "quantized")
    # Of each vector the rows of the k + 1 smallest ids; tasks send no more than that of one.
    least = Window.partitionBy("h", "vec").orderBy("vid", "uid")
    data = materialize(rows.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1).select("dim", "uid", "vid", "vec"), "rows")
    asks = materialize(rows.where("query").groupBy("h", "vec").agg(F.min("uid").alias("qid"), F.min("dim").alias("dim")), "queries")
    found = None
    for (dim,) in asks.select("dim").distinct().collect():  # the lengths of vectors, one as a rule
        one = search(data.where(F.col("dim") == dim), asks.where(F.col("dim") == dim), k + 1, block)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "uid")
    found = materialize(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"), "best")
    discard(data)
    own = rows.where("query").select("h", "vec", F.col("uid").alias("me"), F.col("vid").alias("query_id"))
    mine = own.join(asks.select("h", "vec", "qid"), ["h", "vec"]).select("me", "query_id", "qid").join(found, "qid").where("uid <> me")
    place = Window.partitionBy("me").orderBy(F.desc("score"), "vec_id", "uid")
    return mine.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 best of all other embeddings for each whose vec_id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS uid, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.uid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.uid <> c.uid AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
