"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one representative of each group.

Vectors equal in every component are one class first, so copies cost nothing.
Spherical k-means is fit on a bounded sample; there is a cell for every PER
vectors, up to CELLS, so that cells keep their size as tables grow. A vector is a member of the
cell of its nearest centroid, and a guest in every other whose centroid is nearer than that less a
margin. Members are compared with all that a cell holds.

Let u be of the cell of centroid a and v of that of b, and no guest of the other's. What u is nearer to a than to b,
and v nearer to b than to a, is together (u - v).(a - b), and so no more than |u - v| |a - b|: with a margin of half of that at the threshold no link can be
missed (exact=True: worth it where vectors lie in tight groups). In many dimensions differences lie across the
centroids as a rule. How far along they spread is told from the data: in proportion to the spread of a sample of the vectors along a - b,
by their second moments, or to that of vectors of any direction, if that is more. The margin of two cells is MARGIN standard deviations of it, never more than the
exact one; so it is the exact one where vectors have few dimensions of their own, in however many they are written. A pair is missed only if neither is a
guest of the other's cell, that is beyond twice MARGIN deviations. Tests ask for 0.99 of all links on vectors of 64 free dimensions, of 3 to 8 in
128 to 512, and of spectra that fall by a power.

Members so near to their centroid that any two of them must link (at half of the link angle) are the
cell's core: they are counted, not compared, so a group of very many near copies costs no
more than its size. Large cells are split into blocks, compared pair by pair, and a task returns
a count and one neighbour for each vector, never the pairs.

Defined results. A vector that is null, empty, zero or holds null or non-finite
components links with nothing, and is its own component. So is a row with a null
vec_id, whose component_id is null; it is kept. Vectors of different lengths do
not link. Rows that repeat count as vectors of their own. An empty table gives an
empty result. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_meetings, block_pairs, bounded_sample, connected_components, discard, map_groups, materialize, small

#: k-means is fit on so many vectors at most.
SAMPLE = 32_768
PER, CELLS = 1024, 4096
MARGIN = 2.0
BLOCK = 2048
ROUNDING = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; first by the largest component, so that nothing overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """k centroids of unit vectors x, from k of them."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds):
        sums = np.zeros_like(centroids)
        for lo in range(0, len(x), 2048):
            chunk = x[lo : lo + 2048]
            np.add.at(sums, (chunk @ centroids.T).argmax(axis=1), chunk)
        length = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        ok = length > 1e-9
        centroids[ok] = sums[ok] / length[ok, None]
    return centroids


def joined_labels(linked: np.ndarray, one: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
    """Smallest row reachable from each of n rows, by links between rows one (down) and other (across)."""
    labels = np.arange(n)
    while True:
        best = labels.copy()
        np.minimum.at(best, one, np.where(linked, labels[other][None, :], n).min(axis=1, initial=n))
        np.minimum.at(best, other, np.where(linked, labels[one][:, None], n).min(axis=0, initial=n))
        best = best[best]
        if (best == labels).all():
            return labels
        labels = best


def link_rows(threshold: float, cells: int):
    """For two blocks of a cell, or one: each row's links between them, and one row it is connected with.

    A member counts all it links with. A guest counts a member only if that is no guest of the cell that the guest is a member of,
    where the pair is met again: so both of a pair count it once, whichever of them was sent to the other.
    """

    def run(table: pa.Table) -> pa.Table | None:
        x = unit(rows_of(table.column("vec")))
        ids, n, side, home, member = (table.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "n", "side", "home", "member"))
        one = np.flatnonzero(side == 0)
        other = np.flatnonzero(side == 1) if side.any() else one
        linked = (x[one] @ x[other].T >= threshold) & (member[one][:, None] | member[other][None, :])
        if other is one:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return None
        sent = table.column("cells").combine_chunks()
        owner = np.repeat(np.arange(len(ids)), np.diff(sent.offsets.to_numpy()))
        known = owner * np.int64(cells) + sent.flatten().to_numpy()  # (member, cell that it is in)
        links = np.zeros(len(ids), np.int64)
        for rows, cols, both in ((one, other, linked), (other, one, linked.T)):
            if cols is rows and both is not linked:
                break  # one block: what is counted down is all
            links[rows] += np.where(member[rows], both @ n[cols], 0)
            guests = np.flatnonzero(~member[rows])
            g, m = np.nonzero(both[guests])
            again = np.isin(cols[m] * np.int64(cells) + home[rows[guests[g]]], known)
            np.add.at(links, rows[guests[g]], np.where(again, 0, n[cols[m]]))
        labels = joined_labels(linked, one, other, len(ids))
        some = np.zeros(len(ids), bool)
        some[one], some[other] = some[one] | linked.any(axis=1), some[other] | linked.any(axis=0)
        return pa.table({"cid": ids[some], "links": links[some], "peer": ids[labels[some]]})

    return run


LINKS = "cid long, links long, peer long"


def moments(sample: np.ndarray) -> np.ndarray:
    """Second moments of unit vectors about their mean, as shares of their sum."""
    x = sample - sample.mean(axis=0)
    m = x.T @ x
    return m / max(1e-12, np.trace(m))


def margins(centroids: np.ndarray, spread: np.ndarray | None, apart: float) -> np.ndarray:
    """For each two cells how much less near a guest of one, of the other, may be; spread: moments(), or None for the exact margin."""
    c = centroids.astype(np.float64)

    def lengths(m: np.ndarray) -> np.ndarray:
        out = m @ c.T * -2
        q = np.einsum("ij,ij->i", m, c)
        out += q[:, None]
        out += q[None, :]
        return np.sqrt(np.maximum(out, 0, out=out), out=out)

    own = lengths(c)
    out = (own * (apart / 2)).astype(np.float32)
    if spread is not None:
        own *= MARGIN * apart / math.sqrt(c.shape[1])
        np.minimum(out, np.maximum(own, lengths(c @ spread) * (MARGIN * apart)), out=out, casting="same_kind")
    return out + np.float32(1e-6)


def assign(vectors: DataFrame, centroids: np.ndarray, spread: np.ndarray | None, apart: float, core: float) -> DataFrame:
    """A row for each vector and cell it is in: home is the cell that it is a member of; members carry all cells they are in.

    core: whether a member's product with its centroid is that or more.
    """
    shipped = vectors.sparkSession.sparkContext.broadcast((centroids, spread))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, spread = shipped.value
        margin = margins(c, spread, apart)
        step = max(1, 2_000_000 // len(c))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                sims = unit(rows_of(part.column(2))) @ c.T
                home = sims.argmax(axis=1)
                best = sims[np.arange(len(home)), home]
                near = sims >= best[:, None] - margin[home]
                at, cell = np.nonzero(near)
                member = home[at] == cell
                offsets = np.concatenate([[0], np.cumsum(near.sum(axis=1))])
                cells = [cell[offsets[a] : offsets[a + 1]] if m else [] for a, m in zip(at, member)]
                for cut in range(0, len(at), 4096):  # a batch of few rows may come to many
                    s = slice(cut, cut + 4096)
                    out = part.take(pa.array(at[s]))
                    cols = [pa.array(cell[s], pa.int32()), pa.array(home[at[s]], pa.int32()), pa.array(member[s]), pa.array(member[s] & (best[at[s]] >= core)), pa.array(cells[s], pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*out.columns, *cols], names=["cid", "n", "vec", "cell", "home", "member", "core", "cells"])

    kind = vectors.schema["vec"].dataType.simpleString()
    return vectors.select("cid", "n", "vec").mapInArrow(run, f"cid long, n long, vec {kind}, cell int, home int, member boolean, core boolean, cells array<int>")


def found_links(vectors: DataFrame, threshold: float, exact: bool) -> list[DataFrame]:
    """Tables cid, links, peer of the links found between classes of one vector length."""
    m = vectors.count()
    if m < 2:
        return []
    sample = unit(rows_of(bounded_sample(vectors, SAMPLE, m, "cid").select("vec").toArrow().column(0)))
    centroids = spherical_kmeans(sample, min(CELLS, max(1, m // PER), len(sample)))
    apart = math.sqrt(2 - 2 * threshold)
    spread = None if exact else moments(sample)
    sent = materialize(assign(vectors, centroids, spread, apart, math.cos(math.acos(threshold) / 2) + ROUNDING), "cells")
    core, others = sent.where("core"), sent.where("NOT core")
    # All of a core link with each other.
    sums = core.groupBy("cell").agg(F.sum("n").alias("all"), F.min("cid").alias("peer"), F.count(F.lit(1)).alias("c")).where("c > 1")  # a row for a cell
    out = [core.join(F.broadcast(sums), "cell").select("cid", (F.col("all") - F.col("n")).alias("links"), "peer")]
    # Members meet each other and the guests; the core meets both. Guests do not meet here.
    members, guests = others.where("member"), others.where("NOT member")
    among = block_pairs(members, "cell", "cid", BLOCK).withColumn("kind", F.lit(0))
    across = block_meetings(core, others, "cell", "cid", BLOCK).withColumn("kind", F.lit(1))
    visits = block_meetings(members, guests, "cell", "cid", 2 * BLOCK).withColumn("kind", F.lit(2))
    groups = among.unionByName(across.select(*among.columns)).unionByName(visits.select(*among.columns))
    out.append(map_groups(groups, ["cell", "kind", "bi", "bj"], link_rows(threshold, len(centroids)), LINKS))
    done = [materialize(t, "links") for t in out]
    discard(sent)
    return done


def near_duplicate_vectors(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of df; see the module's docstring."""
    spark = df.sparkSession
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fit = F.coalesce(finite & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull(), F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), v.alias("vec"), fit.alias("fit"))
    grouped = rows.where("fit").groupBy("vec").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")

    tables = []
    for (d,) in classes.select(F.size("vec").alias("d")).distinct().collect():  # the lengths of vectors, one as a rule
        tables += found_links(classes.where(F.size("vec") == d).select("cid", "n", "vec"), threshold, exact)
    found = spark.createDataFrame([], LINKS)
    for t in tables:
        found = found.unionByName(t)
    found = materialize(found, "found")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("cid").alias("a"), F.col("peer").alias("b")))
    low = parts.join(classes.select(F.col("cid").alias("node"), "low"), "node")
    least = materialize(low.groupBy("component").agg(F.min("low").alias("least")), "least")
    comps = low.join(small(least), "component").select(F.col("node").alias("cid"), "least")
    per_class = materialize(
        classes.join(links, "cid", "left").join(comps, "cid", "left").select("vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "low").alias("component_id")),
        "vector-classes",
    )
    out = rows.where("fit").select("id", "vec").join(per_class, "vec").select("id", "n_links", "component_id")
    out = out.unionByName(rows.where("NOT fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    """All embeddings, links at a cosine of 0.95 or more."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.c, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(c.c, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = e.vec_id
"""
