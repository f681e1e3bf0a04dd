"""Mixing sources to target weights.

Capped water-filling: a source's share of the budget is proportional to its
weight, but no source goes beyond a number of epochs; what a clamped source
leaves is shared out again by weight until no source is above its cap. Documents
are then drawn with whole repetitions for all, and a seeded fractional one.

Defined results. A null text has size 0 and takes 0. A null source is a source
of its own, after all others. Sources of size 0 get target 0. Rows that repeat
are drawn as rows of their own. An empty table gives an empty result. Columns
other than those named are kept and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Documents of a source are dealt by hash into so many buckets; only one of them is ever sorted.
BUCKETS = 4096


def ranked(sources: DataFrame, name: str) -> DataFrame:
    """Adds __rank, from 0, by code point, null last, without gathering the rows in one task.

    Range partitions are counted (a number each), so a row's rank is its place in
    its own partition plus the rows of the partitions before.
    """
    spark = sources.sparkSession
    parts = materialize(
        sources.repartitionByRange(F.col(name).asc_nulls_last())
        .sortWithinPartitions(F.col(name).asc_nulls_last())
        .withColumn("__id", F.monotonically_increasing_id()),
        "sources",
    )
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = dict(parts.groupBy(part.alias("p")).count().collect())  # one number for each shuffle partition
    before, start = [], 0
    for p in sorted(counts):
        before.append((int(p), start))
        start += counts[p]
    offsets = spark.createDataFrame(before, "__p long, __before long")
    return parts.withColumn("__p", part).join(offsets, "__p").withColumn("__rank", F.col("__before") + place).drop("__id", "__p", "__before")


def fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """sources: source, source_size, weight. Adds target.

    Only a level is carried between rounds: a source takes weight x level, or its
    cap if that is less. A clamped source stays clamped, since the level only rises.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size")).head()[0] or 0
    budget, level, clamped = share * total, None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= cap
        n, held, free = sources.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight").cast("double")))).head()
        if n == clamped or not free:
            break
        clamped, level = n, (budget - (held or 0.0)) / free
    level = 0.0 if level is None else level
    above = F.col("weight") * F.lit(level) >= cap
    return sources.withColumn("target", F.when(above, cap).otherwise(F.col("weight") * F.lit(level)))


def draw_key(id_col: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))


def mix_sources(
    docs: DataFrame,
    size: Column,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """docs with __size, __source_size, __target and __taken.

    Sources by code point, null last, weigh weights, repeating; together they take
    share of all sizes. In each source the order by a seeded hash says which
    documents the fractional repetition takes; the one that it ends in is taken in
    part, so a source's taken size is its target, rounded.

    The order is never made for a whole source: sizes are summed by hash bucket
    first, and only the documents of the bucket in which the repetition ends are
    sorted, one in BUCKETS of a source.
    """
    key = draw_key(F.col(id_col), seed)
    sized = docs.withColumns({"__size": size, "__key": key, "__bucket": F.conv(F.substring(key, 1, 3), 16, 10).cast("int")})
    sums = materialize(sized.groupBy(F.col(source_col).alias("__source"), "__bucket").agg(F.sum("__size").alias("__sum")), "mix-sums")
    sources = ranked(sums.groupBy("__source").agg(F.sum("__sum").alias("source_size")), "__source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    targets = fill(sources.withColumn("weight", weight), share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("__whole", whole.cast("long"))
    targets = targets.withColumn("__rest", F.round("target").cast("long") - F.col("__whole") * F.col("source_size"))
    so_far = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        sums.withColumn("__before", F.coalesce(F.sum("__sum").over(so_far), F.lit(0)))
        .withColumnRenamed("__source", "__s")
        .join(targets.select("__source", "__rest"), F.col("__s").eqNullSafe(F.col("__source")))
        .where("__before <= __rest AND __rest < __before + __sum")
        .select(F.col("__s"), F.col("__bucket").alias("__end"), (F.col("__rest") - F.col("__before")).alias("__left"))
    )
    plan = materialize(
        targets.join(ends, F.col("__source").eqNullSafe(F.col("__s")), "left").select("__source", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "__whole", "__end", "__left"),
        "mix-plan",
    )
    joined = sized.join(plan, F.col(source_col).eqNullSafe(F.col("__source")))
    ending = F.col("__bucket") == F.col("__end")
    clear = joined.where(~F.coalesce(ending, F.lit(False))).withColumn("__part", F.when(F.col("__bucket") < F.col("__end"), F.col("__size")).otherwise(0))
    order = Window.partitionBy(source_col).orderBy("__key", F.col(id_col).asc_nulls_last(), "__size").rowsBetween(Window.unboundedPreceding, -1)
    cut = joined.where(ending).withColumn("__part", F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__left") - F.coalesce(F.sum("__size").over(order), F.lit(0)))))
    out = clear.unionByName(cut).withColumn("__taken", F.col("__whole") * F.col("__size") + F.col("__part"))
    return out.drop("__key", "__bucket", "__source", "__whole", "__end", "__left", "__part")


def mixed_rows(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: every document once for each whole repetition, and what is taken of a further one as its first words.

    A document of size 0 has nothing to take and goes. Columns stay those of docs;
    n_chars, where there is one, follows the text.
    """
    from .common import WORD, word_count

    names = docs.columns
    mixed = mix_sources(docs, word_count(F.col(text_col)), **options).where("__taken > 0")
    times = F.sequence(F.lit(0), ((F.col("__taken") - 1) / F.col("__size")).cast("int"))
    each = mixed.withColumn("__k", F.explode(times)).withColumn("__n", F.least(F.col("__size"), F.col("__taken") - F.col("__k") * F.col("__size")))
    first = F.concat_ws(" ", F.slice(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)), F.lit(1), F.col("__n").cast("int")))
    each = each.withColumn("__text", F.when(F.col("__n") == F.col("__size"), F.col(text_col)).otherwise(first))
    columns = [F.col("__text").alias(c) if c == text_col else F.char_length("__text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in names]
    return each.select(*columns)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, sources weighing 5, 2, 1, 150 % of all words, at most 2 epochs."""
    from .common import word_count

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix_sources(materialize(docs, "sizes"), F.col("size"))
    return mixed.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
b AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS br, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM w),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY br, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(weight) OVER (ORDER BY br, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM b),
l AS (SELECT arg_min((budget - held) / free, br) FILTER (WHERE (budget - held) / free < br) AS level FROM c),
t AS (SELECT source, source_size, CASE WHEN weight * coalesce(level, 0) >= cap THEN cap ELSE weight * level END AS target FROM b, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, CAST(round(target) AS BIGINT) - whole * source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM r
"""
