"""Sketches of an evaluation that are kept and merged: quantiles of latencies and numbers of distinct payloads.

A day's sketches are two binary columns of bounded size for each group; those of many days are merged without
reading the rows again. Quantiles are by KLL, at its default size: the share of values up to an estimate is off by 1.3 % at
most 99 times in 100, by RANK_ERROR hardly ever. Distinct numbers are by HLL, with a relative standard error of about 1.04 / 2 ** (LOG_K / 2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_K = 12
#: Six and five standard errors.
RANK_ERROR, DISTINCT_ERROR = 0.03, 5 * 1.04 / 2 ** (LOG_K / 2)


def sketched(df: DataFrame, by: list[str], value: Column, item: Column) -> DataFrame:
    """by, rows, values (KLL of value), items (HLL of item) of each group. Nulls are in neither sketch."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.kll_sketch_agg_double(value.cast("double")).alias("values"), F.hll_sketch_agg(item, LOG_K).alias("items"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups, from those of finer ones alone."""
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.kll_merge_agg_double("values").alias("values"), F.hll_union_agg("items").alias("items"))


def estimates(sketches: DataFrame, by: list[str], shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """by, rows, quantiles (one for each share) and distinct."""
    some = F.kll_sketch_get_n_double("values") > 0
    quantiles = F.when(some, F.kll_sketch_get_quantile_double("values", F.array(*[F.lit(float(s)) for s in shares])))
    return sketches.select(*by, "rows", quantiles.alias("quantiles"), F.hll_sketch_estimate("items").alias("distinct"))
