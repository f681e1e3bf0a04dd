"""Evaluation of verdicts against labels: one pass; one row, or one for each group of several groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_attack, is_correct


def _counts(expected: str, actual: str, llm_used: str, latency: str) -> list[Column]:
    e, a, used, ms = F.col(expected), F.col(actual), F.coalesce(F.col(llm_used), F.lit(False)), F.col(latency)
    labelled = F.coalesce(e, F.lit("")) != ""
    hit, said = is_attack(e), is_attack(a)
    return [
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(labelled), F.lit(False)).alias("has_expected"),
        F.count_if(labelled & hit & said).alias("tp"), F.count_if(labelled & ~hit & ~said).alias("tn"),
        F.count_if(labelled & ~hit & said).alias("fp"), F.count_if(labelled & hit & ~said).alias("fn"),
        F.count_if(is_correct(e, a)).alias("correct_count"), F.count_if(used).alias("llm_used"), F.count_if(~used).alias("llm_skipped"),
        F.coalesce(F.avg(ms), F.lit(0.0)).alias("avg_latency_ms"), F.coalesce(F.avg(F.when(~used, ms)), F.lit(0.0)).alias("avg_latency_without_llm"),
        F.coalesce(F.avg(F.when(used, ms)), F.lit(0.0)).alias("avg_latency_with_llm"),
    ]


def _with_ratios(some: DataFrame) -> DataFrame:
    ratio = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    c = F.col
    out = some.withColumns({
        "accuracy": ratio(c("tp") + c("tn"), c("n")), "precision": ratio(c("tp"), c("tp") + c("fp")), "recall": ratio(c("tp"), c("tp") + c("fn")),
        "llm_used_share": ratio(c("llm_used"), c("n")), "llm_skipped_share": ratio(c("llm_skipped"), c("n")),
    })
    return out.withColumn("f1", ratio(2 * (c("precision") * c("recall")), c("precision") + c("recall")))


def evaluate(df: DataFrame, expected: str = "expected_verdict", actual: str = "actual_verdict", llm_used: str = "llm_used", latency: str = "latency_ms") -> DataFrame:
    """One row: n, has_expected, tp, tn, fp, fn, accuracy (over all rows), precision, recall, f1, correct_count, llm_used,
    llm_skipped, their shares, and mean latencies overall, without and with the judge. Ratios over nothing are 0."""
    return _with_ratios(df.agg(*_counts(expected, actual, llm_used, latency)))


def evaluate_by(df: DataFrame, sets: list[list[str]], expected: str = "expected_verdict", actual: str = "actual_verdict", llm_used: str = "llm_used", latency: str = "latency_ms") -> DataFrame:
    """The evaluation by each set of columns, [] for all rows, in one pass and one exchange.

    A row has its set's columns, null for the others, and grouping_id: a bit for each column in the order in which the sets first name
    them, the first the highest, which is 1 where the row is not grouped by it (so that a null value is told from none). An empty table gives no rows.
    """
    names = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *names)
    return _with_ratios(grouped.agg(F.grouping_id(*names).alias("grouping_id"), *_counts(expected, actual, llm_used, latency)))


def report(row) -> str:
    """The evaluation as text: a line for each number, quality first where there are expectations."""
    share = lambda x: f"{100 * x:.1f} %"
    out = [f"evaluated prompts    {row['n']}"]
    if row["has_expected"]:
        out += [f"{name:<21}{share(row[name])}" for name in ("accuracy", "precision", "recall", "f1")]
        out += [f"{name:<21}{row[k]}" for name, k in (("attacks found", "tp"), ("attacks missed", "fn"), ("harmless let pass", "tn"), ("harmless stopped", "fp"))]
    out += [f"{name:<21}{row[k]} ({share(row[k + '_share'])})" for name, k in (("judged", "llm_used"), ("not judged", "llm_skipped"))]
    out += [f"{name:<21}{row[k]:.0f}" for name, k in (("mean ms", "avg_latency_ms"), ("mean ms, judged", "avg_latency_with_llm"), ("mean ms, not judged", "avg_latency_without_llm"))]
    return "\n".join(out)
