"""Sources of prompts and sinks of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_correct
from ..operators.gate import audit_rows


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompts of a CSV file with a header: prompt, expected_verdict, and what else it has, as text.

    Empty cells of these two are '': an empty prompt is a prompt. Cells that a short row lacks count as empty.
    """
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', emptyValue="")
    if not df.columns or df.isEmpty():
        raise ValueError("no rows in the CSV file")
    if "prompt" not in df.columns:
        raise ValueError("the CSV file needs a column named prompt")
    expected = F.coalesce(F.col("expected_verdict"), F.lit("")) if "expected_verdict" in df.columns else F.lit("")
    return df.withColumns({"prompt": F.coalesce("prompt", F.lit("")), "expected_verdict": expected})


def nonblank(df: DataFrame, col: str) -> DataFrame:
    """Rows whose prompt has anything but white space; a null is blank."""
    return df.where(F.coalesce(F.col(col).rlike(r"(?U)\S"), F.lit(False)))


def single_prompt(spark: SparkSession, prompt: str) -> DataFrame:
    """One prompt as a table; a blank one is an error."""
    if not (prompt or "").strip():
        raise ValueError("the prompt is blank")
    return spark.createDataFrame([(prompt,)], "prompt string")


def results(analyzed: DataFrame, latency_ms=None) -> DataFrame:
    """Rows of a batch as they are reported."""
    return analyzed.select(
        "prompt", "expected_verdict", F.col("verdict").alias("actual_verdict"), "risk_score", "confidence", "llm_used",
        (F.lit(None).cast("double") if latency_ms is None else latency_ms).alias("latency_ms"), is_correct(F.col("expected_verdict"), F.col("verdict")).alias("correct"),
    )


def write_results(rows: DataFrame, path: str, with_correct: bool | None = None) -> None:
    """Results as CSV; correct only where some row has an expectation."""
    if with_correct is None:
        with_correct = not rows.where(F.coalesce("expected_verdict", F.lit("")) != "").limit(1).isEmpty()
    shown = rows.withColumn("llm_used", F.when(F.col("llm_used"), "YES").otherwise("NO")).withColumn("latency_ms", F.bround("latency_ms").cast("long"))
    (shown if with_correct else shown.drop("correct")).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_audit(decided: DataFrame, path: str, text_col: str = "text", snippets: str = "mask") -> None:
    """Appends an audit record a row, as JSON lines."""
    audit_rows(decided, text_col, snippets).write.mode("append").option("ignoreNullFields", "false").json(path)
