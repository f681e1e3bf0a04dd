"""Operators as stages of a corpus pipeline: documents in, documents out (pieces of sequences from the last).

Every stage works on all rows of its input, takes the columns of documents, further
ones too, whatever their names, and returns the same columns. An empty table passes through empty. Texts of any length are
worked through whole. Rows with a null doc_id, a null text or an empty one stay rows: what becomes of them, of
ties and of repeated rows is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .common import materialize, small
from .jaccard import jaccard_join
from .mixing import mixed_rows
from .packing import pack_documents
from .secret_scan import scan_secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of predicted quality 1. Learns as op10 does, from labelled documents of this stage's input.

    A null text is scored as an empty one, which has a score as any other; a null doc_id is scored, never learnt from.
    Rows that repeat have one score, so all of them stay or go; a score of just 0.5 stays. Without labels of both
    classes the share of label 1 (0.5 without any) decides for all.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, ~quality.held_out(F.col("doc_id"), 3, 1))
    return quality.score_column(docs, model, keep_text=True).where("__predicted = 1").select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id.

    Null and empty texts, and rows with a null doc_id, are of no group and stay. Where a doc_id repeats, rows are told apart by
    their place: of equal rows the first stays. At a similarity of just 0.8 documents are of one group.
    """
    total, ids = docs.agg(F.count("doc_id"), F.countDistinct("doc_id")).head()
    if total == ids:
        dropped = jaccard_join(docs).where("NOT kept").select("doc_id")
        return docs.join(small(materialize(dropped, "dropped")), "doc_id", "left_anti").select(*docs.columns)
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    dropped = jaccard_join(numbered, id_col="__row").where("NOT kept").select("__row")
    return numbered.join(small(materialize(dropped, "dropped")), "__row", "left_anti").select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows.

    No row goes. A null text stays null, and its n_chars as it was; overlapping spans, and those that touch a kept one, become one mark
    where they overlap. Rows that repeat are scanned each, with one result.
    """
    others = tuple(c for c in docs.columns if c != "text")
    found = scan_secrets(docs.withColumnsRenamed({c: f"__k{i}" for i, c in enumerate(others)}), tuple(f"__k{i}" for i in range(len(others))))
    names = {c: F.col(f"__k{i}") for i, c in enumerate(others)} | {"text": F.col("redacted")}
    if "n_chars" in names:
        names["n_chars"] = F.coalesce(F.char_length("redacted").cast(docs.schema["n_chars"].dataType), names["n_chars"])
    return found.select(*[names[c].alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents repeated, or cut, as their sources' targets say.

    Null and empty texts have no words: nothing of them is taken, and they go. A null source is a source of its own. Rows that repeat are drawn as rows
    of their own, ties in the drawing order are broken by row, and reruns agree.
    """
    return mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids: the columns of op2.

    A null text is an empty one, a piece of one id. Rows that repeat are packed each; ties between bins are broken by their age.
    """
    return pack_documents(docs)
